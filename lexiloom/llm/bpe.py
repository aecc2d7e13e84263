"""Byte-level BPE encoding and decoding of whole texts.

A text is cut at the matches of the splitting pattern, each distinct piece is encoded once by the
matrix engine (``bpe_engine``), and the ids of a text are joined from a bounded memory of pieces.
Before a single space or newline between two visible characters the pattern always starts a new
match, so the memory can hold whole words instead of pieces.

Edge cases: null and empty texts give no ids and decode to empty bytes; repeated rows are encoded
each; a null id stays null; an empty table gives no rows; further columns are not read.
The step is a map without any shuffle, so a hot source or group of copies costs nothing extra.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from . import bpe_engine
from .common import cuts, lean, texts

_OTHER_SPACE = re.compile(r"[^\S \n]")
#: Parts kept in a worker's memory, and their characters and ids in bytes; it is emptied when full.
MEMORY, MEMORY_BYTES = 400_000, 48 << 20


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str, memory: int = MEMORY):
        self.engine, self.table = bpe_engine.from_ranks(path)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.memory, self.held = memory, 0

    def split(self, text: str) -> tuple[list[str], bool]:
        """Parts of a text that no match crosses, and whether they are matches already: texts with wide or
        double blanks are cut by the pattern at once."""
        if not text:
            return [], False
        words = text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")
        if "\0" in text or " " in words or "\n" in words or _OTHER_SPACE.search(text):
            return self.find(text), True
        return words, False

    def cut(self, part: str) -> list[str]:
        """The matches of the pattern; plain words need no search."""
        if not part:
            return []
        if part[0] == " ":
            if part[1:].isalpha():
                return [part]
            if part[-1] in ",." and part[1:-1].isalpha():
                return [part[:-1], part[-1]]
        return self.find(part)

    def encode_batch(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in batch]
        parts, known = [p for p, _ in split], self.known
        if len(known) > self.memory or self.held > MEMORY_BYTES:
            known.clear()
            self.held = 0
        whole = set().union(*[p for p, matches in split if matches])
        cut = {w: [w] for w in whole if w not in known}
        cut.update((w, self.cut(w)) for w in set().union(*[p for p, matches in split if not matches]) if w not in known and w not in cut)
        if cut:
            fresh = list({x for v in cut.values() for x in v if x not in known})
            known.update(zip(fresh, self.engine.encode([x.encode("utf-8", "replace") for x in fresh]), strict=True))
            for w, v in cut.items():
                if len(v) != 1 or v[0] != w:
                    known[w] = b"".join([known[x] for x in v])
            self.held += sum(4 * len(w) + 2 * len(known[w]) for w in cut)
        get = known.__getitem__
        return [np.frombuffer(b"".join(map(get, p)), "<u4") for p in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))


_LOADED: dict[tuple, ByteBpe] = {}


def loaded(path: str, pattern: str) -> ByteBpe:
    """One encoder for each worker process."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe(path, pattern)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, batch: int = 200) -> DataFrame:
    """Per row: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for,
    ``ids`` (binary, little-endian unsigned 32-bit)."""

    def run(frames):
        bpe = loaded(path, pattern)
        for pdf in frames:
            values = pdf["text"].tolist()
            for lo, hi in cuts(values, batch):
                part = pdf.iloc[lo:hi]
                ids = bpe.encode_batch(values[lo:hi])
                out = pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].array,
                        "n_tokens": [len(x) for x in ids],
                        "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                        "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids],
                    }
                )
                if with_ids:
                    out["ids"] = [x.tobytes() for x in ids]
                yield out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return texts(docs).mapInPandas(lean(run), schema)
