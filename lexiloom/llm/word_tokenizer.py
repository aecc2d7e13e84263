"""Token ids of whole texts under a word-level BPE vocabulary file.

White space separates words and is dropped, so ids of a text are the ids of its words in order;
each distinct word is encoded once and kept in a bounded memory, which is looked up for all words of a
batch at once. Words of plain letters, digits and marks below U+0250 in composed form go through
the matrix engine; all others (combining marks, control characters, other scripts), and texts in
which a special token can stand, through the ``tokenizers`` library.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import regex

from . import bpe_engine
from .words import HashTable, Words, span_hashes, spread

_ODD = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_HIGH = re.compile("[^\x21-ɏ]|[\x7f-\xa0]")
#: Fixed: the splitting pattern of the vocabulary's pre-tokenizer.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words and pieces whose ids are remembered.
MEMORY = 1_000_000
#: As many may stay between tasks: a worker outlives its task, and other stages need its memory.
IDLE = 100_000


class WordBpe:
    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.engine = bpe_engine.from_json(path)
        self.wide = self.library.get_vocab_size() > 65536
        self.dtype = "<u4" if self.wide else "<u2"
        self.memory = memory
        self._forget()

    def _forget(self) -> None:
        """Remembered ids stand one after another in ``store``; the table has each word's place * 2^16 + number."""
        self.table, self.store, self.used = HashTable(), np.zeros(1 << 16, self.dtype), 0

    def rest(self) -> None:
        """At the end of a task: little stays remembered."""
        if self.table.n > IDLE:
            self._forget()

    def _remember(self, hashes: np.ndarray, ids: list[bytes]) -> np.ndarray:
        """Entries of new words."""
        data = np.frombuffer(b"".join(ids), self.dtype)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.store.itemsize
        while self.used + len(data) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[self.used : self.used + len(data)] = data
        entry = ((self.used + np.cumsum(size) - size) << 16) + size
        self.used += len(data)
        self.table.add(hashes, entry)
        return entry

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)

    def _fresh(self, found: list[bytes]) -> list[bytes]:
        """Ids of words in ASCII lower case that aren't remembered."""
        words = [w.decode() for w in found]
        out: dict[str, bytes] = {}
        for w in words:
            if _HIGH.search(w) or not (w.isascii() or unicodedata.is_normalized("NFC", w)):
                out[w] = self._library(w).tobytes()
        plain = [w for w in words if w not in out] if out else words
        low = "\n".join(plain).lower().split("\n") if plain else []  # no plain letter changes the number of lines
        # a word of letters alone, or one with a mark behind, is the usual case
        cut = [[x] if x.isalpha() else [x[:-1], x[-1]] if x[-1] in ",." and x[:-1].isalpha() else PIECES.findall(x) for x in low]
        ids = self._pieces(list(dict.fromkeys([p for v in cut for p in v])))
        out.update((w, ids[v[0]] if len(v) == 1 else b"".join([ids[p] for p in v])) for w, v in zip(plain, cut, strict=True))
        return [out[w] for w in words]

    def _pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Pieces are remembered like words: a word of one piece is that piece."""
        raw = [p.encode() for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        hashes = span_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size)
        entry = self.table.find(hashes)
        new = np.flatnonzero(entry < 0)
        ids = dict(zip([pieces[i] for i in new], self.engine.encode([raw[i] for i in new], self.dtype), strict=True))
        short = new[np.fromiter((len(ids[pieces[i]]) < 1 << 16 for i in new), bool, len(new))]
        self._remember(hashes[short], [ids[pieces[i]] for i in short])
        store = self.store
        for i in np.flatnonzero(entry >= 0).tolist():
            at, n = divmod(int(entry[i]), 1 << 16)
            ids[pieces[i]] = store[at : at + n].tobytes()
        return ids

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if self.table.n > self.memory:
            self._forget()
        special = [i for i, t in enumerate(texts) if "<|" in t]
        plain = [self._spaced(t) for t in texts] if not special else ["" if "<|" in t else self._spaced(t) for t in texts]
        words = Words([t.encode("utf-8") for t in plain])
        entry = self.table.find(words.hash)
        new = np.flatnonzero(entry < 0)
        long: dict[int, np.ndarray] = {}
        if len(new):
            _, first, back = np.unique(words.hash[new], return_index=True, return_inverse=True)
            own = self._fresh(words.bytes_of(new[first]))
            hashes = words.hash[new[first]]
            known = self.table.find(hashes)  # remembered as a piece meanwhile
            size = np.fromiter(map(len, own), np.int64, len(own)) // self.store.itemsize
            add = np.flatnonzero((known < 0) & (size < 1 << 16))
            known[add] = self._remember(hashes[add], [own[i] for i in add])
            entry[new] = known[back]
            long = {int(new[i]): np.frombuffer(own[b], self.dtype) for i, b in enumerate(back.tolist()) if known[b] < 0}
            entry[entry < 0] = 0
        at, size = entry >> 16, entry & 0xFFFF
        ids = self.store[spread(at, size)]
        ends = np.concatenate([[0], np.cumsum(size)])[words.first]
        out = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for i in {int(np.searchsorted(words.first, w, "right")) - 1 for w in long}:  # words of very many ids
            a, b = words.first[i], words.first[i + 1]
            out[i] = np.concatenate([long.get(k, self.store[at[k] : at[k] + size[k]]) for k in range(a, b)])
        for i in special:
            out[i] = self._library(texts[i])
        return out

    @staticmethod
    def _spaced(text: str) -> str:
        """The text with nothing but ASCII blanks between its words."""
        if _ODD.search(text):
            return " ".join(_SPACE.split(text))
        return text if text.isascii() or not _WIDE.search(text) else " ".join(text.split())


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One tokenizer for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]
