"""Packing by concatenation and cut.

First pass: every partition tokenizes its documents (each followed by the end id) and notes, for
each, how many ids of the partition come before it; the table goes to the shared folder. The
totals of the partitions, one number each, give by prefix sums where each partition begins in
the one long sequence of ids. Second pass: the sequence is cut into windows of fixed length; a
document that crosses a border yields a record on either side. Only the last window can be
short, and there is no shuffle.

Edge cases: null and empty texts are one end id; repeated rows, ids included, are packed each;
a null id stays null; an empty table gives no rows; further columns are not read. Long texts
simply cross many windows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import word_tokenizer
from .common import cuts, lean, stored, texts


def token_table(docs: DataFrame, path: str, end_id: int = 1, batch: int = 500) -> DataFrame:
    """``doc_id``, ``part``, ``before`` (ids of the partition before the document's),
    ``n_tokens`` and ``ids`` (binary, two bytes an id if the vocabulary allows)."""

    def run(frames):
        bpe, part, before = word_tokenizer.loaded(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], bpe.dtype).tobytes()
        for pdf in frames:
            values = pdf["text"].tolist()
            for lo, hi in cuts(values, batch):
                rows = pdf.iloc[lo:hi]
                ids = [x.tobytes() + end for x in bpe.encode_batch(values[lo:hi])]
                n = np.fromiter(map(len, ids), np.int64, len(ids)) // len(end)
                at = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pd.DataFrame({"doc_id": rows["doc_id"].array, "part": part, "before": at, "n_tokens": n, "width": len(end), "ids": ids})
        bpe.rest()

    return texts(docs).mapInPandas(lean(run), "doc_id long, part long, before long, n_tokens long, width int, ids binary")


def pack(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` (ids of its document before it), ``length``,
    ``doc_tokens``, ``sequence_id``, ``offset``, ``continues`` (the document goes on in the next
    sequence) and ``ids`` (little-endian unsigned 32-bit)."""
    table = stored(token_table(docs, path, end_id))
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    begin, at = {}, 0
    for row in totals:
        begin[row["part"]] = at
        at += row["n"]

    def run(frames):
        for pdf in frames:
            out = {k: [] for k in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "continues", "ids")}
            for doc, part, before, n, width, ids in zip(pdf["doc_id"].array, pdf["part"], pdf["before"], pdf["n_tokens"], pdf["width"], pdf["ids"], strict=True):
                data = np.frombuffer(ids, f"<u{width}").astype("<u4")
                first, start = begin[part] + before, 0
                while start < n:
                    seq, offset = divmod(first + start, length)
                    size = min(length - offset, n - start)
                    for k, v in (("doc_id", doc), ("start", start), ("length", size), ("doc_tokens", n), ("sequence_id", seq), ("offset", offset), ("continues", start + size < n), ("ids", data[start : start + size].tobytes())):
                        out[k].append(v)
                    start += size
            yield pd.DataFrame(out).astype({"doc_id": "Int64"})

    return table.mapInPandas(lean(run), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, continues boolean, ids binary")
