"""Token matrices for training: best-fit-decreasing packing, written as binary rows.

Each task tokenizes its documents, splits those longer than a sequence into pieces without loss,
and packs the pieces of about ``shard_tokens`` ids at a time: pieces in falling length, each into
the fullest open sequence that still holds it. A segment tree over the free capacities finds that
sequence in logarithmic time. A row holds a padded line of the id matrix, the cumulative segment
lengths and the positions, which restart at 0 with each segment. There is no shuffle, and a task
holds one shard at most.

Edge cases: null and empty texts are one end id; repeated rows are packed each; a null id stays
null in ``doc_ids``; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import word_tokenizer
from .common import cuts, lean, texts


class CapacityTree:
    """Which free capacities 0..most have open sequences, with search for the least that fits."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, capacity: int, bin_id: int) -> None:
        self.bins[capacity].append(bin_id)
        node = capacity + self.leaves
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The open sequence of least sufficient capacity: (capacity, id)."""
        node = need + self.leaves
        while not self.any[node]:
            while node & 1:  # up until there is a right sibling
                node >>= 1
            if node == 0:
                return None
            node += 1
            if node & (node - 1) == 0:  # past the last leaf of this level
                return None
        while node < self.leaves:
            node = 2 * node + (not self.any[2 * node])
        capacity = node - self.leaves
        bin_id = self.bins[capacity].pop()
        if not self.bins[capacity]:
            self.any[node] = 0
            node >>= 1
            while node and not (self.any[2 * node] or self.any[2 * node + 1]):
                self.any[node] = 0
                node >>= 1
        return capacity, bin_id


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Items of each sequence, by best fit in falling size; ties keep their order."""
    tree, bins = CapacityTree(length), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[i])
        if found is None:
            found = (length, len(bins))
            bins.append([])
        capacity, b = found
        bins[b].append(i)
        if capacity > sizes[i]:
            tree.put(capacity - sizes[i], b)
    return bins


def matrices(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, pad_id: int = 0, shard_tokens: int = 1 << 22, batch: int = 500) -> DataFrame:
    """One row per sequence: ``part``, ``shard``, ``row``, ``n_tokens``, ``ids`` (``length``
    unsigned 32-bit ids, padded), ``cu_seqlens``, ``position_ids`` (as ``ids``), and of each
    segment ``doc_ids`` and ``starts`` (ids of its document before it)."""

    def pack(part, shard, pieces):
        rows = []
        for r, items in enumerate(best_fit([len(p[2]) for p in pieces], length)):
            sizes = [len(pieces[i][2]) for i in items]
            cu = np.concatenate([[0], np.cumsum(sizes)])
            ids, pos = np.full(length, pad_id, "<u4"), np.zeros(length, "<u4")
            ids[: cu[-1]] = np.concatenate([pieces[i][2] for i in items])
            pos[: cu[-1]] = np.arange(cu[-1]) - np.repeat(cu[:-1], sizes)
            rows.append((part, shard, r, int(cu[-1]), ids.tobytes(), cu.astype(np.int32), pos.tobytes(), [pieces[i][0] for i in items], [pieces[i][1] for i in items]))
        return pd.DataFrame(rows, columns=["part", "shard", "row", "n_tokens", "ids", "cu_seqlens", "position_ids", "doc_ids", "starts"])

    def run(frames):
        bpe, part, shard, held, pieces = word_tokenizer.loaded(path), TaskContext.get().partitionId(), 0, 0, []
        for pdf in frames:
            values = pdf["text"].tolist()
            for lo, hi in cuts(values, batch):
                for doc, ids in zip(pdf["doc_id"].array[lo:hi], bpe.encode_batch(values[lo:hi]), strict=True):
                    ids = np.append(ids, np.array([end_id], bpe.dtype))
                    doc = None if pd.isna(doc) else int(doc)
                    pieces += [(doc, s, ids[s : s + length]) for s in range(0, len(ids), length)]
                    held += len(ids)
                if held >= shard_tokens:
                    yield pack(part, shard, pieces)
                    shard, held, pieces = shard + 1, 0, []
        if pieces:
            yield pack(part, shard, pieces)

    return texts(docs).mapInPandas(
        lean(run), "part int, shard int, row int, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<long>"
    )


def write(docs: DataFrame, target: str, path: str, **options) -> None:
    """Write the packed matrices as Parquet; every file is self-contained."""
    matrices(docs, path, **options).write.mode("overwrite").option("compression", "zstd").parquet(target)
