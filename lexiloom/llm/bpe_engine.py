"""Byte-pair merges for many pieces at once, on padded numpy matrices.

Pieces are grouped by length. In each round every row merges its leftmost pair of minimum rank;
the two pairs beside it are looked up again in a hashed pair table, the row closes up, and rows
without a mergeable pair leave the matrix. Pieces longer than ``WIDE`` symbols would make rounds
too wide and take a heap instead, with the same result.
"""

from __future__ import annotations

import base64
import heapq
import json

import numpy as np

NONE = np.int32(2**31 - 1)
WIDE = 192


class PairTable:
    """(left id, right id) -> (rank, merged id) in levels of directly addressed slots.

    A key whose slot on one level is taken goes to the next; slots that passed keys on are
    flagged, so a miss stops at the first unflagged slot.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.levels = []
        mult = 0x9E3779B97F4A7C15
        while len(keys):
            bits = max(8, int(np.ceil(np.log2(len(keys) * 4))))
            shift, factor = np.uint64(64 - bits), np.uint64(mult | 1)
            slot = (keys * factor) >> shift
            _, first = np.unique(slot, return_index=True)
            table = np.full(1 << bits, np.uint64(2**64 - 1))
            ranks, ids = np.full(1 << bits, NONE), np.zeros(1 << bits, np.int32)
            passed = np.zeros(1 << bits, bool)
            table[slot[first]], ranks[slot[first]], ids[slot[first]] = keys[first], rank[first], merged[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            passed[slot[rest]] = True
            self.levels.append((factor, shift, table, ranks, ids, passed))
            keys, rank, merged = keys[rest], rank[rest], merged[rest]
            mult = (mult * 0xD1342543DE82EF95 + 1) % 2**64

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (``NONE`` if there is no such pair) and merged ids; negative ids never match."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        out_rank, out_id = np.full(keys.shape, NONE), np.zeros(keys.shape, np.int32)
        todo = None
        for factor, shift, table, ranks, ids, passed in self.levels:
            k = keys if todo is None else keys[todo]
            slot = (k * factor) >> shift
            hit = table[slot] == k
            if todo is None:
                out_rank[hit], out_id[hit] = ranks[slot[hit]], ids[slot[hit]]
                todo = np.flatnonzero((~hit & passed[slot]).ravel())
                keys, out_rank, out_id = keys.ravel(), out_rank.ravel(), out_id.ravel()
            else:
                at = todo[hit]
                out_rank[at], out_id[at] = ranks[slot[hit]], ids[slot[hit]]
                todo = todo[~hit & passed[slot]]
            if not len(todo):
                break
        return out_rank.reshape(left.shape), out_id.reshape(left.shape)


class BpeEngine:
    """``start``: id of each byte inside a piece; ``last``: id of each byte at its end."""

    def __init__(self, pairs: PairTable, start: np.ndarray, last: np.ndarray):
        self.pairs, self.start, self.last = pairs, start.astype(np.int32), last.astype(np.int32)
        a, b = np.repeat(np.arange(256), 256), np.tile(np.arange(256), 256)
        self.inner = self._pair(self.start[a], self.start[b])
        self.final = self._pair(self.start[a], self.last[b])

    def encode(self, pieces: list[bytes], dtype: str = "<u4") -> list[bytes]:
        """The ids of each piece, as bytes of little-endian ``dtype``."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(sizes, kind="stable")
        lo = int(np.searchsorted(sizes[order], 1))
        while lo < len(order):
            width = int(sizes[order[lo]])
            if width > WIDE:
                for i in order[lo:]:
                    out[i] = self._heap(pieces[i]).astype(dtype).tobytes()
                break
            width = width if width <= 12 else min(WIDE, -(-width // 8) * 8)
            hi = min(int(np.searchsorted(sizes[order], width, "right")), lo + max(1, 4_000_000 // width))
            self._bucket(pieces, order[lo:hi], sizes, width, out, dtype)
            lo = hi
        return out

    def _bucket(self, pieces, rows, sizes, width, out, dtype) -> None:
        size = sizes[rows]
        data = np.frombuffer(b"".join([pieces[i] for i in rows]), np.uint8)
        mask = np.arange(width) < size[:, None]
        m = np.full((len(rows), width), -1, np.int32)
        m[mask] = self.start[data]
        ends = np.cumsum(size) - 1
        m[np.arange(len(rows)), size - 1] = self.last[data[ends]]
        which = np.arange(len(rows))
        rank, merged = np.full((len(rows), width - 1), NONE), np.zeros((len(rows), width - 1), np.int32)
        if width > 1:
            pair = data[:-1].astype(np.int32) * 256 + data[1:]
            inside = np.ones(len(pair), bool)
            inside[ends[:-1]] = False
            pair, mask = pair[inside], mask[:, 1:]
            rank[mask], merged[mask] = self.inner[0][pair], self.inner[1][pair]
            two = np.flatnonzero(size > 1)
            pair = data[ends[two] - 1].astype(np.int32) * 256 + data[ends[two]]
            rank[two, size[two] - 2], merged[two, size[two] - 2] = self.final[0][pair], self.final[1][pair]
        while len(m):
            if width > 1:
                at = rank.argmin(axis=1)
                ids = np.arange(len(m))
                going = rank[ids, at] != NONE
            else:
                going = np.zeros(len(m), bool)
            if not going.all():
                done = ~going
                left = m[done]
                left = left.astype(dtype)
                step = width * left.itemsize
                stop = (m[done] >= 0).sum(axis=1) * left.itemsize
                data = left.tobytes()
                for r, n, at0 in zip(rows[which[done]].tolist(), stop.tolist(), range(0, len(data), step), strict=True):
                    out[r] = data[at0 : at0 + n]
                m, rank, merged, which = m[going], rank[going], merged[going], which[going]
                if not len(m):
                    break
                at = at[going]
                ids = np.arange(len(m))
            m[ids, at] = merged[ids, at]
            cols = np.arange(width - 1)
            take = cols + (cols > at[:, None])
            m = np.take_along_axis(m, take, axis=1)
            width -= 1
            if width == 1:
                rank, merged = np.zeros((len(m), 0), np.int32), np.zeros((len(m), 0), np.int32)
                continue
            # the pair (at, at+1) is gone: close up, then renew the pairs beside the merged id
            cols = np.arange(width - 1)
            take = cols + (cols >= at[:, None])
            rank, merged = np.take_along_axis(rank, take, axis=1), np.take_along_axis(merged, take, axis=1)
            for j in (at - 1, at):
                ok = (j >= 0) & (j < width - 1)
                r, c = ids[ok], j[ok]
                rank[r, c], merged[r, c] = self._pair(m[r, c], m[r, c + 1])
            keep = int((m >= 0).any(axis=0).sum())
            if keep < width:
                width = max(1, keep)
                m, rank, merged = m[:, :width], rank[:, : width - 1], merged[:, : width - 1]

    def _pair(self, a, b):
        rank, merged = self.pairs.find(a, b)
        rank[(a < 0) | (b < 0)] = NONE
        return rank, merged

    def _heap(self, piece: bytes) -> np.ndarray:
        """One very long piece: a heap of pairs over a doubly linked list."""
        sym = self.start[np.frombuffer(piece, np.uint8)]
        sym[-1] = self.last[piece[-1]]
        rank, merged = self._pair(sym[:-1], sym[1:])
        sym = sym.tolist()
        n = len(sym)
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, sym[i], sym[i + 1], g) for i, (r, g) in enumerate(zip(rank.tolist(), merged.tolist(), strict=True)) if r != NONE]
        heapq.heapify(heap)
        memo: dict[tuple[int, int], tuple[int, int]] = {}

        def push(i):
            j = nxt[i]
            if i < 0 or j < 0:
                return
            key = (sym[i], sym[j])
            if key not in memo:
                r, g = self._pair(np.array([key[0]], np.int32), np.array([key[1]], np.int32))
                memo[key] = (int(r[0]), int(g[0]))
            r, g = memo[key]
            if r != NONE:
                heapq.heappush(heap, (r, i, *key, g))

        while heap:
            _, i, a, b, g = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = g, -1
            nxt[i] = nxt[j]
            if nxt[i] >= 0:
                prev[nxt[i]] = i
            if prev[i] >= 0:
                push(prev[i])
            push(i)
        return np.array([s for s in sym if s >= 0], np.int32)


def from_ranks(path: str) -> tuple[BpeEngine, list[bytes]]:
    """Engine of a rank file (``base64 rank`` lines) and the bytes of each id."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                a, b = line.split()
                ranks[base64.b64decode(a)] = int(b)
    left, right, rank = [], [], []
    for token, r in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                left.append(a), right.append(b), rank.append(r)
    rank = np.array(rank, np.int32)
    start = np.array([ranks[bytes([b])] for b in range(256)])
    table: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for token, r in ranks.items():
        table[r] = token
    return BpeEngine(PairTable(np.array(left), np.array(right), rank, rank), start, start), table


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: bytes that
    print stand for themselves, the others follow from code point 256 on."""
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, more = [], 256
    for b in range(256):
        letters.append(chr(b if b in printing else more))
        more += b not in printing
    return letters


def from_json(path: str) -> BpeEngine:
    """Engine of a merges file with an end-of-word suffix."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
    left, right, merged = [], [], []
    for pair in model["merges"]:
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        left.append(vocab[a]), right.append(vocab[b]), merged.append(vocab[a + b])
    letters = byte_letters()
    return BpeEngine(
        PairTable(np.array(left), np.array(right), np.arange(len(left), dtype=np.int32), np.array(merged, np.int32)),
        np.array([vocab[c] for c in letters]),
        np.array([vocab[c + suffix] for c in letters]),
    )
