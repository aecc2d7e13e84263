"""Words of many texts at once, on one numpy array of bytes, and a hashed table keyed by them.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, A-Z in lower case. Each has a 64-bit
polynomial hash, found as a difference of running sums.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rising powers of the hash's base and of its inverse, ``n`` each."""
    if not _POWERS or len(_POWERS[0]) < n:
        if n > 1 << 21:  # very long texts: not kept
            return tuple(np.cumprod(np.full(n, m, np.uint64)) for m in (BASE, INVERSE))
        size = 1 << max(16, (n - 1).bit_length())
        _POWERS[:] = [np.cumprod(np.full(size, m, np.uint64)) for m in (BASE, INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; never 0."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power, back = powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    h = mix64((sums[start + size] - sums[start]) * back[start] + size.astype(np.uint64))
    h[h == 0] = 1
    return h


class Words:
    """``data`` (bytes of all texts, a blank behind each), ``start``, ``size`` and ``hash`` of each word,
    and ``first``: for each text the number of words before it (and their total at the end)."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)
        blank = SPACE[self.data]
        edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=1, append=1))
        self.start, stop = edge[::2], edge[1::2]
        self.size = stop - self.start
        self.hash = span_hashes(self.data, self.start, self.size)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)])

    def bytes_of(self, rows: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes() if len(rows) * 8 > len(self.start) else self.data
        if isinstance(raw, bytes):
            return [raw[a : a + n] for a, n in zip(self.start[rows].tolist(), self.size[rows].tolist(), strict=True)]
        return [raw[a : a + n].tobytes() for a, n in zip(self.start[rows].tolist(), self.size[rows].tolist(), strict=True)]


class HashTable:
    """64-bit keys (never 0) -> numbers, with open addressing; doubles as it fills."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        mask = (1 << self.bits) - 1
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        todo = np.flatnonzero((held != keys) & (held != 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & mask
            held, own = self.keys[slot], keys[todo]
            hit = held == own
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (held != 0)
            todo, slot = todo[on], slot[on]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        while (self.n + len(keys)) * 2 > len(self.keys):
            used = self.keys != 0
            old = self.keys[used], self.values[used]
            self.bits, self.n = self.bits + 1, 0
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int64)
            self.add(*old)
        self.n += len(keys)
        mask = (1 << self.bits) - 1
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            won = self.keys[slot] == keys
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + 1) & mask


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of several spans, one after another."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))
