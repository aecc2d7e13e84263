"""Language-model scoring by online logistic context mixing.

A text is a sequence of tokens (words, A-Z in lower case, then one end). Every token is a path of binary
decisions. Tokens of the vocabulary (seen at least twice in training, the ``most_words`` most frequent
ones if there are more) have a Huffman code by their counts, an escape among them; a token behind the
escape is spelt in bytes with a closing mark, each byte by a Huffman code of bytes. So the paths of all
tokens together are a probability over all token sequences.

Each decision is predicted from several contexts. Of a word's code: none (the counts themselves), the
token before, and the two before. Of a spelt byte: none, the last three bytes, the token so far, and
the token so far with the token before. Contexts but the first are hashed, with the decision's place
in the code, into tables that count zeros and ones. Their logits are added up under weights that a
gate picks (how often the longer contexts have been seen, and whether a sentence or a token begins);
an adaptive probability map refines the sum. The logarithms add up to the probability of a text, and
over its bytes to bits per byte.

Training reads every training text, in order and once: a group of tokens is predicted from what came
before, weights and map learn from the errors, then the counts take the group in. Several tasks learn
from their shares; their counts are added, their weights averaged by how much
each gate was used. The tables' sizes follow the
number of training tokens up to ``most_bits``, which bounds what is sent to executors; the table of token
counts behind the base score is exact and has no bound: its most frequent tokens travel with the
vocabulary, the rest meet the texts in a shuffle join.

Tokens go by 64-bit hashes. Edge cases: a null or empty text is its end token alone; a null id is hashed
as the empty text; repeated rows are learned and scored each; without training rows all counts are
0 and every decision has one half; an empty table gives no rows; further columns are not read. Long
texts are taken whole.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, cuts, lean, mix64, stored, texts
from .words import HashTable, Words, powers, spread

#: Stands for the end in contexts and tables.
END = int(mix64(np.array([0x454E44], np.uint64))[0])
GATES, CELLS, SLOT_BLOCK = 32, 33, 1 << 15
#: Steps of the mixed logit when scoring, and how far they reach.
FINE, REACH = 4096, 12.0
#: Grades of how often a context has been seen: never, once, up to 15 times, more.
_SEEN = np.array([0.5, 1.5, 15.5], np.float32)
#: Trained counts as one number: grade * 256 + logit in tenths + 128.
_LOGIT = ((np.arange(1024) & 255) - 128).astype(np.float32) / 10


class Code:
    """Huffman code of symbols: for each its length and, one after another, the inner nodes on its way
    and the turns there; for each inner node the logit of a one by the weights."""

    def __init__(self, weights):
        weights = np.maximum(np.asarray(weights, np.float64), 0) + 0.5  # every symbol has a code
        n = len(weights)
        heap = [(w, i) for i, w in enumerate(weights.tolist())]
        heapq.heapify(heap)
        parent, turn = np.full(2 * n, -1, np.int64), np.zeros(2 * n, np.uint8)
        self.static = np.zeros(max(1, n - 1), np.float32)
        for k in range(n - 1):
            u, x = heapq.heappop(heap)
            v, y = heap[0]
            heapq.heapreplace(heap, (u + v, n + k))
            parent[x] = parent[y] = n + k
            turn[y] = 1
            self.static[k] = np.log(v / u)
        self.size = np.zeros(n, np.int64)
        up = parent[:n].copy()
        while (up >= 0).any():
            self.size += up >= 0
            up = np.where(up >= 0, parent[up], -1)
        self.start = np.cumsum(self.size) - self.size
        self.node, self.turn = np.zeros(int(self.size.sum()), np.uint32), np.zeros(int(self.size.sum()), np.uint8)
        leaf, at = np.arange(n), np.arange(n)
        for back in range(1, int(self.size.max(initial=0)) + 1):
            on = parent[at] >= 0
            leaf, at = leaf[on], at[on]
            place = self.start[leaf] + self.size[leaf] - back
            self.node[place], self.turn[place] = parent[at] - n, turn[at]
            at = parent[at]


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, z.dtype.type(-20), z.dtype.type(20))))


def cells(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower cell and the share of the upper one in the probability map."""
    v = (np.clip(z, z.dtype.type(-7.99), z.dtype.type(7.99)) + 8) * ((CELLS - 1) / 16)
    low = v.astype(np.int32)
    return low, v - low.astype(v.dtype)


def nearest(z: np.ndarray) -> np.ndarray:
    half = z.dtype.type((CELLS - 1) / 2)
    return (np.clip(z, z.dtype.type(-8), z.dtype.type(8)) * (half / 8) + (half + z.dtype.type(0.5))).astype(np.int64)


def steps(z: np.ndarray) -> np.ndarray:
    """Step of each logit among ``FINE`` from -``REACH`` to ``REACH``."""
    scale = z.dtype.type((FINE - 1) / (2 * REACH))
    return ((np.clip(z, z.dtype.type(-REACH), z.dtype.type(REACH)) + z.dtype.type(REACH)) * scale + z.dtype.type(0.5)).astype(np.int64)


def states(counts: np.ndarray) -> np.ndarray:
    """Counts of zeros and ones [slots, 2] as grades and logits."""
    logit = np.log((counts[:, 1] + 0.4) / (counts[:, 0] + 0.4))
    grade = np.searchsorted(_SEEN, counts.sum(axis=1), "right")
    return (grade * 256 + np.clip(np.rint(logit * 10), -128, 127).astype(np.int64) + 128).astype(np.uint16)


class Mixer:
    """Predicts the decisions of one code's symbols in ``len(bits)`` hashed contexts of 2^bits slots.

    ``gated``: the two contexts whose grades the gate looks at.
    ``rare``: contexts that are looked up only for symbols whose first decision has been seen in them.
    """

    def __init__(self, code: Code, bits: tuple[int, ...], gated: tuple[int, int], rare: tuple[int, ...]):
        self.code, self.bits, self.gated, self.rare = code, bits, gated, rare
        self.inputs = len(bits) + 1
        self.weights = np.full((self.inputs, GATES), 0.5 / len(bits), np.float32)
        self.weights[0] = 0.7
        self.tables, self.chart = None, None
        self.hits, self.groups = np.zeros((GATES, CELLS, 2)), 0
        self.steep = np.zeros((self.inputs, GATES))

    @staticmethod
    def slots(context: np.ndarray, salt, bits: int) -> np.ndarray:
        x = context ^ salt
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0xC2B2AE35)
        x >>= np.uint32(32 - bits)
        return x

    def read(self, symbols: np.ndarray, contexts: list[np.ndarray], look, every: bool):
        """Of each decision: the symbol's place, turn and slots (``every``: of all contexts), the inputs and
        the grades (0 to 3). ``look``: table and slots -> logits and grades."""
        size = self.code.size[symbols]
        way = spread(self.code.start[symbols], size)
        owner = np.repeat(np.arange(len(symbols)), size)
        node = self.code.node.take(way)
        salt, root = node * np.uint32(0x9E3779B1), np.uint32((len(self.code.static) - 1) * 0x9E3779B1 & 0xFFFFFFFF)
        slots, x, grades = [], [self.code.static.take(node)], []
        for i, (bits, c, table) in enumerate(zip(self.bits, contexts, self.tables, strict=True)):
            rows = None
            if i in self.rare:
                seen = look(table, self.slots(c, root, bits))[1] > 0
                rows = np.flatnonzero(seen.take(owner))
            if every or rows is None:
                slots.append(self.slots(c.take(owner), salt, bits))
            if rows is None:
                logit, grade = look(table, slots[-1])
            else:
                logit, grade = np.zeros(len(owner), np.float32), np.zeros(len(owner), np.uint8)
                logit[rows], grade[rows] = look(table, slots[-1].take(rows) if every else self.slots(c.take(owner.take(rows)), salt.take(rows), bits))
            x.append(logit)
            grades.append(grade)
        return owner, self.code.turn.take(way), slots, x, grades

    def gate(self, grades: list[np.ndarray], flag: np.ndarray) -> np.ndarray:
        a, b = (grades[i] for i in self.gated)
        return (flag * np.uint8(16) + a * np.uint8(4) + b).astype(np.int64)

    def mixed(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        z = x[0] * self.weights[0].take(gate)
        for w, v in zip(self.weights[1:], x[1:], strict=True):
            z += v * w.take(gate)
        return z

    def learn(self, symbols, contexts, flag, rate: float = 0.4) -> None:
        """One group: predict, correct the weights, note in the map, then count."""
        if self.tables is None:
            self.tables = [np.zeros((1 << b, 2), np.float32) for b in self.bits]
        owner, turn, slots, x, grades = self.read(symbols, contexts, counted, True)
        gate = self.gate(grades, flag.take(owner))
        z = self.mixed(x, gate)
        self.hits += np.bincount((gate * CELLS + nearest(z)) * 2 + turn, minlength=self.hits.size).reshape(self.hits.shape)
        p = squash(z)
        err, slope = turn - p, p * (1 - p)
        if self.groups % 4 == 0:  # how steep the error is changes slowly
            self.steep *= 0.92
            for i, v in enumerate(x):
                self.steep[i] += 4 * np.bincount(gate, slope * v * v, GATES)
        self.groups += 1
        for i, v in enumerate(x):
            self.weights[i] += rate * np.bincount(gate, err * v, GATES) / (self.steep[i] + 5)
        one = np.ones(len(turn), np.float32)  # an array of the table's type takes numpy's fast way
        for table, slot in zip(self.tables, slots, strict=True):
            np.add.at(table.ravel(), slot.astype(np.int64) * 2 + turn, one)

    def log10(self, symbols, contexts, flag) -> np.ndarray:
        """Of each symbol, from trained tables of ``states``."""
        owner, turn, _, x, grades = self.read(symbols, contexts, trained, False)
        gate = self.gate(grades, flag.take(owner))
        at = gate * FINE + steps(self.mixed(x, gate))
        return np.bincount(owner, self.logs.take(2 * at + turn), len(symbols))

    def finish(self) -> None:
        """The logarithms of both turns in each gate at each step of the mixed logit: half the mixed
        probability, half the map's."""
        z = np.linspace(-REACH, REACH, FINE)
        low, up = cells(z)
        p = 0.5 * squash(z) + 0.5 * ((1 - up) * self.chart[:, low] + up * self.chart[:, low + 1])
        p = np.clip(p, 1e-9, 1 - 1e-9)
        self.logs = np.log10(np.stack([1 - p, p], axis=-1)).astype(np.float32).ravel()


def counted(table: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logit and grade from counts of zeros and ones, which are read as one number."""
    pair = table.view(np.uint64).ravel().take(slot).view(np.float32).reshape(-1, 2)
    zeros, ones = np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1])
    n = zeros + ones
    grade = (n > _SEEN[0]).view(np.uint8) + (n > _SEEN[1]) + (n > _SEEN[2])
    return np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4))), grade


def trained(table: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logit and grade from ``states``."""
    state = table.take(slot)
    return _LOGIT.take(state), (state >> np.uint16(8)).astype(np.uint8)


def map_of(hits: np.ndarray) -> np.ndarray:
    """Probability of a one in each cell; cells without hits keep their own."""
    own = squash(np.linspace(-8, 8, CELLS))
    return ((hits[..., 1] + 4 * own) / (hits.sum(axis=-1) + 4)).astype(np.float32)


def fold(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint32)


class Tokens:
    """Tokens of several texts with their ends: ``hash``, ``doc``, ``word`` (the place in ``words``, -1 for
    an end), ``contexts`` of a word's code and ``flag`` (the token before ends a sentence)."""

    def __init__(self, values: list[str]):
        self.raw = [t.encode("utf-8", "replace") for t in values]
        self.words = words = Words(self.raw)
        n = len(words.hash)
        ends = words.first[1:] + np.arange(len(values))  # each text's end stands behind its words
        self.hash, self.word = np.empty(n + len(values), np.uint64), np.full(n + len(values), -1)
        inside = np.ones(n + len(values), bool)
        inside[ends] = False
        self.hash[inside], self.hash[ends] = words.hash, END
        self.word[inside] = np.arange(n)
        self.doc = np.repeat(np.arange(len(values)), np.diff(words.first) + 1)
        self.ends = ends
        one = np.concatenate([[np.uint64(END)], self.hash[:-1]])  # an end stands before each text's first token
        two = np.concatenate([[np.uint64(END)], one[:-1]])
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(values)]
        two[starts] = END
        self.one = one
        self.contexts = [fold(mix64(one)), fold(mix64(one + mix64(two) * np.uint64(3)))]
        last = np.zeros(n + len(values), bool)
        if n:
            last[inside] = np.isin(words.data[words.start + words.size - 1], np.frombuffer(b".!?", np.uint8))
        self.flag = np.concatenate([[False], last[:-1]]).astype(np.uint8)

    def spelt(self, rows: np.ndarray):
        """Bytes of the tokens at ``rows``, with the closing mark: symbols, contexts, flags and the row of each."""
        start, size = self.words.start[self.word[rows]], self.words.size[self.word[rows]]
        at, owner = spread(start, size + 1), np.repeat(np.arange(len(rows)), size + 1)
        place = at - start[owner]
        data = self.words.data
        byte = np.where(place == size[owner], np.uint8(32), data[at])
        back = [np.where(place >= k, data[at - k], np.uint8(0)).astype(np.uint32) for k in (1, 2, 3)]
        lo, hi = int(start.min(initial=0)), int(at.max(initial=-1)) + 1
        power, inverse = powers(hi - lo)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * power)])
        so_far = mix64((sums[at - lo] - sums[start[owner] - lo]) * inverse[start[owner] - lo] + place.astype(np.uint64))
        three = (back[0] | back[1] << np.uint32(8) | back[2] << np.uint32(16)) * np.uint32(0x9E3779B1)
        contexts = [three, fold(so_far), fold(mix64(so_far + self.one[rows][owner]))]
        return byte.astype(np.int64), contexts, (place == 0).astype(np.uint8), owner


class Model:
    """Vocabulary, codes and mixers. Symbol ``len(words)`` of the word code is the escape."""

    #: Sizes of the tables, as powers of two beside the given one.
    WORD, BYTE = (0, 0), (-2, -1, 0)

    def __init__(self, words: np.ndarray, counts: np.ndarray, by_word: Code, by_byte: Code, bits: int):
        self.escape = len(words)
        self.table = HashTable()
        self.table.add(words, np.arange(len(words)))
        self.logs = np.log10(counts + 1.0)
        self.by_word = Mixer(by_word, tuple(max(10, bits + d) for d in self.WORD), (1, 0), (1,))
        self.by_byte = Mixer(by_byte, tuple(max(10, bits + d) for d in self.BYTE), (2, 1), (2,))

    def groups(self, tokens: Tokens, ids: np.ndarray, most: int):
        """The tokens, and of the escaped ones the bytes, as (mixer, symbols, contexts, flags, rows) of about
        ``most`` symbols each."""
        symbols = np.where(ids < 0, self.escape, ids)
        for lo in range(0, len(symbols), most):
            part = slice(lo, lo + most)
            yield self.by_word, symbols[part], [c[part] for c in tokens.contexts], tokens.flag[part], np.arange(lo, min(lo + most, len(symbols)))
        escaped = np.flatnonzero((ids < 0) & (tokens.word >= 0))
        ends = np.cumsum(tokens.words.size[tokens.word[escaped]] + 1)
        lo = 0
        while lo < len(escaped):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 2 * most, "right")))
            byte, contexts, flag, owner = tokens.spelt(escaped[lo:hi])
            yield self.by_byte, byte, contexts, flag, escaped[lo:hi][owner]
            lo = hi

    def log10(self, tokens: Tokens, ids: np.ndarray, most: int = 8192) -> np.ndarray:
        """Of each token."""
        out = np.zeros(len(ids))
        for mixer, symbols, contexts, flag, rows in self.groups(tokens, ids, most):
            out += np.bincount(rows, mixer.log10(symbols, contexts, flag), len(ids))
        return out

    def learn(self, tokens: Tokens, ids: np.ndarray, most: int = 4096) -> None:
        for mixer, symbols, contexts, flag, _ in self.groups(tokens, ids, most):
            mixer.learn(symbols, contexts, flag)


def token_counts(train: DataFrame, most: int = 1_500_000) -> DataFrame:
    """``hash`` and ``c`` of each token of the training texts; bytes stand as hash -1 - byte with ``kind`` 1."""

    def run(frames):
        held, kept, by_byte = [], 0, np.zeros(256, np.int64)

        def merged():
            h, c = map(np.concatenate, zip(*held, strict=True))
            h, back = np.unique(h, return_inverse=True)
            return h, np.bincount(back, c).astype(np.int64)

        for pdf in frames:
            values = pdf["text"].tolist()
            for lo, hi in cuts(values, 2000, 1 << 20):
                words = Words([t.encode("utf-8", "replace") for t in values[lo:hi]])
                h, c = np.unique(words.hash, return_counts=True)
                held.append((np.append(h, np.uint64(END)), np.append(c, hi - lo)))
                kept += len(h)
                by_byte += np.bincount(words.data, minlength=256)
                if kept > most:
                    held = [merged()]
                    kept = len(held[0][0])
                    if 2 * kept > most:
                        yield pd.DataFrame({"kind": 0, "hash": held[0][0].view(np.int64), "c": held[0][1]})
                        held, kept = [], 0
        if held:
            h, c = merged()
            yield pd.DataFrame({"kind": 0, "hash": h.view(np.int64), "c": c})
        yield pd.DataFrame({"kind": 1, "hash": np.arange(256), "c": by_byte})

    return train.mapInPandas(lean(run), "kind int, hash long, c long").groupBy("kind", "hash").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, most_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the tokens seen at least twice, from the most frequent on and, where not all
    of one grade of frequency fit in, without that grade."""
    grade = F.floor(8 * F.log2("c"))
    above, lowest = 0, None
    for row in counts.where("c > 1").groupBy(grade.alias("g")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("g")).collect():
        above += row["k"]
        if above > most_words:
            break
        lowest = row["g"]
    if lowest is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = counts.where((F.col("c") > 1) & (grade >= lowest)).select("hash", "c").toPandas()
    h, c = rows["hash"].to_numpy(np.int64).view(np.uint64), rows["c"].to_numpy(np.int64)
    order = np.lexsort((h, -c))
    return h[order], c[order]


def _squeeze(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _swell(data: bytes, dtype, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)


def fit(train: DataFrame, make, tasks: int) -> None:
    """Learn in ``tasks`` tasks from all rows and give the model its tables, weights and maps.

    make: a function that gives the untrained model. Tables travel in blocks of fixed size; what
    comes to the driver is their states, two bytes a slot.
    """
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(make)

    def run(frames):
        model = shared.value()
        for pdf in frames:
            values = pdf["text"].tolist()
            for lo, hi in cuts(values, 200, 1 << 18):
                tokens = Tokens(values[lo:hi])
                model.learn(tokens, model.table.find(tokens.hash))
        for m, mixer in enumerate((model.by_word, model.by_byte)):
            for t, table in enumerate(mixer.tables or []):
                flat = table.ravel()
                for at in range(0, len(flat), 2 * SLOT_BLOCK):
                    block = flat[at : at + 2 * SLOT_BLOCK]
                    if block.any():
                        small = block.max() < 65536
                        yield pd.DataFrame({"m": [m], "t": [t], "block": [at // (2 * SLOT_BLOCK)], "width": [len(block)], "small": [bool(small)], "data": [_squeeze(block.astype(np.uint16 if small else np.float32))]})
            facts = np.concatenate([mixer.weights.ravel().astype(np.float64), mixer.hits.ravel()])
            yield pd.DataFrame({"m": [m], "t": [-1], "block": [TaskContext.get().partitionId()], "width": [len(facts)], "small": [False], "data": [_squeeze(facts)]})

    def add(pdf):
        first = pdf.iloc[0]
        if first["t"] < 0:
            return pdf[["m", "t", "block", "width", "data"]]
        total = np.zeros(int(first["width"]))
        for small, data in zip(pdf["small"], pdf["data"], strict=True):
            total += _swell(data, np.uint16 if small else np.float32, len(total))
        out = states(total.reshape(-1, 2))
        return pd.DataFrame({"m": [first["m"]], "t": [first["t"]], "block": [first["block"]], "width": [len(out)], "data": [_squeeze(out)]})

    schema = "m int, t int, block int, width int, small boolean, data binary"
    parts = train.coalesce(tasks).mapInPandas(lean(run), schema)
    rows = parts.groupBy("m", "t", "block").applyInPandas(add, "m int, t int, block int, width int, data binary").collect()
    return sorted(((r["m"], r["t"], r["block"], r["width"], bytes(r["data"])) for r in rows), key=lambda r: r[:3])


def install(model: Model, rows: list[tuple]) -> Model:
    for m, mixer in enumerate((model.by_word, model.by_byte)):
        mixer.tables = [np.full(1 << b, 128, np.uint16) for b in mixer.bits]
        n, weights, hits = GATES * mixer.inputs, np.zeros((mixer.inputs, GATES)), np.zeros((GATES, CELLS, 2))
        for _, t, block, width, data in (r for r in rows if r[0] == m):
            if t >= 0:
                mixer.tables[t][block * SLOT_BLOCK : block * SLOT_BLOCK + width] = _swell(data, np.uint16, width)
                continue
            facts = _swell(data, np.float64, width)
            own = facts[n:].reshape(hits.shape)
            weights, hits = weights + facts[:n].reshape(-1, GATES) * own.sum(axis=(1, 2)), hits + own
        load = hits.sum(axis=(1, 2))
        mixer.weights = np.where(load > 0, weights / np.maximum(load, 1), mixer.weights).astype(np.float32)
        mixer.chart = map_of(hits)
        mixer.finish()
    return model


class Maker:
    """Makes the untrained model; holds counts and codes only, so it travels cheaply."""

    def __init__(self, *facts):
        self.facts = facts

    def __call__(self) -> Model:
        return Model(*self.facts)


#: The last model that a worker unpacked.
_MODEL: dict[str, Model] = {}


def unpacked(shared) -> Model:
    name, make, rows = shared
    if name not in _MODEL:
        _MODEL.clear()
        _MODEL[name] = install(make(), rows)
    return _MODEL[name]


def score(docs: DataFrame, folds: int = 7, held: int = 2, most_words: int = 1 << 18, most_bits: int = 22, most_tasks: int = 4096) -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score`` (log10 of the model's probability), ``n_bytes`` and
    ``bits_per_byte``."""
    spark = docs.sparkSession
    base = texts(docs).withColumn("held_out", crc_bucket(F.col("doc_id"), folds) == held)
    train = base.where(~F.col("held_out"))
    found = stored(token_counts(train))
    counts = found.where("kind = 0").select("hash", "c")
    facts = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).collect()[0]
    n, v = int(facts["n"]), int(facts["v"])
    by_byte = np.zeros(256, np.int64)
    for row in found.where("kind = 1").collect():
        by_byte[row["hash"]] = row["c"]
    words, word_counts = vocabulary(counts, most_words)
    bits = int(min(most_bits, max(12, np.ceil(np.log2(n + 1)) + 1)))
    make = Maker(words, word_counts, Code([*word_counts.tolist(), n - int(word_counts.sum())]), Code(by_byte), bits)
    tasks = int(min(most_tasks, spark.sparkContext.defaultParallelism))
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, make, fit(train, make, tasks)))

    def run(frames):
        model, part, row = unpacked(shared.value), TaskContext.get().partitionId(), 0
        for pdf in frames:
            values = pdf["text"].tolist()
            for lo, hi in cuts(values, 200, 1 << 18):
                tokens = Tokens(values[lo:hi])
                ids, k = model.table.find(tokens.hash), hi - lo
                known = ids >= 0
                rare = tokens.hash[~known].view(np.int64)
                edges = np.concatenate([[0], np.cumsum(np.bincount(tokens.doc[~known], minlength=k))])
                yield pd.DataFrame(
                    {
                        "uid": (part << 36) + row + np.arange(k),
                        "doc_id": pdf["doc_id"].array[lo:hi],
                        "held_out": pdf["held_out"].array[lo:hi],
                        "n_tokens": np.bincount(tokens.doc, minlength=k),
                        "n_bytes": np.fromiter(map(len, tokens.raw), np.int64, k),
                        "heavy_sum": np.bincount(tokens.doc[known], model.logs[ids[known]], k),
                        "heavy_known": np.bincount(tokens.doc[known], minlength=k),
                        "score": np.bincount(tokens.doc, model.log10(tokens, ids), k),
                        "rare": [rare[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)],
                    }
                ).astype({"doc_id": "Int64"})
                row += k

    schema = "uid long, doc_id long, held_out boolean, n_tokens long, n_bytes long, heavy_sum double, heavy_known long, score double, rare array<long>"
    scored = stored(base.mapInPandas(lean(run), schema))
    rare = scored.select("uid", F.explode("rare").alias("hash"))
    met = rare.join(counts, "hash").groupBy("uid").agg(F.sum(F.log10(F.col("c") + 1)).alias("rare_sum"), F.count(F.lit(1)).alias("rare_known"))
    joined = scored.drop("rare").join(met, "uid", "left")
    none = F.lit(0)
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("heavy_known") + F.coalesce("rare_known", none)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("heavy_sum") + F.coalesce("rare_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        "score",
        "n_bytes",
        (-F.col("score") * F.lit(float(np.log2(10))) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
