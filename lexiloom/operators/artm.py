"""Topic models with additive regularizers, and the search for the number of topics.

All fits go on together. ``tokens`` has (``fit``, ``doc``, ``word``, ``n``). Words travel by 64-bit names, which are checked to
be different; their texts stay in a dictionary. Documents are dealt over blocks of at most about ``PAIRS`` pairs of document and word, which
are packed as binary chunks; the word-topic matrix is a table with a row per word and a column per topic (``p0``, ``p1`` ...).
A round sends each block the rows of its own words, runs the E-step there in numpy and adds its counts up per word; the
M-step is one map over the words. Each round's matrix is written to the shared folder; a block is lost and run anew alone.

Fits of one corpus share its blocks: ``search`` keeps the tokens once, with how often each bootstrap draws a document.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.operators import topics as T
from lexiloom.operators.graph import written

#: Pairs of document and word in a block, about, at most; those that are worth a task of their own.
PAIRS, WORTH = 4_000_000, 50_000
#: Documents are dealt over so many slots, and these over blocks.
SLOTS = 4096
#: Tokens that a task packs at once, and pairs of a chunk.
HELD, CHUNK = 1_000_000, 1 << 17
SCORES = "fit int, round int, perplexity double, sparsity_theta double, sparsity_phi double"
PACKED = "corpus int, block int, part int, word long, df long, docs int, index binary, sizes binary, n binary, times binary, {}"


def blocks(tokens: DataFrame) -> DataFrame:
    """``tokens`` as a fit counts them: repeated pairs are summed; rows with nulls or without a positive count are left out."""
    return usable(tokens).groupBy("fit", "doc", "word").agg(F.sum("n").alias("n"))


def usable(tokens: DataFrame) -> DataFrame:
    some = tokens.select(F.col("fit").cast("int"), "doc", "word", F.col("n").cast("double").alias("n"))
    return some.where("doc is not null and word is not null and fit is not null and n > 0")


def weight(seed: Column, word: Column, t: Column) -> Column:
    return (F.pmod(F.xxhash64(seed, word, t), F.lit(1 << 20)) + 1) / (1 << 20)


def start(dealt: DataFrame, topics: DataFrame, seed: int) -> DataFrame:
    """The matrix that a fit starts from (``fit``, ``word``, ``t``, ``p``), of hashes of (seed, word, topic), so that it is the same in
    every run; ``topics`` has (``fit``, ``k``, optional ``seed``)."""
    own = F.col("seed") if "seed" in topics.columns else F.lit(seed)
    words = dealt.select("fit", "word").distinct().join(F.broadcast(topics), "fit")
    cells = words.select("fit", "word", own.alias("seed"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("t"))
    cells = cells.select("fit", "word", "t", weight(F.col("seed"), F.col("word"), F.col("t")).alias("m"))
    total = cells.groupBy("fit", "t").agg(F.sum("m").alias("total"))
    return cells.join(F.broadcast(total), ["fit", "t"]).select("fit", "word", "t", (F.col("m") / F.col("total")).alias("p"))


def small(x: np.ndarray) -> bytes:
    """Numbers from 0 in the narrowest kind that holds them."""
    kind = "f8"
    if not len(x) or (x.max() < 1 << 32 and (x == np.floor(x)).all()):
        kind = "u1" if not len(x) or x.max() < 1 << 8 else "u2" if x.max() < 1 << 16 else "u4"
    return kind.encode() + x.astype(kind).tobytes()


def large(data: bytes) -> np.ndarray:
    return np.frombuffer(data, data[:2].decode(), offset=2)


def named(word: Column, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), word)


def pieces(tokens: DataFrame, salt: int) -> DataFrame:
    """Two kinds of rows, in one pass: of each slot of a corpus the pairs that a task saw (``corpus``, ``slot``, ``pairs``, ``docs``, ``sizes``,
    ``ids``, ``n``), and words with their names (``id``, ``word``)."""
    whole = dict(tokens.dtypes)["doc"] in ("tinyint", "smallint", "int", "bigint")
    doc = F.col("doc").cast("long") if whole else F.xxhash64("doc")
    rows = usable(tokens).select(F.col("fit").alias("corpus"), F.pmod(F.xxhash64("doc"), F.lit(SLOTS)).cast("int").alias("slot"), doc.alias("doc"), named(F.col("word"), salt).alias("id"), "n", F.col("word").cast("string").alias("word"))
    fields = pa.schema([("corpus", pa.int32()), ("slot", pa.int32()), ("pairs", pa.int64()), ("docs", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary()), ("n", pa.binary()), ("id", pa.int64()), ("word", pa.string())])

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        corpus, slot, doc, name, n = (table[c].to_numpy() for c in ("corpus", "slot", "doc", "id", "n"))
        order = np.lexsort((name, doc, corpus.astype(np.int64) * SLOTS + slot))
        corpus, slot, doc, name, n = corpus[order], slot[order], doc[order], name[order], n[order]
        place = np.r_[True, (corpus[1:] != corpus[:-1]) | (slot[1:] != slot[:-1])]
        owner = place | np.r_[True, doc[1:] != doc[:-1]]
        pair = np.flatnonzero(owner | np.r_[True, name[1:] != name[:-1]])
        n = np.add.reduceat(n, pair)
        place, owner = np.flatnonzero(place[pair]), np.flatnonzero(owner[pair])
        corpus, slot, doc, name = corpus[pair], slot[pair], doc[pair], name[pair]
        sizes = np.diff(np.append(owner, len(pair)))
        ends, first = np.append(place, len(pair)), np.searchsorted(owner, np.append(place, len(pair)))
        spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True))
        yield pa.RecordBatch.from_pydict({
            "corpus": corpus[place], "slot": slot[place], "pairs": [z - a for a, z, _, _ in spans], "docs": [doc[owner[b:c]].tobytes() for _, _, b, c in spans], "sizes": [small(sizes[b:c]) for _, _, b, c in spans],
            "ids": [name[a:z].tobytes() for a, z, _, _ in spans], "n": [small(n[a:z]) for a, z, _, _ in spans], "id": [None] * len(spans), "word": [None] * len(spans),
        }, schema=fields)
        names, at = np.unique(table["id"].to_numpy(), return_index=True)
        nothing = {c: pa.nulls(len(names), fields.field(c).type) for c in fields.names}
        yield pa.RecordBatch.from_pydict(nothing | {"id": names, "word": table["word"].combine_chunks().take(pa.array(at))}, schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= HELD:
                yield from packed(held)
                held, size = [], 0
        if size:
            yield from packed(held)

    return rows.mapInArrow(run, "corpus int, slot int, pairs long, docs binary, sizes binary, ids binary, n binary, id long, word string")


def chunks(corpus: int, block: int, words: np.ndarray, index: np.ndarray, sizes: np.ndarray, n: np.ndarray, seen: int, times: np.ndarray | None = None) -> pa.Table:
    """A block's rows: its words in order (part -1), each word with its count of documents and in which fits it is (part -2), and its pairs in
    chunks of whole documents (part from 0). times: [fits, documents], how often a fit has each."""
    ends = np.cumsum(sizes)
    cut, at = [0], 0
    while at < len(sizes):
        at = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        cut.append(at)
    parts = list(zip(cut[:-1], cut[1:], strict=True))
    span = lambda a, z: slice(int(ends[a - 1]) if a else 0, int(ends[z - 1]))
    df = np.bincount(index, minlength=len(words))
    if times is None:
        there = [np.ones(len(words), bool)] * seen
    else:
        there = [np.bincount(index, np.repeat(t > 0, sizes), len(words)) > 0 for t in times]
        there += [np.zeros(len(words), bool)] * (seen - len(there))
    rest = len(parts) + 1
    flag = lambda x: pa.array([None] * rest, pa.bool_()) if x is None else pa.array(x)
    head = {
        "corpus": pa.array([corpus] * rest, pa.int32()), "block": pa.array([block] * rest, pa.int32()), "part": pa.array(range(-1, len(parts)), pa.int32()), "word": pa.nulls(rest, pa.int64()), "df": pa.nulls(rest, pa.int64()),
        "docs": pa.array([0, *(z - a for a, z in parts)], pa.int32()), "index": pa.array([words.tobytes(), *(small(index[span(a, z)]) for a, z in parts)], pa.binary()), "sizes": pa.array([None, *(small(sizes[a:z]) for a, z in parts)], pa.binary()),
        "n": pa.array([None, *(small(n[span(a, z)]) for a, z in parts)], pa.binary()), "times": pa.array([None, *(None if times is None else small(times[:, a:z].ravel()) for a, z in parts)], pa.binary()),
    } | {f"s{j}": flag(None) for j in range(seen)}
    size = len(words)
    tail = {
        "corpus": pa.array(np.full(size, corpus, np.int32)), "block": pa.array(np.full(size, block, np.int32)), "part": pa.array(np.full(size, -2, np.int32)), "word": pa.array(words), "df": pa.array(df.astype(np.int64)),
        "docs": pa.nulls(size, pa.int32()), **{c: pa.nulls(size, pa.binary()) for c in ("index", "sizes", "n", "times")},
    } | {f"s{j}": pa.array(there[j]) for j in range(seen)}
    return pa.concat_tables([pa.table(head), pa.table(tail)])


def packed_kind(seen: int) -> str:
    return PACKED.format(", ".join(f"s{j} boolean" for j in range(seen)))


def opened(left: pa.Table) -> tuple[np.ndarray, list[dict]]:
    """Words and chunks of a block."""
    rows = sorted(left.select(["part", "index", "sizes", "n", "times"]).to_pylist(), key=lambda r: r["part"])
    out = [{"index": large(r["index"]), "sizes": large(r["sizes"]).astype(np.int64), "n": large(r["n"]).astype(float), "times": r["times"] and large(r["times"]).astype(float)} for r in rows[1:]]
    return np.frombuffer(rows[0]["index"], np.int64), out


def merged(found: DataFrame, pairs: int, seen: int) -> tuple[DataFrame, int]:
    """Blocks of the ``pieces`` of all corpora, as ``chunks`` gives them, and their number."""
    spark = found.sparkSession
    parts = found.where("corpus is not null")
    sizes = {r["corpus"]: r["n"] for r in parts.groupBy("corpus").agg(F.sum("pairs").alias("n")).collect()}  # one row a corpus
    wanted = -(-2 * spark.sparkContext.defaultParallelism // max(1, len(sizes)))
    plan, at = [], 0
    for corpus, n in sorted(sizes.items()):
        many = min(SLOTS, max(-(-n // pairs), min(wanted, -(-n // WORTH))))
        plan.append((corpus, at, many))
        at += many
    where = F.broadcast(spark.createDataFrame(plan, "corpus int, base int, many int"))
    dealt = parts.join(where, "corpus").withColumn("block", (F.col("base") + F.floor(F.col("slot") * F.col("many") / SLOTS)).cast("int"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        col = {c: table[c].to_pylist() for c in ("docs", "sizes", "ids", "n")}
        doc = np.concatenate([np.repeat(np.frombuffer(d, np.int64), large(s)) for d, s in zip(col["docs"], col["sizes"], strict=True)])
        name = np.concatenate([np.frombuffer(x, np.int64) for x in col["ids"]])
        n = np.concatenate([large(x).astype(float) for x in col["n"]])
        del col
        words, index = np.unique(name, return_inverse=True)
        order = np.lexsort((index, doc))
        doc, index, n = doc[order], index[order], n[order]
        owner = np.r_[True, doc[1:] != doc[:-1]]
        pair = np.flatnonzero(owner | np.r_[True, index[1:] != index[:-1]])
        n, index = np.add.reduceat(n, pair), index[pair]
        sizes = np.diff(np.append(np.flatnonzero(owner[pair]), len(pair)))
        return chunks(key[0].as_py(), key[1].as_py(), words, index, sizes, n, seen)

    some = dealt.select("corpus", "block", "docs", "sizes", "ids", "n").repartition(max(1, at), "corpus", "block")
    return written(some.groupBy("corpus", "block").applyInArrow(run, packed_kind(seen))), at


def beside(left: DataFrame, right: DataFrame, number: int, run, kind: str) -> DataFrame:
    """``run`` for each block with its rows of ``right``; blocks are dealt over tasks one by one, however small their bytes are."""
    deal = lambda rows, *keys: rows.repartition(max(1, number), *keys).groupBy(*keys)
    own = left.where("part > -2").select("corpus", "block", "part", "index", "sizes", "n", "times")
    other = right.withColumnsRenamed({"corpus": "right_corpus", "block": "right_block"})  # both may come from one table
    return deal(own, "corpus", "block").cogroup(deal(other, "right_corpus", "right_block")).applyInArrow(run, kind)


def restricted(dealt: DataFrame, number: int, common: DataFrame) -> DataFrame:
    """Blocks with the words of ``common`` (``corpus``, ``word``) alone, without documents that have none."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return chunks(0, 0, *[np.zeros(0, np.int64)] * 4, 1).slice(0, 0)
        words, parts = opened(left)
        kept = np.sort(right["word"].to_numpy())
        there, to = np.isin(words, kept), np.searchsorted(kept, words)
        index, n, sizes = [], [], []
        for p in parts:
            mask = there[p["index"]]
            index.append(to[p["index"][mask]])
            n.append(p["n"][mask])
            own = np.add.reduceat(mask.astype(np.int64), np.cumsum(p["sizes"]) - p["sizes"])
            sizes.append(own[own > 0])
        return chunks(key[0].as_py(), key[1].as_py(), kept, np.concatenate(index), np.concatenate(sizes), np.concatenate(n), 1)

    needs = dealt.where("part = -2").select("corpus", "block", "word").join(common, ["corpus", "word"])
    return written(beside(dealt, needs, number, run, packed_kind(1)))


def weighed(dealt: DataFrame, number: int, fits: int, draws: list[tuple[int, int]], share: float) -> DataFrame:
    """Blocks of one corpus with the ``times`` of a bootstrap for each of the ``draws`` (number of the fit, seed). Documents are
    numbered through by the counts of the chunks, one number a chunk on the driver."""
    spark = dealt.sparkSession
    counts = sorted((r["corpus"], r["block"], r["part"], r["docs"]) for r in dealt.where("part >= 0").select("corpus", "block", "part", "docs").collect())
    first = np.cumsum([0, *(c[3] for c in counts)])
    first_of = dict(zip((c[:3] for c in counts), first.tolist(), strict=False))
    begins = {}
    for (corpus, block, _), at in first_of.items():
        begins.setdefault((corpus, block), at)
    keys, bases = list(begins), np.array(list(begins.values()), np.int64)
    owners = np.array(keys, np.int32).reshape(-1, 2)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.column("i").to_numpy()
            at = np.searchsorted(bases, i, "right") - 1
            yield pa.RecordBatch.from_pydict({"corpus": owners[at, 0], "block": owners[at, 1], "i": i - bases[at], "fit": b.column("fit"), "times": b.column("times")})

    drawn = times_drawn(spark, int(first[-1]), draws, share).select("i", "fit", "times")
    placed = drawn.mapInArrow(place, "corpus int, block int, i long, fit int, times long")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        words, parts = opened(left)
        sizes = np.concatenate([p["sizes"] for p in parts])
        times = np.zeros((fits, len(sizes)))
        times[right["fit"].to_numpy(), right["i"].to_numpy()] = right["times"].to_numpy()
        return chunks(key[0].as_py(), key[1].as_py(), words, np.concatenate([p["index"] for p in parts]), sizes, np.concatenate([p["n"] for p in parts]), fits, times)

    return written(beside(dealt, placed, number, run, packed_kind(fits)))


def e_step(n: np.ndarray, sizes: np.ndarray, own: np.ndarray, passes: int, theta_tau: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Counts of (topic, pair), theta (topic, document) and the log-likelihood, of documents that have so many pairs each."""
    k, starts = len(own), np.cumsum(sizes) - sizes
    theta = np.full((k, len(sizes)), 1.0 / k)

    def mixed():
        total = own[0] * np.repeat(theta[0], sizes)
        for t in range(1, k):
            total += own[t] * np.repeat(theta[t], sizes)
        return np.maximum(total, 1e-300, out=total)

    for _ in range(passes):
        ratio = n / mixed()
        counts = np.maximum(np.stack([theta[t] * np.add.reduceat(own[t] * ratio, starts) for t in range(k)]) + theta_tau, 0.0)
        size = counts.sum(0)
        theta = np.where(size > 0, counts / np.where(size > 0, size, 1.0), theta)
    total = mixed()
    ratio = n / total
    return np.stack([own[t] * np.repeat(theta[t], sizes) * ratio for t in range(k)]), theta, float((n * np.log(total)).sum())


class Layout:
    """Which columns of the matrix the fits of each corpus have; ``plan`` has (corpus, fit, k, seed)."""

    def __init__(self, plan: list[tuple[int, int, int, int]]):
        self.fits: dict[int, list[tuple[int, int, int, int]]] = {}  # fit, k, first column, seed
        for corpus, name, k, seed in plan:
            own = self.fits.setdefault(corpus, [])
            own.append((name, k, own[-1][2] + own[-1][1] if own else 0, seed))
        self.width = max((own[-1][2] + own[-1][1] for own in self.fits.values()), default=1)
        self.most = max(map(len, self.fits.values()), default=1)

    def columns(self, corpus: int) -> list[tuple[int, int, int, int]]:
        """Of each column: number of the fit in its corpus, fit, topic, seed."""
        return [(j, name, t, seed) for j, (name, k, _, seed) in enumerate(self.fits[corpus]) for t in range(k)]

    def table(self, spark, kind: str = "int") -> DataFrame:
        rows = [(c, *([x[i] for x in self.columns(c)] for i in range(4))) for c in self.fits]
        return F.broadcast(spark.createDataFrame(rows, f"corpus int, j array<int>, fits array<int>, ts array<int>, seeds array<{kind}>"))


def names(letter: str, width: int) -> list[str]:
    return [f"{letter}{c}" for c in range(width)]


def expectation(layout: Layout, passes: int, theta_tau: float):
    """The E-step of a block: counts of its words (``told`` -1) and, of each fit, four sums."""
    width = layout.width

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        corpus = key[0].as_py()
        words, parts = opened(left)
        matrix = np.zeros((width, len(words)))
        at = np.searchsorted(words, right["word"].to_numpy())
        for c in range(width):
            matrix[c, at] = right[f"p{c}"].to_numpy()
        found, told = np.zeros_like(matrix), np.zeros((4, width))
        for p in parts:
            for j, (_, k, lo, _) in enumerate(layout.fits[corpus]):
                index, sizes, n = p["index"], p["sizes"], p["n"]
                if p["times"] is not None:
                    times = p["times"].reshape(-1, len(sizes))[j]
                    mask = np.repeat(times > 0, sizes)
                    index, n, sizes = index[mask], (n * np.repeat(times, sizes))[mask], sizes[times > 0]
                if not len(sizes):
                    continue
                counts, theta, likely = e_step(n, sizes, matrix[lo : lo + k][:, index], passes, theta_tau)
                for t in range(k):
                    found[lo + t] += np.bincount(index, counts[t], len(words))
                told[:, lo] += likely, n.sum(), (theta == 0).sum(), theta.size
        some = np.flatnonzero((found > 0).any(0))
        out = {"corpus": np.full(len(some) + 4, corpus, np.int32), "told": np.r_[np.full(len(some), -1), range(4)].astype(np.int32), "word": np.r_[words[some], np.zeros(4, np.int64)]}
        return pa.table(out | {f"m{c}": np.r_[found[c, some], told[:, c]] for c in range(width)})

    return run


def maximization(layout: Layout, phi_tau: float, decorrelation: float, background: int, smooth: float):
    """The M-step on rows of counts ``m`` and old shares ``p``: positive parts of the regularized counts. ``told`` rows stay."""
    width = layout.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            corpus, told = b.column("corpus").to_numpy(), b.column("told").to_numpy()
            m = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in names("m", width)]).copy()
            p = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in names("p", width)]) if decorrelation else None
            for c in np.unique(corpus).tolist():
                at = np.flatnonzero((corpus == c) & (told < 0))
                for _, k, lo, _ in layout.fits[c]:
                    counts, domain = m[lo : lo + k, at], np.arange(k)[:, None] < k - background
                    change = np.where(domain, phi_tau, smooth)
                    if decorrelation:
                        own = p[lo : lo + k, at]
                        change = change - np.where(domain, decorrelation * own * (np.where(domain, own, 0.0).sum(0) - own), 0.0)
                    m[lo : lo + k, at] = np.where(counts > 0, np.maximum(counts + change, 0.0), 0.0)
            kept = np.flatnonzero((told >= 0) | (m > 0).any(0))
            yield pa.RecordBatch.from_pydict({"corpus": corpus[kept], "told": told[kept], "word": b.column("word").to_numpy()[kept]} | {f"m{c}": m[c, kept] for c in range(width)})

    return run


def learnt(dealt: DataFrame, number: int, dictionary: DataFrame, layout: Layout, kind: str, rounds: int, passes: int, phi_tau: float = 0.0, theta_tau: float = 0.0, decorrelation: float = 0.0, background: int = 0, smooth: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The matrix and the scores of the fits of ``layout``, over blocks."""
    spark, width = dealt.sparkSession, layout.width
    ms, ps = names("m", width), names("p", width)
    own = layout.table(spark, kind)
    needs = dealt.where("part = -2").select("corpus", "block", "word")
    flags = names("s", layout.most)
    there = written(dealt.where("part = -2").groupBy("corpus", "word").agg(*[F.max(s).alias(s) for s in flags]))
    vocabulary = {r["corpus"]: r for r in there.groupBy("corpus").agg(*[F.sum(F.col(s).cast("int")).alias(s) for s in flags]).collect()}
    at = lambda name, c: F.get(F.col(name), F.lit(c))
    texts = there.join(dictionary.select(F.col("id").alias("word"), F.col("word").alias("text")), "word").join(own, "corpus")
    first = [F.when(F.get(F.array(*flags), at("j", c)), weight(at("seeds", c), F.col("text"), at("ts", c))).otherwise(0.0).alias(ms[c]) for c in range(width)]
    cells, scores = written(texts.select("corpus", F.lit(-1).alias("told"), "word", *first)), []
    run, step = expectation(layout, passes, theta_tau), maximization(layout, phi_tau, decorrelation, background, smooth)
    kept = "corpus int, told int, word long, " + ", ".join(f"{m} double" for m in ms)

    def shares() -> tuple[DataFrame, dict]:
        """Each topic's counts as shares, and per corpus the totals and numbers of positive cells."""
        rows = cells.where("told < 0")
        sums = rows.groupBy("corpus").agg(*[F.sum(m).alias(f"q{c}") for c, m in enumerate(ms)], *[F.sum((F.col(m) > 0).cast("long")).alias(f"c{c}") for c, m in enumerate(ms)]).collect()  # one row a corpus
        totals = spark.createDataFrame([(r["corpus"], *(float(r[f"q{c}"]) for c in range(width))) for r in sums], "corpus int, " + ", ".join(f"q{c} double" for c in range(width)))
        part = [F.when(F.col(m) > 0, F.col(m) / F.col(f"q{c}")).otherwise(0.0).alias(ps[c]) for c, m in enumerate(ms)]
        return rows.join(F.broadcast(totals), "corpus").select("corpus", "word", *part), {r["corpus"]: r for r in sums}

    phi, counted = shares()
    for r in range(rounds):
        sent = needs.join(phi.hint("shuffle_hash"), ["corpus", "word"])  # a part of the words, not sorted
        parts = beside(dealt, sent, number, run, kept)
        sums = [F.sum(m).alias(m) for m in ms]
        if decorrelation:
            old = phi.select("corpus", F.lit(-1).alias("told"), "word", *[F.lit(0.0).alias(m) for m in ms], *ps)
            parts = parts.select("*", *[F.lit(0.0).alias(p) for p in ps]).unionByName(old)
            sums += [F.sum(p).alias(p) for p in ps]
        cells = written(parts.groupBy("corpus", "told", "word").agg(*sums).mapInArrow(step, kept))
        phi, counted = shares()
        told = {(x["corpus"], x["told"]): x for x in cells.where("told >= 0").collect()}  # four rows a corpus
        for corpus in sorted({c for c, _ in told}):
            for j, (name, k, lo, _) in enumerate(layout.fits[corpus]):
                likely, n, zero, size = (told[corpus, i][f"m{lo}"] for i in range(4))
                if size:
                    positive = sum(counted[corpus][f"c{c}"] for c in range(lo, lo + k)) if corpus in counted else 0
                    scores.append((name, r, float(np.exp(-likely / n)), zero / size, 1 - positive / (vocabulary[corpus][f"s{j}"] * k)))
    every = F.explode(F.array(*[F.struct(at("fits", c).alias("fit"), at("ts", c).alias("t"), F.col(ps[c]).alias("p")) for c in range(width)])).alias("x")
    long = phi.join(own, "corpus").select("word", every).select("word", "x.*").where("p > 0").withColumnRenamed("word", "id")
    return long.join(dictionary, "id").select("fit", "word", "t", "p"), spark.createDataFrame(sorted(scores), SCORES)


def prepared(tokens: DataFrame, pairs: int, seen: int) -> tuple[DataFrame, int, DataFrame]:
    """Blocks, their number and the dictionary (``id``, ``word``). Where two words have one name, all get others."""
    for salt in itertools.count():
        found = written(pieces(tokens, salt))
        dictionary = written(found.where("id is not null").select("id", "word").distinct())
        told = dictionary.agg(F.count_distinct("id").alias("ids"), F.count(F.lit(1)).alias("words")).first()
        if told["ids"] == told["words"]:
            return *merged(found, pairs, seen), dictionary


def fit(tokens: DataFrame, topics: DataFrame, rounds: int = 10, passes: int = 5, phi_tau: float = 0.0, theta_tau: float = 0.0, decorrelation: float = 0.0, background: int = 0, smooth: float = 0.0, seed: int = 1, pairs: int = PAIRS) -> tuple[DataFrame, DataFrame]:
    """The matrix (``fit``, ``word``, ``t``, ``p``) and per round the ``SCORES``, of ``tokens`` for ``topics`` (``fit``, ``k``, optional ``seed``).

    ``phi_tau`` and ``theta_tau`` are added to the counts before their positive parts are taken (below 0 they make topics and
    documents sparse); ``decorrelation`` takes a word from topics as far as others have it. The last ``background`` topics are left
    out of both and get ``smooth`` instead. Perplexity is that of the round's E-step. Scores of a round are one row a fit.
    A fit without tokens has no rows; an empty table gives empty ones; repeated (doc, word) rows are summed.
    """
    seeded = "seed" in topics.columns
    layout = Layout([(r["fit"], r["fit"], r["k"], r["seed"] if seeded else seed) for r in topics.collect()])  # one row a fit
    kind = dict(topics.dtypes)["seed"] if seeded else "int"
    dealt, number, dictionary = prepared(tokens.where(F.col("fit").isin(list(layout.fits))), pairs, 1)
    return learnt(dealt, number, dictionary, layout, kind, rounds, passes, phi_tau, theta_tau, decorrelation, background, smooth)


def top_words(phi: DataFrame, n: int) -> DataFrame:
    """``fit``, ``t``, ``rank``, ``word``, ``p`` of the ``n`` likeliest words of each topic; ties by word."""
    rank = F.row_number().over(T.Window.partitionBy("fit", "t").orderBy(F.desc("p"), "word"))
    return phi.select("fit", "t", rank.alias("rank"), "word", "p").where(F.col("rank") <= n)


def times_drawn(spark, total: int, draws: Iterable[tuple[int, int]], share: float) -> DataFrame:
    """``fit``, ``i`` of ``total`` numbers from 0 and how often (``times``) they are drawn, for each (fit, seed): exactly
    max(2, round(share x total)) draws with replacement, each from a hash of the seed and its number."""
    plan = [(place, fit_, seed) for place, (fit_, seed) in enumerate(draws)]
    size = max(2, round(total * share)) if total else 0
    every = spark.range(size * len(plan)).select(F.expr(f"cast(id div {max(1, size)} as int)").alias("place"), (F.col("id") % max(1, size)).alias("draw"))
    fits = F.broadcast(spark.createDataFrame(plan, "place int, fit int, seed long"))
    picks = every.join(fits, "place").select("fit", F.pmod(F.xxhash64("seed", "draw"), F.lit(max(1, total))).alias("i"))
    return picks.groupBy("fit", "i").agg(F.count(F.lit(1)).alias("times"))


def resampled(tokens: DataFrame, draws: Iterable[tuple[int, int]], share: float) -> DataFrame:
    """Tokens (``doc``, ``word``, ``n``) of a bootstrap of documents for each (fit, seed): exactly max(2, round(share x documents))
    draws with replacement, each from a hash of the seed and its number; a document drawn twice counts twice.

    Documents are numbered through by the counts of their partitions, one number a partition on the driver.
    """
    spark = tokens.sparkSession
    docs = written(tokens.select("doc").where("doc is not null").distinct().withColumn("key", F.monotonically_increasing_id()))
    counts = sorted((r["part"], r["count"]) for r in docs.groupBy(F.shiftright("key", 33).alias("part")).count().collect())
    total = sum(n for _, n in counts)
    if not total:
        return tokens.select(F.lit(0).alias("fit"), "doc", "word", "n").where("false")
    offsets, at = [], 0
    for part, n in counts:
        offsets.append((part, at))
        at += n
    base = F.broadcast(spark.createDataFrame(offsets, "part long, base long"))
    numbered = docs.join(base, F.shiftright("key", 33) == F.col("part")).select("doc", (F.col("base") + F.col("key").bitwiseAND((1 << 33) - 1)).alias("i"))
    times = times_drawn(spark, total, draws, share).join(numbered, "i")
    return tokens.join(times, "doc").select("fit", "doc", "word", (F.col("n") * F.col("times")).alias("n"))


def search(docs: DataFrame, ks: list[int], runs: int = 2, share: float = 0.8, words: int = 10, rounds: int = 8, seed: int = 1, least: int = 3, penalty: float = 0.1) -> DataFrame:
    """Per number of topics ``k``: ``coherence``, ``diversity``, ``stability``, ``score`` and which is ``best``, from fits of ``runs`` bootstraps
    each. Words in fewer than ``least`` documents are left out. All fits share one token table and their rounds."""
    spark = docs.sparkSession
    tokens = T.tokenized(docs).select(F.lit(0).alias("fit"), F.col("doc_id").alias("doc"), F.explode("tokens").alias("word"), F.lit(1).alias("n"))
    plan = [(i, k, r) for i, (k, r) in enumerate((k, r) for k in ks for r in range(runs))]
    dealt, number, dictionary = prepared(tokens, PAIRS, 1)
    common = dealt.where("part = -2").groupBy("corpus", "word").agg(F.sum("df").alias("df")).where(F.col("df") >= least).select("corpus", "word")
    dealt = weighed(restricted(dealt, number, common), number, len(plan), [(i, seed + r + 997 * k) for i, k, r in plan], share)
    topics = spark.createDataFrame([(i, k) for i, k, r in plan], "fit int, k int")
    phi, _ = learnt(dealt, number, dictionary, Layout([(0, i, k, seed + r) for i, k, r in plan]), "int", rounds, 5)
    kept = written(top_words(phi, words).join(F.broadcast(topics), "fit"))
    named = kept.select(F.struct("fit", "t").alias("topic"), "word")
    pairs = T.cooccurrence(docs, kept.select("word").distinct())
    coherence = T.coherence(named, pairs).groupBy("topic.fit").agg(F.avg("coherence").alias("coherence"))
    diverse = kept.groupBy("fit", "k").agg((F.count_distinct("word") / F.count("word")).alias("diversity"))
    means = diverse.join(coherence, "fit").groupBy("k").agg(F.avg("coherence").alias("coherence"), F.avg("diversity").alias("diversity"))
    sets = kept.groupBy("k", F.col("fit").alias("run"), F.col("t").alias("topic")).agg(F.collect_list("word").alias("words"))
    stable = [T.stability(sets.where(F.col("k") == k).drop("k")).select(F.lit(k).alias("k"), F.coalesce("stability", F.lit(0.0)).alias("stability")) for k in ks]
    both = stable[0]
    for one in stable[1:]:
        both = both.unionByName(one)
    rows = written(means.join(both, "k"))
    return rows.join(T.choose_k(rows, penalty), "k")
