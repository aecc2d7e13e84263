"""Ranked lexical search: for each item the documents of highest score, by TPUT over term-partitioned postings.

Terms are maximal runs of ASCII letters, digits and all that isn't ASCII, with A-Z in lower case. A posting's impact is
``(10^9 tf) div (1000 tf + 20 m)``, in which m follows from the document's length; an item's score of a document is the sum over
its terms of weight times impact, all in whole numbers.

1. Documents are read once into postings of the items' terms, packed per task and term. The lists are then partitioned by
   term, long ones also by a hash of the document (``LIST`` postings a part), and stored in order of impact.
2. Heads: the first ``k`` and more postings of every list give documents with partial scores; the k-th best of an item is a
   lower bound of its k-th best score. The best of them are looked up in all lists, which raises the bound.
3. Threshold: from every list all postings that bring an item its bound divided by its number of terms or more. A document
   that appears in none of them stays below the bound. Partial sums raise the bound again; a document whose partial
   sum, with the most that its missing lists may add, doesn't reach it goes. A list may be missing only where one occurrence
   in a document of that length stays below the threshold.
4. Lookup: what is left gets its exact score from all lists.

Every step reads the packed lists in numpy, meets them with what the items ask of a part by a join on (term, part), and
sums per item and range of documents. Nothing but counts passes through the driver, and the set of the items' terms where
it is small (counted; beyond ``most_terms`` all terms are posted and the items' ones joined).

Edge cases: documents without terms or text are in no list and no count; rows of one ``doc_id`` are documents of their own,
and a null id comes last among equal scores; items of one id are one item with all their terms, those without terms or text have no
rows; empty tables give no rows; texts are taken whole; further columns are not read.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, lean, mix64, release, small_side, stored

#: ASCII letters in lower case and digits stay, other ASCII characters part terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Terms whose set travels to all tasks, postings that a task gathers before it packs them, postings of a part of a list, and
#: items that meet a list's part in one row.
MOST_TERMS, FLUSH, LIST, ITEMS = 1 << 18, 1 << 22, 1 << 16, 64
#: Postings of a list's head, and documents of an item that are looked up to raise its bound, as multiples of k.
HEAD, PROBE = 4, 4


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TERMS).split()


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id`` and its ``term``s."""

    def run(batches):
        for b in batches:
            ids, texts = b.column("item_id").to_pylist(), b.column("text").to_pylist()
            rows = [(i, t.decode()) for i, x in zip(ids, texts, strict=True) if x for t in set(terms(x))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["item_id", "term"])

    told = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return told.mapInArrow(lean(run), "item_id long, term string")


def postings(docs: DataFrame, wanted: list[str] | None) -> DataFrame:
    """``kind`` 0: a row per document with its ``key`` (a number of the row), ``doc_id`` and ``words``. ``kind`` 1: a row per
    task and term with the documents' keys, occurrences and lengths, packed. All terms if none are given."""
    fixed = None if wanted is None else docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(wanted)})
    names = ["kind", "term", "size", "keys", "tf", "n", "key", "doc_id", "words"]
    types = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def batch(**columns):
        rows = max(len(c) for c in columns.values())
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in zip(names, types, strict=True)], names=names)

    def counted(found, place, size):
        """(term number, row, occurrences) of the words' numbers of some rows."""
        number, row = np.concatenate(found), np.repeat(np.arange(len(place)), place)
        number, row = number[number >= 0], row[number >= 0]
        both, tf = np.unique(row * size + number, return_counts=True)
        return both % size, both // size, tf

    def packed(parts, words):
        number, key, tf, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(number, kind="stable")
        number, key, tf, n = number[order], key[order], tf[order].astype("<i4"), n[order].astype("<i4")
        ends = np.append(np.flatnonzero(np.diff(number)) + 1, len(number)) if len(number) else []
        lo = 0
        for group in itertools.batched(np.asarray(ends).tolist(), 2000):
            cuts = list(itertools.pairwise([lo, *group]))
            yield batch(
                kind=[1] * len(cuts), term=[words[number[a]].decode() for a, _ in cuts], size=[b - a for a, b in cuts],
                **{c: [x[a:b].tobytes() for a, b in cuts] for c, x in (("keys", key), ("tf", tf), ("n", n))},
            )
            lo = group[-1]

    def run(batches):
        known = {} if fixed is None else fixed.value
        words = list(known)
        parts, held = [], 0
        for b in batches:
            keys, ids, texts = (b.column(c).to_pylist() for c in ("key", "doc_id", "text"))
            lengths, lo = [], 0
            while lo < len(texts):
                found, size, hi = [], 0, lo
                while hi < len(texts) and size < 1 << 20:
                    got = terms(texts[hi] or "")
                    if fixed is None:
                        found.append(np.fromiter((known.setdefault(w, len(known)) for w in got), np.int64, len(got)))
                    else:
                        found.append(np.fromiter(map(known.get, got, itertools.repeat(-1)), np.int64, len(got)))
                    size, hi = size + len(got), hi + 1
                place = np.array([len(x) for x in found])
                lengths += place.tolist()
                number, row, tf = counted(found, place, max(1, len(known)))
                parts.append((number, np.array(keys[lo:hi], "<i8")[row], tf, place[row]))
                held, lo = held + len(number), hi
                if held >= FLUSH:
                    yield from packed(parts, words if fixed is not None else list(known))
                    parts, held = [], 0
                    if fixed is None:
                        known = {}
                    release()
            yield batch(kind=[0] * len(keys), key=keys, doc_id=ids, words=lengths)
        if held:
            yield from packed(parts, words if fixed is not None else list(known))

    told = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return told.mapInArrow(lean(run), "kind int, term string, size int, keys binary, tf binary, n binary, key long, doc_id long, words long")


def weights(sizes: DataFrame, n_docs: int) -> DataFrame:
    """``term``, ``df`` and ``w`` of (``term``, ``df``)."""

    def run(batches):
        for b in batches:
            w = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in b.column("df").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("term"), b.column("df"), pa.array(w, pa.int64())], names=["term", "df", "w"])

    return sizes.select("term", "df").mapInArrow(run, "term string, df long, w long")


def part_of(docs: np.ndarray, parts: int) -> np.ndarray:
    """Which of so many parts a document's postings stand in."""
    return (mix64(docs) % np.uint64(parts)).astype(np.int64) if parts > 1 else np.zeros(len(docs), np.int64)


def split_by(part: np.ndarray):
    """Pairs of a number and the places that have it."""
    order = np.argsort(part, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(at):
            yield int(part[at[0]]), at


def arrow(rows: list[tuple], kinds: str) -> pa.RecordBatch:
    """Rows as a batch of the columns that ``kinds`` names."""
    known = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [(n, known[t]) for n, t in (c.split() for c in kinds.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def columns(batch, *names: str):
    return zip(*[batch.column(c).to_pylist() for c in names], strict=True)


#: A length code stands for lengths of ``50 * 2^(code / 8)`` and less, measured as ``m``.
_LONGEST = np.array([math.ceil(50 * 2 ** (code / 8)) for code in range(256)], np.int64)
#: The least impact of a term in a document of a length code; none is known of the last code.
LEAST_IMPACT = np.append(1_000_000_000 // (1000 + 20 * _LONGEST[:-1]), 0)


def lists(packed: DataFrame, starts: dict[int, int], n_docs: int, n_words: int, most: int = LIST) -> DataFrame:
    """``term``, ``part``, ``parts``, ``w``, ``top`` impact, and by falling impact the ``docs``, ``impact`` and length ``codes``,
    of packed postings with ``df`` and ``w``. Documents are numbered through by the ``starts`` of their partitions."""
    kinds = "term string, part int, parts int, w long, top long, docs binary, impact binary, codes binary"
    first = np.zeros(max(starts, default=0) + 1, np.int64)
    first[list(starts)] = list(starts.values())

    def dealt(batches):
        for b in batches:
            rows = []
            for term, df, w, keys, tf, n in columns(b, "term", "df", "w", "keys", "tf", "n"):
                key, tf, n = np.frombuffer(keys, "<i8"), np.frombuffer(tf, "<i4").astype(np.int64), np.frombuffer(n, "<i4").astype(np.int64)
                doc = first[key >> 33] + (key & ((1 << 33) - 1))
                m = 50 + (50 * n * n_docs) // n_words
                impact = ((1_000_000_000 * tf) // (1000 * tf + 20 * m)).astype("<i4")
                code = np.minimum(np.searchsorted(_LONGEST, m), 255).astype(np.uint8)
                parts = max(1, -(-df // most))
                rows += [(term, p, parts, w, 0, *[x[at].tobytes() for x in (doc, impact, code)]) for p, at in split_by(part_of(doc, parts))]
            yield arrow(rows, kinds)

    def joined(batches):
        for b in batches:
            rows = []
            for (term, part), group in itertools.groupby(columns(b, *b.schema.names), lambda r: r[:2]):
                group = list(group)
                doc, impact, code = (np.frombuffer(b"".join(r[i] for r in group), t) for i, t in ((5, "<i8"), (6, "<i4"), (7, np.uint8)))
                order = np.argsort(-impact, kind="stable")
                rows.append((term, part, *group[0][2:4], int(impact.max()), *[x[order].tobytes() for x in (doc, impact, code)]))
            yield arrow(rows, kinds)

    parted = packed.select("term", "df", "w", "keys", "tf", "n").mapInArrow(lean(dealt), kinds)
    return parted.repartition("term", "part").sortWithinPartitions("term", "part").mapInArrow(lean(joined), kinds)


def heads(listed: DataFrame, size: int) -> DataFrame:
    """``term``, ``w``, ``doc`` and ``impact`` of the first postings of every list."""
    kinds = "term string, w long, doc long, impact long"

    def run(batches):
        for b in batches:
            rows = []
            for term, w, docs, impact in columns(b, "term", "w", "docs", "impact"):
                rows += [(term, w, d, i) for d, i in zip(np.frombuffer(docs[: 8 * size], "<i8").tolist(), np.frombuffer(impact[: 4 * size], "<i4").tolist(), strict=True)]
            yield arrow(rows, kinds)

    first = listed.select("term", "w", "docs", "impact").mapInArrow(lean(run), kinds)
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "doc"))
    return first.withColumn("place", place).where(F.col("place") <= size).drop("place")


def kth(scores: DataFrame, k: int, name: str) -> DataFrame:
    """``item`` and its k-th highest ``score``, for items that have so many."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    return scores.select("item", "score", place.alias("place")).where(F.col("place") == k).select("item", F.col("score").alias(name))


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte of equal weight, as they compress better."""
    return np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def met(listed: DataFrame, asked: DataFrame, match) -> DataFrame:
    """Postings that items ask of lists, summed per item and range of 2^16 documents: ``item``, ``range``, ``docs``, ``scores``,
    ``rest``, ``codes``.

    ``asked`` has (``term``, optional ``part``) and ``asks``, an array of structs with ``item``, ``least``, ``most`` and what ``match``
    reads: match(ask, w, docs, impact, order) gives the places of the list that the item gets. ``rest`` sums ``most`` over a
    document's lists whose posting could have been missing, by the document's length.
    """
    kinds = "item long, range int, docs binary, impact binary, codes binary, w long, least long, most long"
    sums = "item long, range int, docs binary, scores binary, rest binary, codes binary"

    def sent(batches):
        for b in batches:
            rows, size = [], 0
            for w, docs, impact, codes, asks in columns(b, "w", "docs", "impact", "codes", "asks"):
                doc, impact, code = np.frombuffer(docs, "<i8"), np.frombuffer(impact, "<i4"), np.frombuffer(codes, np.uint8)
                order, ranges = np.argsort(doc), doc >> 16
                for ask in asks:
                    at = match(ask, w, doc, impact, order)
                    for r, those in split_by(ranges[at]):
                        those = at[those]
                        rows.append((ask["item"], r, doc[those].astype("<u2").tobytes(), planes(impact[those]), code[those].tobytes(), w, ask["least"], ask["most"]))
                        size += len(those)
                    if size > 1 << 18:
                        yield arrow(rows, kinds)
                        rows, size = [], 0
            yield arrow(rows, kinds)

    def summed(table):
        score, rest, code = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint8)
        some = np.zeros(1 << 16, bool)
        for docs, impact, codes, w, least, most in columns(table, "docs", "impact", "codes", "w", "least", "most"):
            at, c = np.frombuffer(docs, "<u2"), np.frombuffer(codes, np.uint8)
            some[at], code[at] = True, c
            score[at] += w * unplaned(impact).astype(np.int64)  # a document stands in a list once
            rest[at] += most * (w * LEAST_IMPACT[c] < least)
        at = np.flatnonzero(some)
        row = (table.column("item")[0].as_py(), table.column("range")[0].as_py(), at.astype("<u2").tobytes(), score[at].tobytes(), rest[at].tobytes(), code[at].tobytes())
        return pa.Table.from_batches([arrow([row], sums)])

    on = ["term", "part"] if "part" in asked.columns else ["term"]
    pairs = listed.join(asked, on).select("w", "docs", "impact", "codes", "asks")
    return pairs.mapInArrow(lean(sent), kinds).groupBy("item", "range").applyInArrow(summed, sums)


def best(summed: DataFrame, k: int, chosen: bool = False) -> DataFrame:
    """``item``, ``doc``, ``score`` of the documents of each range whose score is at least its k-th best."""
    kinds = "item long, doc long, score long"

    def run(batches):
        for b in batches:
            rows = []
            for item, r, docs, scores in columns(b, "item", "range", "docs", "scores"):
                doc, score = np.frombuffer(docs, "<u2") + (np.int64(r) << 16), np.frombuffer(scores, "<i8")
                least = np.partition(score, -k)[-k] if len(score) > k else 1
                at = np.flatnonzero(score >= max(1, least))
                if chosen and len(at) > k:  # any k do, for a bound
                    at = at[np.argsort(-score[at], kind="stable")[:k]]
                rows += [(item, d, x) for d, x in zip(doc[at].tolist(), score[at].tolist(), strict=True)]
            yield arrow(rows, kinds)

    return summed.mapInArrow(lean(run), kinds)


def asks_of(rows: DataFrame, *on: str, fields: list[str]) -> DataFrame:
    """``asks`` per term (and part), of at most ``ITEMS`` a row: a term that all items have is dealt over rows."""
    numbered = rows.withColumn("deal", (F.row_number().over(Window.partitionBy(*on).orderBy("item")) / ITEMS).cast("int"))
    return numbered.groupBy(*on, "deal").agg(F.collect_list(F.struct("item", *fields)).alias("asks")).drop("deal")


def by_threshold(ask, w, docs, impact, order):
    """The postings that bring the item its threshold: the list's beginning."""
    return np.arange(np.searchsorted(-impact, -ask["least"] // w, "right"))


def by_doc(ask, w, docs, impact, order):
    """The postings of the documents that are looked up."""
    want = np.frombuffer(ask["docs"], "<u2") + (np.int64(ask["range"]) << 16)
    at = order[np.minimum(np.searchsorted(docs, want, sorter=order), len(docs) - 1)]
    return at[docs[at] == want]


def lookup(listed: DataFrame, per_item: DataFrame, candidates: DataFrame) -> DataFrame:
    """Exact scores of ``candidates`` (``item``, ``range``, ``docs`` packed), as ``met`` gives them."""
    kinds = "term string, part int, item long, range int, docs binary, least long, most long"

    def run(batches):
        for b in batches:
            rows = []
            for item, r, docs, wanted in columns(b, "item", "range", "docs", "terms"):
                doc = np.frombuffer(docs, "<u2")
                split: dict[int, list] = {}
                for t in wanted:
                    if t["parts"] not in split:
                        split[t["parts"]] = [(p, doc[at].tobytes()) for p, at in split_by(part_of(doc + (np.int64(r) << 16), t["parts"]))]
                    rows += [(t["term"], p, item, r, x, 0, 0) for p, x in split[t["parts"]]]
                if len(rows) > 2000:
                    yield arrow(rows, kinds)
                    rows = []
            yield arrow(rows, kinds)

    held = per_item.groupBy("item").agg(F.collect_list(F.struct("term", "parts")).alias("terms"))
    rows = candidates.join(held, "item").select("item", "range", "docs", "terms").mapInArrow(lean(run), kinds)
    return met(listed, asks_of(rows, "term", "part", fields=["range", "docs", "least", "most"]), by_doc)


def packed_docs(rows: DataFrame) -> DataFrame:
    """``item``, ``range`` and ``docs``, of (``item``, ``doc``): packed in the tasks that hold them."""
    kinds = "item long, range int, docs binary"

    def run(batches):
        for b in batches:
            packs: dict[tuple, list] = {}
            for item, doc in columns(b, "item", "doc"):
                packs.setdefault((item, doc >> 16), []).append(doc & 0xFFFF)
            yield arrow([(*at, np.array(x, "<u2").tobytes()) for at, x in packs.items()], kinds)

    return rows.select("item", "doc").mapInArrow(lean(run), kinds)


def left(seen: DataFrame) -> DataFrame:
    """``item``, ``range`` and ``docs`` of the documents whose partial score, with the most that missing lists may add, reaches
    the bound. A list is missing only where even one occurrence in a document of this length stays below the threshold."""
    kinds = "item long, range int, docs binary"

    def run(batches):
        for b in batches:
            rows = []
            for item, r, docs, scores, rest, codes, least, lists, bound in columns(b, "item", "range", "docs", "scores", "rest", "codes", "least", "lists", "bound"):
                w, most = (np.array([x[c] for x in lists], np.int64) for c in ("w", "most"))
                missing = np.array([most[w * x < least].sum() for x in LEAST_IMPACT])
                highest = np.frombuffer(scores, "<i8") + missing[np.frombuffer(codes, np.uint8)] - np.frombuffer(rest, "<i8")
                rows.append((item, r, np.frombuffer(docs, "<u2")[highest >= bound].tobytes()))
            yield arrow(rows, kinds)

    return seen.mapInArrow(lean(run), kinds).where(F.length("docs") > 0)


def search(docs: DataFrame, items: DataFrame, k: int = 50, most_terms: int = MOST_TERMS, part: int = LIST) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score`` of the ``k`` best documents of every item with a score above 0."""
    spark = docs.sparkSession
    numbered = stored(items.select(F.col("item_id").cast("long")).distinct().coalesce(1).select(F.monotonically_increasing_id().alias("item"), "item_id"))
    named = item_terms(items).withColumnRenamed("item_id", "id")
    asked = stored(named.join(numbered, named["id"].eqNullSafe(numbered["item_id"])).select("item", "term").distinct())
    few = asked.select("term").distinct().limit(most_terms + 1).count() <= most_terms
    wanted = sorted(r["term"] for r in asked.select("term").distinct().collect()) if few else None

    found = stored(postings(docs, wanted), partition_by=["kind"])
    told = found.where("kind = 0").groupBy(F.shiftright("key", 33).alias("p")).agg(F.count(F.lit(1)).alias("rows"), F.count(F.expr("nullif(words, 0)")).alias("n"), F.sum("words").alias("words"))
    per_part = sorted(told.collect())  # one row a partition of the table
    n_docs, n_words = sum(r["n"] for r in per_part), sum(r["words"] for r in per_part)
    if not n_docs:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    starts = dict(zip((r["p"] for r in per_part), itertools.accumulate((r["rows"] for r in per_part), initial=0), strict=False))

    packed = found.where("kind = 1")
    if not few:
        packed = packed.join(asked.select("term").distinct(), "term", "left_semi")
    counted = stored(weights(packed.groupBy("term").agg(F.sum("size").cast("long").alias("df")), n_docs))
    listed = stored(lists(packed.join(small_side(counted, counted.count(), most_terms), "term"), starts, n_docs, n_words, part))
    tops = listed.groupBy("term").agg(F.max("top").alias("top"), F.max("w").alias("w"), F.max("parts").alias("parts"))
    per_item = stored(asked.join(tops, "term").where("w > 0"))

    first = heads(listed, HEAD * k).join(asked, "term").groupBy("item", "doc").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
    probed = packed_docs(first.withColumn("place", place).where(F.col("place") <= PROBE * k))
    bound = kth(best(lookup(listed, per_item, probed), k, chosen=True), k, "bound")

    size = per_item.groupBy("item").agg(F.count(F.lit(1)).alias("m"))
    least = size.join(bound, "item", "left").select("item", F.coalesce("bound", F.lit(1)).alias("bound"), F.greatest(F.lit(1), F.expr("(coalesce(bound, 1) + m - 1) div m")).alias("least"))
    most = F.least(F.col("least") - 1, F.col("w") * F.col("top"))
    limits = stored(per_item.join(least, "item").withColumn("most", most))
    seen = stored(met(listed, asks_of(limits.where("w * top >= least"), "term", fields=["least", "most"]), by_threshold))
    second = kth(best(seen, k, chosen=True), k, "second")
    held = limits.groupBy("item").agg(F.max("bound").alias("bound"), F.max("least").alias("least"), F.collect_list(F.struct("w", "most")).alias("lists"))
    bounds = held.join(second, "item", "left").withColumn("bound", F.greatest("bound", "second"))
    candidates = stored(left(seen.join(bounds, "item")))

    scored = stored(best(lookup(listed, per_item, candidates), k))
    ids = found.where("kind = 0 and words > 0").select("key", "doc_id")
    base = spark.createDataFrame(list(starts.items()), "p long, start long")
    ids = ids.join(F.broadcast(base), F.shiftright("key", 33) == F.col("p")).select((F.col("start") + F.col("key").bitwiseAND((1 << 33) - 1)).alias("doc"), "doc_id")
    results = ids.join(small_side(scored, scored.count(), most_terms), "doc")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "doc"))
    ranked = stored(results.withColumn("rank", rank).where(F.col("rank") <= k).join(numbered, "item").select("item_id", "rank", "doc_id", "score"))
    discard(spark, found, listed, seen, candidates)
    return ranked
