"""Personal data in texts: fixed patterns give seeds, and bootstrapped contexts find identifiers of other shapes.

1. Every text is read once. The four base patterns give its base spans. Other runs that look like an identifier
   (numbers of 7 to 19 digits in any grouping, addresses with a spelt or single-part domain) are mentions without a kind.
2. Base spans and mentions are instances (by value) and the words around them lexical patterns: the word before, the two words
   before, the words on both sides. Distinct pairs are the edges of a graph, so copies of a text count once.
3. A pattern with at least ``LEAST`` known instances of a kind has the confidence known / (all instances + 1), times the share of
   the pattern's occurrences in the whole corpus that hold an identifier at all, so that "the" is no sign of a telephone.
   An unknown instance scores 1 - product of (1 - confidence) over its patterns; from ``ACCEPT`` on it is known in the
   next round. Rounds go on until none is added.
4. All mentions of instances that became known are added to their documents' spans. They never overlap a base span.

The graph lives in Spark tables; texts are read twice, for mentions and for the patterns' occurrences, and only where patterns
have enough seeds the second time. Patterns travel to the tasks in groups of at most ``MOST`` (one pass a group).

Edge cases: a null text counts as empty and has no spans; null ids and repeated rows are documents of their own; an empty table
gives no rows; texts are taken whole, in time that grows with their length; further columns are not read. An instance
of two possible kinds takes the higher score, then the kind listed first.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, small_side, stored, texts

#: The kinds, in their order.
KINDS = ("email", "ip", "card", "phone")
LEAST, ACCEPT, MOST = 3, 0.8, 1 << 17

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: A number in any grouping, and an address whose sign or points may be spelt.
_NUMBER = re.compile(r"(?<![A-Za-z0-9_@.+-])[+(]?[0-9](?:[\x20().:/-]{0,2}[0-9]){6,40}+(?![A-Za-z0-9_@])")
_SIGN = re.compile(r"@|\x20?[\[({](?:at|AT)[\])}]\x20?|\x20at\x20(?=[A-Za-z0-9-]{1,63}(?:\x20dot\x20|\.[A-Za-z]))")
_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[({](?:dot|DOT)[\])}]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63})*+")
_SPELT = [(re.compile(r"\x20?[\[({]at[\])}]\x20?|\x20at\x20"), "@"), (re.compile(r"\x20?[\[({]dot[\])}]\x20?|\x20dot\x20"), ".")]
_FOUR = re.compile(r"[0-9]{1,3}(?:[.:\x20-][0-9]{1,3}){3}")
_NORMAL = {**{c: c + 32 for c in range(65, 91)}, **{c: 48 for c in range(48, 58)}}


def local_start(text: str, sign: int, least: int) -> int:
    """Where the run of an address's local characters before ``sign`` begins."""
    lo = sign
    while lo > least and text[lo - 1] in _LOCAL:
        lo -= 1
    return lo


def emails(text: str):
    end, sign = 0, text.find("@")
    while sign >= 0:
        lo = local_start(text, sign, end)
        if lo < sign and (m := _DOMAIN.match(text, sign + 1)):
            end = m.end()
            yield lo, end
        sign = text.find("@", max(sign + 1, end))


def ips(text: str):
    for m in _CHAIN.finditer(text):
        parts = m.group().split(".")
        lo = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            hi = lo + sum(map(len, four)) + 3
            if all(len(x) <= 3 or not x[:-3].strip("0") for x in four) and all(int(x[-3:]) <= 255 for x in four):
                yield lo, hi
            lo = hi + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str):
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str):
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGIT.findall(m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) by start, then kind."""
    found = [(lo, 0, hi) for lo, hi in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(lo, 1, hi) for lo, hi in ips(text)] + [(lo, 2, hi) for lo, hi in cards(text)]
        found += [(lo, 3, hi) for lo, hi in phones(text)] if "+" in text else []
    return sorted(found)


def value(kinds: int, said: str) -> str:
    """What an instance is known by: an address in one spelling, or digits."""
    if kinds & 1:
        said = said.lower()
        for spelt, sign in _SPELT:
            said = spelt.sub(sign, said)
        return said
    if kinds == 2:
        return re.sub(r"[^0-9]", ".", said)
    return "".join(_DIGIT.findall(said))


def looks(text: str, base: list[tuple[int, int, int]]):
    """(start, end, kinds) of other runs that look like identifiers, outside the base spans; ``kinds`` is a set of bits."""
    taken, i, found = sorted((lo, hi) for lo, _, hi in base), 0, []
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            n = len(_DIGIT.findall(m.group()))
            kinds = 8 * (n <= 15) + 4 * (13 <= n <= 19) + 2 * bool(_FOUR.fullmatch(m.group()))
            if kinds:
                found.append((*m.span(), kinds))
    end = 0
    for m in _SIGN.finditer(text):
        lo = local_start(text, m.start(), max(end, m.start() - 64))
        if lo < m.start() and (host := _HOST.match(text, m.end())):
            end = host.end()
            found.append((lo, end, 1))
    reach = 0
    for lo, hi, kinds in sorted(found):
        while i < len(taken) and taken[i][0] < hi:
            reach = max(reach, taken[i][1])
            i += 1
        if lo >= reach:
            reach = hi
            yield lo, hi, kinds


def contexts(text: str, lo: int, hi: int) -> list[str]:
    """The patterns around a place: the word before, the two words before, the words on both sides."""
    before = text[max(0, lo - 80) : lo].translate(_NORMAL).split()[-2:]
    behind = text[hi : hi + 40].translate(_NORMAL).split(None, 1)[:1] or ["$"]
    one = before[-1] if before else "^"
    return [f"1 {one}", f"3 {one} {behind[0]}", *([f"2 {before[0]} {one}"] if len(before) == 2 else [])]


def mentions(docs: DataFrame) -> DataFrame:
    """Per document ``key`` (a number of the row), ``doc_id``, ``base`` spans and ``found``, all instances with their patterns."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    seen = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kinds", pa.int32()), ("seed", pa.bool_()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])
    fields = [("key", pa.int64()), ("doc_id", pa.int64()), ("base", pa.list_(span)), ("found", pa.list_(seen))]

    def run(batches):
        for b in batches:
            spans, found = [], []
            for text in b.column("text").to_pylist():
                base = base_spans(text)
                spans.append([{"kind": KINDS[k], "start": lo, "end": hi} for lo, k, hi in base])
                every = [(lo, hi, 1 << k, True) for lo, k, hi in base] + [(*x, False) for x in looks(text, base)]
                found.append([{"start": lo, "end": hi, "kinds": k, "seed": s, "value": value(k, text[lo:hi]), "patterns": contexts(text, lo, hi)} for lo, hi, k, s in every])
            arrays = [b.column("key"), b.column("doc_id"), pa.array(spans, fields[2][1]), pa.array(found, fields[3][1])]
            yield pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])

    kinds = "key long, doc_id long, base array<struct<kind: string, start: long, end: long>>, found array<struct<start: long, end: long, kinds: int, seed: boolean, value: string, patterns: array<string>>>"
    return texts(docs).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text").mapInArrow(lean(run), kinds)


def occurrences(docs: DataFrame, patterns: list[str]) -> DataFrame:
    """``pattern`` and ``slots``, how often the corpus has its words, one unknown word between those on both sides; summed per task."""
    known = docs.sparkSession.sparkContext.broadcast([{p[2:] for p in patterns if p[0] == kind} for kind in "123"])

    def run(batches):
        one, two, both = known.value
        first, last = {p.split(" ")[0] for p in two}, {p.split(" ")[0] for p in both}
        total: Counter = Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                words = text.translate(_NORMAL).split()
                if not words:
                    continue
                count = Counter(words)
                total.update({f"1 {w}": count[w] for w in one & count.keys()})
                total["1 ^"] += 1
                if first & count.keys():
                    total.update(f"2 {p}" for p in map(" ".join, zip(words, words[1:], strict=False)) if p in two)
                if last & count.keys() or "^" in last:
                    around = zip(["^", *words], [*words[1:], "$"], strict=False)
                    total.update(f"3 {p}" for p in map(" ".join, around) if p in both)
        rows = [(p, n) for p, n in total.items() if n]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["pattern", "slots"])

    return texts(docs).select("text").mapInArrow(lean(run), "pattern string, slots long")


def bits(kinds: str):
    """``kinds`` as an array of kind numbers."""
    return F.array_compact(F.array(*[F.when(F.expr(f"{kinds} & {1 << k} <> 0"), F.lit(k)) for k in range(len(KINDS))]))


def bootstrap(docs: DataFrame, found: DataFrame, least: int = LEAST, accept: float = ACCEPT, most: int = MOST) -> DataFrame:
    """``value``, ``kind`` (a number) of the instances that are no seeds and became known, from all instances ``found``
    (``kinds``, ``seed``, ``value``, ``patterns``)."""
    spark = found.sparkSession
    edges = found.select("value", "kinds", "seed", F.explode("patterns").alias("pattern"))
    pairs = stored(edges.groupBy("pattern", "value").agg(F.expr("bit_or(kinds)").alias("kinds"), F.count(F.lit(1)).alias("times")))
    seeds = found.where("seed").select("value", F.explode(bits("kinds")).alias("kind")).distinct()
    known = stored(seeds.withColumn("new", F.lit(False)))
    size = pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("values"), F.sum("times").alias("filled"))
    #: Only what has enough instances of any sort can ever have enough known ones.
    likely = stored(size.where(F.col("values") >= least))
    told = likely.count()
    if not told or not known.limit(1).count():
        return known.where("new").select("value", "kind")
    groups = -(-told // most)
    counts = None
    for g in range(groups):
        chosen = [r["pattern"] for r in likely.where(F.pmod(F.xxhash64("pattern"), F.lit(groups)) == g).select("pattern").collect()]
        some = occurrences(docs, chosen).groupBy("pattern").agg(F.sum("slots").alias("slots"))
        counts = some if counts is None else counts.unionByName(some)
    share = F.least(F.lit(1.0), F.col("filled") / F.greatest("filled", F.coalesce("slots", "filled")))
    shares = stored(likely.join(counts, "pattern", "left").select("pattern", "values", share.alias("share")))
    able = stored(pairs.join(small_side(shares, told, most), "pattern"))  # edges of patterns that may count
    discard(spark, pairs, likely)

    while True:
        hits = able.join(known.select("value", "kind"), "value").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("hits"), F.first("values").alias("values"), F.first("share").alias("share"))
        confidence = F.col("hits") / (F.col("values") + 1) * F.col("share")
        trusted = hits.where(F.col("hits") >= least).select("pattern", F.col("kind").alias("of"), confidence.alias("confidence")).where("confidence >= 0.1")
        unknown = able.join(known.select("value").distinct(), "value", "left_anti").select("pattern", "value", F.explode(bits("kinds")).alias("of"))
        missed = F.sum(F.log(1 - F.col("confidence")))
        scored = unknown.join(trusted, ["pattern", "of"]).groupBy("value", "of").agg(F.round(1 - F.exp(missed), 9).alias("score"))
        top = scored.groupBy("value").agg(F.max(F.struct("score", (-F.col("of")).alias("first"))).alias("top"))
        added = top.where(F.col("top.score") >= accept).select("value", (-F.col("top.first")).cast("int").alias("kind"), F.lit(True).alias("new"))
        added = stored(added)
        if not added.limit(1).count():
            return known.where("new").select("value", "kind")
        known = stored(known.unionByName(added))


def find(docs: DataFrame, least: int = LEAST, accept: float = ACCEPT, most: int = MOST) -> DataFrame:
    """Per document ``doc_id``, ``base`` and ``added``: arrays of spans (``kind``, ``start``, ``end``; code points, end exclusive)."""
    told = stored(mentions(docs))
    every = told.select("key", F.explode("found").alias("x")).select("key", "x.*")
    known = stored(bootstrap(docs, every.drop("key"), least, accept, most))
    names = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    spans = every.where("not seed").join(small_side(known, known.count(), most), "value").select("key", F.struct(names.alias("kind"), "start", "end").alias("span"))
    more = spans.groupBy("key").agg(F.sort_array(F.collect_list("span")).alias("added"))
    none = F.array().cast("array<struct<kind: string, start: long, end: long>>")
    return told.select("key", "doc_id", "base").join(more, "key", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def number_of(spans, kind: str):
    """A column: how many of the spans are of the kind."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def joined(spans):
    """A column of spans as ``kind:start:end``, by start, then kind as listed, then end."""
    place = F.array(*map(F.lit, KINDS))
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.array_position(place, x["kind"]).alias("place"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
