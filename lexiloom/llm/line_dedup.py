"""Line dedup by a segment-partition edit join.

Lines are equal in kind if they are equal, or if they differ by few insertions, deletions and
substitutions: as many as ``EDITS`` allows for the shorter one's length, so a long line may differ by
more. Kinds are closed under this relation. Of each kind the first line in the order of ``doc_id`` and
line number stays, the others go.

The join: a line of length l that may differ by k edits is cut into k + 1 segments, one of which any
line within the threshold must contain unchanged near the same place. Segments are indexed under (l,
number, hash); every line probes, for each length it can match, the substrings that the multi-match
rule leaves. A key with few lines gives pairs; one with many ties its lines to one of them, in the
tasks before the shuffle as well as after it. Pairs and ties are verified by the banded bit-parallel
edit distance, many at a time. Lines that ties connect are a family; where verified links don't make
it one already, its lines are compared further, by ranges of length: those linked with the
largest part go to one block each, the others meet every block. Equal lines are one line throughout,
and are counted inside tasks before any shuffle. Lines go by 64-bit hashes; their text is fetched
only for candidates.

Edge cases: null and empty texts have no lines that count; blank lines never count as repeated, nor
lines of fewer than ``least_words`` words (1: all others count); lines too short for an edit must be
equal; rows that repeat id and text are one document; null ids come first in the order; an empty
table gives no rows; further columns are carried on by ``keep`` and not read by ``dedup``. A line of any
length is compared whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mix64, small_side, stored, texts
from .components import Forest, components
from .words import powers, spread

#: Edits allowed from a length in characters on.
EDITS = ((24, 1), (64, 2), (160, 3), (400, 4))
#: Keys with more lines than this tie each line to one of them.
FEW = 32
BLOCK = 512
#: Characters of pairs that are verified at a time, and kinds of characters that are counted before.
CELLS, BAGS = 2_000_000, 32
#: Lines of one family meet by ranges of this many lengths.
RANGE = 16
#: Families, and ranges of them, whose facts are broadcast, so that a large one isn't gathered for a join.
FEW_FAMILIES = 200_000
#: Entries of a broadcast table of lines; above it shuffle joins take over.
MOST = 2_000_000
LOWEST = -(2**63)


def line_ids(lines: list[str]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(x.encode("utf-8", "replace")) for x in lines), np.uint64, len(lines)).view(np.int64)


def counted(text: str, least_words: int) -> list[tuple[int, str]]:
    """Numbers and texts of the lines that count."""
    if least_words == 1:
        return [(i, x) for i, x in enumerate(text.split("\n")) if x and not x.isspace()]
    return [(i, x) for i, x in enumerate(text.split("\n")) if len(x.split(None, least_words)) >= least_words]


def lines_in(values, least_words: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of several texts: the text's place and the number of each counted line, and the lines."""
    owner, number, lines = [], [], []
    for k, text in enumerate(values):
        found = counted(text, least_words)
        owner += [k] * len(found)
        number += [i for i, _ in found]
        lines += [x for _, x in found]
    return np.array(owner, np.int64), np.array(number, np.int64), lines


def allowed(length: int, edits) -> int:
    return max((k for least, k in edits if length >= least), default=0)


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """Start and size of each part; later parts take the remainder."""
    base, more = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        size = base + (i >= parts - more)
        out.append((at, size))
        at += size
    return out


def probes(length: int, edits) -> list[tuple[int, int, int, int, int]]:
    """(probe, indexed length, segment number, start, size) of a line's substrings: first those it is
    indexed by, then those to look up, for partners that are not longer."""
    own = [(0, length, i, p, size) for i, (p, size) in enumerate(segments(length, allowed(length, edits) + 1))]
    more, most = [], allowed(length, edits)
    for l in range(max(1, length - most), length + 1):
        k, delta = allowed(l, edits), length - l
        if not k or delta > k:
            continue
        for i, (p, size) in enumerate(segments(l, k + 1)):
            lo = max(p - i, p + delta - (k - i), 0)
            hi = min(p + i, p + delta + (k - i), length - size)
            more += [(1, l, i, at, size) for at in range(lo, hi + 1) if delta or at != p]
    return own + more


class Plans:
    """``probes`` of the lengths met so far, one after another in arrays."""

    def __init__(self, edits):
        self.edits, self.at, self.rows, self.flat = edits, {}, [], np.zeros((0, 5), np.int64)

    def of(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each length."""
        if len(self.at) > 20_000:
            self.__init__(self.edits)
        kinds, back = np.unique(lengths, return_inverse=True)
        for n in kinds.tolist():
            if n not in self.at:
                rows = probes(n, self.edits)
                self.at[n] = (len(self.rows), len(rows))
                self.rows += rows
        if len(self.rows) > len(self.flat):
            self.flat = np.array(self.rows, np.int64)
        where = np.array([self.at[n] for n in kinds.tolist()], np.int64).reshape(-1, 2)
        return where[back, 0], where[back, 1]


def keys(lines: list[str], plans: Plans) -> tuple[np.ndarray, np.ndarray]:
    """Signed 64-bit keys of all probes of the lines, whose last bit says that a key is only looked
    up, and the line each belongs to."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    power, back = powers(len(codes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power)])
    first, count = plans.of(size)
    rows = plans.flat[spread(first, count)]
    owner = np.repeat(np.arange(len(lines)), count)
    start = np.repeat(np.cumsum(size) - size, count) + rows[:, 3]
    h = (sums[start + rows[:, 4]] - sums[start]) * back[np.minimum(start, len(codes) - 1)]
    h = mix64(h ^ mix64((rows[:, 1] * 64 + rows[:, 2]).astype(np.uint64)))
    return ((h & ~np.uint64(1)) | rows[:, 0].astype(np.uint64)).view(np.int64), owner


def bags(lines: list[str]) -> np.ndarray:
    """[lines, BAGS] counts of characters by code; an edit changes their sum of differences by at most 2."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    out = np.empty((len(lines), BAGS), np.int32)
    ends = np.cumsum(size)
    lo = 0
    while lo < len(lines):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + CELLS, "right")))
        codes = np.frombuffer("".join(lines[lo:hi]).encode("utf-32-le", "surrogatepass"), np.uint32) % BAGS
        at = np.repeat(np.arange(hi - lo) * BAGS, size[lo:hi]) + codes
        out[lo:hi] = np.bincount(at, minlength=(hi - lo) * BAGS).reshape(hi - lo, BAGS)
        lo = hi
    return out


def within(a: list[str], b: list[str], edits=EDITS) -> np.ndarray:
    """Whether each pair differs by at most the edits allowed for the shorter one: bit-parallel
    rows of a diagonal band, for as many pairs at a time as have ``CELLS`` characters.

    A 64-bit word holds the band's vertical differences; its top bit is the band's lower edge,
    which moves along a diagonal until it meets the end of the pattern and then along that row.
    """
    n = len(a)
    la, lb = np.fromiter(map(len, a), np.int64, n), np.fromiter(map(len, b), np.int64, n)
    short, long = np.minimum(la, lb), np.maximum(la, lb)
    k = np.zeros(n, np.int64)
    for least, e in edits:
        k[short >= least] = e
    out = np.fromiter((x == y for x, y in zip(a, b, strict=True)), bool, n)
    todo = np.flatnonzero(~out & (long - short <= k) & (k > 0))
    for e in np.unique(k[todo]).tolist():
        rows = todo[k[todo] == e]
        sure = rows[long[rows] <= e]
        out[sure] = True
        rows = rows[long[rows] > e]
        rows = rows[np.argsort(long[rows], kind="stable")]
        while len(rows):
            # the longest line of a part sets its width
            fits = max(1, int(np.searchsorted(long[rows] * np.arange(1, len(rows) + 1), CELLS, "right")))
            part, rows = rows[:fits], rows[fits:]
            swap = la[part] < lb[part]
            x = [b[i] if s else a[i] for i, s in zip(part.tolist(), swap.tolist(), strict=True)]
            y = [a[i] if s else b[i] for i, s in zip(part.tolist(), swap.tolist(), strict=True)]
            out[part] = _banded(x, y, e)
    return out


def _codes(values: list[str], width: int, before: int, fill: int) -> np.ndarray:
    """[width, values] code points of each text, ``before`` rows down."""
    grid = np.full((len(values), width), fill, np.uint32)
    for row, x in zip(grid, values, strict=True):
        data = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
        row[before : before + len(data)] = data
    return np.ascontiguousarray(grid.T)


def _banded(a: list[str], b: list[str], edits: int) -> np.ndarray:
    la, lb = np.array(list(map(len, a))), np.array(list(map(len, b)))
    steps = int(lb.max(initial=0))
    pattern = _codes(a, int(max(la.max(initial=0), steps)) + 2 * edits + 2, edits, 0xFFFFFFFF)
    text = _codes(b, steps + 1, 0, 0xFFFFFFFE)
    one, full = np.uint64(1), np.uint64(2**64 - 1)
    top = np.uint64(63)
    low = 63 - 2 * edits
    vp = np.full(len(a), (full << np.uint64(63 - edits)) & full, np.uint64)
    vn = np.zeros(len(a), np.uint64)
    score = np.full(len(a), edits, np.int64)
    row = np.full(len(a), 62, np.int64)  # bit of the pattern's end, once the band has met it
    diagonal_until = la - edits
    for i in range(steps):
        eq = np.zeros(len(a), np.uint64)
        for k in range(2 * edits + 1):
            eq |= (pattern[i + k] == text[i]).astype(np.uint64) << np.uint64(low + k)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        active = i < lb
        diagonal = active & (i < diagonal_until)
        flat = active & ~diagonal
        score[diagonal] += ((d0[diagonal] >> top) & one) == 0
        if flat.any():
            at = row[flat].astype(np.uint64)
            score[flat] += ((hp[flat] >> at) & one).astype(np.int64) - ((hn[flat] >> at) & one).astype(np.int64)
            row[flat] -= 1
        vp, vn = hn | ~((d0 >> one) | hp), (d0 >> one) & hp
    return score <= edits


def first_lines(docs: DataFrame, least_words: int, most: int = 500_000) -> DataFrame:
    """``lid``, ``first`` (doc, line) and ``n`` of each counted line."""

    def run(frames):
        held, kept = [], 0

        def rows():
            lid, doc, line, n = map(np.concatenate, zip(*held, strict=True))
            order = np.lexsort((line, doc, lid))
            lid, doc, line, n = lid[order], doc[order], line[order], n[order]
            new = np.flatnonzero(np.r_[True, lid[1:] != lid[:-1]])
            held[:] = [(lid[new], doc[new], line[new], np.add.reduceat(n, new))]
            return held[0]

        for pdf in frames:
            owner, number, lines = lines_in(pdf["text"], least_words)
            if len(lines):
                ids = pdf["doc_id"].fillna(LOWEST).astype("int64").to_numpy()
                held.append((line_ids(lines), ids[owner], number, np.ones(len(lines), np.int64)))
                kept += len(lines)
            if kept > most:
                kept = len(rows()[0])  # repeats are counted together
                if 2 * kept > most:
                    yield pd.DataFrame(dict(zip(("lid", "doc", "line", "n"), held[0], strict=True)))
                    held, kept = [], 0
        if held:
            yield pd.DataFrame(dict(zip(("lid", "doc", "line", "n"), rows(), strict=True)))

    parts = texts(docs).mapInPandas(lean(run), "lid long, doc long, line long, n long")
    return parts.groupBy("lid").agg(F.min(F.struct("doc", "line")).alias("first"), F.sum("n").alias("n"))


def _fresh(ids: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """First places of ids that are not in ``seen`` (rising)."""
    ids, first = np.unique(ids, return_index=True)
    if len(seen):
        place = np.minimum(np.searchsorted(seen, ids), len(seen) - 1)
        first = first[seen[place] != ids]
    return np.sort(first)


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal keys."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return start, np.diff(np.r_[start, len(key)])


_EDGE = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def spread_keys(docs: DataFrame, found: DataFrame, least_words: int, edits) -> DataFrame:
    """``key``, ``a`` (a line) of each key; with ``b``, a line that is tied to ``a`` by a key which is
    frequent in one batch: that key then goes on with ``a`` alone.

    A line that repeats gives keys where it first stands; only if more than ``MOST`` lines repeat, every
    task gives the keys of the lines it has.
    """
    spark = docs.sparkSession
    again = found.where("n > 1").select("lid", F.col("first.doc").alias("doc"), F.col("first.line").alias("line"))
    known = again.toPandas().sort_values("lid") if again.count() <= MOST else None
    shared = spark.sparkContext.broadcast(None if known is None else tuple(known[c].to_numpy(np.int64) for c in ("lid", "doc", "line")))
    shortest = min((least for least, k in edits if k), default=0)

    def batch(key, lid):
        key, other = key.copy(), np.zeros(len(key), np.int64)
        order = np.argsort(key >> 1, kind="stable")
        start, size = _grouped((key >> 1)[order])
        for s, n in zip(start[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
            own = order[s : s + n]
            first = own[np.argmin(key[own])]  # an indexed one if there is any
            rest = own[own != first]
            other[rest], lid[rest] = lid[rest], lid[first]
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(lid), pa.array(other, mask=other == 0)], schema=_EDGE)

    def run(batches):
        plans, seen, firsts = Plans(edits), np.zeros(0, np.int64), shared.value
        for b in batches:
            owner, number, lines = lines_in(b.column("text").to_pylist(), least_words)
            long = np.array([i for i, x in enumerate(lines) if len(x) >= shortest], np.int64)
            ids = line_ids([lines[i] for i in long])
            if firsts is not None and len(long):
                doc = np.array([LOWEST if d is None else d for d in b.column("doc_id").to_pylist()], np.int64)[owner[long]]
                place = _inside(firsts[0], ids)
                own = (place < 0) | ((firsts[1][place] == doc) & (firsts[2][place] == number[long])) if len(firsts[0]) else np.ones(len(ids), bool)
                long, ids = long[own], ids[own]
            if not len(long):
                continue
            lines = [lines[i] for i in long]
            fresh = _fresh(ids, seen)
            if len(seen) > 2_000_000:
                seen = np.zeros(0, np.int64)
            seen = np.union1d(seen, ids[fresh])
            for lo in range(0, len(fresh), 4096):
                part = fresh[lo : lo + 4096]
                key, owner = keys([lines[i] for i in part], plans)
                yield batch(key, ids[part][owner])

    return texts(docs).mapInArrow(lean(run), "key long, a long, b long")


def candidate_edges(docs: DataFrame, found: DataFrame, least_words: int, edits) -> DataFrame:
    """Edges (``a`` < ``b``, ``sure``) of lines that share a key; ``sure`` ones are ties."""
    rows = spread_keys(docs, found, least_words, edits)
    ordered = rows.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")

    def run(batches):
        key, lid = np.zeros(0, np.int64), np.zeros(0, np.int64)
        hot, first = None, 0  # a key that more lines follow than FEW, and the line they are tied to

        def edges(a, b, sure):
            a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
            keep = a != b
            a, b = a[keep], b[keep]
            return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "sure": sure})

        def close(key, lid):
            nonlocal hot, first
            h = key >> 1
            if hot is not None:
                n = int(np.searchsorted(h, hot, "right"))
                if n:
                    yield edges(np.full(n, first), lid[:n], True)
                key, lid, h = key[n:], lid[n:], h[n:]
                if len(h):
                    hot = None
            again = np.zeros(len(h), bool)
            again[1:] = h[1:] == h[:-1]
            again[:-1] |= again[1:]
            key, lid = key[again], lid[again]
            order = np.lexsort((lid, key))
            key, lid = key[order], lid[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (lid[1:] != lid[:-1])] if len(key) else np.zeros(0, bool)
            key, lid = key[new], lid[new]  # the same line from another task
            start, size = _grouped(key >> 1)
            left, right = [], []
            for s, n in zip(start[size > 1].tolist(), size[size > 1].tolist(), strict=True):
                own, of = lid[s : s + n].tolist(), n - int((key[s : s + n] & 1).sum())
                if n > FEW:
                    if of:
                        yield edges(np.full(n, own[0]), own, True)
                    continue
                for i in range(of):
                    left += [own[i]] * (n - i - 1)
                    right += own[i + 1 :]
            if left:
                yield edges(left, right, False)

        for b in batches:
            key = np.concatenate([key, b.column(0).to_numpy()])
            lid = np.concatenate([lid, b.column(1).to_numpy()])
            tie = b.column(2)
            if tie.null_count < len(tie):
                at = np.flatnonzero(tie.is_valid().to_numpy(zero_copy_only=False))
                yield edges(b.column(1).to_numpy()[at], tie.drop_null().to_numpy(), True)
            if len(key) < 100_000:
                continue
            h = key >> 1
            cut = int(np.searchsorted(h, h[-1], "left"))
            if cut:
                yield from close(key[:cut], lid[:cut])
            key, lid = key[cut:], lid[cut:]
            if len(key) > 10 * FEW:
                if hot != (key[0] >> 1):
                    hot, first = key[0] >> 1, lid[0]
                yield edges(np.full(len(lid), first), lid, True)
                key, lid = key[:0], lid[:0]
        yield from close(key, lid)

    def arrow(batches):
        for pdf in run(batches):
            if len(pdf):
                yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)

    return ordered.mapInArrow(lean(arrow), "a long, b long, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure"))


def lines_of(docs: DataFrame, wanted: DataFrame, least_words: int) -> DataFrame:
    """``lid`` and ``line`` of the lines in ``wanted`` (one column of distinct lids)."""
    spark = docs.sparkSession
    few = wanted.count() <= MOST
    shared = spark.sparkContext.broadcast(np.sort(wanted.toPandas().iloc[:, 0].to_numpy(np.int64)) if few else None)

    def run(frames):
        have, seen = shared.value, np.zeros(0, np.int64)
        for pdf in frames:
            _, _, lines = lines_in(pdf["text"], least_words)
            ids = line_ids(lines)
            at = _fresh(ids, seen)
            if few:
                at = at[_inside(have, ids[at]) >= 0]
            if len(seen) > 1_000_000:
                seen = np.zeros(0, np.int64)
            seen = np.union1d(seen, ids[at])
            if len(at):
                yield pd.DataFrame({"lid": ids[at], "line": [lines[i] for i in at]})

    rows = texts(docs).select("text").mapInPandas(lean(run), "lid long, line string")
    if not few:
        rows = rows.join(wanted.toDF("lid"), "lid", "left_semi")
    return rows.groupBy("lid").agg(F.first("line").alias("line"))


def _inside(have: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Place of each id among the rising ``have``, -1 where it isn't."""
    if not len(have):
        return np.full(len(ids), -1)
    place = np.minimum(np.searchsorted(have, ids), len(have) - 1)
    return np.where(have[place] == ids, place, -1)


def family_links(lids: list[int], lines: list[str], settled: np.ndarray, part: int, parts: int, edits=EDITS) -> list[tuple[int, int]]:
    """A forest of the links between a line that isn't settled and any other. Of two unsettled lines, the
    part of the family in which they are compared follows from their ids."""
    size, bag, own = np.fromiter(map(len, lines), np.int64, len(lines)), bags(lines), np.array(lids, np.int64)
    most = np.zeros(len(lines), np.int64)
    for least, k in edits:
        most[size >= least] = k
    forest, left, right, held = Forest(), [], [], 0

    def flush():
        for x, y, ok in zip(left, right, within([lines[x] for x in left], [lines[y] for y in right], edits), strict=True):
            if ok:
                forest.join(lids[x], lids[y])
        left.clear()
        right.clear()

    free = np.flatnonzero(~settled)
    done = np.zeros(len(lines), bool)
    for x in free.tolist():
        done[x] = True
        k = np.minimum(most, most[x])
        near = ~done & (np.abs(size - size[x]) <= k) & (settled | ((own ^ own[x]) % parts == part))
        at = np.flatnonzero(near)
        at = at[np.abs(bag[at] - bag[x]).sum(axis=1) <= 2 * k[at]]
        root = forest.root(lids[x])
        at = [y for y in at.tolist() if forest.root(lids[y]) != root]
        left += [x] * len(at)
        right += at
        held += len(at) * int(size[x] + 1)
        if held > CELLS:
            flush()
            held = 0
    flush()
    return [(x, r) for x in forest.up if (r := forest.root(x)) != x]


def line_links(docs: DataFrame, found: DataFrame, least_words: int, edits) -> DataFrame:
    """Verified links (``a``, ``b``) that connect the lines within the threshold."""
    edges = stored(candidate_edges(docs, found, least_words, edits))
    wanted = edges.select("a").union(edges.select("b")).distinct()
    line = stored(lines_of(docs, wanted, least_words))
    pairs = edges.select("a", "b").join(line.select(F.col("lid").alias("a"), F.col("line").alias("la")), "a").join(line.select(F.col("lid").alias("b"), F.col("line").alias("lb")), "b")

    def verify(frames):
        for pdf in frames:
            yield pdf.loc[within(pdf["la"].tolist(), pdf["lb"].tolist(), edits), ["a", "b"]]

    direct = stored(pairs.mapInPandas(lean(verify), "a long, b long"))
    linked = components(direct).withColumnRenamed("component", "kind")
    family = components(edges.where("sure").select("a", "b")).join(linked, "node", "left").select("node", F.col("component").alias("f"), F.coalesce("kind", "node").alias("kind"))
    # the largest linked part of each family, where it is not all of it
    part = family.groupBy("f", "kind").agg(F.count(F.lit(1)).alias("n"))
    top = part.groupBy("f").agg(F.max(F.struct("n", "kind")).alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("f", F.col("m.kind").alias("top"))
    top = stored(top)
    members = stored(family.join(small_side(top, top.count(), FEW_FAMILIES), "f").join(line, F.col("node") == F.col("lid")).select("f", "lid", "line", (F.col("kind") == F.col("top")).alias("settled"), F.char_length("line").alias("size")))
    most = max((k for _, k in edits), default=0)
    low = F.floor(F.col("size") / RANGE)
    # a line near the end of its range of lengths meets the longer ones of the next range there
    ranged = members.withColumn("r", F.explode(F.when(F.floor((F.col("size") + most) / RANGE) > low, F.array(low, low + 1)).otherwise(F.array(low))))
    blocks = ranged.groupBy("f", "r").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"), F.count_if(~F.col("settled")).alias("free")).where("free > 0")
    blocks = stored(blocks)
    dealt = ranged.join(small_side(blocks, blocks.count(), FEW_FAMILIES), ["f", "r"]).withColumn("part", F.explode(F.when(F.col("settled"), F.array(F.pmod("lid", "parts"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))))
    dealt = dealt.select("f", "r", "part", "parts", "lid", "line", "settled").repartition("f", "r", "part").sortWithinPartitions("f", "r", "part")

    def run(frames):
        at, held = None, []

        def links():
            lids, lines, settled = zip(*held, strict=True)
            return family_links(list(lids), list(lines), np.array(settled, bool), at[2], at[3], edits)

        for pdf in frames:
            out = []
            for f, r, p, n, lid, x, s in zip(pdf["f"].tolist(), pdf["r"].tolist(), pdf["part"].tolist(), pdf["parts"].tolist(), pdf["lid"].tolist(), pdf["line"], pdf["settled"].tolist(), strict=True):
                if (f, r, p, n) != at:
                    if len(held) > 1:
                        out += links()
                    at, held = (f, r, p, n), []
                held.append((lid, x, s))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])
        if len(held) > 1:
            yield pd.DataFrame(links(), columns=["a", "b"]).astype("int64")

    return stored(direct.unionByName(dealt.mapInPandas(lean(run), "a long, b long")))


def repeated(docs: DataFrame, edits=EDITS, least_words: int = 1) -> DataFrame:
    """``lid``, ``doc``, ``line``: of each line that isn't alone in its kind, where the kind's
    first line is."""
    found = stored(first_lines(docs, least_words))
    kinds = components(line_links(docs, found, least_words, edits))
    named = found.join(kinds, found["lid"] == kinds["node"], "left").where("n > 1 or component is not null")
    named = named.select("lid", F.coalesce("component", "lid").alias("kind"), "first")
    least = named.groupBy("kind").agg(F.min("first").alias("m"))
    return stored(named.join(least, "kind").select("lid", F.col("m.doc").alias("doc"), F.col("m.line").alias("line")))


def dedup_column(docs: DataFrame, table: DataFrame, least_words: int):
    """A column ``struct<text, n_lines, n_kept>`` of ``docs``'s rows, from a broadcast table."""
    pdf = table.toPandas().sort_values("lid")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(pdf[c].to_numpy(np.int64) for c in ("lid", "doc", "line")))

    @F.pandas_udf("struct<text:string,n_lines:long,n_kept:long>")
    def column(ids: pd.Series, values: pd.Series) -> pd.DataFrame:
        lid, doc, line = shared.value
        owner, number, lines = lines_in(values, least_words)
        place = _inside(lid, line_ids(lines))
        known = np.flatnonzero(place >= 0)
        own = ids.fillna(LOWEST).astype("int64").to_numpy()[owner[known]]
        known = known[(doc[place[known]] != own) | (line[place[known]] != number[known])]
        drop: dict[int, set[int]] = {}
        for k, i in zip(owner[known].tolist(), number[known].tolist(), strict=True):
            drop.setdefault(k, set()).add(i)
        return pd.DataFrame([_without(t, drop.get(k, ())) for k, t in enumerate(values)], columns=["text", "n_lines", "n_kept"])

    return column(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def _without(text: str, drop) -> tuple[str, int, int]:
    lines = text.split("\n")
    if not drop:
        return text, len(lines), len(lines)
    left = [x for i, x in enumerate(lines) if i not in drop]
    return "\n".join(left), len(lines), len(left)


def _dropped(docs: DataFrame, table: DataFrame, least_words: int) -> DataFrame:
    """``k`` (hash of id and text) and ``drop`` (line numbers), by shuffle joins."""

    def run(frames):
        for pdf in frames:
            owner, number, lines = lines_in(pdf["text"], least_words)
            ids = pdf["doc_id"].fillna(LOWEST).astype("int64").to_numpy()
            yield pd.DataFrame({"k": pdf["k"].to_numpy()[owner], "d": ids[owner], "i": number, "l": line_ids(lines)})

    keyed = texts(docs).withColumn("k", F.xxhash64("doc_id", "text"))
    seen = keyed.mapInPandas(lean(run), "k long, d long, i long, l long").join(table, F.col("l") == F.col("lid"))
    return seen.where("d <> doc or i <> line").groupBy("k").agg(F.collect_set("i").alias("drop"))


def with_deduped(docs: DataFrame, edits=EDITS, least_words: int = 1, most: int = MOST) -> DataFrame:
    """``docs`` with a column ``_lexiloom_lines``: ``struct<text, n_lines, n_kept>``."""
    table = repeated(docs, edits, least_words)
    if table.count() <= most:
        return docs.withColumn("_lexiloom_lines", dedup_column(docs, table, least_words))
    drop = _dropped(docs, table, least_words).withColumnsRenamed({"k": "_lexiloom_k", "drop": "_lexiloom_drop"})

    @F.pandas_udf("struct<text:string,n_lines:long,n_kept:long>")
    def column(values: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        out = [_without(t, set() if n is None else set(map(int, n))) for t, n in zip(values, numbers, strict=True)]
        return pd.DataFrame(out, columns=["text", "n_lines", "n_kept"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.xxhash64(F.col("doc_id").cast("long"), text)
    joined = docs.withColumn("_lexiloom_key", key).join(drop, F.col("_lexiloom_key") == F.col("_lexiloom_k"), "left")
    return joined.withColumn("_lexiloom_lines", column(text, F.col("_lexiloom_drop"))).drop("_lexiloom_key", "_lexiloom_k", "_lexiloom_drop")


def dedup(docs: DataFrame, **options) -> DataFrame:
    """Per document: ``doc_id``, ``n_lines``, ``n_kept`` and ``text`` without repeated lines."""
    lines = F.col("_lexiloom_lines")
    return with_deduped(docs, **options).select(F.col("doc_id").cast("long").alias("doc_id"), lines["n_lines"].alias("n_lines"), lines["n_kept"].alias("n_kept"), lines["text"].alias("text"))


def keep(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; a document that had words and has none
    left, all its lines being elsewhere, goes. A column ``n_chars`` is brought up to date."""
    name = "_lexiloom_lines"
    found = with_deduped(docs, **options)
    text = F.col(name)["text"]
    had, has = (F.coalesce(c, F.lit("")).rlike(r"\S") for c in (F.col("text").cast("string"), text))
    left = found.where(~had | has).withColumn("text", F.when(F.col("text").isNotNull(), text))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return left.drop(name)
