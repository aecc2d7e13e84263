"""N-gram Jaccard join by token-combination prefixes, with connected components as result.

Sets of word shingles (64-bit hashes) are compared; documents with equal sets form one class, so
copies are never expanded. Shingles that stand in many documents are found by counts inside
partitions, added up: their list is bounded by the mean set size over ``frequent_share``. In the
global order rare shingles come first, those of rare words before others, as what stands in few
documents ties few classes however large the corpus is. A set's prefix is extended until it guarantees a shared
signature with every set within the threshold: each rare shingle of the prefix is a signature by
itself; frequent ones are dealt into groups and every pair inside a group is a signature, which
guarantees one less than the group's number of prefix shingles.

Classes that share a signature are candidates. In a signature of few classes all pairs of
fitting size are taken and checked against a bound from parity bitmaps: the bits in which they
differ never exceed the sets' symmetric difference. In a larger one every class is tied to the
first; tasks do so with what they see themselves, before the shuffle. The connected candidates are
families. Ties may connect much of a large corpus, so a family of more than ``BLOCK`` classes is split
by what the bitmaps of its classes leave connected; they are compared in blocks of like sizes. Within
families every pair is verified exactly, in blocks, by matrix products; only a forest of the links
leaves a block, never all pairs.

Edge cases: null and empty texts have no shingles and are linked with nothing; a text with fewer
words than a shingle is one shingle of its whole sequence; repeated rows fall into one class; a
null id is kept and is never the smallest; an empty table gives no rows; further columns are
carried on by ``keep_one`` and not read by ``groups``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cuts, discard, lean, mix64, release, small_side, stored, texts
from .components import Forest, components
from .words import Words

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Signatures of more classes than this tie each class to the first instead of giving pairs.
FEW = 48
BLOCK = 512
#: Words are counted in so many cells (a power of two) by their hashes.
CELLS = 1 << 16
#: Classes of one range of sizes whose bitmaps stand in a block.
WIDE = 8192


def cells(h: np.ndarray) -> np.ndarray:
    return (mix64(h ^ _B) & np.uint64(CELLS - 1)).astype(np.int64)


def weighed_sets(values: list[str], n: int, weight: np.ndarray | None = None, counts: np.ndarray | None = None, rows: int = 512):
    """``shingle_sets``, each with the sum of its words' weights (of their cells; 0 without a table or for a text of fewer words).
    The texts' words are added to ``counts``, where given."""
    for lo, hi in cuts(values, rows):
        words = Words([t.encode("utf-8", "replace") for t in values[lo:hi]])
        h, first = words.hash, words.first
        if counts is not None:
            counts += np.bincount(cells(h), minlength=CELLS)
        out = np.zeros(max(0, len(h) - n + 1), np.uint64)
        sums = np.zeros(len(out), np.uint64)
        own = None if weight is None else weight[cells(h)]
        for k in range(n if len(out) else 0):
            out = mix64(out * _A + h[k : len(h) - n + 1 + k])
            if own is not None:
                sums += own[k : len(h) - n + 1 + k]
        for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if z - a >= n:
                if own is None:
                    s = np.sort(out[a : z - n + 1])
                    s = s[np.r_[True, s[1:] != s[:-1]]]
                    yield s, np.zeros(len(s), np.uint64)
                else:
                    s, at = np.unique(out[a : z - n + 1], return_index=True)
                    yield s, sums[a + at]
            elif z > a:
                whole = np.array([z - a], np.uint64) * _B
                for x in h[a:z]:
                    whole = mix64(whole * _A + x)
                yield whole, np.zeros(1, np.uint64)
            else:
                yield np.zeros(0, np.uint64), np.zeros(0, np.uint64)


def shingle_sets(values: list[str], n: int, rows: int = 512):
    """Of each text the distinct hashes of its n-word shingles, rising; a text with fewer words has one
    hash of its whole sequence, one without words none."""
    for s, _ in weighed_sets(values, n, rows=rows):
        yield s


def shingle_set(text: str, n: int) -> np.ndarray:
    return next(shingle_sets([text], n))


def class_of(tokens: np.ndarray) -> int:
    """64-bit name of a set."""
    return int.from_bytes(hashlib.md5(tokens.tobytes()).digest()[:8], "little", signed=True)


class Rule:
    """Jaccard of at least num/den over n-word shingles."""

    def __init__(self, n: int, num: int, den: int):
        self.n, self.num, self.den = n, num, den

    def least(self, size: int) -> int:
        """Smallest size of a partner, and smallest overlap with any."""
        return -(-size * self.num // self.den)

    def most(self, size: int) -> int:
        return size * self.den // self.num

    def alone(self, size: int) -> bool:
        """Only an equal set can be within the threshold."""
        return self.least(size) == size == self.most(size)

    def groups(self, level: int) -> int:
        """Groups of frequent shingles for sizes of 2^level up to twice that."""
        return max(1, int((1 - self.num / self.den) * 1.5 * 2**level) // 4)

    def linked(self, inter, a, b):
        return self.den * inter >= self.num * (a + b - inter)


def signatures(tokens: np.ndarray, frequent: np.ndarray, rule: Rule, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signatures by single rare shingles, the lightest first, and by pairs of frequent ones."""
    size = len(tokens)
    if rule.alone(size):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    need = size - rule.least(size) + 1
    rare, often = tokens[~frequent], tokens[frequent]
    if weights is not None and len(rare) > need:
        rare = rare[np.argsort(weights[~frequent], kind="stable")]  # equal weights: by hash
    singles, pairs = mix64(rare[:need] ^ _C), []
    left = need - len(rare)
    if left <= 0:
        return singles, np.zeros(0, np.uint64)
    for level in range(rule.least(size).bit_length() - 1, rule.most(size).bit_length()):
        salt = np.uint64(((level * 2 + 1) * int(_C) + int(_B)) % 2**64)
        groups = np.uint64(rule.groups(level))
        group = ((often * _B) >> np.uint64(32)) % groups
        # a group's first shingle guarantees nothing, each further one guarantees one
        order = np.argsort(group, kind="stable")
        starts = np.r_[True, group[order][1:] != group[order][:-1]]
        first = np.zeros(len(often), bool)
        first[order[starts]] = True
        stop = int(np.searchsorted(np.cumsum(~first), left)) + 1
        prefix, group = often[:stop], group[:stop]
        for g in np.unique(group):
            own = prefix[group == g]
            if len(own) > 1:
                i, j = np.triu_indices(len(own), 1)
                pairs.append(mix64(mix64(own[i] * _A + own[j]) ^ salt))
    return singles, np.concatenate(pairs or [np.zeros(0, np.uint64)])


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity of the shingles in each of a power of two of at least 2 |set| cells (64 to 2^16)."""
    bits = min(1 << 16, max(64, 1 << (2 * len(tokens) - 1).bit_length()))
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ; the longer one is folded to the other's length."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def sets(docs: DataFrame, rule: Rule, share: float) -> DataFrame:
    """Rows of documents (``doc_id``, ``size``, ``cls``), of shingles that repeat in a task (size -1:
    ``token``, ``df``) and of cells of words (size -2: ``token``, ``df`` their count), in one pass."""

    def run(frames):
        held, kept, rows = [], 0, 0
        counts = np.zeros(CELLS, np.int64)

        def repeated():
            value, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= max(2, share * rows)
            return pd.DataFrame({"doc_id": pd.array([None] * int(often.sum()), "Int64"), "size": -1, "cls": 0, "token": value[often].astype(np.int64), "df": count[often]})

        seen: set[int] = set()
        for pdf in frames:
            size, cls = [], []
            for s, _ in weighed_sets(pdf["text"].tolist(), rule.n, counts=counts):
                c = class_of(s)
                size.append(len(s))
                cls.append(c)
                if len(s) and c not in seen:
                    seen.add(c)
                    held.append(s)
                    kept += len(s)
                    rows += 1
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "size": size, "cls": cls, "token": 0, "df": 0}).astype({"doc_id": "Int64"})
            if kept > 3_000_000:
                yield repeated()
                held, kept, rows, seen = [], 0, 0, set()
        if held:
            yield repeated()
        some = np.flatnonzero(counts)
        yield pd.DataFrame({"doc_id": pd.array([None] * len(some), "Int64"), "size": -2, "cls": 0, "token": some, "df": counts[some]})

    return texts(docs).mapInPandas(lean(run), "doc_id long, size long, cls long, token long, df long")


def frequent_tokens(counted: DataFrame, n_sets: int, share: float) -> np.ndarray:
    """Shingles counted in at least ``share`` of the sets (16 at least), rising."""
    least = max(16.0, share * n_sets)
    rows = counted.where("size = -1").groupBy("token").agg(F.sum("df").alias("df")).where(F.col("df") >= least).select("token")
    return np.sort(rows.toPandas()["token"].to_numpy(np.int64).astype(np.uint64))


def word_weights(counted: DataFrame) -> np.ndarray:
    """Of each cell of words the logarithm of its count, in sixteenths of a doubling."""
    rows = counted.where("size = -2").groupBy("token").agg(F.sum("df").alias("n")).toPandas()  # CELLS rows at most
    out = np.zeros(CELLS, np.uint64)
    out[rows["token"].to_numpy(np.int64)] = np.log2(rows["n"].to_numpy(float)) * 16
    return out


def candidates(docs: DataFrame, rule: Rule, frequent, weights=None) -> DataFrame:
    """Rows of three kinds: 0 a class (``a``, ``size``, ``bits``), 1 a signature (``sig``, ``a``,
    ``size``), 2 a tie (``a``, ``b``) of classes that share a signature many times in one task."""
    empty = b""

    def run(frames):
        often = frequent.value
        mask = np.zeros(1 << 24, bool)
        mask[(often & np.uint64((1 << 24) - 1)).astype(np.int64)] = True
        seen: set[int] = set()
        times: dict[int, list[int]] = {}
        for pdf in frames:
            out = []
            for s, w in weighed_sets(pdf["text"].tolist(), rule.n, weight=weights.value if weights else None):
                if not len(s):
                    continue
                c = class_of(s)
                if c in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(c)
                hot = mask[(s & np.uint64((1 << 24) - 1)).astype(np.int64)]
                if hot.any():
                    at = np.flatnonzero(hot)
                    place = np.minimum(np.searchsorted(often, s[at]), len(often) - 1)
                    hot[at] = often[place] == s[at]
                singles, pairs = signatures(s, hot, rule, w)
                if not len(singles) and not len(pairs):
                    continue
                out.append((0, 0, c, 0, len(s), bitmap(s)))
                out += [(1, x, c, 0, len(s), empty) for x in singles.astype(np.int64).tolist()]
                for x in pairs.astype(np.int64).tolist():
                    held = times.get(x)
                    if held is None:
                        if len(times) > 200_000:
                            times.clear()
                        times[x] = [1, c]
                    elif held[0] >= FEW:
                        out.append((2, 0, c, held[1], 0, empty))
                        continue
                    else:
                        held[0] += 1
                    out.append((1, x, c, 0, len(s), empty))
                if len(out) > 60_000:
                    yield pd.DataFrame(out, columns=["kind", "sig", "a", "b", "size", "bits"])
                    out = []
            yield pd.DataFrame(out, columns=["kind", "sig", "a", "b", "size", "bits"])

    return texts(docs).select("text").mapInPandas(lean(run), "kind int, sig long, a long, b long, size long, bits binary")


def bucket_edges(rows: DataFrame, rule: Rule) -> DataFrame:
    """Candidate edges (``a`` < ``b``, ``sure``) of each signature, streamed in signature order."""
    ordered = rows.repartition("sig").sortWithinPartitions("sig", "size", "a")

    def run(frames):
        at, members, tied = None, [], False

        def pairs():
            found = []
            for i, (c, n) in enumerate(members):
                for d, m in members[i + 1 :]:
                    if rule.least(m) > n:
                        break
                    if c != d:
                        found.append((min(c, d), max(c, d), False))
            return found

        out: list[tuple[int, int, bool]] = []
        for pdf in frames:
            key = pdf["sig"].to_numpy()
            mask = np.ones(len(key), bool)  # signatures of one class alone need no look
            mask[1:-1] = (key[1:-1] == key[:-2]) | (key[1:-1] == key[2:])
            pdf = pdf[mask]
            for sig, c, n in zip(pdf["sig"].tolist(), pdf["a"].tolist(), pdf["size"].tolist(), strict=True):
                if sig != at:
                    if len(members) > 1 and not tied:
                        out += pairs()
                    at, members, tied = sig, [], False
                if tied:
                    if c != members[0][0]:
                        out.append((min(c, members[0][0]), max(c, members[0][0]), True))
                    continue
                if members and members[-1][0] == c:
                    continue
                members.append((c, n))
                if len(members) > FEW:
                    tied = True
                    first = members[0][0]
                    out += [(min(first, d), max(first, d), True) for d, _ in members[1:] if d != first]
                    members = members[:1]
            if out:
                yield pd.DataFrame(out, columns=["a", "b", "sure"])
                out = []
        if len(members) > 1 and not tied:
            out += pairs()
        if out:
            yield pd.DataFrame(out, columns=["a", "b", "sure"])

    return ordered.mapInPandas(lean(run), "a long, b long, sure boolean")


def families(found: DataFrame, rule: Rule) -> DataFrame:
    """``node`` and ``component`` of the classes tied by candidate edges."""
    ties = found.where("kind = 2").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True).alias("sure"))
    rows = found.where("kind = 1").select("sig", "a", "size")
    edges = stored(bucket_edges(rows, rule).unionByName(ties).groupBy("a", "b").agg(F.max("sure").alias("sure")))
    sketch = found.where("kind = 0").groupBy("a").agg(F.first("size").alias("size"), F.first("bits").alias("bits"))
    left = sketch.select(F.col("a"), F.col("size").alias("sa"), F.col("bits").alias("ba"))
    right = sketch.select(F.col("a").alias("b"), F.col("size").alias("sb"), F.col("bits").alias("bb"))
    pairs = edges.where("not sure").select("a", "b").join(left, "a").join(right, "b")

    def near(frames):
        for pdf in frames:
            differ = np.fromiter((differing(x, y) for x, y in zip(pdf["ba"], pdf["bb"], strict=True)), np.int64, len(pdf))
            a, b = pdf["sa"].to_numpy(), pdf["sb"].to_numpy()
            yield pdf.loc[rule.linked((a + b - differ) // 2, a, b), ["a", "b"]]

    close = pairs.mapInPandas(lean(near), "a long, b long")
    return components(edges.where("sure").select("a", "b").unionByName(close))


def folded(bits: list[bytes], width: int) -> np.ndarray:
    """Bitmaps as rows of ``width`` 64-bit words; longer ones are folded."""
    out = np.zeros((len(bits), width), np.uint64)
    for i, b in enumerate(bits):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, width), 0)
    return out


def near_forest(size: np.ndarray, bits: list[bytes], left: np.ndarray, rule: Rule) -> np.ndarray:
    """Of each set the number of the least one that it is connected with, by pairs whose bitmaps allow a link. Sets of the
    ``left`` meet the others; if all are left, each meets each."""
    width = min(map(len, bits)) // 8
    few = 1  # words that tell most pairs apart: unlike sets differ in half of the bits
    while few < width and 24 * few < size.max() * 2 * (rule.den - rule.num) / (rule.den + rule.num):
        few *= 2
    x, short = folded(bits, width), None
    if few < width:
        short = np.bitwise_xor.reduce(x.reshape(len(x), -1, few), 1)
    label = np.arange(len(size))
    rows, others = np.flatnonzero(left), np.flatnonzero(~left)
    one = not len(others)
    for lo in range(0, len(rows), 64):
        i, j = rows[lo : lo + 64], (rows[lo:] if one else others)
        narrow = x if short is None else short
        differ = np.zeros((len(i), len(j)), np.int64)
        for w in range(narrow.shape[1]):
            differ += np.bitwise_count(narrow[i, w][:, None] ^ narrow[j, w][None, :])
        total = size[i][:, None] + size[j][None, :]
        a, b = np.nonzero(rule.linked((total - differ) // 2, total, 0) & (rule.den * np.minimum(size[i][:, None], size[j][None, :]) >= rule.num * np.maximum(size[i][:, None], size[j][None, :])))
        a, b = i[a], j[b]
        if one:
            a, b = a[a < b], b[a < b]
        if short is not None and len(a):
            differ = np.concatenate([np.bitwise_count(x[a[k : k + 65536]] ^ x[b[k : k + 65536]]).sum(1, dtype=np.int64) for k in range(0, len(a), 65536)])
            ok = rule.linked((size[a] + size[b] - differ) // 2, size[a], size[b])
            a, b = a[ok], b[ok]
        while len(a):  # most pairs are inside one part after few merges
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            if len(a):
                p, q = sorted((label[a[0]], label[b[0]]))
                label[label == q] = p
    return label


def split(family: DataFrame, found: DataFrame, rule: Rule) -> DataFrame:
    """``family`` (``node``, ``component``), where those of more than ``BLOCK`` classes are replaced by what their bitmaps connect."""
    family = stored(family)
    large = stored(family.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("component"))
    if not large.limit(1).count():
        return family
    sketch = found.where("kind = 0").groupBy("a").agg(F.first("size").alias("size"), F.first("bits").alias("bits"))
    step = 1.01 * np.log(rule.den / rule.num)  # sizes within the threshold lie in one range or in two that touch
    ranged = F.floor(F.log(F.col("size").cast("double")) / float(step)).cast("int")
    members = stored(family.join(large, "component").join(sketch, F.col("node") == F.col("a")).select("component", "node", "size", "bits", ranged.alias("r")))
    blocks = stored(members.groupBy("component", "r").agg(F.ceil(F.count(F.lit(1)) / WIDE).cast("int").alias("blocks")))
    beside = lambda d, name: blocks.select("component", (F.col("r") - d).alias("r"), F.col("blocks").alias(name))
    known = members.join(beside(0, "own"), ["component", "r"]).join(beside(1, "above"), ["component", "r"], "left").join(beside(-1, "below"), ["component", "r"], "left")
    known = known.withColumn("g", F.pmod(F.xxhash64("node"), "own").cast("int"))
    every = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    meets = lambda r, i, s, j, left: F.struct(r.alias("r1"), i.alias("i"), s.alias("r2"), j.alias("j"), left.alias("is_left"))
    r, g = F.col("r"), F.col("g")
    same = F.transform(every(F.col("own")), lambda j: meets(r, F.least(g, j), r, F.greatest(g, j), g <= j))
    up = F.transform(every(F.coalesce("above", F.lit(0))), lambda j: meets(r, g, r + 1, j, F.lit(True)))
    down = F.transform(every(F.coalesce("below", F.lit(0))), lambda j: meets(r - 1, j, r, g, F.lit(False)))
    dealt = known.select("component", "node", "size", "bits", F.explode(F.concat(same, up, down)).alias("k")).select("component", "k.*", "node", "size", "bits")

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        left, node = pdf["is_left"].to_numpy(bool), pdf["node"].to_numpy()
        one = (pdf["r1"].iat[0], pdf["i"].iat[0]) == (pdf["r2"].iat[0], pdf["j"].iat[0])
        if not one and (left.all() or not left.any()):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        label = near_forest(pdf["size"].to_numpy(np.int64), pdf["bits"].tolist(), left, rule)
        tied = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": node[label[tied]], "b": node[tied]})

    parts = components(dealt.groupBy("component", "r1", "i", "r2", "j").applyInPandas(links, "a long, b long"))
    return family.join(large, "component", "left_anti").select("node", "component").unionByName(parts.select("node", "component"))


def links_in(cls: list[int], members: list[np.ndarray], rule: Rule) -> list[tuple[int, int]]:
    """A forest of the true links among sets, by products of their incidence matrices."""
    size = np.fromiter(map(len, members), np.int64, len(members))
    owner = np.repeat(np.arange(len(members)), size)
    value, column, count = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    inter = np.zeros((len(members), len(members)), np.float32)
    width = int(shared.sum())
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, width, 8192):
        i, j = np.searchsorted(column, [lo, lo + 8192])
        part = np.zeros((len(members), min(8192, width - lo)), np.float32)
        part[owner[i:j], column[i:j] - lo] = 1
        inter += part @ part.T
    inter = np.rint(inter).astype(np.int64)
    x, y = np.nonzero(np.triu(rule.linked(inter, size[:, None], size[None, :]), 1))
    forest = Forest()
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        forest.join(i, j)
    return [(cls[i], cls[r]) for i in forest.up if (r := forest.root(i)) != i]


def true_links(docs: DataFrame, named: DataFrame, family: DataFrame, rule: Rule, most_broadcast: int = 1_000_000) -> DataFrame:
    """Forest edges (``a``, ``b``) of the true links, family by family and block by block.

    named: ``doc_id``, ``cls`` of one document of each class.
    """
    sizes = family.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = sizes.select("component", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    chosen = stored(family.join(blocks, "component").join(named, F.col("node") == F.col("cls")).select(F.col("doc_id").alias("_lexiloom_id"), F.col("cls").alias("_cls"), "component", "blocks"))
    side = small_side(chosen, chosen.count(), most_broadcast)
    found = texts(docs).join(side, F.col("doc_id").eqNullSafe(F.col("_lexiloom_id"))).select("text", "_cls", "component", "blocks")

    def deal(frames):
        seen: set[int] = set()
        for pdf in frames:
            out = []
            for s, cls, family_id, n in zip(shingle_sets(pdf["text"].tolist(), rule.n), pdf["_cls"].tolist(), pdf["component"].tolist(), pdf["blocks"].tolist(), strict=True):
                if class_of(s) != cls or cls in seen:
                    continue  # another text under the same id, or a repeated row
                seen.add(cls)
                own, data = cls % n, s.tobytes()
                out += [(family_id, min(own, k), max(own, k), cls, data) for k in range(n)]
                if len(out) > 2_000:
                    yield pd.DataFrame(out, columns=["f", "i", "j", "cls", "data"])
                    out = []
            yield pd.DataFrame(out, columns=["f", "i", "j", "cls", "data"])

    dealt = found.mapInPandas(lean(deal), "f long, i int, j int, cls long, data binary").repartition("f", "i", "j").sortWithinPartitions("f", "i", "j", "cls")

    def run(frames):
        at, cls, data, out = None, [], [], []
        for pdf in frames:
            for key, c, d in zip(zip(pdf["f"].tolist(), pdf["i"].tolist(), pdf["j"].tolist(), strict=True), pdf["cls"].tolist(), pdf["data"], strict=True):
                if key != at:
                    if len(cls) > 1:
                        out += links_in(cls, data, rule)
                    at, cls, data = key, [], []
                if not cls or cls[-1] != c:
                    cls.append(c)
                    data.append(np.frombuffer(d, np.uint64))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        if len(cls) > 1:
            out += links_in(cls, data, rule)
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])

    return dealt.mapInPandas(lean(run), "a long, b long")


def _joined(docs: DataFrame, rule: Rule, frequent_share: float) -> tuple[DataFrame, DataFrame]:
    """Document rows (``doc_id``, ``size``, ``cls``) and, of each class, ``cls``, ``component``
    (a class name), ``first`` (smallest id of the class)."""
    spark = docs.sparkSession
    counted = stored(sets(docs, rule, frequent_share))
    rows = counted.where("size >= 0").select("doc_id", "size", "cls")
    named = stored(rows.where("size > 0").groupBy("cls").agg(F.min("doc_id").alias("first")))
    frequent = spark.sparkContext.broadcast(frequent_tokens(counted, named.count(), frequent_share))
    weights = spark.sparkContext.broadcast(word_weights(counted))
    found = stored(candidates(docs, rule, frequent, weights))
    family = split(families(found, rule), found, rule)
    links = stored(true_links(docs, named.select(F.col("first").alias("doc_id"), "cls"), family, rule))
    discard(spark, found)
    parts = components(links)
    classes = named.join(parts, named["cls"] == parts["node"], "left").select("cls", F.coalesce("component", "cls").alias("component"), "first")
    return rows, classes


def groups(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, frequent_share: float = 1e-4) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable by links)."""
    rows, classes = _joined(docs, Rule(n, num, den), frequent_share)
    least = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = classes.join(least, "component").select("cls", "component_id")
    return rows.join(ids, "cls", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, frequent_share: float = 1e-4, most_broadcast: int = 1_000_000) -> DataFrame:
    """The documents of ``docs``, all columns, of which one of each group stays: the one with the
    smallest id (among rows that repeat it, one). Documents without words all stay."""
    rule = Rule(n, num, den)
    rows, classes = _joined(docs, rule, frequent_share)
    kept = classes.groupBy("component").agg(F.min(F.struct("first", "cls")).alias("m")).select(F.col("m.first").alias("first"), F.col("m.cls").alias("kept"))
    seen = rows.where("size > 0").groupBy("doc_id", "cls").agg(F.count(F.lit(1)).alias("n"))
    known = seen.join(kept, F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("cls") == F.col("kept")), "left")
    known = stored(
        known.select(F.col("doc_id").alias("_lexiloom_id"), F.col("cls").alias("_lexiloom_known"), F.col("kept").isNotNull().alias("_lexiloom_stays"), (F.col("n") > 1).alias("_lexiloom_repeats"))
    )
    name = "_lexiloom_class"

    @F.pandas_udf("long")
    def class_column(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in parts:
            yield pd.Series([class_of(s) if len(s) else None for s in shingle_sets([t or "" for t in values], n)], index=values.index, dtype="Int64")
        release()

    marked = docs.withColumn(name, class_column(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    # what goes is mostly far less than what stays: the shorter list is joined, so that texts are rarely shuffled
    stay, odd = known.where("_lexiloom_stays"), known.where("not _lexiloom_stays or _lexiloom_repeats")
    n_stay, n_odd = stay.count(), odd.count()
    side = small_side(odd if n_odd <= n_stay else stay, min(n_odd, n_stay), most_broadcast)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_lexiloom_id")) & (F.col(name) == F.col("_lexiloom_known"))
    joined = marked.join(side, same, "left").where(F.col(name).isNull() | F.coalesce("_lexiloom_stays", F.lit(n_odd <= n_stay)))
    if stay.where("_lexiloom_repeats").limit(1).count():
        again = F.coalesce("_lexiloom_repeats", F.lit(False))
        joined = joined.where(~again).unionByName(joined.where(again).dropDuplicates(["doc_id", name]))
    return joined.drop(name, "_lexiloom_id", "_lexiloom_known", "_lexiloom_stays", "_lexiloom_repeats")
