"""Document fingerprints by consistent weighted sampling.

Terms are the words of a text, weighted by their counts. For each term and each of ``SAMPLES``
samples, r and c are drawn from Gamma(2, 1) and b from the unit interval, all from a hash of term
and sample. With weight w: t = floor(ln w / r + b), ln a = ln c - r (t - b) - r; the sample is the
(term, t) of least a. Two texts share a sample with a probability equal to their generalised Jaccard
similarity, so the share of equal samples estimates it. A fingerprint is one 16-bit digit per
sample, in hexadecimal.

The draws come from three exponentials E, X and q: c = E + X and r = s + q, both Gamma(2, 1), with
s = ln(c / E), and b = q / r. So a term of weight 1 has t = 0 and a = E, which rises with the hash
itself: of all such terms the least hash wins, and nothing else is computed for them. That s is an
exponential independent of c follows from the joint density E e^s exp(-E e^s) of E and s.

``with_edited`` also fingerprints each text after its second half is replaced by the beginning of
the next document. Documents are dealt by ranges of their ids; the first ones of each range also go
to the range before, so no task needs more than its own rows.

Edge cases: null and empty texts have no terms, a fingerprint of their own that is like itself
(1) and unlike others (0); rows that repeat an id are ordered by text and count as documents of
their own; null ids come first; a single document is its own next one; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, texts, tokens_of

SAMPLES = 128
_SEEDS = (mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
#: Repeated terms whose draws a worker remembers, 1.5 KB each.
MEMORY = 12_000


def mix32(x: np.ndarray) -> np.ndarray:
    """The finalizer of a 32-bit hash, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def exponential(v: np.ndarray) -> np.ndarray:
    """Exp(1) by its quantiles, rising with the hash."""
    return -np.log1p(-(v.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32 * (1 - 2.0**-20)))


def draws(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b from the hashes of terms and samples."""
    e, x, q = exponential(v), exponential(mix32(v + np.uint32(0x9E3779B9))), exponential(mix32(v + np.uint32(0x7F4A7C15)))
    ln_c = np.log(e + x)
    r = ln_c - np.log(e) + q
    return r, ln_c, q / r


class Draws:
    """The draws of repeated terms, kept from batch to batch up to ``MEMORY`` of them."""

    def __init__(self):
        self.rows: dict[bytes, int] = {}
        self.values = np.empty((3, 256, SAMPLES), np.float32)

    def of(self, terms: list[bytes], v: np.ndarray) -> np.ndarray:
        """Rows of the terms, whose hashes are ``v``."""
        if len(self.rows) > MEMORY:
            self.__init__()
        new = [i for i, t in enumerate(terms) if t not in self.rows]
        if new:
            at = len(self.rows)
            while at + len(new) > self.values.shape[1]:
                self.values = np.concatenate([self.values, np.empty_like(self.values)], axis=1)
            self.values[:, at : at + len(new)] = draws(v[new])
            self.rows.update((terms[i], at + k) for k, i in enumerate(new))
        return np.fromiter(map(self.rows.__getitem__, terms), np.int64, len(terms))


_DRAWS = Draws()


def _least(batch: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text (term -> weight): the least ln a of every sample and the digit of its sample."""
    least = np.full((len(batch), SAMPLES), np.inf, np.float32)
    out = np.full((len(batch), SAMPLES), 0xFFFF, np.uint64)
    index = {t: i for i, t in enumerate(dict.fromkeys(t for c in batch for t in c))}
    if not index:
        return least, out
    terms = list(index)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    v = mix32(folded[:, None] ^ _SEEDS)
    repeated = np.unique([index[t] for c in batch for t, w in c.items() if w > 1]).astype(np.int64)
    rows = np.full(len(terms), -1)
    rows[repeated] = _DRAWS.of([terms[i] for i in repeated], v[repeated])
    r, ln_c, b = _DRAWS.values
    for k, counter in enumerate(batch):
        if not counter:
            continue
        at = np.fromiter(map(index.__getitem__, counter), np.int64, len(counter))
        w = np.fromiter(counter.values(), np.float32, len(counter))
        once, more = at[w == 1], at[w > 1]
        low, level, a = np.full(SAMPLES, 0xFFFFFFFF, np.uint32), np.zeros(SAMPLES, np.uint64), np.full(SAMPLES, np.inf, np.float32)
        if len(once):
            low = v[once].min(axis=0)
            a = np.log(exponential(low))
        if len(more):
            own = rows[more]
            rm, bm = r[own], b[own]
            t = np.floor(np.log(w[w > 1])[:, None] / rm + bm)
            am = ln_c[own] - rm * (t - bm + 1)
            best = am.argmin(axis=0)
            each = np.arange(SAMPLES)
            less = am[best, each] < a
            a = np.where(less, am[best, each], a)
            low = np.where(less, v[more[best], each], low)
            level = np.where(less, t[best, each], 0).astype(np.int64).astype(np.uint64)
        digit = mix64(low.astype(np.uint64) + (level << np.uint64(32))) & np.uint64(0xFFFF)
        least[k], out[k] = a, np.where(digit == 0xFFFF, 0, digit)
    return least, out


def signatures(batch: list[Counter], most: int = 16_000) -> np.ndarray:
    """[texts, SAMPLES] digits; 65535 throughout for a text without terms.

    At most about ``most`` different terms are drawn at a time: texts are taken in groups, and one
    with more terms is taken in slices, whose least values are merged.
    """
    out = np.full((len(batch), SAMPLES), 0xFFFF, np.uint16)
    lo = 0
    while lo < len(batch):
        if len(batch[lo]) > most:
            items = list(batch[lo].items())
            least = None
            for cut in range(0, len(items), most):
                a, digit = _least([dict(items[cut : cut + most])])
                if least is None:
                    least, digits = a, digit
                else:
                    digits, least = np.where(a < least, digit, digits), np.minimum(a, least)
            out[lo] = digits[0]
            lo += 1
            continue
        hi, seen = lo, set()
        while hi < len(batch) and len(batch[hi]) <= most and len(seen) < most:
            seen.update(batch[hi])
            hi += 1
        out[lo:hi] = _least(batch[lo:hi])[1]
        lo = hi
    return out


def text_of(row: np.ndarray) -> str:
    return row.astype(">u2").tobytes().hex()


def fingerprint(docs: DataFrame, batch: int = 128) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of each text: a map without a shuffle."""

    def run(frames):
        for pdf in frames:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                rows = signatures([Counter(tokens_of(t)) for t in part["text"]])
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "fingerprint": list(map(text_of, rows))})

    return texts(docs).mapInPandas(run, "doc_id long, fingerprint string")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def with_edited(docs: DataFrame, parts: int | None = None, batch: int = 128) -> DataFrame:
    """``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``."""
    spark = docs.sparkSession
    base = texts(docs)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(q) for q in base.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    lowest, borders = -(2**63), np.array(cuts, np.int64)

    def ids_of(pdf):
        return pdf["doc_id"].fillna(lowest).astype("int64").to_numpy()

    def firsts(frames):
        found: dict[int, int] = {}
        for pdf in frames:
            ids = ids_of(pdf)
            own = np.searchsorted(borders, ids, "right")
            for p in np.unique(own).tolist():
                m = int(ids[own == p].min())
                found[p] = min(found.get(p, m), m)
        yield pd.DataFrame({"p": list(found), "m": list(found.values())})

    # the first id of each range: one number a range comes to the driver
    rows = base.select("doc_id").mapInPandas(firsts, "p int, m long").groupBy("p").agg(F.min("m").alias("m")).collect()
    least = {r["p"]: r["m"] for r in rows}
    used = sorted(least)
    before = {least[p]: used[i - 1] for i, p in enumerate(used)}  # the first range follows the last

    def deal(frames):
        for pdf in frames:
            ids = ids_of(pdf)
            yield pdf.assign(part=named[np.searchsorted(borders, ids, "right")], ghost=False)
            first = np.fromiter((i in before for i in ids.tolist()), bool, len(ids))
            if first.any():
                yield pdf[first].assign(part=named[np.fromiter((before[i] for i in ids[first].tolist()), np.int64)], ghost=True)

    # ranges are named by numbers that Spark deals to different tasks
    names, number, place = {}, F.col("id"), F.pmod(F.hash("id"), F.lit(parts))
    for row in spark.range(0, 30 * parts, 1, 1).groupBy(place.alias("p")).agg(F.min(number).alias("name")).collect():
        names[row["p"]] = row["name"]
    spare = iter(range(30 * parts, 31 * parts))
    named = np.array([names[p] if p in names else next(spare) for p in range(parts)], np.int64)
    kinds = "doc_id long, text string, part long, ghost boolean"
    dealt = base.mapInPandas(deal, kinds).repartition(parts, "part").sortWithinPartitions("part", "ghost", "doc_id", "text")

    def edit(text: str, nxt: str) -> str:
        half = len(text) // 2
        return text[: len(text) - half] + nxt[:half]

    def run(frames):
        waiting: list[tuple] = []  # rows of one range; the last may still lack its next text

        def flush(rows, upto):
            """Results of rows[:upto]; each has its next document after it in rows."""
            edited = [edit(rows[i][1], rows[i + 1][1]) for i in range(upto)]
            # a text and its edited form stand side by side, so their common terms are drawn once
            texts_of = [t for i in range(upto) for t in (rows[i][1], edited[i])] + [rows[upto][1]]
            sig = signatures([Counter(tokens_of(t)) for t in texts_of])
            own, ed = sig[::2], sig[1::2]
            return pd.DataFrame(
                {
                    "doc_id": pd.array([r[0] for r in rows[:upto]], "Int64"),
                    "n_chars": [len(r[1]) for r in rows[:upto]],
                    "edited_sha256": [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in edited],
                    "fingerprint": list(map(text_of, own[:upto])),
                    "edited_fingerprint": list(map(text_of, ed)),
                    "near_edited": [likeness(own[i], ed[i]) for i in range(upto)],
                    "near_next": [likeness(own[i], own[i + 1]) for i in range(upto)],
                }
            )

        at, closed = None, False
        for pdf in frames:
            for doc, text, p, ghost in zip(pdf["doc_id"].array, pdf["text"], pdf["part"], pdf["ghost"], strict=True):
                if p != at:
                    at, closed, waiting = p, False, []
                if closed:
                    continue
                waiting.append((None if pd.isna(doc) else int(doc), text))
                if ghost or len(waiting) > batch:
                    yield flush(waiting, len(waiting) - 1)
                    waiting, closed = waiting[-1:], bool(ghost)

    return dealt.mapInPandas(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
