"""Quality rules at host level.

Per document a few exact counts (words, symbols, repeated lines and three-word windows) and the
base rule; per host the share of documents that fail it, shrunk towards the mean of all hosts by
a beta prior fitted to the hosts themselves (method of moments); then the verdict on the host is
joined back. A document is kept if it passes the base rule and its host isn't condemned: shrunk
rate at or above ``reject_rate``, with at least ``least`` documents.

The host counts are pre-aggregated before their shuffle. Verdicts are broadcast up to
``most_hosts`` hosts, a counted bound; beyond that all verdicts meet their documents in a shuffle
join. Hosts with more than one in ``share`` of all documents, of which there are fewer than
``share``, are salted there, so that a host with a third of all rows is dealt over ``salts`` tasks.
Both ways give the same rows.

Edge cases: a null or empty text has no words and fails; a null host is a host of its own that is
never condemned; repeated rows count each; an empty table gives no rows; further columns are
not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, texts

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_LINE_WORD = re.compile(r"[^\x20\x09-\x0D]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    base = len(index)
    window = ids[:-2] * base + ids[1:-1]
    if base > 2_000_000:  # keep the three-word number below 2^63
        window = np.unique(window, return_inverse=True)[1]
    window = window * base + ids[2:]
    _, back, count = np.unique(window, return_inverse=True, return_counts=True)
    twice = count[back] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


def counts(text: str) -> tuple[int, int, int, int, int]:
    """``COUNTS`` of one text."""
    words = text.encode("utf-8", "replace").split()
    lines = [x for x in text.split("\n") if _LINE_WORD.search(x)] if "\n" in text else []
    dup = sum(c - 1 for c in Counter(lines).values()) if len(lines) > 1 else 0
    return len(words), sum(map(len, map(bytes.decode, words))), len(_SYMBOLS.findall(text)), dup, repeated_words(words)


def document_counts(docs: DataFrame, *more: str, least_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """``doc_id``, the columns ``more``, ``COUNTS`` and ``base_failed``."""

    def run(frames):
        for pdf in frames:
            found = [counts(t) for t in pdf["text"]]
            yield pdf.drop(columns="text").assign(**{c: [x[i] for x in found] for i, c in enumerate(COUNTS)})

    base = texts(docs, *more)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != "text"]
    out = base.mapInPandas(run, ", ".join(kinds + [f"{c} long" for c in COUNTS]))
    return out.withColumn(
        "base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    )


def host_verdicts(counted: DataFrame, host: str, reject_rate: float = 0.75, least: int = 20) -> DataFrame:
    """Per host: ``n_docs``, ``n_failed``, ``shrunk_rate`` and ``condemned``.

    The beta prior has the mean m of the hosts' rates and the strength that their variance v
    leaves after the part p(1-p)/n of chance is taken off: m(1-m)/v - 1, between 1 and 10^6.
    """
    hosts = counted.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    m = hosts.agg(
        F.avg(rate).alias("m"),
        F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"),
        F.avg(1.0 / F.col("n_docs")).alias("inv"),
    ).collect()[0]
    mean = m["m"] if m["m"] is not None else 0.5
    spread = max(1e-9, m["v"] - mean * (1 - mean) * (m["inv"] or 0.0))
    strength = min(1e6, max(1.0, mean * (1 - mean) / spread - 1))
    shrunk = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumn("shrunk_rate", shrunk).withColumn(
        "condemned", F.col(host).isNotNull() & (F.col("shrunk_rate") >= reject_rate) & (F.col("n_docs") >= least)
    )


def judge(docs: DataFrame, host: str = "source", most_hosts: int = 100_000, salts: int = 64, share: int = 1000) -> DataFrame:
    """Per document: ``doc_id``, ``COUNTS``, ``base_failed``, ``host_rate``, ``kept``."""
    counted = stored(document_counts(docs.withColumn("_host", F.col(host).cast("string")), "_host"))
    verdicts = stored(host_verdicts(counted, "_host"))
    few = verdicts.limit(most_hosts + 1).count() <= most_hosts
    rates = [F.col("_host").alias("_h"), F.col("shrunk_rate").alias("host_rate"), "condemned"]
    if few:
        joined = counted.join(F.broadcast(verdicts.select(*rates)), F.col("_host").eqNullSafe(F.col("_h")), "left")
    else:
        total = verdicts.agg(F.sum("n_docs").alias("n")).collect()[0]["n"] or 0
        large = F.col("n_docs") * share > total
        deals = F.sequence(F.lit(0), F.when(large, salts - 1).otherwise(0))
        side = verdicts.select(*rates, F.explode(deals).alias("_s"))
        heavy = verdicts.where(large).select(F.col("_host").alias("_l"), F.lit(True).alias("_large"))
        salt = F.pmod(F.xxhash64("doc_id", "word_chars"), F.lit(salts)).cast("int")
        marked = counted.join(F.broadcast(heavy), F.col("_host").eqNullSafe(F.col("_l")), "left")
        salted = marked.withColumn("_t", F.when(F.col("_large"), salt).otherwise(0))
        joined = salted.join(side, F.col("_host").eqNullSafe(F.col("_h")) & (F.col("_t") == F.col("_s")), "left")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("condemned"), F.lit(False))
    return joined.select("doc_id", *COUNTS, "base_failed", "host_rate", kept.alias("kept"))
