"""Corpus statistics, vocabulary and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T


def tokenized(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``tokens`` after all vocabulary rules. A null text has null tokens, an empty one none;
    rows that repeat an id are documents of their own here and one in what counts by id."""
    raw = docs.select("doc_id", T.once(T.topic_tokens(F.col("text"))).alias("raw"))
    return raw.select("doc_id", T.once(T.kept_tokens(F.col("raw"))).alias("tokens"))


def term_statistics(tokens: DataFrame) -> DataFrame:
    """``token``, ``tf``, ``df``: counted per document first, so both sums are combined early."""
    once = tokens.select("doc_id", F.explode("tokens").alias("token")).groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("token").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))


def rank_statistics(lengths: DataFrame, column: str) -> DataFrame:
    """Minimum, upper median and floor-rank percentiles, from the histogram of the values, which
    is as small as the number of different values."""
    histogram = lengths.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = histogram.select("v", F.sum("n").over(order).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    n = F.col("total")
    return ranked.agg(
        F.min("v").alias("len_min"), at(F.floor(n / 2)).alias("len_median"),
        at(F.floor(0.95 * (n - 1))).alias("len_p95"), at(F.floor(0.99 * (n - 1))).alias("len_p99"),
    )


def filter_reason(token, min_len: int = 3):
    """Why a dictionary entry goes; null if it stays. The first reason wins."""
    return (
        F.when(token.endswith("-"), "trailing_hyphen")
        .when(token.isin(T.BIBLIOGRAPHY), "biblio_stoplist")
        .when(token.isin(T.FRAGMENTS), "fragment_suffix")
        .when((F.length(token) < min_len) & ~token.isin(T.KEEP_SHORT), "too_short")
        .when(token.rlike("^[a-z]{1,2}$") & ~token.isin(T.KEEP_SHORT), "short_alpha")
    )


def word_chunks(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """``doc_id``, ``chunk_index``, ``chunk``: the text itself if it is short, else word windows. A null text has no
    chunk, an empty one itself; repeated rows are cut each."""
    words = F.filter(F.split(F.col("text"), r"(?U)\s+"), lambda w: w != "")
    step = size - overlap
    parts = docs.select("doc_id", "text", T.once(words).alias("w")).select(
        "doc_id",
        F.when(F.size("w") <= size, F.array("text")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step)), lambda i: F.array_join(F.slice(F.col("w"), i + 1, size), " "))
        ).alias("chunks"),
    )
    return parts.select("doc_id", F.posexplode("chunks").alias("chunk_index", "chunk"))


def char_chunks(docs: DataFrame, size: int = 1000, overlap: int = 300, least: int = 200) -> DataFrame:
    """Character windows up to the first that is too short once stripped or that reaches the end. Null and
    empty texts have none; repeated rows are cut each."""
    n = F.length("text")
    step = size - overlap
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int")) * step, F.lit(step))).otherwise(F.array().cast("array<int>"))
    windows = F.transform(
        starts,
        lambda s: F.struct(s.alias("start_char"), F.least(s + size, n).alias("end_char"), F.regexp_replace(F.substring(F.col("text"), s + 1, F.lit(size)), r"(?U)^\s+|\s+$", "").alias("chunk")),
    )
    bad = F.filter(F.transform(F.col("x"), lambda c, i: F.when(F.length(c["chunk"]) < least, i)), lambda i: i.isNotNull())
    kept = docs.select("doc_id", T.once(windows).alias("x")).select("doc_id", F.slice("x", 1, F.coalesce(F.array_min(bad), F.size("x"))).alias("x"))
    return kept.select("doc_id", F.posexplode("x").alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.*")
