"""Retrieval: BM25 over an inverted index, exact vector search, fused ranking."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators.graph import cut_lineage

#: Queries that one block of the vector search holds.
BLOCK = 4096


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, **equal) -> DataFrame:
    """``query_id``, ``doc_id``, ``score`` of every pair that shares a token; with ``equal`` (column=value, all of them) only of the
    documents whose metadata say so. Counts and lengths are those of all documents, so a filter changes no score; null metadata match nothing.

    Postings are cut to the queries' tokens before the join that scores them; idf is
    ln(1 + (N - df + 0.5) / (df + 0.5)).
    """
    wanted_docs = reduce(lambda x, y: x & y, [F.col(c) == F.lit(v) for c, v in equal.items()], F.lit(True))
    tokens = docs.select("doc_id", F.coalesce(wanted_docs, F.lit(False)).alias("among"), T.once(T.word_tokens(F.lower("text"))).alias("t"))
    facts = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("mean"))
    asked = queries.select("query_id", F.explode(F.array_distinct(T.word_tokens(F.lower("text")))).alias("token"))
    wanted = asked.select("token").distinct()
    postings = tokens.select("doc_id", "among", F.size("t").alias("len"), F.explode("t").alias("token")).join(wanted, "token", "left_semi").groupBy("token", "doc_id", "among", "len").agg(F.count(F.lit(1)).alias("tf"))
    postings = cut_lineage(postings)
    df = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    scored = postings.where("among").join(df, "token").crossJoin(F.broadcast(facts)).select(
        "token", "doc_id",
        (F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))).alias("part"),
    )
    return scored.join(asked, "token").groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def top_k(scored: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Best ``k`` per query by rounded score, then id, with ``rank``."""
    rounded = scored.withColumn("score", F.round("score", digits))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Exact best ``k`` by dot product: ``query_id``, ``doc_id``, ``score``, ``rank``.

    Queries are packed into rows of ``BLOCK`` vectors and meet the vectors block by block; every task
    keeps only its own best ``k`` of each query, so what is shuffled doesn't depend on the rows.
    """
    packed = (
        queries.select(F.col("query_id"), F.col("embedding").cast("array<double>").alias("q"))
        .groupBy((F.col("query_id") % F.lit(997)).alias("slot"))
        .agg(F.collect_list(F.struct("query_id", "q")).alias("qs"))
    )
    pieces = packed.select(F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("qs") - 1) / BLOCK).cast("int")), lambda i: F.slice("qs", i * BLOCK + 1, BLOCK))).alias("qs"))
    blocks = [([r["query_id"] for r in row["qs"]], np.array([r["q"] for r in row["qs"]])) for row in pieces.toLocalIterator()]

    def best(frames):
        held: dict[int, list[tuple[float, int]]] = {}
        for pdf in frames:
            x = np.array(pdf["embedding"].tolist(), np.float64)
            own = pdf["vec_id"].to_numpy(np.int64)
            for ids, m in blocks:
                scores = np.round(m @ x.T, digits)
                for row, q in enumerate(ids):
                    order = np.lexsort((own, -scores[row]))[:k]
                    held[q] = sorted(held.get(q, []) + [(-float(scores[row, j]), int(own[j])) for j in order])[:k]
        rows = [(q, d, -s) for q, best in held.items() for s, d in best]
        yield pd.DataFrame(rows, columns=["query_id", "doc_id", "score"])

    found = vectors.select("vec_id", F.col("embedding").cast("array<double>")).mapInPandas(best, "query_id long, doc_id long, score double")
    return top_k(found, k, digits)


def fused(lexical: DataFrame, semantic: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Per query min-max scores of both rankings, mixed: ``alpha`` of the vectors', the rest of
    the words'. A document that one ranking lacks has 0 there."""
    w = Window.partitionBy("query_id")

    def scaled(x, name):
        low, high = F.min("score").over(w), F.max("score").over(w)
        return x.select("query_id", "doc_id", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(0.0)).alias(name))

    both = scaled(lexical, "x").join(scaled(semantic, "y"), ["query_id", "doc_id"], "full")
    zero = F.lit(0.0)
    return both.select("query_id", "doc_id", (alpha * F.coalesce("y", zero) + (1 - alpha) * F.coalesce("x", zero)).alias("score"))
