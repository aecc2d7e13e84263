"""Topic measures: co-occurrence, coherence, diversity, stability, choice of K; topic models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import similarity as S
from lexiloom.functions import text as T
from lexiloom.operators.corpus import tokenized
from lexiloom.operators.graph import cut_lineage


def cooccurrence(docs: DataFrame, words: DataFrame) -> DataFrame:
    """``a`` < ``b``, document counts and NPMI of every pair among ``words`` (``word``).

    Documents are cut to the words asked for before pairs are made, so pairs depend on the
    words and not on the documents' length.
    """
    tokens = docs.select("doc_id", T.once(F.array_distinct(T.k_tokens(F.col("text")))).alias("t")).where(F.size("t") > 0)
    n = tokens.agg(F.count(F.lit(1)).alias("n"))
    hits = cut_lineage(tokens.select("doc_id", F.explode("t").alias("word")).join(words, "word", "left_semi"))
    df = hits.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    own = hits.groupBy("doc_id").agg(F.sort_array(F.collect_set("word")).alias("w"))  # at most the words asked for
    pair = F.flatten(F.transform("w", lambda a: F.transform(F.filter("w", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    together = own.select(F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("df_ab"))
    known = df.select(F.col("word"), "df")
    joined = together.join(known.select(F.col("word").alias("a"), F.col("df").alias("df_a")), "a").join(known.select(F.col("word").alias("b"), F.col("df").alias("df_b")), "b")
    joined = joined.crossJoin(F.broadcast(n))
    return joined.select("a", "b", "df_a", "df_b", "df_ab", S.npmi(F.col("df_a"), F.col("df_b"), F.col("df_ab"), F.col("n")).alias("npmi"))


def coherence(topics: DataFrame, pairs: DataFrame) -> DataFrame:
    """``topic`` and its mean NPMI over all pairs of its words; unseen pairs count 0."""
    left = topics.select("topic", F.col("word").alias("x"))
    right = topics.select("topic", F.col("word").alias("y"))
    own = left.join(right, "topic").where("x < y").select("topic", F.col("x").alias("a"), F.col("y").alias("b"))
    return own.join(pairs, ["a", "b"], "left").groupBy("topic").agg(F.avg(F.coalesce("npmi", F.lit(0.0))).alias("coherence"))


def diversity(topics: DataFrame):
    return topics.agg((F.count_distinct("word") / F.count("word")).alias("diversity"))


def stability(runs: DataFrame) -> DataFrame:
    """Mean over pairs of runs of the greedy topic matching; ``runs`` has ``run``, ``topic``,
    ``words``. Each pair of runs, a handful of topics, is one group."""

    def match(pdf):
        a = [set(w) for w in pdf["wa"].iloc[0]]
        b = [set(w) for w in pdf["wb"].iloc[0]]
        left, scores = list(range(len(b))), []
        for x in a:
            if not left:
                break
            best = max(left, key=lambda j: (len(x & b[j]) / len(x | b[j]) if x | b[j] else 0.0, -j))
            scores.append(len(x & b[best]) / len(x | b[best]) if x | b[best] else 0.0)
            left.remove(best)
        return pd.DataFrame({"similarity": [sum(scores) / len(scores) if scores else 0.0]})

    own = runs.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("topic", "words"))), lambda s: s["words"]).alias("w"))
    pairs = own.select(F.col("run").alias("ra"), F.col("w").alias("wa")).join(own.select(F.col("run").alias("rb"), F.col("w").alias("wb")), F.col("ra") < F.col("rb"))
    return pairs.groupBy("ra", "rb").applyInPandas(match, "similarity double").agg(F.avg("similarity").alias("stability"))


def choose_k(rows: DataFrame, penalty: float = 0.1) -> DataFrame:
    """``k`` and ``score`` of (``k``, ``coherence``, ``diversity``, ``stability``), and ``best``."""
    w = Window.partitionBy()

    def norm(c):
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.when(high - low <= 1e-9 * F.greatest(F.abs(low), F.abs(high)), F.lit(0.0)).otherwise((F.col(c) - low) / (high - low))

    score = 0.5 * norm("coherence") + 0.25 * norm("diversity") + 0.25 * norm("stability") - penalty * norm("k")
    scored = rows.select("k", score.alias("score"))
    return scored.withColumn("best", F.row_number().over(Window.orderBy(F.desc("score"), "k")) == 1)


def lda_terms(docs: DataFrame, k: int = 4, terms: int = 10, seed: int = 1) -> DataFrame:
    """``topic``, ``rank``, ``term`` of a latent Dirichlet model."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    tokens = tokenized(docs)
    vocabulary = CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=5000, minDF=2, maxDF=0.7).fit(tokens)
    model = LDA(k=k, maxIter=10, seed=seed, optimizer="online").fit(vocabulary.transform(tokens))
    words = F.array(*[F.lit(w) for w in vocabulary.vocabulary])
    found = model.describeTopics(terms).select("topic", F.posexplode("termIndices").alias("rank", "i"))
    return found.select("topic", "rank", F.get(words, F.col("i")).alias("term"))


def kmeans(vectors: DataFrame, k: int = 8, seed: int = 1) -> DataFrame:
    """``vec_id`` and ``cluster``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=15).fit(points).transform(points).select("vec_id", F.col("prediction").alias("cluster"))


def cluster_stats(vectors: DataFrame, label: str = "label") -> DataFrame:
    """Size of each cluster and mean of 1 - x . mean, with the mean as it is."""
    long = vectors.select(label, "vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    mean = long.groupBy(label, "i").agg(F.avg("x").alias("m"))
    # the mean of x . m over a cluster's rows is m . m
    own = mean.groupBy(label).agg((1 - F.sum(F.col("m") * F.col("m"))).alias("distance"))
    return vectors.groupBy(label).agg(F.count(F.lit(1)).alias("n")).join(own, label)
