"""Topic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import artm as A
from lexiloom.operators import topics as P
from lexiloom.plans.registry import query, table

TOPICS = [("t1", w) for w in ("the", "and", "that", "with")] + [("t2", w) for w in ("und", "die", "der", "the")] + [("t3", w) for w in ("les", "des", "est", "zzzz")]
_T = ", ".join(f"('{t}', '{w}')" for t, w in TOPICS)
PAIRS = f"""topics AS (SELECT * FROM (VALUES {_T}) v(topic, word)),
d AS (SELECT doc_id, regexp_extract_all(regexp_replace(regexp_replace(lower(text), '`[^`]+`', ' ', 'g'), '\\[([^\\]]+)\\]\\(([^)]+)\\)', '\\1', 'g'), '[a-z][a-z0-9\\-]{{2,}}') AS t FROM documents),
n AS (SELECT count(*) AS n FROM d WHERE len(t) > 0), h AS (SELECT DISTINCT doc_id, unnest(t) AS word FROM d), w AS (SELECT * FROM h WHERE word IN (SELECT word FROM topics)),
df AS (SELECT word, count(*) AS df FROM w GROUP BY word),
ab AS (SELECT x.word AS a, y.word AS b, count(*) AS df_ab FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word < y.word GROUP BY ALL),
pairs AS (SELECT a, b, p.df AS df_a, q.df AS df_b, df_ab, coalesce(ln(df_ab * n::DOUBLE / (p.df * q.df)) / nullif(-ln(df_ab / n), 0), 0) AS npmi FROM ab JOIN df p ON p.word = a JOIN df q ON q.word = b, n)"""


def _topics(spark):
    return spark.createDataFrame(TOPICS, "topic string, word string")


def _pairs(spark, sf_dir):
    return P.cooccurrence(table(spark, sf_dir, "documents"), _topics(spark).select("word").distinct())


@query(f"WITH {PAIRS} SELECT a, b, df_a, df_b, df_ab, round(npmi, 6) AS npmi FROM pairs")
def cooccurrence_npmi(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("npmi", F.round("npmi", 6))


@query(
    f"""WITH {PAIRS}, o AS (SELECT x.topic, x.word AS a, y.word AS b FROM topics x JOIN topics y ON x.topic = y.topic AND x.word < y.word)
SELECT topic, round(avg(coalesce(npmi, 0)), 6) AS coherence FROM o LEFT JOIN pairs USING (a, b) GROUP BY topic"""
)
def topic_coherence(spark, sf_dir):
    return P.coherence(_topics(spark), _pairs(spark, sf_dir)).withColumn("coherence", F.round("coherence", 6))


@query(f"SELECT round(count(DISTINCT word) / count(*), 6) AS diversity FROM (VALUES {_T}) v(topic, word)")
def topic_diversity(spark, sf_dir):
    return P.diversity(_topics(spark)).select(F.round("diversity", 6).alias("diversity"))


@query("SELECT round((1.0 + 0.5 + 0.0) / 3, 6)::DOUBLE AS stability")
def topic_stability(spark, sf_dir):
    rows = [(1, 0, ["a", "b"]), (1, 1, ["c", "d"]), (2, 0, ["c", "d"]), (2, 1, ["a", "b"]), (3, 0, ["a", "b"]), (3, 1, ["x", "y"])]
    found = P.stability(spark.createDataFrame(rows, "run int, topic int, words array<string>"))
    return found.select(F.round("stability", 6).alias("stability"))


@query("SELECT * FROM (VALUES (10, 0.25::DOUBLE, false), (20, 0.575, true), (30, 0.15, false)) t(k, score, best)")
def k_selection(spark, sf_dir):
    rows = spark.createDataFrame([(10, 0.1, 0.9, 0.5), (20, 0.3, 0.8, 0.5), (30, 0.2, 0.7, 0.5)], "k int, coherence double, diversity double, stability double")
    return P.choose_k(rows).withColumn("score", F.round("score", 6))


@query(
    """WITH l AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM l GROUP BY ALL),
d AS (SELECT label, 1 - sum(m * m) AS distance FROM m GROUP BY label), s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT label, n, round(distance, 6) AS distance FROM s JOIN d USING (label)"""
)
def cluster_stats(spark, sf_dir):
    return P.cluster_stats(table(spark, sf_dir, "embeddings")).withColumn("distance", F.round("distance", 6))


@query()
def lda_topics(spark, sf_dir):
    return P.lda_terms(table(spark, sf_dir, "documents"))


@query()
def kmeans_clusters(spark, sf_dir):
    return P.kmeans(table(spark, sf_dir, "embeddings"))


def _tokens(spark, sf_dir):
    docs = P.tokenized(table(spark, sf_dir, "documents"))
    return docs.select(F.lit(0).alias("fit"), F.col("doc_id").alias("doc"), F.explode("tokens").alias("word"), F.lit(1).alias("n"))


@query()
def regularized_topics(spark, sf_dir):
    """Top words of a model whose topics are made sparse and unlike each other; the last topic takes common words."""
    topics = spark.createDataFrame([(0, 6)], "fit int, k int")
    phi, _ = A.fit(_tokens(spark, sf_dir), topics, rounds=5, phi_tau=-0.1, theta_tau=-0.05, decorrelation=1000.0, background=1, smooth=0.1)
    return A.top_words(phi, 10).select(F.col("t").alias("topic"), "rank", "word", F.round("p", 8).alias("p"))


@query()
def topic_number_search(spark, sf_dir):
    return A.search(table(spark, sf_dir, "documents"), [2, 4, 6], rounds=3)
