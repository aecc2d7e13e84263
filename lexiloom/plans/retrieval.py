"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import retrieval as R
from lexiloom.plans.registry import query, table

BM25 = """t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents), facts AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
a AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS token FROM benchmark),
p AS (SELECT doc_id, len, token, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS token FROM t) GROUP BY ALL),
f AS (SELECT token, count(*) AS df FROM p GROUP BY token),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
 FROM a JOIN p USING (token) JOIN f USING (token), facts GROUP BY ALL)"""
VECTORS = """v AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score
 FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0)"""


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {BM25}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s) SELECT * FROM r WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return R.top_k(R.bm25(table(spark, sf_dir, "documents"), _asked(spark, sf_dir)), 10)


@query(
    f"""WITH {BM25}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s
 WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND source = (SELECT min(source) FROM documents))) SELECT * FROM r WHERE rank <= 10"""
)
def filtered_topk(spark, sf_dir):
    """The best of one language and one source, under the counts of all documents."""
    docs = table(spark, sf_dir, "documents")
    source = docs.agg(F.min("source")).first()[0]
    return R.top_k(R.bm25(docs, _asked(spark, sf_dir), lang="en", source=source), 10)


@query(f"WITH {VECTORS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM v) SELECT * FROM r WHERE rank <= 10")
def vector_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.vector_top_k(vectors, asked, 10)


@query(
    f"""WITH {BM25}, v AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score
 FROM embeddings q JOIN benchmark b ON q.vec_id = b.item_id, embeddings d),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM v), sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM s),
x AS (SELECT query_id, doc_id, (score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0) AS x FROM sr WHERE r <= 50 WINDOW w AS (PARTITION BY query_id)),
y AS (SELECT query_id, doc_id, (score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0) AS y FROM vr WHERE r <= 50 WINDOW w AS (PARTITION BY query_id)),
z AS (SELECT query_id, doc_id, round(0.5 * coalesce(y, 0) + 0.5 * coalesce(x, 0), 6) AS score FROM x FULL JOIN y USING (query_id, doc_id)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM z) SELECT * FROM r WHERE rank <= 5"""
)
def hybrid_topk(spark, sf_dir):
    vectors, asked = table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir)
    lexical = R.top_k(R.bm25(table(spark, sf_dir, "documents"), asked), 50).drop("rank")
    own = vectors.join(asked.select("query_id"), F.col("vec_id") == F.col("query_id"), "inner").select("query_id", "embedding")
    semantic = R.vector_top_k(vectors, own, 50).drop("rank")
    return R.top_k(R.fused(lexical, semantic), 5)
