"""Queries that extract identifiers, links and page metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import extract as X
from lexiloom.functions import text as T
from lexiloom.plans.registry import query, table

TEXTS = [
    (1, "see https://doi.org/10.1234/ABC.5)."), (2, "arXiv:2405.00334v2 and DOI: 10.5555/x.y;"), (3, "at http://arxiv.org/pdf/1706.03762 or https://a.org/b.pdf, yes"),
    (4, "10.48550/arxiv.2405.00334"), (5, ""), (6, None), (7, "two\nlines https://x.y/z)"),
]
PDFS = [
    (1, "http://arxiv.org/pdf/2111.02275v2.pdf"), (2, "https://ieeexplore.ieee.org/stamp/stamp.jsp?tp=&arnumber=123"), (3, "https://dl.acm.org/doi/pdf/10.1145/1"),
    (4, "https://x.org/paper.pdf"), (5, "https://openreview.net/forum?id=abc"), (6, "https://x.org/y"),
]
MARKDOWN = [(1, "[[PDF]](https://a.org/1) ![i](https://a.org/i.png) [t](#top) [u](https://a.org/2) https://a.org/3. [v](https://a.org/1)"), (2, "none")]
REFS = [(1, "2405.00334", "10.1/x", "T"), (2, "", "10.1145/ABC.5", "T"), (3, None, None, "Deep Active Learning: A Survey"), (4, "", "", "")]


def _values(rows) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


@query(
    f"""WITH s AS (SELECT * FROM (VALUES {_values(TEXTS)}) v(id, x) UNION ALL SELECT 100 + page_id, url FROM pages)
SELECT id, lower(regexp_replace(nullif(regexp_extract(x, '(?i)(?:doi\\.org/|doi[:\\s]+)(10\\.\\d{{4,}}/[^\\s)]+)', 1), ''), '[.,;)]+$', '')) AS doi,
 nullif(regexp_extract(x, '(?i)(?:arxiv[:\\s]+|arxiv\\.org/(?:abs|pdf)/)(\\d{{4}}\\.\\d{{4,}})', 1), '') AS arxiv_id,
 array_to_string(list_transform(regexp_extract_all(regexp_replace(coalesce(x, ''), '\\s+', ' ', 'g'), '(?i)https?://[^\\s)\\]]+'), lambda u: regexp_replace(u, '[.,;)]+$', '')), ' ') AS urls FROM s"""
)
def doi_arxiv_url_extract(spark, sf_dir):
    x = F.col("x")
    rows = spark.createDataFrame(TEXTS, "id long, x string").unionByName(table(spark, sf_dir, "pages").select((100 + F.col("page_id")).alias("id"), F.col("url").alias("x")))
    return rows.select("id", X.doi(x).alias("doi"), X.arxiv_id(x).alias("arxiv_id"), F.array_join(X.urls(x), " ").alias("urls"))


@query(
    """SELECT * FROM (VALUES (1, 'https://arxiv.org/abs/2111.02275', 'arxiv'), (2, 'https://ieeexplore.ieee.org/document/123', NULL), (3, 'https://dl.acm.org/doi/10.1145/1', NULL),
 (4, 'https://x.org/paper', 'direct'), (5, '', 'openreview'), (6, '', NULL)) t(id, article, kind)"""
)
def pdf_links(spark, sf_dir):
    rows = spark.createDataFrame(PDFS, "id int, u string")
    return rows.select("id", X.article_url(F.col("u")).alias("article"), X.pdf_source(F.col("u")).alias("kind"))


@query("SELECT * FROM (VALUES (1, 'https://a.org/1 https://a.org/2 https://a.org/i.png https://a.org/3'), (2, '')) t(id, links)")
def markdown_links(spark, sf_dir):
    rows = spark.createDataFrame(MARKDOWN, "id int, x string")
    return rows.select("id", F.array_join(X.markdown_links(F.col("x")), " ").alias("links"))


@query(
    f"""WITH r AS (SELECT * FROM (VALUES {_values(REFS)}) v(id, a, d, t))
SELECT id, coalesce(nullif(a, ''), nullif(trim(regexp_replace(nullif(d, ''), '[^A-Za-z0-9]+', '-', 'g'), '-'), ''),
 left(trim(regexp_replace(lower(nullif(t, '')), '[^a-z0-9]+', '-', 'g'), '-'), 50) || '-' || left(sha256(t), 8), 'ref-' || left(sha256('' || id), 12)) AS ref_id FROM r"""
)
def ref_ids(spark, sf_dir):
    rows = spark.createDataFrame(REFS, "id int, a string, d string, t string")
    return rows.select("id", X.ref_id(F.col("a"), F.col("d"), F.col("t"), F.col("id").cast("string")).alias("ref_id"))


@query(
    """SELECT page_id, nullif(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '') AS title,
 nullif(regexp_extract(html, '(?i)<meta[^>]+name="description"[^>]+content="([^"]*)"', 1), '') AS description, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages"""
)
def page_metadata(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", X.page_title(h).alias("title"), X.meta_tag(h, "description").alias("description"), X.host(F.col("url")).alias("host"))


@query(
    """WITH p AS (SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages)
SELECT CASE WHEN host LIKE '%ieee%' THEN 'ieee' WHEN host LIKE '%acm.org' THEN 'acm' WHEN host LIKE '%springer%' THEN 'springer' WHEN host LIKE '%openreview%' THEN 'openreview' ELSE 'generic' END AS parser,
 host, count(*) AS n FROM p GROUP BY 1, 2"""
)
def host_dispatch(spark, sf_dir):
    host = X.host(F.col("url"))
    kind = F.when(host.contains("ieee"), "ieee").when(host.endswith("acm.org"), "acm").when(host.contains("springer"), "springer").when(host.contains("openreview"), "openreview").otherwise("generic")
    return table(spark, sf_dir, "pages").groupBy(kind.alias("parser"), host.alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lower(string_split(url, '?')[1]) AS key, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY 1")
def url_dedupe(spark, sf_dir):
    key = F.lower(F.substring_index("url", "?", 1)).alias("key")
    return table(spark, sf_dir, "pages").groupBy(key).agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES (1, 'Deep Learning Model'), (2, 'Name'), (3, 'graph nn')) t(id, label)")
def iri_labels(spark, sf_dir):
    rows = spark.createDataFrame([(1, "http://x.org/o#DeepLearningModel"), (2, "http://x.org/a/Name"), (3, "http://x.org/o#graph_nn")], "id int, iri string")
    return rows.select("id", T.split_camel(T.local_name(F.col("iri"))).alias("label"))


SECTIONS = "# Top\nintro\n## Surveys\n- a\n### Deep\n- b\n## Other\n- c"


@query("SELECT 'surveys' AS anchor, '- a' || chr(10) || '### Deep' || chr(10) || '- b' AS body")
def sections_fold(spark, sf_dir):
    """The lines from a heading up to the next one of its level or above, as folds inside the row."""
    lines = F.split(F.lit(SECTIONS), "\n")
    level = lambda x: F.length(F.regexp_extract(x, r"^(#{1,6})\s+.+$", 1))
    marked = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"), level(x).alias("level"), T.heading_anchor(F.regexp_extract(x, r"^#{1,6}\s+(.+)$", 1)).alias("anchor")))
    rows = spark.range(1).select(F.lit("surveys").alias("anchor"), marked.alias("m"))
    rows = rows.withColumn("start", F.get(F.filter("m", lambda s: (s["level"] > 0) & ((s["anchor"] == F.col("anchor")) | s["anchor"].startswith(F.concat("anchor", F.lit("-"))))), F.lit(0)))
    stop = F.get(F.filter("m", lambda s: (s["i"] > F.col("start.i")) & (s["level"] > 0) & (s["level"] <= F.col("start.level"))), F.lit(0))["i"]
    body = F.filter("m", lambda s: (s["i"] > F.col("start.i")) & (s["i"] < F.coalesce(F.col("stop"), F.size("m"))))
    return rows.withColumn("stop", stop).select("anchor", F.array_join(F.transform(body, lambda s: s["x"]), "\n").alias("body"))
