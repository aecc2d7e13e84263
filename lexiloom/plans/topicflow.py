"""Queries over local topics, clusters, reports; records are made of orders, topics of their lines."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lexiloom.operators import topicflow as P
from lexiloom.plans.registry import query, table


def records(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    topic = F.struct(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("local_topic_id"), F.when(F.col("l_quantity") > 10, F.concat(F.lit(" Part "), F.col("l_partkey").cast("string"))).alias("title"),
        F.when(F.col("l_discount") > 0.02, F.concat(F.lit("by "), F.col("l_suppkey").cast("string"))).alias("description"), F.lit(None).cast("string").alias("text_span"),
    )
    order = table(spark, sf_dir, "orders")
    nested = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(topic)).alias("topics"))
    return nested.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("record"), F.concat(F.lit("a"), F.col("o_custkey").cast("string")).alias("article_id"), F.lit(None).cast("string").alias("article_title"),
        "o_orderstatus", F.col("o_orderpriority").alias("section_id"), F.lit("").alias("section_heading"), "topics",
    )


TOPICS = """t AS (SELECT l_orderkey AS record, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS local_topic_id, 'a' || o_custkey AS article_id, o_orderpriority AS section_id, CASE WHEN l_quantity > 10 THEN 'Part ' || l_partkey ELSE '' END AS title,
 CASE WHEN l_discount > 0.02 THEN 'by ' || l_suppkey ELSE '' END AS description, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(f"""WITH {TOPICS} SELECT record, local_topic_id, article_id, concat_ws('. ', nullif(title, ''), nullif(description, '')) AS text FROM t""")
def local_topics(spark, sf_dir):
    t = P.exploded_topics(records(spark, sf_dir))
    return t.select("record", "local_topic_id", "article_id", P.topic_text(F.col("title"), F.col("description")).alias("text"))


def labelled(spark, sf_dir):
    """Customers as topics, their segments as clusters, those in debt as noise."""
    label = F.when(F.col("c_acctbal") < 0, -1).otherwise(F.col("c_nationkey"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("index"), label.alias("label"), "c_mktsegment")


@query(
    """WITH l AS (SELECT c_custkey AS i, CASE WHEN c_acctbal < 0 THEN -1 ELSE c_nationkey END AS label FROM customer), n AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS n FROM (SELECT DISTINCT label FROM l WHERE label >= 0))
SELECT 'CLUSTER_' || lpad(n::VARCHAR, 4, '0') AS cluster_id, count(*) AS size, false AS is_noise, string_agg(i::VARCHAR, ',' ORDER BY i) AS indices FROM l JOIN n USING (label) GROUP BY n UNION ALL SELECT NULL, 1, true, i::VARCHAR FROM l WHERE label < 0"""
)
def topic_clusters(spark, sf_dir):
    rows = P.clusters(labelled(spark, sf_dir))
    return rows.withColumn("indices", F.array_join(F.transform("indices", lambda i: i.cast("string")), ","))


@query(
    """WITH f AS (SELECT c_nationkey AS label, c_mktsegment AS article_id, min(c_custkey) AS first FROM customer GROUP BY 1, 2) SELECT label, article_id, row_number() OVER (PARTITION BY label ORDER BY first) AS place FROM f"""
)
def cluster_sources(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").alias("index"), F.col("c_nationkey").alias("label"), F.concat(F.col("c_mktsegment"), F.lit(" ")).alias("article_id"), F.lit("").alias("article_title"), F.lit(None).cast("string").alias("section_id"), F.lit("").alias("section_heading"))
    return P.first_sources(P.usable_sources(rows)).select("label", "article_id", F.col("place").cast("long").alias("place"))


@query("""WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer WHERE c_acctbal < 0) SELECT floor(i / 20)::BIGINT AS batch, string_agg(c_custkey::VARCHAR, ',' ORDER BY i) AS items FROM n GROUP BY 1""")
def noise_batches(spark, sf_dir):
    noise = labelled(spark, sf_dir).where("label < 0").select("index")
    return P.batches(noise).select("batch", F.array_join(F.transform("items", lambda s: s["index"].cast("string")), ",").alias("items"))


def stub(text: str) -> str:
    """Keeps topics with a long name and invents one id."""
    items = json.loads(text)["items"]
    return json.dumps([{"id": x["id"], "title": x["name"].upper(), "keep": len(x["name"]) > 10} for x in items] + [{"id": "unknown", "title": "?", "keep": True}])


@query("""SELECT p_partkey::VARCHAR AS local_topic_id, upper(p_name) AS canonical FROM part WHERE length(p_name) > 10""")
def canonical_topics(spark, sf_dir):
    """The provider is a stub; its answers come back to the topics they name."""
    topics = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("local_topic_id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("index"))
    asked = P.batches(topics).select("batch", F.to_json(F.struct(F.transform("items", lambda s: F.struct(s["local_topic_id"].alias("id"), s["name"].alias("name"))).alias("items"))).alias("payload"))
    return P.matched_answers(P.ask(asked, stub), topics).select("local_topic_id", "canonical")


@query(
    """SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'O' THEN 1.0 WHEN 'F' THEN 2.0 ELSE 3.0 END::DOUBLE AS text, CASE o_orderstatus WHEN 'O' THEN NULL WHEN 'F' THEN 1.0 ELSE 0.5 END::DOUBLE AS bigrams FROM orders"""
)
def modality_weights(spark, sf_dir):
    x = F.when(F.col("o_orderstatus") == "O", " ").when(F.col("o_orderstatus") == "F", "2 : 1").otherwise("3:0.5:0.1")
    w = P.modality_weights(x)
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", w["text"].alias("text"), w["bigrams"].alias("bigrams"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE value END AS value FROM events""")
def finite_values(spark, sf_dir):
    v = F.when(F.col("event_type") == "click", F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", P.finite(v).alias("value"))


@query("""SELECT true AS whole_rows, true AS size_near, true AS repeats""")
def bootstrap_sample(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    s = P.bootstrap(d, 0.8, 7)
    n, k = d.agg(F.count(F.lit(1)).alias("n")), s.agg(F.count(F.lit(1)).alias("k"), F.max("draw").alias("m"), F.count_distinct("doc_id").alias("u"))
    return n.crossJoin(k).select((F.col("u") <= F.col("n")).alias("whole_rows"), (F.abs(F.col("k") - 0.8 * F.col("n")) < 6 * F.sqrt("n")).alias("size_near"), (F.col("m") > 1).alias("repeats"))


@query(
    """WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS chunk, l_suppkey AS paper, l_partkey AS start FROM lineitem GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY chunk, paper, start) AS n FROM c),
d AS (SELECT min(chunk) AS chunk FROM o GROUP BY paper UNION SELECT min(chunk) FROM o GROUP BY start) SELECT DISTINCT chunk FROM d ORDER BY chunk LIMIT 5"""
)
def diverse_chunks(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk")).agg(F.min(F.struct("l_suppkey", "l_partkey")).alias("m"), F.collect_set(F.struct("l_suppkey", "l_partkey")).alias("all"))
    rows = line.select("chunk", F.explode("all").alias("p")).select("chunk", F.col("p.l_suppkey").alias("paper"), F.col("p.l_partkey").alias("start"))
    return P.diverse(rows, 50).select("chunk").distinct().orderBy("chunk").limit(5)


@query("""SELECT n_regionkey AS key, array_to_string(list_sort(list(n_name ORDER BY n_name)[1:3]), ' ') AS examples FROM nation GROUP BY 1""")
def capped_examples(spark, sf_dir):
    return P.capped_lists(table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "key"), "key", "n_name", 3)


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN p_partkey ELSE 999999 END::INT AS place FROM part""")
def file_order(spark, sf_dir):
    name = F.when(F.col("p_size") > 25, F.concat(F.col("p_partkey").cast("string"), F.lit("-2101.00001.pdf"))).otherwise(F.concat(F.lit("x"), F.col("p_partkey").cast("string"), F.lit(".pdf")))
    return table(spark, sf_dir, "part").select("p_partkey", P.file_order(name).alias("place"))


@query("""SELECT CASE WHEN o_orderstatus = 'F' THEN 'c' || o_custkey ELSE 'p' || o_custkey END AS pid, max_by(o_orderpriority, o_orderkey) AS title FROM orders GROUP BY 1""")
def references_by_id(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_custkey").cast("string")
    rows = o.select(
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("c"), k)).otherwise("").alias("ref_id"), F.concat(F.lit("https://a.org/p"), k, F.lit(".pdf")).alias("pdf_url"),
        F.col("o_orderpriority").alias("title"), F.lit(2000).alias("year"), F.lit("").alias("venue"), "o_orderkey",
    )
    return P.last_by_key(rows, "o_orderkey").select("pid", "title")


@query("""SELECT level, kind, n FROM (SELECT CASE WHEN value < 50 THEN 'error' ELSE 'warning' END AS level, event_type AS kind, count(*) AS n FROM events WHERE value < 200 GROUP BY 1, 2) ORDER BY n DESC, level, kind LIMIT 10""")
def log_error_types(spark, sf_dir):
    level = F.when(F.col("value") < 50, "error").when(F.col("value") < 200, "warning").otherwise("info")
    return P.log_errors(table(spark, sf_dir, "events").where("value is not null").select(level.alias("level"), F.col("event_type").alias("kind")))


@query("""SELECT CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal >= 10000 THEN 11 ELSE floor(c_acctbal / 1000)::BIGINT + 1 END AS bucket, count(*) AS n FROM customer GROUP BY 1""")
def score_histogram(spark, sf_dir):
    return P.histogram(table(spark, sf_dir, "customer"), "c_acctbal", 0.0, 10000.0, 10)


@query("""SELECT year(o_orderdate) AS year, o_orderstatus AS kind, count(*) AS n, median(o_totalprice) AS median, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1, 2""")
def value_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("kind"))
    return o.agg(F.count(F.lit(1)).alias("n"), F.median("o_totalprice").alias("median"), F.round(F.avg("o_totalprice"), 2).alias("mean"))


@query("""SELECT o_custkey AS survey, count(*) AS n, min(o_orderkey)::VARCHAR AS first FROM orders GROUP BY 1""")
def survey_papers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    paper = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("year"), "o_orderkey")
    documents = o.groupBy(F.col("o_custkey").alias("survey")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", paper.alias("p")))), lambda s: s["p"]).alias("papers"))).alias("document"))
    found = P.papers(F.col("document"))
    return documents.select("survey", F.size(found).cast("long").alias("n"), F.get(found, F.lit(0))["id"].alias("first"))


@query("""SELECT r_regionkey AS pattern, 'Which ' || n_name || ' parts does ' || r_name || ' need?' AS question FROM region JOIN nation ON n_regionkey = r_regionkey""")
def filled_patterns(spark, sf_dir):
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    patterns = region.select(F.col("r_regionkey").alias("pattern"), F.concat(F.lit("Which [NATION] parts does "), "r_name", F.lit(" need?")).alias("text"), F.col("r_regionkey").alias("entity_list"))
    return P.filled_patterns(patterns, nation.select(F.col("n_regionkey").alias("entity_list"), F.col("n_name").alias("entity")))


@query("""SELECT count(*) FILTER (value < 50) AS found, count(*) FILTER (value >= 50 AND value < 150) AS downloaded, count(*) FILTER (value >= 150 AND event_type <> 'error') AS skipped, count(*) FILTER (value >= 150 AND event_type = 'error') AS errors FROM events""")
def download_counters(spark, sf_dir):
    v = F.col("value")
    wrong = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").agg(
        F.count_if(v < 50).alias("found"), F.count_if((v >= 50) & (v < 150)).alias("downloaded"), F.count_if((v >= 150) & ~wrong).alias("skipped"), F.count_if((v >= 150) & wrong).alias("errors")
    )


@query("""SELECT doc_id, left(coalesce(text, ''), 800) AS raw_text, left(coalesce(text, ''), 200) AS preview FROM documents""")
def truncated_texts(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.left(text, F.lit(800)).alias("raw_text"), F.left(text, F.lit(200)).alias("preview"))


@query(
    """WITH a AS (SELECT count(*) AS n_orders, round(avg(o_totalprice), 4) AS mean_price FROM orders), b AS (SELECT count(*) AS n_customers FROM customer), c AS (SELECT count(DISTINCT n_regionkey) AS regions FROM nation) SELECT * FROM a, b, c"""
)
def summary_row(spark, sf_dir):
    """Three metric documents of one row each side by side."""
    a = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))
    b, c = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n_customers")), table(spark, sf_dir, "nation").agg(F.count_distinct("n_regionkey").alias("regions"))
    return a.crossJoin(b).crossJoin(c)
