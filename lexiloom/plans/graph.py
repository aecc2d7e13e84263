"""Queries over the provenance graph and class hierarchies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiloom.operators import graph as G
from lexiloom.operators import hierarchy as H
from lexiloom.plans.registry import query, table

EVIDENCE = """n AS (SELECT count(*) AS k FROM benchmark),
e AS (SELECT 'q' || (doc_id % k) AS cq, 'd' || doc_id || '__c0' AS chunk, source AS paper, (doc_id * 37 % 100) / 100.0 AS score, 0 AS pos FROM documents, n)"""


def evidence(spark, sf_dir):
    """Every document is evidence for one question."""
    k = table(spark, sf_dir, "benchmark").agg(F.count(F.lit(1)).alias("k"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source").crossJoin(F.broadcast(k))
    return d.select(
        F.concat(F.lit("q"), (F.col("doc_id") % F.col("k")).cast("string")).alias("cq_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("__c0")).alias("chunk_id"),
        F.col("source").alias("paper_id"), (F.col("doc_id") * 37 % 100 / 100).alias("score"), F.lit(0).alias("pos"),
    )


def edges(spark, sf_dir):
    e = evidence(spark, sf_dir)
    own = e.select(F.col("chunk_id").alias("s"), F.lit("inPaper").alias("p"), F.col("paper_id").alias("o"))
    return own.unionByName(e.select(F.col("cq_id").alias("s"), F.lit("supportedBy").alias("p"), F.col("chunk_id").alias("o"))).distinct()


EDGES = EVIDENCE + """, g AS (SELECT DISTINCT chunk AS s, 'inPaper' AS p, paper AS o FROM e UNION SELECT DISTINCT cq, 'supportedBy', chunk FROM e)"""


@query(
    f"""WITH {EVIDENCE}, i AS (SELECT 'kg:cq/' || cq AS cq, 'kg:chunk/' || chunk AS chunk, 'kg:paper/' || paper AS paper, '_:s' || sha1(cq || '|' || chunk || '|' || pos) AS sup FROM e)
SELECT cq AS s, 'rdf:type' AS p, 'kg:CQ' AS o FROM i UNION SELECT chunk, 'rdf:type', 'kg:Chunk' FROM i UNION SELECT paper, 'rdf:type', 'kg:Paper' FROM i
UNION SELECT sup, 'rdf:type', 'kg:Support' FROM i UNION SELECT chunk, 'kg:inPaper', paper FROM i UNION SELECT cq, 'kg:supportedBy', chunk FROM i UNION SELECT sup, 'kg:fromCQ', cq FROM i
UNION SELECT sup, 'kg:toChunk', chunk FROM i UNION SELECT sup, 'prov:wasDerivedFrom', chunk FROM i"""
)
def kg_triples(spark, sf_dir):
    return G.evidence_triples(evidence(spark, sf_dir)).where("p <> 'kg:score'")


@query(f"WITH {EVIDENCE} SELECT 'kg:cq/' || cq AS subject, 'supportedBy' AS predicate, 'kg:chunk/' || chunk AS object, string_split(chunk, '__')[1] AS doc_id, chunk AS chunk_id, round(score, 6) AS score FROM e")
def kg_provenance(spark, sf_dir):
    e = evidence(spark, sf_dir)
    return e.select(
        F.concat(F.lit("kg:cq/"), "cq_id").alias("subject"), F.lit("supportedBy").alias("predicate"), F.concat(F.lit("kg:chunk/"), "chunk_id").alias("object"),
        F.substring_index("chunk_id", "__", 1).alias("doc_id"), "chunk_id", F.round("score", 6).alias("score"),
    )


@query(f"WITH {EVIDENCE} SELECT count(DISTINCT cq) AS n_cqs, count(DISTINCT chunk) AS n_chunks, count(DISTINCT paper) AS n_papers, count(*) AS n_supports FROM e")
def kg_stats(spark, sf_dir):
    types = G.evidence_triples(evidence(spark, sf_dir)).where("p = 'rdf:type'")
    n = lambda o: F.count_if(F.col("o") == f"kg:{o}")
    return types.agg(n("CQ").alias("n_cqs"), n("Chunk").alias("n_chunks"), n("Paper").alias("n_papers"), n("Support").alias("n_supports"))


@query(
    f"""WITH {EDGES}, v AS (SELECT count(*) AS n FROM (SELECT s FROM g UNION SELECT o FROM g)), c AS (SELECT p, count(*) AS c FROM g GROUP BY p), t AS (SELECT sum(c) AS m FROM c)
SELECT n AS n_nodes, CAST(m AS BIGINT) AS n_edges, round(m / (n * (n - 1)), 6) AS density, round(2 * m / n, 4) AS avg_degree,
 round((SELECT -sum(c / m * log2(c / m)) FROM c), 4) AS predicate_entropy, round((SELECT max(c) FROM c) / m, 4) AS top1_share, round((SELECT sum(c) FROM (SELECT c FROM c ORDER BY c DESC LIMIT 3)) / m, 4) AS top3_share FROM v, t"""
)
def graph_metrics(spark, sf_dir):
    return G.edge_metrics(edges(spark, sf_dir))


#: Every customer is tied to the next one of its nation and segment and to its orders: components grow with the tables.
CHAIN = """l AS (SELECT c_custkey AS a, lead(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS b FROM customer QUALIFY b IS NOT NULL
UNION ALL SELECT o_custkey, 1000000000 + o_orderkey FROM orders)"""


def chain(spark, sf_dir):
    following = F.lead("c_custkey").over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey"))
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), following.alias("b")).where("b is not null")
    return own.unionByName(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (1_000_000_000 + F.col("o_orderkey")).alias("b")))


@query(
    f"""WITH RECURSIVE {CHAIN}, u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r(node, m) AS (SELECT a, a FROM u UNION SELECT u.b, r.m FROM r JOIN u ON r.node = u.a)
SELECT node, min(m) AS component FROM r GROUP BY node"""
)
def connected_components(spark, sf_dir):
    return G.connected_components(chain(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {CHAIN}, u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r(node, m) AS (SELECT a, a FROM u UNION SELECT u.b, r.m FROM r JOIN u ON r.node = u.a),
k AS (SELECT component, count(*) AS n FROM (SELECT node, min(m) AS component FROM r GROUP BY node) GROUP BY component)
SELECT count(*) AS n_components, max(n) AS giant_size, round(max(n) / sum(n), 4) AS giant_share FROM k"""
)
def component_summary(spark, sf_dir):
    sizes = G.connected_components(chain(spark, sf_dir)).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_components"), F.max("n").alias("giant_size"), F.round(F.max("n") / F.sum("n"), 4).alias("giant_share"))


@query(
    """WITH RECURSIVE p AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
d(node, depth) AS (SELECT DISTINCT parent, 0 FROM p WHERE parent NOT IN (SELECT child FROM p) UNION SELECT p.child, d.depth + 1 FROM d JOIN p ON d.node = p.parent)
SELECT node, max(depth) AS depth FROM d GROUP BY node"""
)
def class_depth(spark, sf_dir):
    name = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    own = nation.select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent"))
    return H.depths(own.union(customer.select(name("c", "c_custkey"), name("n", "c_nationkey"))))


#: The nations of a region form a cycle. Customers stand in chains of a thousand, each of which ends in a region's cycle, and each
#: cycle but the last leads to the chain that ends in the next one.
CLASSES = """m AS (SELECT n_regionkey AS r, min(n_nationkey) AS n FROM nation GROUP BY n_regionkey),
p AS (SELECT 'c' || a.c_custkey AS child, 'c' || b.c_custkey AS parent FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_custkey % 1000 <> 0
UNION SELECT 'c' || c_custkey, 'n' || n FROM customer JOIN m ON r = (c_custkey // 1000 - 1) % 5 WHERE c_custkey % 1000 = 0
UNION SELECT 'n' || n_nationkey, 'n' || coalesce(lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), min(n_nationkey) OVER (PARTITION BY n_regionkey)) FROM nation
UNION SELECT 'n' || n, 'c' || (1000 * r + 1001) FROM m WHERE r < 4)"""


def classes(spark, sf_dir):
    key = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    after = customer.select((F.col("c_custkey") - 1).alias("c_custkey"), key("c", "c_custkey").alias("parent"))
    chains = customer.where("c_custkey % 1000 <> 0").join(after, "c_custkey").select(key("c", "c_custkey").alias("child"), "parent")
    first = nation.groupBy(F.col("n_regionkey").cast("long").alias("r")).agg(F.min("n_nationkey").alias("n"))
    ends = customer.where("c_custkey % 1000 = 0").withColumn("r", F.expr("(c_custkey div 1000 - 1) % 5")).join(first, "r").select(key("c", "c_custkey"), key("n", "n"))
    region = Window.partitionBy("n_regionkey")
    onward = F.coalesce(F.lead("n_nationkey").over(region.orderBy("n_nationkey")), F.min("n_nationkey").over(region))
    cycles = nation.select(key("n", "n_nationkey"), F.concat(F.lit("n"), onward.cast("string")))
    leads = first.where("r < 4").select(key("n", "n"), F.concat(F.lit("c"), (1000 * F.col("r") + 1001).cast("string")))
    return chains.union(ends).union(cycles).union(leads)


@query(
    f"""WITH RECURSIVE {CLASSES}, n AS (SELECT child AS node FROM p UNION SELECT parent FROM p), r(a, b) AS (SELECT child, parent FROM p UNION SELECT r.a, p.parent FROM r JOIN p ON p.child = r.b),
k AS (SELECT node, least(node, coalesce(min(x.b), node)) AS spot FROM n LEFT JOIN (SELECT r.a, r.b FROM r JOIN r q ON q.a = r.b AND q.b = r.a) x ON x.a = node GROUP BY node),
e AS (SELECT DISTINCT c.spot AS child, q.spot AS parent FROM p JOIN k c ON c.node = p.child JOIN k q ON q.node = p.parent WHERE c.spot <> q.spot),
d(spot, depth) AS (SELECT DISTINCT spot, 0 FROM k WHERE spot NOT IN (SELECT child FROM e) UNION SELECT e.child, d.depth + 1 FROM d JOIN e ON e.parent = d.spot)
SELECT node, max(depth)::INTEGER AS depth FROM k JOIN d USING (spot) GROUP BY node"""
)
def cyclic_class_depth(spark, sf_dir):
    return H.depths(classes(spark, sf_dir))


@query(
    """WITH p AS (SELECT n_regionkey AS parent, count(*) AS c FROM nation GROUP BY 1)
SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS n_classes, round(sum(c) / count(*), 4) AS inheritance_richness, max(c) AS branching_max FROM p"""
)
def schema_metrics(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    p = nation.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("c")).agg(F.round(F.sum("c") / F.count(F.lit(1)), 4).alias("inheritance_richness"), F.max("c").alias("branching_max"))
    n = nation.select("n_nationkey").union(region.select("r_regionkey")).agg(F.count(F.lit(1)).alias("n_classes"))
    return n.crossJoin(p)


@query(
    f"""WITH {EVIDENCE}, c AS (SELECT paper, count(*) AS c FROM e GROUP BY paper), t AS (SELECT count(*) AS n FROM e)
SELECT n AS n_statements, round((SELECT count(*) FILTER (coalesce(trim(paper), '') <> '') FROM e) / n, 4) AS evidence_coverage, (SELECT count(*) FROM c) AS doc_diversity, round((SELECT max(c) FROM c) / n, 4) AS doc_top1_share,
 round((SELECT -sum(c / n * log2(c / n)) FROM c), 4) AS doc_entropy, round((SELECT avg(score::DOUBLE) FROM e), 4) AS score_mean,
 round((SELECT count(*) FILTER (score >= 0.5) FROM e) / n, 4) AS score_ge_05, round((SELECT count(*) FILTER (score >= 0.7) FROM e) / n, 4) AS score_ge_07, round((SELECT count(*) FILTER (score >= 0.9) FROM e) / n, 4) AS score_ge_09 FROM t"""
)
def provenance_metrics(spark, sf_dir):
    return G.provenance(evidence(spark, sf_dir).select(F.col("paper_id").alias("doc_id"), "score"))


STATUS = [(1, 1, 0, 0, 1.0, 0.115, 0.7429, 1.0), (2, 0, 0, 0, 1.0, 0.1, 0.4, 1.0), (3, 1, 1, 2, 1.0, 0.1, 0.4, 1.0), (4, 1, 0, 0, 0.5, 0.1, 0.4, 1.0), (5, 1, 0, 0, 1.0, 0.1, 0.4, 0.4)]


@query("SELECT * FROM (VALUES (1, 'WARN', true), (2, 'FAIL', true), (3, 'FAIL', false), (4, 'FAIL', false), (5, 'OK', false)) t(id, status, all_ok)")
def kg_status(spark, sf_dir):
    c = F.col
    rows = spark.createDataFrame(STATUS, "id int, ok int, ran int, v int, cov double, d1 double, p1 double, g double")
    return rows.select("id", G.status(c("ok"), c("ran"), c("v"), c("cov"), c("d1"), c("p1")).alias("status"), G.all_ok(c("v"), c("cov"), c("g"), c("p1")).alias("all_ok"))


@query("SELECT lower(trim(p_name)) AS label, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY 1 HAVING count(*) > 1")
def label_collisions(spark, sf_dir):
    label = F.lower(F.trim("p_name")).alias("label")
    return table(spark, sf_dir, "part").groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_key")).where("n > 1")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphans(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@query(
    """SELECT event_type, count(*) FILTER (value < 10) AS low, count(*) FILTER (value >= 10 AND value < 20) AS mid, count(*) FILTER (value >= 20) AS high FROM events GROUP BY event_type"""
)
def log_step_matrix(spark, sf_dir):
    grade = F.when(F.col("value") < 10, "low").when(F.col("value") < 20, "mid").otherwise("high")
    rows = table(spark, sf_dir, "events").where("value is not null").withColumn("grade", grade)
    return rows.groupBy("event_type").pivot("grade", ["low", "mid", "high"]).count().fillna(0, ["low", "mid", "high"])
