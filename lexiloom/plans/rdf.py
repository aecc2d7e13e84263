"""Queries over ontologies and evidence graphs that are made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import graph as G
from lexiloom.operators import hierarchy as H
from lexiloom.operators import rdf as R
from lexiloom.plans.registry import query, table

#: An ontology: regions and nations are classes, as are the customers' segments in each nation; brands are
#: object properties, part types data properties, sizes object properties with empty names.
ONTOLOGY = """t AS (SELECT 'ex#' || r_name AS s, 'rdf:type' AS p, 'owl:Class' AS o, false AS literal FROM region
UNION SELECT 'ex#' || n_name, 'rdf:type', 'rdfs:Class', false FROM nation
UNION SELECT 'ex#' || n_name, 'rdfs:subClassOf', 'ex#' || r_name, false FROM nation JOIN region ON n_regionkey = r_regionkey
UNION SELECT 'ex#' || n_name, 'rdfs:label', lower(replace(n_name, '_', ' ')), true FROM nation WHERE length(n_name) > 8
UNION SELECT 'ex#' || r_name, 'skos:prefLabel', lower(r_name), true FROM region
UNION SELECT 'ex#' || c_mktsegment, 'rdf:type', 'owl:Class', false FROM customer
UNION SELECT 'ex#' || c_mktsegment, 'rdfs:subClassOf', 'ex#' || n_name, false FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION SELECT 'ex#' || p_brand, 'rdf:type', 'owl:ObjectProperty', false FROM part
UNION SELECT 'ex#' || p_brand, 'rdfs:domain', 'ex#' || r_name, false FROM part JOIN region ON p_size >= r_regionkey * 12
UNION SELECT 'ex#property_' || p_size, 'rdf:type', 'owl:ObjectProperty', false FROM part
UNION SELECT 'ex#' || p_type, 'rdf:type', 'owl:DatatypeProperty', false FROM part
UNION SELECT 'ex#' || p_type, 'rdfs:comment', 'type ' || lower(p_type), true FROM part
UNION SELECT 'ex#' || p_type, 'rdfs:range', 'xsd:string', false FROM part WHERE p_size > 45
UNION SELECT 'ex#' || s_name, 'rdf:type', 'owl:NamedIndividual', false FROM supplier)"""


def ontology(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "part", "supplier")}
    iri = lambda c: F.concat(F.lit("ex#"), F.col(c))

    def rows(df, s, p, o, literal=False):
        return df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(literal).alias("literal"))

    lit, part = F.lit, t["part"]
    own = t["nation"].join(F.broadcast(t["region"]), F.col("n_regionkey") == F.col("r_regionkey"))
    segments = t["customer"].join(F.broadcast(t["nation"]), F.col("c_nationkey") == F.col("n_nationkey")).select("c_mktsegment", "n_name").distinct()
    return R.statements(
        rows(t["region"], iri("r_name"), R.TYPE, lit("owl:Class")), rows(t["nation"], iri("n_name"), R.TYPE, lit("rdfs:Class")), rows(own, iri("n_name"), R.SUBCLASS, iri("r_name")),
        rows(t["nation"].where("length(n_name) > 8"), iri("n_name"), R.LABEL, F.lower(F.replace("n_name", lit("_"), lit(" "))), True), rows(t["region"], iri("r_name"), R.PREFERRED, F.lower("r_name"), True),
        rows(segments, iri("c_mktsegment"), R.TYPE, lit("owl:Class")), rows(segments, iri("c_mktsegment"), R.SUBCLASS, iri("n_name")), rows(part, iri("p_brand"), R.TYPE, lit(R.OBJECT_PROPERTY)),
        rows(part.join(F.broadcast(t["region"]), F.col("p_size") >= F.col("r_regionkey") * 12), iri("p_brand"), "rdfs:domain", iri("r_name")),
        rows(part, F.concat(lit("ex#property_"), F.col("p_size").cast("string")), R.TYPE, lit(R.OBJECT_PROPERTY)), rows(part, iri("p_type"), R.TYPE, lit(R.DATA_PROPERTY)),
        rows(part, iri("p_type"), R.COMMENT, F.concat(lit("type "), F.lower("p_type")), True), rows(part.where("p_size > 45"), iri("p_type"), "rdfs:range", lit("xsd:string")),
        rows(t["supplier"], iri("s_name"), R.TYPE, lit(R.INDIVIDUAL)),
    )


CLASSES = "c AS (SELECT DISTINCT s AS iri FROM t WHERE p = 'rdf:type' AND o IN ('owl:Class', 'rdfs:Class'))"
SUB = "e AS (SELECT DISTINCT s AS child, o AS parent FROM t WHERE p = 'rdfs:subClassOf' AND s IN (SELECT iri FROM c) AND o IN (SELECT iri FROM c))"
PROPS = "q AS (SELECT DISTINCT s AS iri FROM t WHERE p = 'rdf:type' AND o IN ('owl:ObjectProperty', 'owl:DatatypeProperty'))"


@query(
    f"""WITH {ONTOLOGY}, r AS (SELECT s AS r FROM t UNION SELECT p FROM t UNION SELECT o FROM t WHERE NOT literal)
SELECT (SELECT count(*) FROM t) AS triples, (SELECT count(*) FROM r) AS resources, (SELECT count(*) FILTER (literal) FROM t) AS literals, (SELECT count(*) FROM r WHERE r LIKE '\\_:%' ESCAPE '\\') AS blank_nodes"""
)
def rdf_statistics(spark, sf_dir):
    return R.stats(ontology(spark, sf_dir))


@query(
    f"""WITH {ONTOLOGY}, {CLASSES}, {SUB}, {PROPS}, n AS (SELECT s FROM t WHERE p IN ('rdfs:label', 'rdfs:comment', 'skos:prefLabel')), k AS (SELECT o, count(DISTINCT s) AS n FROM t WHERE p = 'rdf:type' GROUP BY o),
x AS (SELECT (SELECT count(*) FROM c) AS classes, (SELECT n FROM k WHERE o = 'owl:ObjectProperty') AS op, (SELECT n FROM k WHERE o = 'owl:DatatypeProperty') AS dp, (SELECT count(*) FROM e) AS edges)
SELECT (SELECT count(*) FROM t) AS triples, (SELECT count(*) FROM n) AS annotations, classes, op AS object_properties, dp AS data_properties, coalesce((SELECT n FROM k WHERE o = 'owl:AnnotationProperty'), 0) AS annotation_properties,
 (SELECT n FROM k WHERE o = 'owl:NamedIndividual') AS individuals, edges AS subclass_edges, (SELECT count(*) FROM c WHERE iri NOT IN (SELECT child FROM e)) AS roots, round(op / (op + dp), 6) AS relationship_richness,
 round(dp / classes, 6) AS attribute_richness, round(edges / classes, 6) AS inheritance_richness, round((SELECT count(*) FROM (SELECT iri FROM c UNION ALL SELECT iri FROM q) WHERE iri IN (SELECT s FROM n)) / (classes + op + dp), 6) AS annotation_richness,
 round(edges / classes, 6) AS avg_branching FROM x"""
)
def ontology_richness(spark, sf_dir):
    return R.richness(ontology(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {ONTOLOGY}, {CLASSES}, {SUB}, d(iri, depth) AS (SELECT iri, 0 FROM c WHERE iri NOT IN (SELECT child FROM e) UNION SELECT e.child, d.depth + 1 FROM d JOIN e ON e.parent = d.iri),
m AS (SELECT iri, max(depth) AS depth FROM d GROUP BY iri) SELECT max(depth) AS max_depth, round(avg(depth), 4) AS avg_depth, count(*) AS classes FROM m"""
)
def ontology_depth(spark, sf_dir):
    graph = ontology(spark, sf_dir)
    rows = R.classes(graph).join(H.depths(R.subclass_edges(graph)).withColumnRenamed("node", "iri"), "iri", "left").fillna(0, ["depth"])
    return rows.agg(F.max("depth").alias("max_depth"), F.round(F.avg("depth"), 4).alias("avg_depth"), F.count(F.lit(1)).alias("classes"))


@query(
    f"""WITH {ONTOLOGY}, {CLASSES}, {PROPS}, a AS (SELECT 'classes' AS kind, iri FROM c UNION ALL SELECT 'properties', iri FROM q), l AS (SELECT DISTINCT s FROM t WHERE p = 'rdfs:label'),
m AS (SELECT kind, iri, row_number() OVER (PARTITION BY kind ORDER BY iri) AS n FROM a WHERE iri NOT IN (SELECT s FROM l))
SELECT kind, count(*) AS total, count(*) FILTER (iri IN (SELECT s FROM l)) AS with_label, round(count(*) FILTER (iri NOT IN (SELECT s FROM l)) / count(*), 6) AS missing_ratio,
 (SELECT coalesce(string_agg(iri, ' ' ORDER BY iri), '') FROM m WHERE m.kind = a.kind AND n <= 20) AS missing FROM a GROUP BY kind"""
)
def ontology_label_coverage(spark, sf_dir):
    graph = ontology(spark, sf_dir)
    one = R.label_coverage(graph, R.classes(graph)).withColumn("kind", F.lit("classes"))
    return one.unionByName(R.label_coverage(graph, R.members(graph, R.OBJECT_PROPERTY, R.DATA_PROPERTY)).withColumn("kind", F.lit("properties")))


@query(
    f"""WITH {ONTOLOGY}, {CLASSES}, {PROPS}, a AS (SELECT iri FROM c UNION SELECT iri FROM q), l AS (SELECT s, min(trim(o)) AS label FROM t WHERE p = 'rdfs:label' GROUP BY s),
n AS (SELECT coalesce(nullif(label, ''), regexp_replace(regexp_replace(string_split(iri, '#')[-1], '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\-]+', ' ', 'g')) AS name FROM a LEFT JOIN l ON s = iri)
SELECT count(*) AS named, count(*) FILTER (regexp_matches(lower(trim(name)), '^(class|property|entity|concept)[_\\-]?\\d+$')) AS bad FROM n WHERE name <> ''"""
)
def ontology_bad_names(spark, sf_dir):
    graph = ontology(spark, sf_dir)
    return R.bad_names(graph, R.members(graph, *R.CLASS_TYPES, R.OBJECT_PROPERTY, R.DATA_PROPERTY))


@query(
    f"""WITH {ONTOLOGY}, {PROPS} SELECT iri, 'orphan' AS kind FROM q WHERE iri NOT IN (SELECT s FROM t WHERE p IN ('rdfs:domain', 'rdfs:range')) AND iri NOT IN (SELECT p FROM t)"""
)
def ontology_unused(spark, sf_dir):
    return R.unused(ontology(spark, sf_dir))


@query(f"""WITH {ONTOLOGY}, {CLASSES} SELECT DISTINCT s AS property, o AS iri FROM t WHERE p = 'rdfs:domain' AND o IN (SELECT iri FROM c)""")
def ontology_domains(spark, sf_dir):
    return R.within(ontology(spark, sf_dir), "rdfs:domain")


UNIONS = """t AS (SELECT DISTINCT 'p' || l_linenumber AS s, 'rdfs:domain' AS p, '_:u' || l_linenumber AS o FROM lineitem UNION SELECT DISTINCT '_:u' || l_linenumber, 'owl:unionOf', '_:c' || l_linenumber || '.1' FROM lineitem
UNION SELECT DISTINCT 'q' || l_returnflag, 'rdfs:domain', 'plain' || l_linestatus FROM lineitem)"""


@query("SELECT DISTINCT 'p' || l_linenumber AS property, 'k' || i AS iri FROM lineitem, generate_series(1, l_linenumber) g(i) UNION SELECT DISTINCT 'q' || l_returnflag, 'plain' || l_linestatus FROM lineitem")
def ontology_union_members(spark, sf_dir):
    """The domain of property n is the union of n classes."""
    numbers = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("n")).distinct()
    cell = lambda i: F.concat(F.lit("_:c"), F.col("n").cast("string"), F.lit("."), i.cast("string"))
    cells = numbers.select("n", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    named = lambda a: F.concat(F.lit(a), F.col("n").cast("string"))
    plain = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("q"), "l_returnflag"), F.lit("rdfs:domain"), F.concat(F.lit("plain"), "l_linestatus")).distinct()
    triples = (
        numbers.select(named("p").alias("s"), F.lit("rdfs:domain").alias("p"), named("_:u").alias("o"))
        .union(numbers.select(named("_:u"), F.lit("owl:unionOf"), cell(F.lit(1))))
        .union(cells.select(cell(F.col("i")), F.lit("rdf:first"), F.concat(F.lit("k"), F.col("i").cast("string"))))
        .union(cells.select(cell(F.col("i")), F.lit("rdf:rest"), F.when(F.col("i") < F.col("n"), cell(F.col("i") + 1)).otherwise("rdf:nil")))
        .union(plain)
    )
    return R.expanded(triples.withColumn("literal", F.lit(False)), "rdfs:domain")


#: Questions with nested evidence: an order is a question, its lines are the chunks that support it.
GROUNDED = """e AS (SELECT 'q' || l_orderkey AS cq_id, 'part' || l_partkey || ' :: c' || l_suppkey AS chunk_id, CASE WHEN l_returnflag = 'R' THEN 'paper' || l_suppkey END AS paper_id,
 CASE WHEN l_linestatus = 'O' THEN l_discount END AS score FROM lineitem WHERE l_returnflag <> 'A' OR l_quantity > 25)"""
DOC = "coalesce(paper_id, trim(string_split(trim(chunk_id), '::')[1]))"


def grounded(spark, sf_dir):
    """``cq_id`` and ``evidence_chunks``, an array that may be empty or hold blank ids."""
    line = table(spark, sf_dir, "lineitem")
    blank = (F.col("l_returnflag") == "A") & (F.col("l_quantity") <= 25)
    chunk = F.when(blank, F.lit("  ")).otherwise(F.concat(F.lit("part"), F.col("l_partkey").cast("string"), F.lit(" :: c"), F.col("l_suppkey").cast("string")))
    item = F.struct(
        chunk.alias("chunk_id"), F.lit(None).cast("string").alias("article_id"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("paper"), F.col("l_suppkey").cast("string"))).alias("paper_id"),
        F.when(F.col("l_linestatus") == "O", F.col("l_discount")).alias("score"), F.lit(None).cast("string").alias("text"),
    )
    return line.groupBy(F.concat(F.lit("q"), F.col("l_orderkey").cast("string")).alias("cq_id")).agg(F.collect_list(item).alias("evidence_chunks"))


@query(f"WITH {GROUNDED} SELECT cq_id, chunk_id, {DOC} AS doc_id, coalesce(score, 0.0)::DOUBLE AS score, count(*) AS n FROM e GROUP BY ALL")
def kg_evidence(spark, sf_dir):
    rows = G.exploded_evidence(grounded(spark, sf_dir))
    return rows.groupBy("cq_id", "chunk_id", "doc_id", "score").agg(F.count(F.lit(1)).alias("n"))


def evidence_graph(spark, sf_dir):
    return R.statements(G.evidence_graph(G.exploded_evidence(grounded(spark, sf_dir))))


@query(
    f"""WITH {GROUNDED}, x AS (SELECT *, {DOC} AS doc FROM e) SELECT count(DISTINCT doc) AS n_papers, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT cq_id) AS n_cqs,
 count(DISTINCT (cq_id, chunk_id)) AS n_supports, 1.0::DOUBLE * count(DISTINCT doc) / count(DISTINCT doc) AS typed_ratio FROM x"""
)
def kg_typed_counts(spark, sf_dir):
    return R.typed_counts(evidence_graph(spark, sf_dir))


SLUG = "regexp_replace(trim({x}), '[^A-Za-z0-9_\\-]+', '_', 'g')"


@query(
    f"""WITH {GROUNDED}, x AS (SELECT cq_id, chunk_id, min({DOC}) OVER (PARTITION BY chunk_id) AS doc, min(coalesce(score, 0.0)::DOUBLE::VARCHAR) OVER (PARTITION BY cq_id, chunk_id) AS score FROM e)
SELECT DISTINCT 'kg:cq/' || cq_id AS cq, 'kg:chunk/' || {SLUG.format(x="chunk_id")} AS chunk, chunk_id, doc AS doc_id, score::DOUBLE AS score, true AS has_prov FROM x"""
)
def kg_supports(spark, sf_dir):
    return R.supports(evidence_graph(spark, sf_dir)).drop("support")


@query(
    f"""WITH {GROUNDED}, x AS (SELECT DISTINCT cq_id, chunk_id, {DOC} AS doc FROM e)
SELECT 'kg:chunk/' || {SLUG.format(x="chunk_id")} AS s, 'kg:paper/' || {SLUG.format(x="doc")} AS o, 'inPaper' AS predicate FROM x
UNION SELECT 'kg:cq/' || cq_id, 'kg:chunk/' || {SLUG.format(x="chunk_id")}, 'supportedBy' FROM x"""
)
def kg_entity_edges(spark, sf_dir):
    return R.entity_edges(evidence_graph(spark, sf_dir))


@query(
    f"""WITH {GROUNDED}, x AS (SELECT DISTINCT chunk_id, {DOC} AS doc FROM e)
SELECT 'kg:chunk/' || {SLUG.format(x="chunk_id")} AS iri, count(*) AS n, 0::BIGINT AS wrong FROM x GROUP BY 1 HAVING count(*) > 1"""
)
def kg_shape_violations(spark, sf_dir):
    """Chunks that lie in more than one paper."""
    return R.violations(evidence_graph(spark, sf_dir), "kg:Chunk", "kg:inPaper", 1, 1, "kg:Paper")


@query(
    f"""WITH {GROUNDED}, m AS (SELECT l_shipmode AS name, round(count(*) FILTER (l_quantity > 25) / count(*), 4) AS evidence_coverage, CASE WHEN min(l_discount) > 0 THEN count(*) FILTER (l_tax > 0.07) END AS shacl_violations
 FROM (SELECT l_returnflag || l_linestatus || l_linenumber AS l_shipmode, l_quantity, l_discount, l_tax FROM lineitem) GROUP BY 1)
SELECT name, evidence_coverage, shacl_violations, row_number() OVER (ORDER BY coalesce(evidence_coverage, 0) DESC, coalesce(shacl_violations, 999), name) AS place FROM m"""
)
def kg_metric_table(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("name", F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")))
    rows = line.groupBy("name").agg(
        F.round(F.count_if(F.col("l_quantity") > 25) / F.count(F.lit(1)), 4).alias("evidence_coverage"), F.when(F.min("l_discount") > 0, F.count_if(F.col("l_tax") > 0.07)).alias("shacl_violations")
    )
    ordered = R.ranked(rows).agg(F.collect_list(F.struct("name", "evidence_coverage", "shacl_violations")).alias("r"))  # a few dozen data sets
    return ordered.select(F.posexplode("r").alias("i", "r")).select("r.*", (F.col("i") + 1).cast("long").alias("place"))


@query(
    """SELECT 'ex#' || n_name AS iri, lower(replace(n_name, '_', ' ')) AS text FROM nation UNION SELECT 'ex#' || n_name, lower(n_name) FROM nation"""
)
def lexicon_surfaces(spark, sf_dir):
    from lexiloom.operators import alignment as A

    names = table(spark, sf_dir, "nation").select(F.concat(F.lit("ex#"), "n_name").alias("s"), F.lit(R.TYPE).alias("p"), F.lit("owl:Class").alias("o"), F.lit(False).alias("literal"))
    return A.lexicon(names).select("iri", "text")
