"""Measures over triples (``s``, ``p``, ``o``, ``literal``), a table of distinct statements.

Everywhere: a null in any of the three places never matches a pattern, and ``statements`` leaves such
rows out; repeated rows count once; an empty table gives one row of zeros where one row is promised and
none elsewhere; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators.graph import written

TYPE, SUBCLASS, LABEL, COMMENT, PREFERRED = "rdf:type", "rdfs:subClassOf", "rdfs:label", "rdfs:comment", "skos:prefLabel"
CLASS_TYPES = ("owl:Class", "rdfs:Class")
OBJECT_PROPERTY, DATA_PROPERTY, ANNOTATION_PROPERTY, INDIVIDUAL = "owl:ObjectProperty", "owl:DatatypeProperty", "owl:AnnotationProperty", "owl:NamedIndividual"
#: Fixed value: names that say nothing.
BAD_NAME = r"^(class|property|entity|concept)[_\-]?\d+$"


def statements(*graphs: DataFrame) -> DataFrame:
    """Union of graphs without repeats."""
    parts = [g.select("s", "p", "o", "literal").where("s is not null and p is not null and o is not null") for g in graphs]
    out = parts[0]
    for g in parts[1:]:
        out = out.unionByName(g)
    return out.distinct()


def members(graph: DataFrame, *types: str) -> DataFrame:
    """``iri`` of the resources of one of the types, each once."""
    return graph.where((F.col("p") == TYPE) & F.col("o").isin(*types)).select(F.col("s").alias("iri")).distinct()


def classes(graph: DataFrame) -> DataFrame:
    return members(graph, *CLASS_TYPES)


def subclass_edges(graph: DataFrame) -> DataFrame:
    """``child``, ``parent`` where both are classes; blank nodes are no parents."""
    known = classes(graph)
    edges = graph.where((F.col("p") == SUBCLASS) & ~F.col("o").startswith("_:")).select(F.col("s").alias("child"), F.col("o").alias("parent")).distinct()
    return edges.join(known.withColumnRenamed("iri", "child"), "child", "left_semi").join(known.withColumnRenamed("iri", "parent"), "parent", "left_semi").select("child", "parent")


def stats(graph: DataFrame) -> DataFrame:
    """One row: ``triples``, ``resources`` (distinct subjects, predicates and objects that aren't literals),
    ``literals`` and ``blank_nodes``."""
    nodes = graph.select(F.explode(F.array(F.col("s"), F.col("p"), F.when(~F.col("literal"), F.col("o")))).alias("r"), F.col("p").alias("by")).where("r is not null")
    blank = F.count_distinct(F.when(F.col("r").startswith("_:"), F.col("r")))
    totals = graph.agg(F.count(F.lit(1)).alias("triples"), F.count_if("literal").alias("literals"))
    return totals.crossJoin(nodes.agg(F.count_distinct("r").alias("resources"), blank.alias("blank_nodes"))).select("triples", "resources", "literals", "blank_nodes")


def typed_counts(graph: DataFrame, ns: str = "kg:") -> DataFrame:
    """One row: resources of each type of the provenance graph, and the share of typed nodes: 1, since
    only typed nodes are nodes to the reference's measure, and 1 too where there are none."""
    kinds = graph.where(F.col("p") == TYPE).select("s", "o").distinct()
    n = lambda kind: F.count_if(F.col("o") == ns + kind)
    counts = kinds.agg(n("Paper").alias("n_papers"), n("Chunk").alias("n_chunks"), n("CQ").alias("n_cqs"), n("Support").alias("n_supports"))
    total = F.col("n_papers") + F.col("n_chunks") + F.col("n_cqs") + F.col("n_supports")
    return counts.withColumn("typed_ratio", F.when(total > 0, F.round(total / total, 4)).otherwise(F.lit(1.0)))


def supports(graph: DataFrame, files: DataFrame | None = None, ns: str = "kg:") -> DataFrame:
    """Support nodes with ``cq``, ``chunk``, ``chunk_id``, ``doc_id``, ``score`` and ``has_prov``.

    A node without a chunk is left out; the chunk it leads to stands before the one it derives from.
    ``files`` (``chunk_id``, ``doc_id``) stands before the graph's own document. Of several values the
    least is taken; a score that is no number is 0.
    """
    own = graph.where((F.col("p") == TYPE) & (F.col("o") == ns + "Support")).select("s").distinct()
    value = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    facts = graph.where(F.col("p").isin(ns + "fromCQ", ns + "toChunk", ns + "score", "prov:wasDerivedFrom")).groupBy("s").agg(
        value(ns + "fromCQ").alias("cq"), F.coalesce(value(ns + "toChunk"), value("prov:wasDerivedFrom")).alias("chunk"),
        F.coalesce(value(ns + "score").try_cast("double"), F.lit(0.0)).alias("score"), value("prov:wasDerivedFrom").isNotNull().alias("has_prov"),
    )
    named = graph.where(F.col("p").isin(ns + "chunkId", ns + "docId")).groupBy(F.col("s").alias("chunk")).agg(value(ns + "chunkId").alias("c"), value(ns + "docId").alias("d"))
    rows = own.join(facts, "s").where("chunk is not null").join(named, "chunk", "left")
    rows = rows.withColumn("chunk_id", F.coalesce(F.nullif("c", F.lit("")), F.substring_index("chunk", "/", -1)))
    if files is not None:
        known = files.groupBy("chunk_id").agg(F.max_by("doc_id", "doc_id").alias("f"))
        rows = rows.join(known, "chunk_id", "left")
    else:
        rows = rows.withColumn("f", F.lit(None).cast("string"))
    return rows.select(F.col("s").alias("support"), F.coalesce("cq", F.lit("")).alias("cq"), "chunk", "chunk_id", F.coalesce(F.nullif("f", F.lit("")), "d", F.lit("")).alias("doc_id"), "score", "has_prov")


def entity_edges(graph: DataFrame, ns: str = "kg:") -> DataFrame:
    """``s``, ``o``, ``predicate``: inPaper whose object is a paper, supportedBy whose subject is a question."""
    typed = lambda kind, name: members(graph, ns + kind).withColumnRenamed("iri", name)
    inside = graph.where(F.col("p") == ns + "inPaper").join(typed("Paper", "o"), "o", "left_semi").select("s", "o", F.lit("inPaper").alias("predicate"))
    by = graph.where(F.col("p") == ns + "supportedBy").join(typed("CQ", "s"), "s", "left_semi").select("s", "o", F.lit("supportedBy").alias("predicate"))
    return inside.unionByName(by)


def label_coverage(graph: DataFrame, resources: DataFrame, most: int = 20) -> DataFrame:
    """One row: ``total``, ``with_label``, ``missing_ratio`` and the first ``most`` IRIs without a label."""
    labelled = graph.where(F.col("p") == LABEL).select(F.col("s").alias("iri")).distinct().withColumn("has", F.lit(True))
    rows = resources.join(labelled, "iri", "left")
    total, have = F.count(F.lit(1)), F.count("has")
    counts = rows.agg(total.alias("total"), have.alias("with_label"), F.when(total > 0, F.round((total - have) / total, 6)).otherwise(F.lit(0.0)).alias("missing_ratio"))
    missing = rows.where("has is null").orderBy("iri").limit(most).agg(F.array_join(F.sort_array(F.collect_list("iri")), " ").alias("missing"))
    return counts.crossJoin(missing)


def bad_names(graph: DataFrame, resources: DataFrame) -> DataFrame:
    """One row: ``named`` and ``bad``. A resource's name is its first label, else its local name apart."""
    label = graph.where(F.col("p") == LABEL).groupBy(F.col("s").alias("iri")).agg(F.min(F.trim("o")).alias("label"))
    name = F.coalesce(F.nullif("label", F.lit("")), T.split_camel(T.local_name(F.col("iri"))))
    rows = resources.join(label, "iri", "left").select(name.alias("name")).where("name <> ''")
    return rows.agg(F.count(F.lit(1)).alias("named"), F.count_if(F.lower(F.trim("name")).rlike(BAD_NAME)).alias("bad"))


def expanded(graph: DataFrame, predicate: str) -> DataFrame:
    """``property``, ``iri`` of a domain or range; a union of classes (a list of ``first`` and ``rest``)
    becomes its members. Lists end at ``rdf:nil``, where a cell has no rest, or where they come back to a cell seen before; each
    round follows all lists by one cell and is written, so that no round does the work of those before it."""
    used = graph.where(F.col("p") == predicate).select(F.col("s").alias("property"), F.col("o").alias("node"))
    union = graph.where(F.col("p") == "owl:unionOf").select(F.col("s").alias("node"), F.col("o").alias("cell"))
    first = graph.where(F.col("p") == "rdf:first").select(F.col("s").alias("cell"), F.col("o").alias("iri"))
    rest = graph.where(F.col("p") == "rdf:rest").select(F.col("s").alias("cell"), F.col("o").alias("next"))
    out = used.join(union, "node", "left_anti").select("property", F.col("node").alias("iri"))
    cells = written(used.join(union, "node").select("property", "cell").where("cell <> 'rdf:nil'").distinct())
    seen = cells
    while cells.limit(1).count():
        following = cells.join(rest, "cell").select("property", F.col("next").alias("cell")).where("cell <> 'rdf:nil'").distinct()
        cells = written(following.join(seen, ["property", "cell"], "left_anti"))
        seen = seen.unionByName(cells)
    return out.unionByName(seen.join(first, "cell").select("property", "iri")).distinct()


def within(graph: DataFrame, predicate: str) -> DataFrame:
    """``property``, ``iri`` of domains or ranges that are known classes."""
    return expanded(graph, predicate).join(classes(graph), "iri", "left_semi").select("property", "iri")


def richness(graph: DataFrame) -> DataFrame:
    """One row of sizes and richness of an ontology. Ratios over nothing are 0."""
    kind = F.when(F.col("o").isin(*CLASS_TYPES), "class").when(F.col("o") == OBJECT_PROPERTY, "object").when(F.col("o") == DATA_PROPERTY, "data").when(F.col("o") == ANNOTATION_PROPERTY, "annotation").when(F.col("o") == INDIVIDUAL, "individual")
    kinds = graph.where(F.col("p") == TYPE).select(F.col("s").alias("iri"), kind.alias("kind")).where("kind is not null").distinct()
    noted = graph.where(F.col("p").isin(LABEL, COMMENT, PREFERRED))
    marked = kinds.join(noted.select(F.col("s").alias("iri")).distinct().withColumn("noted", F.lit(1)), "iri", "left")
    n = lambda k: F.count_if(F.col("kind") == k)
    main = F.col("kind").isin("class", "object", "data")
    sizes = marked.agg(
        n("class").alias("classes"), n("object").alias("object_properties"), n("data").alias("data_properties"), n("annotation").alias("annotation_properties"),
        n("individual").alias("individuals"), F.count_if(main & F.col("noted").isNotNull()).alias("noted"), F.count_if(main).alias("entities"),
    )
    totals = graph.agg(F.count(F.lit(1)).alias("triples"), F.count_if(F.col("p").isin(LABEL, COMMENT, PREFERRED)).alias("annotations"))
    edges = subclass_edges(graph)
    roots = classes(graph).join(edges.select(F.col("child").alias("iri")), "iri", "left_anti").where("iri <> 'owl:Thing'")
    c = F.col
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), 6)
    one = totals.crossJoin(sizes).crossJoin(edges.agg(F.count(F.lit(1)).alias("subclass_edges"))).crossJoin(roots.agg(F.count(F.lit(1)).alias("roots")))
    return one.select(
        "triples", "annotations", "classes", "object_properties", "data_properties", "annotation_properties", "individuals", "subclass_edges", "roots",
        ratio(c("object_properties"), c("object_properties") + c("data_properties")).alias("relationship_richness"), ratio(c("data_properties"), c("classes")).alias("attribute_richness"),
        ratio(c("subclass_edges"), c("classes")).alias("inheritance_richness"), ratio(c("noted"), c("entities")).alias("annotation_richness"), ratio(c("subclass_edges"), c("classes")).alias("avg_branching"),
    )


def unused(graph: DataFrame) -> DataFrame:
    """``iri``, ``kind``: classes that say nothing but are never stated to be anything (``dangling``), and
    properties with neither domain nor range nor a use (``orphan``)."""
    subjects = graph.select(F.col("s").alias("iri")).distinct()
    parents = graph.where(F.col("p") == SUBCLASS).select(F.col("o").alias("iri")).distinct()
    dangling = classes(graph).join(parents, "iri", "left_anti").join(subjects, "iri", "left_anti")
    bound = graph.where(F.col("p").isin("rdfs:domain", "rdfs:range")).select(F.col("s").alias("iri")).distinct()
    applied = graph.select(F.col("p").alias("iri")).distinct()
    orphan = members(graph, OBJECT_PROPERTY, DATA_PROPERTY).join(bound, "iri", "left_anti").join(applied, "iri", "left_anti")
    return dangling.withColumn("kind", F.lit("dangling")).unionByName(orphan.withColumn("kind", F.lit("orphan")))


def violations(graph: DataFrame, kind: str, predicate: str, least: int = 0, most: int | None = None, object_type: str | None = None) -> DataFrame:
    """``iri``, ``n``, ``wrong`` of the resources of a type that break a shape: too few or too many values of a
    predicate, or (``wrong`` > 0) values that aren't of the type asked for."""
    values = graph.where(F.col("p") == predicate).select(F.col("s").alias("iri"), "o")
    if object_type is not None:
        values = values.join(members(graph, object_type).select(F.col("iri").alias("o"), F.lit(1).alias("ok")), "o", "left")
    else:
        values = values.withColumn("ok", F.lit(1))
    counts = values.groupBy("iri").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ok").isNull()).alias("wrong"))
    rows = members(graph, kind).join(counts, "iri", "left").fillna(0, ["n", "wrong"])
    broken = (F.col("n") < least) | (F.col("wrong") > 0)
    return rows.where(broken if most is None else broken | (F.col("n") > most))


def ranked(metrics: DataFrame) -> DataFrame:
    """Metric rows by coverage from high to low, then by violations; unknown ones count as 999, an unknown
    coverage as 0. Ties are ordered by name."""
    return metrics.orderBy(F.desc(F.coalesce("evidence_coverage", F.lit(0.0))), F.coalesce("shacl_violations", F.lit(999)), "name")


def first_of(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
