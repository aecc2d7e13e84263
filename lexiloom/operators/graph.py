"""Triples of the provenance graph and measures over edges."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions.similarity import entropy_term


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder that the cluster names; a local one only where none is set."""
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="lexiloom-"))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """A table in the shared folder, read again: unlike a checkpoint it forgets the size that the plan was thought to have, which
    grows with the square in each round of a join with itself."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
    path = f"{shared.rstrip('/')}/lexiloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it the shuffle files of what is written go as soon as it stands; else they stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written_in_slices(rows: DataFrame, key: str, n: int, f) -> DataFrame:
    """``written`` of ``f`` of ``n`` slices of ``rows`` by the whole number ``key``, one after another, each one's shuffles dropped before the next."""
    with shuffles_dropped(rows.sparkSession):
        return reduce(DataFrame.unionByName, [written(f(rows.where(F.pmod(F.col(key), F.lit(n)) == i))) for i in range(n)])


def evidence_triples(evidence: DataFrame, ns: str = "kg:") -> DataFrame:
    """Distinct ``s``, ``p``, ``o`` of (``cq_id``, ``chunk_id``, ``paper_id``, ``score``, ``pos``).

    A support node stands for each evidence row, the supportedBy edge for each (question, chunk).
    """
    e = evidence.select(
        F.concat(F.lit(f"{ns}cq/"), T.slug(F.col("cq_id"))).alias("cq"), F.concat(F.lit(f"{ns}chunk/"), T.slug(F.col("chunk_id"))).alias("chunk"),
        F.concat(F.lit(f"{ns}paper/"), T.slug(F.col("paper_id"))).alias("paper"), F.concat(F.lit("_:s"), F.sha1(F.concat_ws("|", "cq_id", "chunk_id", "pos"))).alias("sup"), "score",
    )
    t = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    c = F.col
    one = [
        t(c("cq"), "rdf:type", F.lit(f"{ns}CQ")), t(c("chunk"), "rdf:type", F.lit(f"{ns}Chunk")), t(c("paper"), "rdf:type", F.lit(f"{ns}Paper")), t(c("sup"), "rdf:type", F.lit(f"{ns}Support")),
        t(c("chunk"), f"{ns}inPaper", c("paper")), t(c("cq"), f"{ns}supportedBy", c("chunk")), t(c("sup"), f"{ns}fromCQ", c("cq")), t(c("sup"), f"{ns}toChunk", c("chunk")),
        t(c("sup"), f"{ns}score", c("score").cast("string")), t(c("sup"), "prov:wasDerivedFrom", c("chunk")),
    ]
    return e.select(F.explode(F.array(*one)).alias("t")).select("t.*").distinct()


def edge_metrics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, average degree, predicate entropy and top shares."""
    nodes = edges.select("s").union(edges.select("o")).distinct().agg(F.count(F.lit(1)).alias("n_nodes"))
    by_p = edges.groupBy("p").agg(F.count(F.lit(1)).alias("c"))
    shares = by_p.crossJoin(by_p.agg(F.sum("c").alias("n_edges"))).withColumn("share", F.col("c") / F.col("n_edges"))
    top = F.sort_array(F.collect_list("share"), asc=False)  # one value per predicate
    predicates = shares.agg(
        F.first("n_edges").alias("n_edges"), F.sum(entropy_term(F.col("share"), 2)).alias("h"),
        F.get(top, F.lit(0)).alias("t1"), F.aggregate(F.slice(top, 1, 3), F.lit(0.0), lambda a, x: a + x).alias("t3"),
    )
    n, m = F.col("n_nodes"), F.col("n_edges")
    return nodes.crossJoin(predicates).select(
        "n_nodes", "n_edges", F.round(m / (n * (n - 1)), 6).alias("density"), F.round(2 * m / n, 4).alias("avg_degree"),
        F.round("h", 4).alias("predicate_entropy"), F.round("t1", 4).alias("top1_share"), F.round("t3", 4).alias("top3_share"),
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (smallest reachable node) of edges (``a``, ``b``): labels spread
    over edges and jump to their labels' labels, so chains take logarithmic rounds."""
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).where("a is not null and b is not null").distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")))
    while True:
        sent = both.join(labels, both["a"] == labels["node"]).groupBy(F.col("b").alias("node")).agg(F.min("component").alias("m"))
        lower = labels.join(sent, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("low"))
        up = lower.select(F.col("node").alias("p"), F.col("low").alias("up"))
        new = cut_lineage(lower.join(up, F.col("low") == F.col("p")).select("node", F.col("up").alias("component"), "old"))
        labels = new.select("node", "component")
        if new.where("component <> old").limit(1).count() == 0:
            return labels


def exploded_evidence(questions: DataFrame) -> DataFrame:
    """One row per piece of evidence of questions (``cq_id``, ``evidence_chunks``: array of structs with
    ``chunk_id``, ``article_id``, ``paper_id``, ``score``, ``text``).

    Questions and pieces with blank ids are left out, as are null arrays; the document is the article, else
    the paper, else what stands before ``::`` in the chunk's id; a missing score is 0; a text is cut to 500
    characters.
    """
    e = questions.where("trim(cq_id) <> ''").select(F.trim("cq_id").alias("cq_id"), F.posexplode("evidence_chunks").alias("pos", "e"))
    chunk = F.trim("e.chunk_id")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return e.where(chunk != "").select(
        "cq_id", chunk.alias("chunk_id"), F.coalesce(some("e.article_id"), some("e.paper_id"), F.trim(F.substring_index(chunk, "::", 1))).alias("doc_id"),
        F.coalesce(F.col("e.score").try_cast("double"), F.lit(0.0)).alias("score"), F.left(F.coalesce(F.col("e.text"), F.lit("")), F.lit(500)).alias("text_span"), "pos",
    )


def evidence_graph(rows: DataFrame, ns: str = "kg:") -> DataFrame:
    """Triples with ``literal`` of ``exploded_evidence``: types, ids, spans, edges and one support node for
    each question and chunk."""
    iri = lambda kind, c: F.concat(F.lit(f"{ns}{kind}/"), T.slug(F.col(c)))
    e = rows.select("*", iri("cq", "cq_id").alias("cq"), iri("chunk", "chunk_id").alias("chunk"), iri("paper", "doc_id").alias("paper"), F.concat(F.lit("_:s"), F.sha1(F.concat_ws("|", "cq_id", "chunk_id"))).alias("sup"))
    t = lambda s, p, o, literal=False: F.struct(F.col(s).alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(literal).alias("literal"))
    c = F.col
    span = F.nullif("text_span", F.lit(""))
    one = F.array(
        t("cq", "rdf:type", F.lit(f"{ns}CQ")), t("chunk", "rdf:type", F.lit(f"{ns}Chunk")), t("paper", "rdf:type", F.lit(f"{ns}Paper")), t("sup", "rdf:type", F.lit(f"{ns}Support")),
        t("cq", f"{ns}cqId", c("cq_id"), True), t("chunk", f"{ns}chunkId", c("chunk_id"), True), t("chunk", f"{ns}docId", c("doc_id"), True), t("paper", f"{ns}docId", c("doc_id"), True), t("chunk", f"{ns}textSpan", span, True),
        t("chunk", f"{ns}inPaper", c("paper")), t("cq", f"{ns}supportedBy", c("chunk")), t("sup", f"{ns}fromCQ", c("cq")), t("sup", f"{ns}toChunk", c("chunk")),
        t("sup", f"{ns}score", c("score").cast("string"), True), t("sup", "prov:wasDerivedFrom", c("chunk")),
    )
    return e.select(F.explode(one).alias("t")).select("t.*").where("o is not null").distinct()


def provenance(supports: DataFrame) -> DataFrame:
    """One row of coverage, concentration and score shares of (``doc_id``, ``score``) statements."""
    has = F.coalesce(F.trim("doc_id"), F.lit("")) != ""
    per_doc = supports.groupBy(F.when(has, F.trim("doc_id")).alias("d")).agg(
        F.count(F.lit(1)).alias("c"), F.sum("score").alias("s"), *[F.count_if(F.col("score") >= x).alias(f"g{i}") for i, x in enumerate((0.5, 0.7, 0.9))]
    )
    own = F.when(F.col("d").isNotNull(), F.col("c"))
    total = per_doc.agg(F.sum("c").alias("n"), F.sum(own).alias("k"))
    x = per_doc.crossJoin(total)
    n = F.first("n")
    return x.agg(
        n.alias("n_statements"), F.round(F.sum(own) / n, 4).alias("evidence_coverage"), F.count("d").alias("doc_diversity"), F.round(F.max(own) / n, 4).alias("doc_top1_share"),
        F.round(F.sum(entropy_term(own / F.col("k"), 2)), 4).alias("doc_entropy"), F.round(F.sum("s") / n, 4).alias("score_mean"),
        *[F.round(F.sum(f"g{i}") / n, 4).alias(f"score_ge_0{x}") for i, x in enumerate((5, 7, 9))],
    )


def status(parse_ok, shacl_ran, violations, coverage, doc_top1, predicate_top1):
    """OK, WARN or FAIL of a graph."""
    return (
        F.when((parse_ok == 0) | ((shacl_ran == 1) & (F.coalesce(violations, F.lit(0)) > 0)) | (coverage < 0.99), "FAIL")
        .when((doc_top1 > 0.4) | (predicate_top1 > 0.5), "WARN")
        .otherwise("OK")
    )


def all_ok(violations, coverage, giant, predicate_top1):
    """The report's verdict, which tolerates more concentration than ``status``."""
    return (coverage >= 0.99) & ((violations < 0) | (violations <= 0)) & (giant >= 0.5) & (predicate_top1 <= 0.95)
