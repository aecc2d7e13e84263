"""Queries over bibliographic references; the inputs are literal, the expected rows worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import references as R
from lexiloom.operators import layout as L
from lexiloom.plans.registry import query, table


@query("SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, false), (5, true), (6, false)) t(id, ok)")
def ref_number_guard(spark, sf_dir):
    rows = spark.createDataFrame([(1, "[12]"), (2, "501"), (3, "x"), (4, "1 Biography"), (5, "(500)"), (6, None)], "id int, n string")
    return rows.select("id", R.valid_number(F.col("n")).alias("ok"))


@query("SELECT * FROM (VALUES (1, false), (2, true), (3, true), (4, true)) t(id, phantom)")
def phantom_references(spark, sf_dir):
    rows = [(1, "1", "A long enough title", "J. Roe, A long enough title, 2020"), (2, "1", "A long enough title", "short"), (3, "2", "About the author", "Jane Roe is about the author of"), (4, "900", "A long enough title", "J. Roe, A long enough title, 2020")]
    return spark.createDataFrame(rows, "id int, n string, t string, r string").select("id", R.is_phantom(F.col("n"), F.col("t"), F.col("r")).alias("phantom"))


@query("SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, true)) t(id, ok)")
def strict_title_match(spark, sf_dir):
    rows = [(1, "Curriculum-Learning for Graphs", "CurriculumLearning for graphs."), (2, "Active learning for images", "Active learning for videos"), (3, "Short", "Shorter than that"), (4, "Über naïve Bayes", "uber naive bayes")]
    pairs = spark.createDataFrame(rows, "id int, a string, b string").select("id", R.normal_title(F.col("a")).alias("a"), R.normal_title(F.col("b")).alias("b"))
    return pairs.select("id", R.strict_title_match(F.col("a"), F.col("b")).alias("ok"))


@query("SELECT * FROM (VALUES (1, 2, 1.4::DOUBLE), (2, 1, 1.05)) t(ref, rank, score)")
def best_candidates(spark, sf_dir):
    kind = "ref int, title string, year int, doi string, arxiv_id string, authors string"
    refs = spark.createDataFrame([(1, "Deep graph networks", 2020, "10.1/a", "", "J Roe"), (2, "Large language models", 2020, "", "", ""), (3, "Nothing fits here", 2020, "", "", "")], kind)
    found = [
        (1, 1, "Deep graph networks", 2020, "", "", "A Doe"), (1, 2, "Deep graph networks", 2020, "10.1/A", "", "j roe"), (2, 1, "Large language models", 2021, "", "", ""),
        (2, 2, "Large language models", 2010, "", "", ""), (3, 1, "Something else entirely", 2020, "", "", ""),
    ]
    return R.best_candidates(refs, spark.createDataFrame(found, "ref int, rank int, title string, year int, doi string, arxiv_id string, authors string"))


@query("SELECT 4 AS total, 2 AS with_doi, 1 AS with_arxiv_id, 3 AS with_title, 2 AS with_year, 1 AS with_pdf, 50.0::DOUBLE AS pct_doi, 3 AS with_doi_or_arxiv, 2 AS with_any_id")
def reference_completeness(spark, sf_dir):
    rows = [("10.1/a", "", "T", 2020, "http://x/a.pdf"), ("", "", "nan", None, "x.pdf"), (None, None, "T", None, None), ("10.1/b", "2405.1", "T", 2021, "")]
    return R.completeness(spark.createDataFrame(rows, "doi string, arxiv_id string, title string, year int, pdf_url string"))


@query("SELECT * FROM (VALUES (1, 'Uber naive Bayes', '10.1234/abc', '2405.00334'), (2, 'x', '', 'old/1')) t(id, title, doi, arxiv_id)")
def normalize_references(spark, sf_dir):
    rows = [(1, "Über\n naïve  Bayes", "https://doi.org/10.1234/ABC", "arXiv:2405.00334v2"), (2, "x", "abc", "old/1")]
    return R.normalize(spark.createDataFrame(rows, "id int, title string, doi string, arxiv_id string"))


@query("SELECT * FROM (VALUES (1, 'jane', 'roe,doe'), (2, 'roe,doe', 'john')) t(id, first, last)")
def author_surnames(spark, sf_dir):
    """Two rules that differ: the dedupe step splits at commas, the matching step at semicolons."""
    rows = spark.createDataFrame([(1, "Jane Roe; John Doe"), (2, "Roe Jane, Doe John")], "id int, a string")
    return rows.select("id", F.array_join(R.surnames_first(F.col("a")), ",").alias("first"), F.array_join(R.surnames_last(F.col("a")), ",").alias("last"))


FORMULAS = """f AS (SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN 'Table 3: y = ' || p_size || '/2 + 1/4 - 5' WHEN p_size > 30 THEN '\\frac{' || p_partkey || '}{b}' WHEN p_size > 20 THEN 'a_b = ' || p_size || '*c/' || p_partkey || ' + 2'
 WHEN p_size > 10 THEN 'a = ' || p_partkey ELSE p_name || ' in size ' || p_size || ' and of one colour' END AS x FROM part),
g AS (SELECT id, x, length(regexp_replace(x, '\\s', '', 'g')) AS n, len(regexp_extract_all(x, '[=+\\-*/^<>_~|()\\[\\]{}]')) AS s, len(regexp_extract_all(x, '[0-9]')) AS d, len(regexp_extract_all(x, '[A-Za-z]+|[=+*/^<>_-]')) AS t FROM f)"""


@query(
    f"""WITH {FORMULAS} SELECT id, x, length(x) >= 8 AND NOT starts_with(x, 'Table 3') AND (contains(x, '\\frac') OR (t >= 5 AND d / n >= 0.1 AND (s / n >= 0.2 OR ((contains(x, '=') OR contains(x, '/')) AND s / n >= 0.08)))) AS formula FROM g"""
)
def formula_lines(spark, sf_dir):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    x = (
        F.when(F.col("p_size") > 40, c("Table 3: y = ", size, "/2 + 1/4 - 5"))
        .when(F.col("p_size") > 30, c("\\frac{", key, "}{b}"))
        .when(F.col("p_size") > 20, c("a_b = ", size, "*c/", key, " + 2"))
        .when(F.col("p_size") > 10, c("a = ", key))
        .otherwise(c(F.col("p_name"), " in size ", size, " and of one colour"))
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), x.alias("x")).select("id", "x", R.is_formula(F.col("x")).alias("formula"))


TEI = '<biblStruct xmlns="http://www.tei-c.org/ns/1.0"><analytic><title level="a">Deep  nets</title><author><persName><surname>Roe</surname></persName></author><author><persName><surname>Doe</surname></persName></author></analytic><monogr><title level="j">J. Tests</title><imprint><date when="2019-05"/></imprint></monogr><idno type="DOI">10.1/a</idno></biblStruct>'


@query("SELECT 1 AS id, 'Deep nets' AS title, 'Roe; Doe' AS surnames, 2019 AS year, '10.1/a' AS doi, 'J. Tests' AS venue")
def tei_records(spark, sf_dir):
    return R.tei_records(spark.createDataFrame([(1, TEI)], "id int, xml string"))


@query(
    """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents),
o AS (SELECT doc_id, page, length(line) AS n, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p),
c AS (SELECT doc_id, i * 700 AS a, least(i * 700 + 1000, length(text)) AS z FROM documents, range(CAST(ceil(length(text) / 700.0) AS BIGINT)) t(i))
SELECT c.doc_id || ':' || a AS chunk, min(page) AS page_start, max(page) AS page_end FROM c JOIN o ON c.doc_id = o.doc_id AND o.start + n + 1 > a AND o.start < z GROUP BY ALL"""
)
def chunk_pages(spark, sf_dir):
    """Lines as pages, windows of 1000 characters every 700 as chunks."""
    docs = table(spark, sf_dir, "documents")
    lines = L.lines_of(docs.select(F.col("doc_id").alias("doc"), "text"))
    pages = lines.select("doc", (F.col("n") + 1).cast("long").alias("page"), "start", (F.col("start") + F.length("line") + 1).alias("stop"))
    n = F.length("text")
    windows = docs.where(n > 0).select(F.col("doc_id").alias("doc"), n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(700))).alias("start_char"))
    chunks = windows.select("doc", F.concat_ws(":", "doc", "start_char").alias("chunk"), "start_char", F.least(F.col("start_char") + 1000, F.col("n")).alias("end_char"))
    return R.page_of(chunks, pages)


@query(
    """WITH e AS (SELECT 'src' || i AS dataset FROM range(22) t(i)), f AS (SELECT source AS dataset, count(*) AS n, count(l.doc_id) AS labelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source)
SELECT dataset, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN labelled = n THEN 'complete' ELSE 'partial' END AS state FROM e FULL JOIN f USING (dataset)"""
)
def dataset_completeness(spark, sf_dir):
    expected = spark.range(22).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("dataset"))
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l"))
    found = docs.join(labels, "doc_id", "left").groupBy(F.col("source").alias("dataset")).agg(F.count(F.lit(1)).alias("n"), F.count("l").alias("labelled"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("labelled") == F.col("n"), "complete").otherwise("partial")
    return expected.join(found, "dataset", "full").select("dataset", F.coalesce("n", F.lit(0)).alias("n"), state.alias("state"))
