"""Queries of the staged search: answers of several sources merged, PDFs checked. Sources and references are made of the web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import cascade as C
from lexiloom.operators import pdfcheck
from lexiloom.operators.graph import written
from lexiloom.plans import enrichment as P
from lexiloom.plans.registry import query, table


def archive(spark, sf_dir, pages=None):
    """Records of an archive: every page with a title of over 55 characters under its arXiv id."""
    p, none = P._pages(spark, sf_dir) if pages is None else pages, F.lit(None).cast("string")
    return p.where("length(title) > 55").select(
        F.concat(F.lit("x"), "k").alias("source_id"), "title", "year", F.lit("The Archive").alias("authors"), none.alias("doi"), F.col("arxiv").alias("arxiv_id"), none.alias("article_url"),
        F.concat(F.lit("https://arxiv.org/pdf/"), "arxiv", F.lit(".pdf")).alias("pdf_url"),
    )


def stages(spark, sf_dir, pages=None) -> list[C.Stage]:
    (_, a), (_, b) = P.sources(spark, sf_dir, pages)
    x = archive(spark, sf_dir, pages)
    b = b.withColumn("article_url", F.concat("article_url", F.lit("#b")))
    return [
        C.Stage("archive", x, "arxiv_id", "pdf"), C.Stage("a", a, "doi"), C.Stage("b", b, "doi", "any"),
        C.Stage("b", b, "title", through=x), C.Stage("a", a, "title", through=x), C.Stage("archive", x, "title", "pdf"), C.Stage("b", b, "title", "any"),
    ]


@query(
    f"""WITH {P.SOURCES}, {P.REFS}, n AS (SELECT r.*, length(p.title) AS n, p.url, a.arxiv_id AS a_arxiv FROM r JOIN p ON p.page_id = r.ref LEFT JOIN a ON a.source_id = 'a' || r.ref),
k AS (SELECT *, n > 55 AS x, n <= 40 AND n > 30 AS y, n <= 40 AS z, '2' || lpad((ref % 1000)::VARCHAR, 3, '0') || '.' || lpad(ref::VARCHAR, 5, '0') AS own FROM n)
SELECT ref, year, CASE WHEN z THEN '10.1234/p.' || ref END AS doi, CASE WHEN x THEN own WHEN y THEN a_arxiv END AS arxiv_id, CASE WHEN x THEN article_url WHEN y THEN url WHEN z THEN url || '#b' END AS article_url,
CASE WHEN x THEN 'https://arxiv.org/pdf/' || own || '.pdf' WHEN y THEN url || '.pdf' END AS pdf_url, CASE WHEN y THEN url || '#b' ELSE '' END AS more_urls,
CASE WHEN x THEN 'article_url=reference,arxiv_id=reference,authors=archive,pdf_url=archive,title=reference,year=reference'
 WHEN y THEN 'article_url=a,arxiv_id=a,doi=reference,pdf_url=a,title=reference,year=reference'
 WHEN z THEN 'article_url=b,doi=reference,title=reference,year=reference' ELSE 'title=reference,year=reference' END AS origin FROM k"""
)
def merged_answers(spark, sf_dir):
    """Answers by id of three sources, folded field by field with where each came from."""
    refs = P._keyed(spark, sf_dir)
    rows = C.merged(refs, C.answers(refs, [s for s in stages(spark, sf_dir) if s.key != "title"]))
    origin = F.array_join(F.sort_array(F.transform(F.map_entries("origin"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return rows.select("ref", "year", "doi", "arxiv_id", "article_url", "pdf_url", F.array_join("more_urls", " ").alias("more_urls"), origin.alias("origin"))


@query()
def cascade_stages(spark, sf_dir):
    """The stage that answers each reference: ids first, then titles; strict likeness of titles is no SQL."""
    p = written(P._pages(spark, sf_dir))
    return C.first_answers(P._keyed(spark, sf_dir, p), stages(spark, sf_dir, p)).select("ref", "stage", "source", "key", "source_id", "arxiv_id", "pdf_url", "article_url")


@query()
def resolved_references(spark, sf_dir):
    """The whole workflow with the check of the PDF; pages stand for what the PDFs of source ``a`` say."""
    p = written(P._pages(spark, sf_dir))
    (_, a), _ = P.sources(spark, sf_dir, p)
    html = table(spark, sf_dir, "pages")
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(style|script)\b.*?</\1>|<!--.*?-->", " "), r"(?s)<[^>]*>", "\n")
    pages = html.select(F.concat("url", F.lit(".pdf")).alias("pdf_url"), F.regexp_replace(body, r"\n\s*\n+", "\n").alias("text"))
    rows = C.resolved(P.references(spark, sf_dir, p), stages(spark, sf_dir, p), archive(spark, sf_dir, p), a, pages)
    return rows.select("ref", "found_by", "doi", "arxiv_id", "pdf_url", "article_url", F.round("confidence", 6).alias("confidence"), "judged_by", "validated", F.array_join("more_urls", " ").alias("more_urls"))


_NO, _MORE, _SENTENCE = (p.removeprefix("(?i)") for p in (pdfcheck.NO_TITLE, pdfcheck.NO_MORE, pdfcheck.NO_SENTENCE))
_goes = lambda c: f"length({c}) BETWEEN 10 AND 150 AND NOT regexp_matches({c}, '{_MORE}', 'i')"


@query(
    f"""WITH t AS (SELECT doc_id, list_transform(string_split(text, chr(10))[1:30], lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS ls,
 trim(regexp_replace(replace(replace(strip_accents(lower(coalesce(text, ''))), 'ß', 'ss'), 'œ', 'oe'), '\\s+', ' ', 'g')) AS plain FROM documents),
s AS (SELECT doc_id, i, ls[i] AS a, ls[i + 1] AS b, ls[i + 2] AS c FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM t)),
j AS (SELECT doc_id, i, a, regexp_matches(a, '{_NO}', 'i') AS bad, a || CASE WHEN {_goes("b")} THEN ' ' || b || CASE WHEN {_goes("c")} THEN ' ' || c ELSE '' END ELSE '' END AS w FROM s),
f AS (SELECT doc_id, min_by(w, i) FILTER (NOT bad AND length(a) BETWEEN 10 AND 250 AND length(w) BETWEEN 20 AND 300) AS w,
 min_by(a, i + CASE WHEN i <= 10 AND length(a) BETWEEN 20 AND 200 THEN 0 ELSE 1000 END) FILTER (NOT bad AND length(a) BETWEEN 15 AND 250) AS alone FROM j GROUP BY doc_id)
SELECT t.doc_id, coalesce(nullif(trim(regexp_replace(coalesce(w, alone), '\\s+', ' ', 'g')), ''),
 list_filter(list_transform(regexp_split_to_array(left(plain, 1000), '[.!?]\\s+'), lambda x: trim(x)), lambda x: length(x) BETWEEN 20 AND 200 AND NOT regexp_matches(x, '{_SENTENCE}', 'i'))[1]) AS found_title,
 nullif(regexp_extract(plain, '(?:doi[:\\s]+|doi\\.org/)(10\\.\\d{{4,}}/[^\\s\\)]+)', 1), '') AS found_doi, nullif(regexp_extract(plain, 'arxiv[:\\s]+(\\d{{4}}\\.\\d{{4,}})', 1), '') AS found_arxiv
FROM t LEFT JOIN f USING (doc_id)"""
)
def first_page_facts(spark, sf_dir):
    """Documents taken for the text of first pages."""
    return table(spark, sf_dir, "documents").select("doc_id", *[v.alias(k) for k, v in pdfcheck.first_page_facts(F.col("text")).items()])
