"""Queries that resolve references against source tables; both are made of the driver's web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import extract as X
from lexiloom.functions import text as T
from lexiloom.operators import enrichment as E
from lexiloom.operators.graph import cut_lineage
from lexiloom.plans.registry import query, table

#: Records of two sources: pages by host, with ids that follow from the page's number.
SOURCES = """p AS (SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, url FROM pages),
a AS (SELECT 'a' || page_id AS source_id, title, 2000 + page_id % 20 AS year, '10.1234/p.' || page_id AS doi, '2' || lpad((page_id % 1000)::VARCHAR, 3, '0') || '.' || lpad(page_id::VARCHAR, 5, '0') AS arxiv_id, url FROM p WHERE length(title) > 30),
b AS (SELECT 'b' || page_id AS source_id, title, 2001 + page_id % 20 AS year, '10.1234/P.' || page_id AS doi, url FROM p)"""
#: References: every page by its title in capitals; its DOI stands in the raw text if the title is short, else its arXiv id in an address if
#: the title is long.
REFS = """r AS (SELECT page_id AS ref, upper(title) AS title, 2000 + page_id % 20 AS year, CASE WHEN length(title) <= 40 THEN 'See doi: 10.1234/p.' || page_id || '.' END AS raw_text,
 CASE WHEN length(title) > 55 THEN 'https://arxiv.org/abs/2' || lpad((page_id % 1000)::VARCHAR, 3, '0') || '.' || lpad(page_id::VARCHAR, 5, '0') || 'v2' END AS article_url FROM p)"""


def _pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    arxiv = F.concat(F.lit("2"), F.lpad((F.col("page_id") % 1000).cast("string"), 3, "0"), F.lit("."), F.lpad(F.col("page_id").cast("string"), 5, "0"))
    return p.select("page_id", F.coalesce(X.page_title(F.col("html")), F.lit("")).alias("title"), "url", (2000 + F.col("page_id") % 20).cast("int").alias("year"), F.col("page_id").cast("string").alias("k"), arxiv.alias("arxiv"))


def sources(spark, sf_dir, pages=None):
    p, none = _pages(spark, sf_dir) if pages is None else pages, F.lit(None).cast("string")
    pdf = F.concat("url", F.lit(".pdf"))
    a = p.where("length(title) > 30").select(
        F.concat(F.lit("a"), "k").alias("source_id"), "title", "year", none.alias("authors"), F.concat(F.lit("10.1234/p."), "k").alias("doi"), F.col("arxiv").alias("arxiv_id"), F.col("url").alias("article_url"), pdf.alias("pdf_url")
    )
    b = p.select(F.concat(F.lit("b"), "k").alias("source_id"), "title", (F.col("year") + 1).alias("year"), none.alias("authors"), F.concat(F.lit("10.1234/P."), "k").alias("doi"), none.alias("arxiv_id"), F.col("url").alias("article_url"), none.alias("pdf_url"))
    return [("a", a), ("b", b)]


def references(spark, sf_dir, pages=None):
    p, none = _pages(spark, sf_dir) if pages is None else pages, F.lit(None).cast("string")
    n = F.length("title")
    return p.select(
        F.col("page_id").alias("ref"), F.upper("title").alias("title"), "year", none.alias("authors"), none.alias("doi"), none.alias("arxiv_id"), none.alias("pdf_url"),
        F.when(n <= 40, F.concat(F.lit("See doi: 10.1234/p."), "k", F.lit("."))).alias("raw_text"), F.when(n > 55, F.concat(F.lit("https://arxiv.org/abs/"), "arxiv", F.lit("v2"))).alias("article_url"),
    )


def _keyed(spark, sf_dir, pages=None):
    c = F.col
    r = references(spark, sf_dir, pages)
    return r.withColumns({"arxiv_id": E.arxiv_of(c("doi"), c("article_url"), c("pdf_url"), c("raw_text"), c("arxiv_id")), "doi": E.doi_of(c("doi"), c("article_url"), c("raw_text"))})


@query(
    f"""WITH {SOURCES}, {REFS} SELECT ref, nullif(regexp_replace(regexp_extract(raw_text, 'doi: (10\\.[^ ]+)', 1), '\\.$', ''), '') AS doi, nullif(regexp_extract(article_url, 'abs/([0-9.]+)', 1), '') AS arxiv_id FROM r"""
)
def reference_ids(spark, sf_dir):
    return _keyed(spark, sf_dir).select("ref", "doi", "arxiv_id")


@query(
    f"""WITH {SOURCES}, {REFS}, k AS (SELECT ref FROM r WHERE raw_text IS NOT NULL) SELECT ref, CASE WHEN a.source_id IS NOT NULL THEN 'a' ELSE 'b' END AS source, coalesce(a.source_id, b.source_id) AS source_id
FROM k LEFT JOIN a ON a.source_id = 'a' || ref JOIN b ON b.source_id = 'b' || ref"""
)
def lookup_by_doi(spark, sf_dir):
    return E.by_priority(_keyed(spark, sf_dir), sources(spark, sf_dir), "doi").select("ref", "source", "source_id")


@query(f"""WITH {SOURCES}, {REFS} SELECT ref, a.source_id FROM r JOIN a ON contains(r.article_url, a.arxiv_id)""")
def lookup_by_arxiv(spark, sf_dir):
    return E.lookup(_keyed(spark, sf_dir), sources(spark, sf_dir)[0][1], "arxiv_id").select("ref", "source_id")


_WORDS = "list_distinct(regexp_extract_all(lower({t}), '[a-z0-9\\-]{{3,}}'){s})"
SEARCH = f"""w AS (SELECT ref, {_WORDS.format(t="title", s="[1:6]")} AS ask FROM r), h AS (SELECT source_id, {_WORDS.format(t="title", s="")} AS have FROM b), f AS (SELECT ref, source_id FROM w JOIN h ON list_has_all(have, ask) WHERE len(ask) > 0)"""


@query(f"""WITH {SOURCES}, {REFS}, {SEARCH} SELECT * FROM f""")
def title_search(spark, sf_dir):
    return E.title_search(references(spark, sf_dir), sources(spark, sf_dir)[1][1])


@query(
    f"""WITH {SOURCES}, {REFS}, {SEARCH}, ha AS (SELECT source_id, {_WORDS.format(t="title", s="")} AS have FROM a), g AS (SELECT ref, h.source_id, 0 AS p FROM w JOIN ha h ON list_has_all(have, ask) WHERE len(ask) > 0 UNION ALL SELECT ref, source_id, 1 FROM f),
t AS (SELECT *, row_number() OVER (PARTITION BY ref, p ORDER BY source_id) AS n FROM g QUALIFY n <= 3)
SELECT ref, CASE WHEN p = 0 THEN 'a' ELSE 'b' END AS source, source_id FROM t QUALIFY row_number() OVER (PARTITION BY ref, substr(source_id, 2) ORDER BY p, n) = 1"""
)
def title_candidates(spark, sf_dir):
    return E.all_candidates(references(spark, sf_dir), sources(spark, sf_dir))


@query(
    f"""WITH {SOURCES}, {REFS}, n AS (SELECT source_id, year, trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '[-_]', ' ', 'g'), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM b WHERE regexp_full_match(title, '[ -~]*')),
m AS (SELECT ref, year, trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '[-_]', ' ', 'g'), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM r WHERE regexp_full_match(title, '[ -~]*'))
SELECT ref, source_id FROM m JOIN n USING (t) WHERE abs(m.year - n.year) <= 2 AND t <> ''"""
)
def validated_titles(spark, sf_dir):
    """Candidates of equal search words whose plain titles are equal, as the rule must accept them."""
    b = sources(spark, sf_dir)[1][1].select("source_id", F.col("title").alias("have"), F.col("year").alias("c_year"))
    r = references(spark, sf_dir).select("ref", F.col("title").alias("ask"), "year")
    b, r = cut_lineage(b), cut_lineage(r)
    words = lambda t: F.array_join(F.sort_array(E.title_words(t, 100)), " ")
    none = F.lit(None).cast("int")
    asked = r.select("ask").distinct().select(F.col("ask").alias("title"), none.alias("year"), words(F.col("ask")).alias("w"))
    pairs = asked.join(b.select("have").distinct().select(F.col("have").alias("c_title"), none.alias("c_year"), words(F.col("have")).alias("w")), "w")
    plain = lambda c: F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), r"[-_\s]+", " "), r"(?U)[^\w\s]", ""))
    kept = E.valid_candidates(pairs).where(T.collapse_space(plain("title")) == T.collapse_space(plain("c_title")))
    kept = kept.where(F.col("title").rlike(r"^[\x20-\x7E]*$") & F.col("c_title").rlike(r"^[\x20-\x7E]*$"))
    return E.expanded(kept.select(F.col("title").alias("ask"), F.col("c_title").alias("have")), r, b, most_years=2)


@query(
    f"""WITH {SOURCES}, {REFS} SELECT ref, CASE WHEN raw_text IS NOT NULL THEN 'doi' WHEN article_url IS NOT NULL THEN 'arxiv_id' END AS found_by, r.year AS year FROM r WHERE raw_text IS NOT NULL OR article_url IS NOT NULL"""
)
def enriched_references(spark, sf_dir):
    """The whole workflow; what is found by an id is compared."""
    registry = E.Registry()
    for name, source in sources(spark, sf_dir):
        registry.register(name, source)
    rows = E.enrich(references(spark, sf_dir), registry)
    return rows.where("found_by in ('doi', 'arxiv_id')").select("ref", "found_by", "year")


LIST = ", ".join("'" + d + "'" for d in E.TRUSTED)
OUT = ", ".join("'" + d + "'" for d in E.BLOCKED)


@query(
    f"""WITH l AS (SELECT page_id, unnest([url, url || '/paper.pdf', 'https://arxiv.org/pdf/' || page_id, 'https://x.org/a.pdf?v=' || page_id, 'https://www.wikipedia.org/wiki/' || page_id]) AS url FROM pages)
SELECT page_id, url, len(list_filter([{LIST}], lambda d: contains(lower(url), d))) > 0 AS trusted, len(list_filter([{OUT}], lambda d: contains(lower(url), d))) > 0 AS blocked,
 regexp_matches(lower(url), '\\.pdf$') OR contains(string_split(string_split(lower(url), '/')[-1], '?')[1], '.pdf') AS names_pdf FROM l"""
)
def url_rules(spark, sf_dir):
    k = F.col("page_id").cast("string")
    made = F.array("url", F.concat("url", F.lit("/paper.pdf")), F.concat(F.lit("https://arxiv.org/pdf/"), k), F.concat(F.lit("https://x.org/a.pdf?v="), k), F.concat(F.lit("https://www.wikipedia.org/wiki/"), k))
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(made).alias("url"))
    return rows.select("page_id", "url", E.trusted(F.col("url")).alias("trusted"), E.blocked(F.col("url")).alias("blocked"), E.names_pdf(F.col("url")).alias("names_pdf"))


@query(
    r"""SELECT page_id, list_distinct(list_filter(regexp_extract_all(html, 'https?://[^\s)\]]+'), lambda u: u <> '')) IS NOT NULL AS has_list,
 coalesce(list_filter(list_transform(regexp_extract_all(regexp_replace(html, '\s+', ' ', 'g'), '(?i)https?://[^\s)\]]+'), lambda u: regexp_replace(u, '[.,;)]+$', '')),
  lambda u: (u LIKE 'http://%' OR u LIKE 'https://%') AND NOT (lower(u) LIKE '%.pdf' OR lower(u) LIKE '%/pdf/%' OR lower(u) LIKE '%/pdf' OR lower(u) LIKE '%filetype=pdf%'))[1], '') AS article_url FROM pages"""
)
def article_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.lit(True).alias("has_list"), E.article_url(F.col("html")).alias("article_url"))


@query(
    """WITH x AS (SELECT o_custkey AS ref, list('https://a.org/' || o_orderstatus ORDER BY o_orderkey) AS a, list('https://a.org/' || o_orderpriority[1] ORDER BY o_orderkey) AS b FROM orders GROUP BY 1),
l AS (SELECT ref, list_concat(a, b) AS l FROM x) SELECT ref, array_to_string(list_filter(l, lambda u, i: list_position(l, u) = i), ' ') AS urls FROM l"""
)
def merged_urls(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat(F.lit("https://a.org/"), c).alias("u")))), lambda s: s["u"])
    rows = o.groupBy(F.col("o_custkey").alias("ref")).agg(in_order(F.col("o_orderstatus")).alias("a"), in_order(F.left("o_orderpriority", F.lit(1))).alias("b"))
    return rows.select("ref", F.array_join(E.merged_urls(F.col("a"), F.col("b")), " ").alias("urls"))


@query(
    """WITH c AS (SELECT c_custkey AS ref, 'https://a.org/' || c_custkey || '.pdf?x=1' AS u1, 'HTTPS://A.org/' || c_custkey || '.pdf' AS u2, 'https://doi.org/10.1/' || c_custkey AS u3, c_acctbal > 5000 AS own, lpad(c_custkey::VARCHAR, 5, '0') AS k FROM customer),
x AS (SELECT ref, 0.95 AS confidence, u1 AS url FROM c UNION ALL SELECT ref, 1.0, 'https://arxiv.org/pdf/2101.' || k || '.pdf' FROM c WHERE own UNION ALL SELECT ref, 0.9, u3 FROM c)
SELECT ref, url, confidence::DOUBLE AS confidence, row_number() OVER (PARTITION BY ref ORDER BY confidence DESC, url) AS place FROM x"""
)
def pdf_candidates(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("string")
    refs = c.select(F.col("c_custkey").alias("ref"), F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("2101."), F.lpad(k, 5, "0"))).alias("arxiv_id"))
    found = c.select(
        F.col("c_custkey").alias("ref"),
        F.explode(F.array(F.struct(F.lit("unpaywall_doi").alias("how"), F.concat(F.lit("https://a.org/"), k, F.lit(".pdf?x=1")).alias("pdf_url")), F.struct(F.lit("title").alias("how"), F.concat(F.lit("HTTPS://A.org/"), k, F.lit(".pdf")).alias("pdf_url")), F.struct(F.lit("doi").alias("how"), F.concat(F.lit("https://doi.org/10.1/"), k).alias("pdf_url")))).alias("f"),
    ).select("ref", "f.*")
    return E.pdf_candidates(refs, found).select("ref", "url", "confidence", F.col("place").cast("long").alias("place"))


@query(
    """SELECT c_custkey AS ref, CASE WHEN c_acctbal > 5000 THEN 'https://arxiv.org/pdf/2101.' || lpad(c_custkey::VARCHAR, 5, '0') || '.pdf' ELSE 'https://a.org/' || c_custkey || '.pdf?x=1' END AS pdf_url FROM customer"""
)
def best_pdf(spark, sf_dir):
    return E.best_pdf(pdf_candidates(spark, sf_dir))


@query(
    """WITH x AS (SELECT c_custkey AS ref, CASE WHEN c_acctbal > 0 THEN c_name END AS title, nullif(c_mktsegment, 'BUILDING') AS doi FROM customer), m AS (SELECT o_custkey AS ref, min(o_orderpriority) AS doi, '  t ' || min(o_orderstatus) AS title, min(o_orderdate)::VARCHAR AS year FROM orders GROUP BY 1)
SELECT ref, coalesce(x.title, trim(m.title)) AS title, coalesce(x.doi, m.doi) AS doi, substr(m.year, 1, 4)::INT AS year FROM x LEFT JOIN m USING (ref)"""
)
def filled_fields(spark, sf_dir):
    none = F.lit(None).cast("string")
    c = table(spark, sf_dir, "customer")
    base = c.select(F.col("c_custkey").alias("ref"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise(" ").alias("title"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise("nan").alias("doi"), F.lit(None).cast("int").alias("year"), none.alias("authors"), none.alias("arxiv_id"), none.alias("article_url"), none.alias("pdf_url"))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("ref")).agg(F.min("o_orderpriority").alias("doi"), F.concat(F.lit("  t "), F.min("o_orderstatus")).alias("title"), F.min("o_orderdate").cast("string").alias("year"))
    more = o.select("ref", "title", "year", "doi", none.alias("authors"), none.alias("arxiv_id"), none.alias("article_url"), none.alias("pdf_url"))
    return E.filled(base, more).select("ref", "title", "doi", "year")


@query(
    """WITH n AS (SELECT l_orderkey AS ref, l_linenumber AS kind, CASE l_linenumber WHEN 1 THEN '[''Roe J'', ''Doe K'']' WHEN 2 THEN 'Roe J; Doe K ;' WHEN 3 THEN 'Roe J|Doe K' WHEN 4 THEN 'Roe J, Doe K' WHEN 5 THEN 'nan' WHEN 6 THEN '[]' ELSE 'Roe J' END AS authors FROM lineitem)
SELECT ref, kind, authors, CASE WHEN kind <= 4 THEN 'Roe J; Doe K' WHEN kind <= 6 THEN '' ELSE 'Roe J' END AS joined, CASE WHEN kind <= 4 THEN 2 WHEN kind <= 6 THEN 0 ELSE 1 END AS n FROM n"""
)
def author_lists(spark, sf_dir):
    kinds = {1: "['Roe J', 'Doe K']", 2: "Roe J; Doe K ;", 3: "Roe J|Doe K", 4: "Roe J, Doe K", 5: "nan", 6: "[]"}
    kind = F.col("l_linenumber")
    text = F.lit("Roe J")
    for k, v in kinds.items():
        text = F.when(kind == k, F.lit(v)).otherwise(text)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ref"), kind.alias("kind"), text.alias("authors"))
    listed = E.author_list(F.col("authors"))
    return rows.select("ref", "kind", "authors", F.array_join(listed, "; ").alias("joined"), F.size(listed).alias("n"))


@query("""SELECT o_orderkey AS ref, o_orderpriority || '!' AS answer FROM orders""")
def cached_lookup(spark, sf_dir):
    """Answers to open orders are in the cache, the rest is asked for."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref"), "o_orderstatus", F.concat("o_orderpriority", F.lit("!")).alias("answer"))
    answers, _ = E.with_cache(o.select("ref"), o.where("o_orderstatus = 'O'").select("ref", "answer"), lambda misses: misses.join(o, "ref").select("ref", "answer"))
    return answers


@query(
    """SELECT o_custkey AS ref, 'Orders of ' || o_custkey AS title, string_agg(o_orderpriority, '; ' ORDER BY o_orderkey) AS authors, min(year(o_orderdate))::INT AS year, '10.1234/' || o_custkey AS doi, 'https://a.org/' || o_custkey AS article_url FROM orders GROUP BY 1"""
)
def work_records(spark, sf_dir):
    """An index's answers, one a customer, read back from their JSON."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("ref")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda s: F.struct(F.struct(s["o_orderpriority"].alias("display_name")).alias("author"))).alias("authorships"), F.min(F.year("o_orderdate")).alias("publication_year"))
    k = F.col("ref").cast("string")
    answer = F.to_json(F.struct(
        F.lit("").alias("title"), F.concat(F.lit("Orders  of "), k).alias("display_name"), F.concat(F.lit("https://doi.org/10.1234/"), k).alias("doi"), "publication_year", "authorships",
        F.struct(F.concat(F.lit("https://a.org/"), k).alias("landing_page_url")).alias("primary_location"),
    ))
    found = E.work_record(F.col("answer"))
    return o.select("ref", answer.alias("answer")).select("ref", *[found[c].alias(c) for c in ("title", "authors", "year", "doi", "article_url")])


@query("""SELECT c_custkey AS ref, c_name AS title, 'Jo ' || c_mktsegment AS authors, CASE WHEN c_acctbal > 0 THEN 2001 ELSE 1999 END::INT AS year, '10.1/' || c_custkey AS doi FROM customer""")
def message_records(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    dates = lambda y: F.struct(F.array(F.array(F.lit(y))).alias("date-parts"))
    answer = F.to_json(F.struct(
        F.array("c_name").alias("title"), F.array(F.struct(F.lit("Jo").alias("given"), F.col("c_mktsegment").alias("family"))).alias("author"), F.concat(F.lit("10.1/"), F.col("c_custkey").cast("string")).alias("DOI"),
        F.when(F.col("c_acctbal") > 0, dates(2001)).alias("published-online"), dates(1999).alias("issued"),
    ))
    found = E.message_record(F.col("answer"))
    return c.select(F.col("c_custkey").alias("ref"), answer.alias("answer")).select("ref", *[found[k].alias(k) for k in ("title", "authors", "year", "doi")])


@query(
    """SELECT c_custkey AS ref, CASE WHEN c_acctbal > 5000 THEN '2101.' || lpad(c_custkey::VARCHAR, 5, '0') WHEN c_acctbal > 0 THEN '2202.' || lpad(c_custkey::VARCHAR, 5, '0') END AS arxiv_id,
 CASE WHEN c_acctbal > 5000 THEN 'https://arxiv.org/abs/2101.' || lpad(c_custkey::VARCHAR, 5, '0') ELSE 'https://b.org/' || c_custkey END AS article_url FROM customer"""
)
def backfilled_references(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.lpad(F.col("c_custkey").cast("string"), 5, "0")
    refs = c.select(
        F.col("c_custkey").alias("ref"), F.lit(" ").alias("arxiv_id"), F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("https://arxiv.org/abs/2101."), k)).alias("article_url"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("See https://a.org/x and https://arxiv.org/pdf/2202."), k, F.lit("."))).alias("raw_text"), F.concat(F.lit("https://b.org/"), F.col("c_custkey").cast("string"), F.lit(".pdf")).alias("pdf_url"),
    )
    return E.backfilled(refs).select("ref", "arxiv_id", "article_url")


@query("""SELECT c_custkey AS ref, c_name AS title, CASE WHEN c_acctbal > 0 THEN 'A, B, C et al.' ELSE 'A, B' END AS people, 'https://doi.org/10.1/' || c_custkey AS link FROM customer""")
def reference_table(spark, sf_dir):
    none = F.lit(None).cast("string")
    authors = F.when(F.col("c_acctbal") > 0, "A;B;C;D").otherwise("A;B")
    refs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ref"), F.col("c_name").alias("title"), authors.alias("authors"), F.concat(F.lit("10.1/"), F.col("c_custkey").cast("string")).alias("doi"), none.alias("pdf_url"), F.lit("nan").alias("article_url"))
    return E.display_rows(refs)
