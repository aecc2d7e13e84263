"""Queries over the text of pages and papers; papers are made of orders and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import layout as L
from lexiloom.plans.registry import query, table

LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: trim(s)), lambda s: s <> '' AND NOT regexp_matches(s, '(?i)JOURNAL OF L ATEX CLASS FILES') AND NOT regexp_matches(s, '^\\d+$'))"


@query(f"""SELECT doc_id, md5(trim(replace(replace(regexp_replace(regexp_replace(array_to_string({LINES}, chr(10)), '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'), '\\s+', ' ', 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl'))) AS digest FROM documents""")
def clean_pages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(L.clean_page(F.col("text"))).alias("digest"))


PAPERS = """p AS (SELECT l_orderkey AS doc, string_agg(l_linenumber || '. ' || CASE l_returnflag WHEN 'A' THEN 'Results of the part ' || l_partkey WHEN 'N' THEN 'Proceedings of volume ' || l_suppkey ELSE CASE WHEN l_linenumber >= 6 THEN 'Appendix on supplier ' ELSE 'Methods for supplier ' END || l_suppkey END || chr(10)
 || repeat('x', l_quantity::INT * 3) || chr(10) || CASE WHEN l_linestatus = 'F' AND l_linenumber = 3 THEN 'REFERENCES' || chr(10) || '[1] Roe, "A title of order ' || l_orderkey || '", 2020.' || chr(10) || '[2] Doe ' || l_suppkey || chr(10) ELSE '' END, '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS text FROM lineitem GROUP BY l_orderkey)"""


def papers(spark, sf_dir):
    n, s = F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")
    service = F.when(F.col("l_linenumber") >= 6, "Appendix on supplier ").otherwise("Methods for supplier ")
    head = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("Results of the part "), F.col("l_partkey").cast("string"))).when(F.col("l_returnflag") == "N", F.concat(F.lit("Proceedings of volume "), s)).otherwise(F.concat(service, s))
    entries = F.concat(F.lit('REFERENCES\n[1] Roe, "A title of order '), F.col("l_orderkey").cast("string"), F.lit('", 2020.\n[2] Doe '), s, F.lit("\n"))
    last = F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 3), entries).otherwise("")
    piece = F.concat(n, F.lit(". "), head, F.lit("\n"), F.expr("repeat('x', cast(l_quantity as int) * 3)"), F.lit("\n"), last)
    keyed = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", piece.alias("x"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(keyed)), lambda k: k["x"]), "").alias("text"))


@query(f"""WITH {PAPERS}, c AS (SELECT doc, string_split(text, chr(10) || 'REFERENCES' || chr(10))[1] AS b FROM p) SELECT doc, length(b) AS n, md5(b) AS digest FROM c""")
def paper_bodies(spark, sf_dir):
    b = L.body(F.col("text"))
    return papers(spark, sf_dir).select("doc", F.length(b).cast("long").alias("n"), F.md5(b).alias("digest"))


HEADS = f"""WITH RECURSIVE {PAPERS}, s AS (SELECT doc, length(text) AS size, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM p),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s),
c AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY start, k) AS i FROM (SELECT doc, size, start, 0 AS k, regexp_extract(line, '^(?:\\d+\\.)+\\s+([A-Z][a-z].{{5,100}})$', 1) AS h FROM o
 UNION ALL SELECT doc, size, start, 2, regexp_extract(line, '^(\\d+\\.?\\s+[A-Z][a-z].{{5,100}})$', 1) FROM o UNION ALL SELECT doc, size, start, 1, CASE WHEN line = 'REFERENCES' THEN line ELSE '' END FROM o) WHERE h <> ''),
f(doc, i, last, done, kept, start, h, size) AS (SELECT doc, 0, -1000::BIGINT, false, false, 0::BIGINT, '', 0 FROM (SELECT DISTINCT doc FROM c)
 UNION ALL SELECT c.doc, c.i::INT, CASE WHEN NOT done AND c.start - last >= 100 AND NOT contains(c.h, 'Proceedings') AND NOT starts_with(lower(c.h), 'references') AND NOT starts_with(lower(c.h), 'appendix') THEN c.start ELSE last END,
 done OR (c.start - last >= 100 AND starts_with(lower(c.h), 'references')), NOT done AND c.start - last >= 100 AND NOT contains(c.h, 'Proceedings') AND NOT starts_with(lower(c.h), 'references') AND NOT starts_with(lower(c.h), 'appendix'), c.start, c.h, c.size
 FROM f JOIN c ON c.doc = f.doc AND c.i = f.i + 1), e AS (SELECT doc, min(start) AS stop FROM f WHERE done GROUP BY doc)"""


@query(f"""{HEADS} SELECT f.doc, start, h AS heading, coalesce(lead(start) OVER (PARTITION BY f.doc ORDER BY start), e.stop, size) AS stop FROM f LEFT JOIN e ON e.doc = f.doc WHERE kept""")
def paper_sections(spark, sf_dir):
    return L.headings(papers(spark, sf_dir))


@query(f"""WITH {PAPERS}, r AS (SELECT doc, string_split(text, 'REFERENCES' || chr(10))[2] AS t FROM p WHERE contains(text, 'REFERENCES' || chr(10))) SELECT doc, 1 AS number, 'A title of order ' || doc AS title FROM r UNION ALL SELECT doc, 2, '' FROM r""")
def paper_references(spark, sf_dir):
    """Entries of the lists' two bracketed numbers; what comes behind the list is numbered without brackets."""
    rows = L.numbered_references(papers(spark, sf_dir).where("text like '%REFERENCES%'"))
    return rows.where("number <= 2").select("doc", "number", F.when(F.col("number") == 1, L.bib_title(F.col("raw"))).otherwise("").alias("title"))


@query(f"""WITH {PAPERS}, s AS (SELECT doc, string_split(text, chr(10)) AS l FROM p) SELECT doc, CASE WHEN length(l[1]) >= 15 THEN l[1] || CASE WHEN l[2] <> '' THEN ' ' || l[2] ELSE '' END END AS title FROM s""")
def paper_titles(spark, sf_dir):
    """The first line and, as it goes on in letters, the second; the third begins with a number."""
    docs = papers(spark, sf_dir)
    return L.joined_titles(docs, 2)


@query(
    """WITH b AS (SELECT o_orderkey AS block, 0 AS kind, o_totalprice / 300 AS y0, 'Page ' || o_custkey || chr(10) || o_orderpriority AS text FROM orders)
SELECT block, y0, text FROM b WHERE NOT ((y0 <= 72 OR y0 + 10 >= 720) AND regexp_matches(text, 'URGENT|LOW'))"""
)
def blocks_without_margins(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    blocks = o.select(
        F.col("o_orderkey").alias("block"), F.lit(0).alias("kind"), (F.col("o_totalprice") / 300).alias("y0"), (F.col("o_totalprice") / 300 + 10).alias("y1"),
        F.concat(F.lit("Page "), F.col("o_custkey").cast("string"), F.lit("\n"), "o_orderpriority").alias("text"),
    )
    keys = o.where("o_orderpriority rlike 'URGENT|LOW'").select(L.running_key(F.col("o_orderpriority")).alias("key"))
    return L.without_margins(blocks, keys).select("block", "y0", "text")


TABLES = """t AS (SELECT o_custkey AS id, list(o_orderstatus || chr(10) ORDER BY o_orderkey) AS a, list(round(o_totalprice)::BIGINT::VARCHAR ORDER BY o_orderkey) AS b FROM orders GROUP BY 1)"""


@query(
    f"""WITH {TABLES} SELECT id, '[TABLE id=' || id || ']' || chr(10) || 'caption: Prices of classification' || chr(10) || 'columns: price' || chr(10)
 || array_to_string(list_transform(range(1, len(a) + 1), lambda i: 'row: ' || trim(replace(a[i], chr(10), '')) || '; price=' || b[i]), chr(10)) || chr(10) || '[/TABLE]' AS block, 1 AS n, id::VARCHAR AS first_id FROM t"""
)
def table_blocks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    row = F.array(F.concat("o_orderstatus", F.lit("\n")), F.round("o_totalprice").cast("long").cast("string"))
    t = o.groupBy(F.col("o_custkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))), lambda s: s["r"]).alias("rows"))
    # a value's own line end is cut with the blanks around it
    rows = F.transform("rows", lambda r: F.transform(r, lambda v: F.regexp_replace(v, r"^\s+|\s+$", "")))
    block = L.table_block(F.col("id").cast("string"), F.lit("Prices of classi- fication"), F.array(F.lit(""), L.column_name(F.lit(" Price "))), rows)
    made = t.select("id", block.alias("block"))
    return made.where(F.size(L.table_bodies(F.col("block"))) == 1).select("id", "block", L.table_count(F.col("block")).alias("n"), F.get(L.table_ids(F.col("block")), F.lit(0)).alias("first_id"))


@query(
    """WITH l AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1) SELECT id, n FROM l WHERE n >= 2"""
)
def table_values_per_row(spark, sf_dir):
    """Each order is a table of one label and as many numbers as it has lines."""
    line = table(spark, sf_dir, "lineitem")
    n = F.row_number().over(L.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    numbers = line.select(F.col("l_orderkey").alias("id"), n.alias("n"), F.col("l_quantity").cast("string").alias("line"))
    labels = line.select(F.col("l_orderkey").alias("id"), F.lit(0).alias("n"), F.lit("Row label").alias("line")).distinct()
    return L.values_per_row(labels.unionByName(numbers))


@query("""SELECT p_partkey, p_brand, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS column_name, regexp_matches('Table ' || p_size || ': ' || p_name, '(?i)^\\s*table\\s*(s?\\d+|[ivxlcdm]+)\\s*[\\.:]?\\s+.*$') AS caption FROM part""")
def column_names(spark, sf_dir):
    caption = F.concat(F.lit("Table "), F.col("p_size").cast("string"), F.lit(": "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", L.column_name(F.col("p_brand")).alias("column_name"), L.is_caption(caption).alias("caption"))


@query(
    r"""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), '') AS title, nullif(regexp_extract(html, '10\.\d{4,}/[^\s"<>]+'), '') AS doi,
 list_filter(list_transform(list_filter(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*"([^"]*)"', 1), lambda u: contains(lower(u), '.pdf')), lambda u: CASE WHEN u LIKE '/%' THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || u ELSE u END), lambda u: u LIKE 'http%')[1] AS pdf_url
FROM pages WHERE NOT regexp_matches(html, '(?is)<meta[^>]*(citation_|og:title|twitter:title)') AND NOT regexp_matches(url, 'ieee|acm\.org|springer')"""
)
def page_records(spark, sf_dir):
    """Pages without scholarly tags, for which the general rules decide."""
    p = table(spark, sf_dir, "pages").where("not html rlike '(?is)<meta[^>]*(citation_|og:title|twitter:title)' and not url rlike 'ieee|acm\\\\.org|springer'")
    found = L.page_record(F.col("url"), F.col("html"))
    return p.select("page_id", *[found[c].alias(c) for c in ("title", "doi", "pdf_url")])


@query("""WITH d AS (SELECT c_custkey AS doc, c_custkey % 100000 AS k FROM customer) SELECT doc, '10.1234/x.' || doc AS doi, '' AS arxiv_id FROM d UNION ALL SELECT doc, '', '2101.' || lpad(k::VARCHAR, 5, '0') FROM d""")
def regex_references(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("see https://doi.org/10.1234/X."), k, F.lit(", again (https://doi.org/10.1234/x."), k, F.lit(") and arXiv: 2101."), F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0"))
    return L.regex_references(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), text.alias("text")))


@query("""SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS clean FROM documents WHERE coalesce(text, '') = regexp_replace(coalesce(text, ''), '[^ -~\\n\\t]', '', 'g')""")
def tei_raw_text(spark, sf_dir):
    """Texts in plain letters, for which the rule is one blank between words."""
    d = table(spark, sf_dir, "documents").where(r"coalesce(text, '') rlike '^[\\x20-\\x7E\\n\\t]*$'")
    return d.select("doc_id", L.clean_tei(F.col("text")).alias("clean"))
