"""Text of pages and papers once it has been taken out of its files.

Null texts count as empty ones; repeated rows are treated each; an empty table gives no rows; further
columns are carried on where a column is added and not read otherwise. Texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import extract as X
from lexiloom.functions import text as T
from lexiloom.operators.references import TABLE_CAPTION

#: A running head, section words, marks of a reference list's end.
RUNNING_HEAD = "(?i)JOURNAL OF L ATEX CLASS FILES"
REFERENCES = r"(?i)(?:^|\n)\s*(?:references|bibliography)\s*(?:\n|$)"
THANKS = r"(?i)(?:^|\n)\s*(?:acknowledgments?|acknowledgements?)\s*(?:\n|$)"
LIST_END = r"(?im)^(?:biographies?|acknowledgments?|acknowledgements?|appendix|appendices|author\s+biography|about\s+the\s+author)"
VENUE = r"(?i)(Conference|Proceedings|Workshop|Journal|IEEE|ACM|Springer|Elsevier)"
SERVICE = r"(?i)^(acknowledgments?|acknowledgements?|appendix|author\s+biography)"


def clean_page(x: Column) -> Column:
    """One page as running text: without running heads, page numbers and blank lines, words joined over
    line ends. Paragraphs don't survive, as blank lines go first."""
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(x, F.lit("")), "\r\n?", "\n"), "\n"), lambda s: F.trim(s))
    kept = F.filter(lines, lambda s: (s != "") & ~s.rlike(RUNNING_HEAD) & ~s.rlike(r"^\d+$"))
    joined = F.regexp_replace(F.array_join(kept, "\n"), r"(?U)(\w)-\n(\w)", "$1$2")
    plain = F.regexp_replace(joined, r"\s+", " ")
    return F.trim(F.replace(F.replace(plain, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")))


def before(x: Column, pattern: str) -> Column:
    """The text before the first match of a pattern; all of it if there is none."""
    y = F.coalesce(x, F.lit(""))
    return F.get(F.split(y, pattern, 2), F.lit(0))


def body(x: Column) -> Column:
    """The text before its references and, in that, before its acknowledgments."""
    return before(before(x, REFERENCES), THANKS)


def is_caption(x: Column) -> Column:
    return x.rlike(TABLE_CAPTION)


def is_numeric(x: Column) -> Column:
    """A line of one number, with sign, decimals, per cent or a deviation."""
    return F.trim(x).rlike(r"^[+-]?\d+(\.\d+)?\s*%?(\s*±\s*\d+(\.\d+)?)?$")


def running_key(x: Column) -> Column:
    """A head or foot line without its numbers, in lower case."""
    return T.collapse_space(F.regexp_replace(F.lower(x), r"\d+", "#"))


def without_margins(blocks: DataFrame, keys: DataFrame, top: float = 72.0, bottom: float = 72.0, height: float = 792.0) -> DataFrame:
    """Text blocks (``block``, ``kind`` 0, ``y0``, ``y1``, ``text``) but those in the page's margins one of whose lines has
    a key of ``keys`` (``key``)."""
    own = blocks.where("kind = 0")
    margin = (F.col("y0") <= top) | (F.col("y1") >= height - bottom)
    lines = own.where(margin).select("block", F.explode(F.split("text", "\n")).alias("l")).where(F.trim("l") != "").select("block", running_key(F.trim("l")).alias("key"))
    gone = lines.join(keys.select("key").distinct(), "key", "left_semi").select("block").distinct()
    return own.join(gone, "block", "left_anti")


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc``, ``n``, ``start`` (characters before it), ``line``."""
    rows = docs.select("doc", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    above = Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(above), F.lit(0)))


def headings(docs: DataFrame, gap: int = 100) -> DataFrame:
    """``doc``, ``start``, ``stop``, ``heading`` of the sections of texts (``doc``, ``text``).

    Numbered lines and lines in capitals are headings unless they stand less than ``gap`` characters behind
    the last kept one, begin with a year, name a venue or look like an author; service sections are
    passed over; the references end it all. The fold goes over a text's few candidates only.
    """
    lines = lines_of(docs)
    numbered, simple = F.regexp_extract("line", r"^(?:\d+\.)+\s+([A-Z][a-z].{5,100})$", 1), F.regexp_extract("line", r"^(\d+\.?\s+[A-Z][a-z].{5,100})$", 1)
    upper = F.trim(F.regexp_extract("line", r"^([A-Z][A-Z\s]{3,50})$", 1))
    capital = F.when(F.length(upper).between(5, 50), upper).otherwise("")
    found = lines.select("doc", "start", F.explode(F.filter(F.array(numbered, capital, simple), lambda h: h != "")).alias("h"), F.lit(0).alias("o"))
    order = F.when(F.col("h").rlike("^[A-Z][a-z]"), 0).when(F.col("h").rlike(r"^\d"), 2).otherwise(1)
    rows = found.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", order.alias("o"), F.trim("h").alias("h")))).alias("c"))
    bad = lambda h: h.rlike(r"^(19|20)\d{2}\s") | h.rlike(VENUE) | h.rlike(r"^[A-Z]\.\s+[A-Z][a-z]+\s+[A-Z]")
    empty = F.from_json(F.lit("[]"), "array<struct<start:bigint,h:string>>")
    state = F.struct(empty.alias("kept"), F.lit(-1000).cast("bigint").alias("last"), F.lit(None).cast("bigint").alias("end"))

    def step(s, c):
        far = s["end"].isNull() & (c["start"] - s["last"] >= gap) & ~bad(c["h"])
        ends = far & c["h"].rlike(r"(?i)^(references|bibliography)")
        keeps = far & ~ends & ~c["h"].rlike(SERVICE)
        return F.struct(
            F.when(keeps, F.concat(s["kept"], F.array(F.struct(c["start"].alias("start"), c["h"].alias("h"))))).otherwise(s["kept"]).alias("kept"),
            F.when(keeps, c["start"]).otherwise(s["last"]).alias("last"), F.when(ends, c["start"]).otherwise(s["end"]).alias("end"),
        )

    folded = rows.select("doc", F.aggregate("c", state, step).alias("s")).join(docs.select("doc", F.length(F.coalesce("text", F.lit(""))).alias("size")), "doc")
    out = folded.select("doc", F.coalesce("s.end", "size").alias("end"), F.explode("s.kept").alias("k")).select("doc", "end", F.col("k.start").alias("start"), F.col("k.h").alias("heading"))
    return out.withColumn("stop", F.coalesce(F.lead("start").over(Window.partitionBy("doc").orderBy("start")), "end").cast("long")).drop("end")


def joined_titles(docs: DataFrame, most: int = 3, least: int = 15) -> DataFrame:
    """``doc``, ``title``: a text's first line that isn't blank, with up to ``most`` - 1 lines after it while they go on
    in letters and neither line ends a sentence; null if it stays under ``least`` characters."""
    lines = lines_of(docs).withColumn("line", F.trim("line")).where("line <> ''")
    w = Window.partitionBy("doc").orderBy("n")
    first = lines.withColumns({"k": F.row_number().over(w), **{f"l{i}": F.lead("line", i).over(w) for i in range(1, most)}}).where("k = 1")
    title, going = F.col("line"), F.lit(True)
    for i in range(1, most):
        going = going & ~title.rlike(r"[.!?]$") & F.coalesce(F.col(f"l{i}").rlike(r"^\p{L}"), F.lit(False))
        title = F.when(going, F.concat_ws(" ", title, F.col(f"l{i}"))).otherwise(title)
    return first.select("doc", F.when(F.length(title) >= least, title).alias("title"))


def numbered_references(docs: DataFrame) -> DataFrame:
    """``doc``, ``number``, ``raw``: entries of a text's reference list, whose marks are ``[1]``, ``(1)`` or ``1.`` at
    the start of a line. An entry goes on until the next mark of its kind or the list's end; the first entry of
    a number stays, brackets before bare numbers before parentheses."""
    behind = F.regexp_extract("text", r"(?is)(?:^|\n)\s*(?:references|bibliography)[ \t]*\n(.*)$", 1)
    part = before(F.when(behind != "", behind).otherwise(F.coalesce("text", F.lit(""))), LIST_END)
    rows = docs.select("doc", part.alias("text"))
    marks = [r"^\[\s*(\d+)\s*\][\s.]*", r"^(\d+)[\s.]+", r"^\(\s*(\d+)\s*\)[\s.]*"]
    out = None
    for kind, mark in enumerate(marks):
        pieces = F.split(F.regexp_replace("text", "(?m)" + mark, "\u0001$1\u0002"), "\u0001")
        own = rows.select("doc", F.posexplode(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1)))).alias("n", "p"))
        own = own.select("doc", F.lit(kind).alias("kind"), "n", F.substring_index("p", "\u0002", 1).try_cast("int").alias("number"), T.normalize_text(T.collapse_space(F.substring_index("p", "\u0002", -1))).alias("raw"))
        out = own if out is None else out.unionByName(own)
    first = F.row_number().over(Window.partitionBy("doc", "number").orderBy("kind", "n"))
    return out.where("number is not null").withColumn("_f", first).where("_f = 1").select("doc", "number", "raw")


def bib_title(raw: Column) -> Column:
    """A reference's title: the longest text in quotes of 10 to 200 characters (the first of equals), else what
    stands after the authors, else the first long run of words; empty if there is none."""
    quoted = F.regexp_extract_all(raw, F.lit('"([^"]{10,200})"'), F.lit(1))
    longest = F.aggregate(quoted, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    authors = r"(?i)(?:[A-Z][.\s]*[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*(?:\s*,\s*[A-Z][.\s]*[A-Z][a-z]+)*(?:\s+and\s+[A-Z][.\s]*[A-Z][a-z]+)*)[,\s]+([^,]{15,200})(?:,|\.|$)"
    after = T.collapse_space(F.regexp_extract(raw, authors, 1))
    run = T.collapse_space(F.regexp_replace(F.regexp_extract(raw, r"(?:^|,\s+)([A-Z][A-Za-z\s]{14,150}?)(?:\.|,|$)", 1), r"^[A-Z]\.\s+", ""))
    good = lambda t: (F.length(t) >= 15) & ~F.lower(t).rlike("^(and |et al)")
    return F.coalesce(F.nullif(T.normalize_text(longest), F.lit("")), F.when(good(after), after), F.when(good(run), run), F.lit(""))


def regex_references(docs: DataFrame) -> DataFrame:
    """``doc``, ``doi``, ``arxiv_id``: the distinct DOIs of a text's addresses, and its first arXiv id."""
    inside = F.transform(F.filter(X.urls(F.col("text")), lambda u: F.lower(u).contains("doi.org")), lambda u: F.lower(F.regexp_extract(u, r"(?i)10\.\d{4,}/[^\s)]+", 0)))
    dois = docs.select("doc", F.explode(F.array_distinct(F.filter(inside, lambda d: d != ""))).alias("doi"), F.lit("").alias("arxiv_id"))
    return dois.unionByName(docs.select("doc", F.lit("").alias("doi"), X.arxiv_id(F.col("text")).alias("arxiv_id")).where("arxiv_id is not null"))


def column_name(x: Column) -> Column:
    """A table's column name in snake case; empty stays empty, marks alone become ``col``."""
    low = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    name = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(low == "", "").when(name == "", "col").otherwise(name)


def row_text(names: Column, values: Column) -> Column:
    """A table's row as ``name=value; ...``. Without a first name the first value is the row's label."""
    flat = F.transform(values, lambda v: F.replace(F.trim(v), F.lit("\n"), F.lit(" ")))
    pairs = F.filter(F.zip_with(names, flat, lambda n, v: F.when(v.isNotNull() & (F.trim(n) != ""), F.concat(n, F.lit("="), v))), lambda p: p.isNotNull())
    labelled = F.trim(F.get(names, F.lit(0))) == ""
    label = F.when(labelled, F.nullif(F.get(flat, F.lit(0)), F.lit("")))
    return F.concat_ws("; ", label, F.nullif(F.array_join(pairs, "; "), F.lit("")))


def table_block(table_id: Column, caption: Column, names: Column, rows: Column) -> Column:
    """A table as a block of text; ``rows`` is an array of arrays."""
    joined = F.regexp_replace(F.trim(caption), r"(\p{L})[-‐‑‒–—]\s+(\p{L})", "$1$2")
    head = F.array_join(F.filter(names, lambda n: F.trim(n) != ""), " | ")
    body_ = F.transform(rows, lambda r: F.concat(F.lit("row: "), row_text(names, r)))
    return F.array_join(F.concat(F.array(F.concat(F.lit("[TABLE id="), table_id, F.lit("]")), F.concat(F.lit("caption: "), joined), F.concat(F.lit("columns: "), head)), body_, F.array(F.lit("[/TABLE]"))), "\n")


def table_count(x: Column) -> Column:
    return F.regexp_count(F.coalesce(x, F.lit("")), F.lit(r"(?i)\[TABLE\s+id="))


def table_ids(x: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(?i)\[TABLE\s+id=([^\]]+)\]"), F.lit(1))


def table_bodies(x: Column) -> Column:
    """Whole blocks from an opening mark to the next closing one."""
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(?is)\[TABLE\s+id=[^\]]+\].*?\[/TABLE\]"), F.lit(0))


def values_per_row(tables: DataFrame) -> DataFrame:
    """``id``, ``n``: how many numbers a table's rows have, from its lines (``id``, ``n``, ``line``): the most frequent length
    of a run of two or more numeric lines behind one that isn't (of equally frequent ones the first seen)."""
    rows = tables.where(F.trim("line") != "").select("id", "n", is_numeric(F.col("line")).alias("num"))
    w = Window.partitionBy("id").orderBy("n")
    runs = rows.withColumn("g", F.sum(F.when(F.col("num"), 0).otherwise(1)).over(w)).groupBy("id", "g").agg(F.count_if("num").alias("run"), F.min("n").alias("at"))
    seen = runs.where("g > 0 and run >= 2").groupBy("id", "run").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("at"))
    return seen.groupBy("id").agg(F.min_by("run", F.struct(-F.col("c"), "at")).alias("n"))


def clean_tei(x: Column) -> Column:
    """Raw text of a TEI element: control characters and wide blanks gone, one blank between words."""
    plain = F.regexp_replace(F.coalesce(x, F.lit("")), r"[\n\r\t\x{00A0}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}]", " ")
    return T.normalize_text(T.collapse_space(F.regexp_replace(plain, r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F]", "")))


def meta(html: Column, *names: str) -> Column:
    """Content of the first of several meta tags, in the order of names, whatever the attributes' order."""
    def one(name):
        key = rf'(?:name|property)\s*=\s*["\']{name}["\']'
        a = F.regexp_extract(html, rf'(?is)<meta\b[^>]*{key}[^>]*\bcontent\s*=\s*"([^"]*)"', 1)
        b = F.regexp_extract(html, rf'(?is)<meta\b[^>]*\bcontent\s*=\s*"([^"]*)"[^>]*{key}', 1)
        return F.nullif(F.trim(F.concat(a, F.when(a == "", b).otherwise(""))), F.lit(""))

    return F.coalesce(*[one(n) for n in names])


def page_record(url: Column, html: Column) -> dict[str, Column]:
    """Title, DOI, PDF and authors of a page: from its tags, and where those lack from its title, its text and its links.
    Pages of IEEE, ACM and Springer take their titles from the tag each uses; null where nothing is found."""
    at = X.host(url)
    usual = F.coalesce(meta(html, "citation_title", "og:title", "twitter:title"), F.nullif(F.trim(X.page_title(html)), F.lit("")))
    heading = F.nullif(F.trim(F.regexp_extract(html, r"(?is)<h1[^>]*>([^<]*)</h1>", 1)), F.lit(""))
    own = F.when(at.contains("ieee"), F.coalesce(meta(html, "og:title"), heading)).when(at.contains("acm.org") | at.contains("springer"), F.coalesce(meta(html, "citation_title", "dc.Title"), heading)).otherwise(usual)
    doi = F.coalesce(meta(html, "citation_doi"), F.nullif(F.regexp_extract(html, r'10\.\d{4,}/[^\s"<>]+', 0), F.lit("")))
    links = F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*\bhref\s*=\s*"([^"]*)"'), F.lit(1))
    root = F.regexp_extract(url, r"^([a-z]+://[^/?#]+)", 1)
    whole = F.transform(F.filter(links, lambda u: F.lower(u).contains(".pdf")), lambda u: F.when(u.startswith("/"), F.concat(root, u)).otherwise(u))
    pdf = F.coalesce(meta(html, "citation_pdf_url"), F.get(F.filter(whole, lambda u: u.startswith("http")), F.lit(0)))
    authors = F.regexp_extract_all(html, F.lit(r'(?is)<meta\b[^>]*name\s*=\s*"citation_author"[^>]*content\s*=\s*"([^"]*)"'), F.lit(1))
    return {"title": own, "doi": doi, "pdf_url": pdf, "authors": F.nullif(F.array_join(F.transform(authors, lambda a: F.trim(a)), "; "), F.lit(""))}
