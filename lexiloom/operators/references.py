"""Bibliographic references: guards, normalization, title matching, best candidates, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import extract as X
from lexiloom.functions import similarity as S
from lexiloom.functions import text as T

#: Accented letters and the plain ones they become (longer forms beside them).
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUY"
WIDE = {"ß": "ss", "æ": "ae", "œ": "oe", "Æ": "AE", "Œ": "OE"}
#: Words of other sections, of biographies, of trusted hosts, of blocked hosts.
SECTION_WORDS = "(?i)biography|acknowledgment|appendix"
BIOGRAPHY = "biography|biographical|about the author|about the authors|author biography|he was also|visiting associate professor|in 2016|ieee transactions"
#: Fixed value: marks of formulas.
LATEX = r"\\(frac|sum|int|alpha|beta|gamma|delta|theta|lambda|mu|sigma|phi|psi|omega|mathbb|mathbf|mathrm|mathcal|cdot|times|approx|leq|geq|neq)"
#: Captions.
TABLE_CAPTION = r"(?i)^\s*table\s*(s?\d+|[ivxlcdm]+)\s*[\.:]?\s+.*$"
FIGURE_CAPTION = r"(?i)^\s*fig(ure)?\.?\s*(s?\d+|[ivxlcdm]+)\s*[\.:]?\s+.*$"


def unaccent(x: Column) -> Column:
    """Latin letters without marks. Other scripts stay as they are."""
    y = F.translate(x, ACCENTED, PLAIN)
    for a, b in WIDE.items():
        y = F.replace(y, F.lit(a), F.lit(b))
    return y


def valid_number(x: Column, most: int = 500) -> Column:
    n = F.regexp_extract(F.trim(x.cast("string")), r"\d+", 0).try_cast("long")
    return F.coalesce((n >= 1) & (n <= most) & ~x.cast("string").rlike(SECTION_WORDS), F.lit(False))


def is_phantom(number: Column, title: Column, raw: Column) -> Column:
    """Not a reference: bad number, too short, a biography, or a single letter."""
    t, r = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(raw, F.lit("")))
    short = (F.length(t) < 10) & (F.length(r) < 20)
    return ~valid_number(number) | (F.length(r) < 15) | short | F.lower(F.concat_ws(" \u0001 ", t, r)).rlike(BIOGRAPHY) | r.rlike(r"^[A-Z]\s*\.?\s*$")


def normal_title(x: Column) -> Column:
    """Title for comparison: words apart, plain letters, no marks."""
    y = F.regexp_replace(F.regexp_replace(x, "([a-z])([A-Z])", "$1 $2"), "[-_]", " ")
    return T.collapse_space(F.regexp_replace(unaccent(F.lower(y)), r"(?U)[^\w\s]", ""))


def strict_title_match(a: Column, b: Column, threshold: float = 0.9) -> Column:
    """Ratio, length within a fifth, and nine tenths of the long words there. The cheap tests
    stand before the ratio, which runs in Arrow batches."""
    words = F.filter(F.array_distinct(F.split(a, " ")), lambda w: F.length(w) > 4)
    missing = F.size(F.array_except(words, F.split(b, " "))) <= 0.1 * F.size(words)
    length = F.abs(F.length(a) - F.length(b)) <= 0.2 * F.greatest(F.length(a), F.length(b))
    cheap = (a != "") & (b != "") & length & ((F.size(words) == 0) | missing)
    return F.coalesce(cheap & (S.indel_column(F.when(cheap, a), F.when(cheap, b)) / 100 >= threshold), F.lit(False))


def surnames_first(authors: Column) -> Column:
    """First word of each part between commas: the rule of the dedupe step."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(F.coalesce(authors, F.lit(""))), ","), lambda p: F.split(F.trim(p), r"\s+")[0]), lambda w: w != ""))


def surnames_last(authors: Column) -> Column:
    """Last word of each part between semicolons: the rule of the matching step."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(F.coalesce(authors, F.lit(""))), ";"), lambda p: F.element_at(F.split(F.trim(p), r"\s+"), -1)), lambda w: w != ""))


def normalize(refs: DataFrame) -> DataFrame:
    """Plain titles, bare DOIs (empty if malformed), bare arXiv ids."""
    doi = F.lower(F.trim(F.regexp_replace(F.coalesce("doi", F.lit("")), r"(?i)^https?://(?:dx\.)?doi\.org/", "")))
    found = F.regexp_extract(F.coalesce("arxiv_id", F.lit("")), r"(\d{4}\.\d{4,})", 1)
    return refs.withColumns(
        {
            "title": T.normalize_text(unaccent(F.col("title"))),
            "doi": F.when(X.is_doi(doi), doi).otherwise(""),
            "arxiv_id": F.when(found != "", found).otherwise(F.coalesce("arxiv_id", F.lit(""))),
        }
    )


def best_candidates(refs: DataFrame, candidates: DataFrame, least: float = 0.9) -> DataFrame:
    """The best candidate of each reference: strict title match, then similarity with bonuses for
    year, ids and shared authors. ``candidates`` has ``ref`` and ``rank``; five are looked at."""
    first = candidates.withColumn("_n", F.row_number().over(Window.partitionBy("ref").orderBy("rank"))).where("_n <= 5").drop("_n")
    b = first.select("ref", "rank", *[F.col(c).alias(f"b_{c}") for c in ("title", "year", "doi", "arxiv_id", "authors")])
    pairs = refs.join(b, "ref").withColumns({"x": normal_title(F.col("title")), "y": normal_title(F.col("b_title"))})
    kept = pairs.where(strict_title_match(F.col("x"), F.col("y")))
    gap = F.abs(F.col("year") - F.col("b_year"))
    same = lambda c, f=lambda v: v: F.when((F.coalesce(c, F.lit("")) != "") & (f(F.col(c)) == f(F.col(f"b_{c}"))), 0.2).otherwise(0.0)
    people = lambda c: F.transform(F.split(F.lower(c), ";"), lambda p: F.trim(p))
    shared = F.when((F.col("authors") != "") & (F.col("b_authors") != "") & F.arrays_overlap(people("authors"), people("b_authors")), 0.1).otherwise(0.0)
    plain = lambda c: unaccent(F.lower(F.trim(c)))
    score = S.indel_column(plain(F.col("title")), plain(F.col("b_title"))) / 100
    score = score + F.when(gap == 0, 0.1).when(gap <= 2, 0.05).when(gap > 5, -0.1).otherwise(0.0) + same("doi", F.lower) + same("arxiv_id") + shared
    scored = kept.withColumn("score", score).where(F.col("score") >= least)
    return scored.withColumn("_n", F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("score"), "rank"))).where("_n = 1").select("ref", "rank", F.round("score", 6).alias("score"))


def accept_pdf(trusted: Column, confidence: Column, ratio: Column) -> Column:
    return trusted | (confidence >= 0.60) | ((confidence >= 0.50) & (ratio > 85))


def completeness(refs: DataFrame) -> DataFrame:
    """Filled fields. ``with_doi_or_arxiv`` counts a missing value as there, as text ``nan`` is;
    ``with_any_id`` is the corrected count."""
    has = lambda c: T.clean_str(F.col(c)).isNotNull()
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("nan"))) != ""
    n = F.count(F.lit(1))
    link = has("pdf_url") & (F.col("pdf_url").startswith("http://") | F.col("pdf_url").startswith("https://"))
    return refs.agg(
        n.alias("total"), F.count_if(has("doi")).alias("with_doi"), F.count_if(has("arxiv_id")).alias("with_arxiv_id"), F.count_if(has("title")).alias("with_title"),
        F.count("year").alias("with_year"), F.count_if(link).alias("with_pdf"), F.round(100 * F.count_if(has("doi")) / n, 6).alias("pct_doi"),
        F.count_if(text("doi") | text("arxiv_id")).alias("with_doi_or_arxiv"), F.count_if(has("doi") | has("arxiv_id")).alias("with_any_id"),
    )


def is_formula(x: Column, symbols: float = 0.2, digits: float = 0.1, least: int = 5) -> Column:
    """Line of a formula: a LaTeX mark, or many symbols and digits among enough words and operators. Captions of
    tables and figures are none, whatever they hold; null is none."""
    line = F.trim(F.coalesce(x, F.lit("")))
    n = F.greatest(F.length(F.regexp_replace(line, r"\s", "")), F.lit(1))
    s, d = F.regexp_count(line, F.lit(r"[=+\-*/^<>_~|()\[\]{}]")) / n, F.regexp_count(line, F.lit(r"\d")) / n
    tokens = F.regexp_count(line, F.lit(r"\\?[A-Za-z]+|[=+*/^<>_-]"))
    dense = ((s >= symbols) & (d >= digits)) | ((line.contains("=") | line.contains("/")) & (d >= digits) & (s >= 0.08))
    caption = line.rlike(TABLE_CAPTION) | line.rlike(FIGURE_CAPTION)
    return (F.length(line) >= 8) & ~caption & (line.rlike(LATEX) | ((tokens >= least) & dense))


def tei_records(rows: DataFrame) -> DataFrame:
    """Title, surnames, year, DOI and venue of TEI ``biblStruct`` elements (``id``, ``xml``)."""
    x = F.regexp_replace("xml", r'\sxmlns(:\w+)?="[^"]*"', "")
    year = F.regexp_extract(F.concat_ws(" ", F.xpath_string(x, F.lit("//date/@when")), F.xpath_string(x, F.lit("//date"))), r"((?:18|19|20)\d{2}|2100)", 1)
    return rows.select(
        "id", T.normalize_text(F.xpath_string(x, F.lit("//title"))).alias("title"), F.array_join(F.xpath(x, F.lit("//author//surname/text()")), "; ").alias("surnames"),
        year.try_cast("int").alias("year"), F.xpath_string(x, F.lit('//idno[@type="DOI"]')).alias("doi"), T.normalize_text(F.xpath_string(x, F.lit('//monogr/title[@level="j"]'))).alias("venue"),
    )


def page_of(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """``chunk``, ``page_start``, ``page_end``: pages (``doc``, ``page``, ``start``, ``stop``) that hold a chunk's
    first and last character; an equi-join on the document, the range inside it."""
    inside = (F.col("stop") > F.col("start_char")) & (F.col("start") < F.col("end_char"))
    return chunks.join(pages, "doc").where(inside).groupBy("chunk").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"))
