"""Whether a PDF is the work that a reference asks for, from fields that are already extracted.

Rows have what is expected (``title``, ``doi``, ``arxiv_id``), the address ``pdf_url`` and what is known of it: ``arxiv_title`` (title
under the address's arXiv id), ``doi_title`` (title under the expected DOI), ``found_title``, ``found_doi``, ``found_arxiv`` (from its first pages).
Any of them may be null or blank, which decides nothing; repeated rows are judged each; further columns are carried on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import extract as X
from lexiloom.functions import similarity as S
from lexiloom.functions import text as T
from lexiloom.operators import enrichment as E
from lexiloom.operators import references as R

#: Words of lines that are no part of a title, at its beginning and further on.
NO_TITLE = "(?i)abstract|keywords|introduction|author|received|accepted"
NO_MORE = "(?i)abstract|keywords|author|introduction"
NO_SENTENCE = "(?i)abstract|keywords|author|received"
#: Hosts of proceedings, and finders, whose PDFs are kept unseen.
PROCEEDINGS = ("aaai.org", "ojs.aaai.org", "openreview.net", "proceedings.mlr.press", "dl.acm.org", "hal.science")
FINDERS = ("openalex", "semanticscholar", "semantic_scholar", "crossref", "unpaywall")
#: Addresses that a registry answers for.
REGISTRIES = ("doi.org", "crossref.org", "dx.doi.org")


def plain_title(x: Column) -> Column:
    """A title in lower case, plain letters, with a blank for every mark."""
    return T.collapse_space(F.regexp_replace(R.unaccent(F.lower(F.trim(x))), r"(?U)[^\w\s]", " "))


def first_page_title(text: Column, most_lines: int = 30) -> Column:
    """Title in the text of a PDF's first pages; null if there is none.

    The first of the lines that, joined with up to two lines that go on, has 20 to 300 characters; else a single line of
    15 to 250, one of 20 to 200 within the first ten lines before others. Lines of other parts (abstract, authors, dates) are no titles.
    """
    lines = F.transform(F.slice(F.split(text, "\n", -1), 1, most_lines), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.get(F.transform(F.array(lines), _title), F.lit(0))  # binds the lines, so that a text is split once


def _title(lines: Column) -> Column:
    more = lambda x: F.length(x).between(10, 150) & ~x.rlike(NO_MORE)

    def joined(line: Column, i: Column) -> Column:
        second, third = F.get(lines, i + 1), F.get(lines, i + 2)
        whole = F.concat_ws(" ", line, F.when(more(second), second), F.when(more(second) & more(third), third))
        return F.when(F.length(line).between(10, 250) & ~line.rlike(NO_TITLE) & F.length(whole).between(20, 300), whole)

    def single(line: Column, i: Column) -> Column:
        able = F.length(line).between(15, 250) & ~line.rlike(NO_TITLE)
        return F.when(able, F.struct((~((i < 10) & F.length(line).between(20, 200))).cast("int").alias("later"), i.alias("i"), line.alias("line")))

    first = F.get(F.array_compact(F.transform(lines, joined)), F.lit(0))
    alone = F.array_min(F.array_compact(F.transform(lines, single)))["line"]
    return F.nullif(T.collapse_space(F.coalesce(first, alone)), F.lit(""))


def first_page_facts(text: Column) -> dict[str, Column]:
    """``found_title``, ``found_doi`` and ``found_arxiv`` of the text of a PDF's first pages; null where it shows none. Without a line for
    a title its first sentence of 20 to 200 characters within 1000 is one."""
    plain = T.normalize_text(R.unaccent(F.lower(text)))
    some = lambda c: F.nullif(c, F.lit(""))
    sentences = F.transform(F.split(F.left(plain, F.lit(1000)), r"[.!?]\s+"), lambda s: F.trim(s))
    sentence = F.get(F.filter(sentences, lambda s: F.length(s).between(20, 200) & ~s.rlike(NO_SENTENCE)), F.lit(0))
    return {
        "found_title": F.coalesce(first_page_title(text), sentence),
        "found_doi": some(F.regexp_extract(plain, r"(?:doi[:\s]+|doi\.org/)(10\.\d{4,}/[^\s\)]+)", 1)),
        "found_arxiv": some(F.regexp_extract(plain, r"arxiv[:\s]+(\d{4}\.\d{4,})", 1)),
    }


def likeness(expected: Column, found: Column) -> Column:
    """0 to 1: ratio of plain titles over 50 characters, partial ratio of shorter ones, less 0.15 where lengths differ by more than 0.3;
    null where either is blank."""
    a, b = F.nullif(plain_title(expected), F.lit("")), F.nullif(plain_title(found), F.lit(""))
    apart = F.abs(F.length(a) - F.length(b)) / F.greatest(F.length(a), F.length(b)) > 0.3
    ratio = F.when(a == b, 100.0).otherwise(S.title_column(F.when(a != b, a), F.when(a != b, b)))
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0.0), ratio / 100 - F.when(apart, 0.15).otherwise(0.0)))


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` with ``confidence`` (0 where nothing speaks for the PDF) and ``judged_by``: arxiv, registry or content, the first that
    accepts it, else null. Another DOI or arXiv id on its pages than the expected one speaks against it."""
    c, url = F.col, F.lower(F.coalesce("pdf_url", F.lit("")))
    some = lambda x: T.clean_str(F.col(x))
    doi, arxiv = F.lower(some("doi")), some("arxiv_id")
    own = F.nullif(F.regexp_extract(url, r"arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,})", 1), F.lit(""))
    listed = lambda names: reduce(lambda a, b: a | b, [url.contains(d) for d in names])
    known = {
        "_r1": likeness(some("title"), F.when(own == arxiv, some("arxiv_title"))),
        "_r2": likeness(some("title"), F.when(X.is_doi(doi) & (url.contains(doi) | listed(REGISTRIES)), some("doi_title"))),
        "_r3": likeness(some("title"), some("found_title")),
    }
    least = F.when(E.trusted(url), 0.80).otherwise(0.85)

    def told(score: Column, want: Column, have: Column) -> Column:
        return F.when(want == have, F.least(F.lit(1.0), score + 0.1)).when(want != have, 0.0).otherwise(score)

    content = F.when(c("_r3") >= least, c("_r3")).otherwise(0.0)
    content = told(told(content, doi, F.lower(some("found_doi"))), arxiv, some("found_arxiv"))
    parts = {
        "arxiv": F.when(c("_r1") >= 0.75, 0.85 + (c("_r1") - 0.75) * 0.15),
        "registry": F.when(c("_r2") >= 0.85, 0.9 + (c("_r2") - 0.85) * 0.1),
        "content": F.when(content >= least, content),
    }
    there = url != ""
    by = F.coalesce(*[F.when(there & v.isNotNull(), F.lit(k)) for k, v in parts.items()])
    value = F.when(there, F.coalesce(*parts.values(), F.lit(0.0))).otherwise(0.0)
    return rows.withColumns(known).withColumns({"confidence": value, "judged_by": by}).drop(*known)


def settled(rows: DataFrame) -> DataFrame:
    """``judged`` rows with the decision: a PDF that was recognised stays and is ``validated``; one from a trusted host or finder
    (``finder``, if there is such a column) stays unvalidated; others go. What isn't validated is kept in ``more_urls``. Without a PDF ``validated``
    is false where other addresses are known, else null."""
    url = T.clean_str(F.col("pdf_url"))
    low = F.lower(url)
    finder = F.coalesce(F.col("finder").isin(*FINDERS), F.lit(False)) if "finder" in rows.columns else F.lit(False)
    trusted = E.trusted(low) | reduce(lambda a, b: a | b, [low.contains(d) for d in PROCEEDINGS]) | finder
    known = F.col("judged_by").isNotNull()
    stays = known | R.accept_pdf(trusted, F.col("confidence"), F.lit(0.0))
    none = F.array().cast("array<string>")
    old = F.coalesce(F.col("more_urls"), none) if "more_urls" in rows.columns else none
    more = F.when(url.isNull() | known, old).otherwise(E.merged_urls(old, F.array(url)))
    return rows.withColumns(
        {"pdf_url": F.when(stays, url), "more_urls": more, "validated": F.when(url.isNotNull() & known, True).when(F.size(more) > 0, False)}
    )
