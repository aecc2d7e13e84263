"""Identifiers and links in text, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first(x: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(x, pattern, group)
    return F.when(found != "", found)


def doi(x: Column) -> Column:
    """First DOI behind a doi.org link or the word doi, in lower case, without closing marks."""
    return F.lower(F.regexp_replace(_first(x, r"(?i)(?:doi\.org/|doi[:\s]+)(10\.\d{4,}/[^\s)]+)"), r"[.,;)]+$", ""))


def is_doi(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)).rlike(r"^10\.\d{4,}/.+"), F.lit(False))


def arxiv_id(x: Column) -> Column:
    """First arXiv id behind the word arxiv or in an arxiv.org link."""
    return _first(x, r"(?i)(?:arxiv[:\s]+|arxiv\.org/(?:abs|pdf)/)(\d{4}\.\d{4,})")


def arxiv_id_in_doi(x: Column) -> Column:
    """The rule of TEI files, which also reads DOIs of arXiv."""
    return _first(x, r"(?i)arxiv\.(\d{4}\.\d{4,})")


def urls(x: Column) -> Column:
    flat = F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")
    found = F.regexp_extract_all(flat, F.lit(r"(?i)https?://[^\s)\]]+"), F.lit(0))
    bare = F.transform(found, lambda u: F.regexp_replace(u, r"[.,;)]+$", ""))
    return F.filter(bare, lambda u: u.startswith("http://") | u.startswith("https://"))


def article_url(pdf: Column) -> Column:
    """The page of a publication from the address of its PDF; empty if unknown."""
    u = F.trim(F.coalesce(pdf, F.lit("")))
    low = F.lower(u)
    arxiv = F.regexp_extract(u, r"(?i)arxiv\.org/pdf/(\d{4}\.\d{4,})", 1)
    ieee = F.regexp_extract(u, r"arnumber=(\d+)", 1)
    return (
        F.when(low.contains("arxiv.org/pdf") & (arxiv != ""), F.concat(F.lit("https://arxiv.org/abs/"), arxiv))
        .when(low.contains("ieee") & (ieee != ""), F.concat(F.lit("https://ieeexplore.ieee.org/document/"), ieee))
        .when(low.contains("acm.org") & u.contains("/pdf/"), F.replace(u, F.lit("/pdf/"), F.lit("/")))
        .when(u.endswith(".pdf"), F.substring(u, F.lit(1), F.length(u) - 4))
        .otherwise(F.lit(""))
    )


def first_pdf(links: Column) -> Column:
    """First link of an array that leads to a PDF."""
    ok = lambda u: (F.lower(u).contains("/pdf") | F.split(F.lower(u), r"\?")[0].contains(".pdf")) & ~F.lower(u).contains("localhost") & ~F.lower(u).contains("/nan")
    return F.coalesce(F.get(F.filter(F.transform(links, lambda u: F.trim(u)), ok), F.lit(0)), F.lit(""))


def pdf_source(url: Column) -> Column:
    """``arxiv``, ``direct``, ``openreview`` or null."""
    low = F.lower(url)
    return (
        F.when(low.rlike(r"arxiv\.org/(abs|pdf)/\d+\.\d+"), "arxiv")
        .when(low.endswith(".pdf") | low.contains(".pdf?") | low.contains(".pdf#"), "direct")
        .when(low.contains("openreview.net") & low.contains("?id="), "openreview")
    )


def markdown_links(x: Column) -> Column:
    """Links of double brackets, then of single ones, then bare ones; each place counts once and
    each link is given once, in that order."""
    double, single, bare = r"\[\[[^\]]+\]\]\(([^)]+)\)", r"(?<!!)\[[^\]]+\]\(([^)]+)\)", r"https?://[^\s)\]>]+"
    rest1 = F.regexp_replace(x, double, "\u0001")
    rest2 = F.regexp_replace(rest1, single, "\u0001")
    named = F.concat(F.regexp_extract_all(x, F.lit(double), F.lit(1)), F.regexp_extract_all(rest1, F.lit(single), F.lit(1)))
    named = F.filter(F.transform(named, lambda u: F.trim(u)), lambda u: (u != "") & ~u.startswith("#"))
    loose = F.transform(F.regexp_extract_all(rest2, F.lit(bare), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))
    return F.array_distinct(F.concat(named, loose))


def ref_id(arxiv: Column, doi_: Column, title: Column, raw: Column) -> Column:
    """Stable id: arXiv id, else slug of the DOI, else slug and hash of the title, else a hash."""
    slugged = lambda c: F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    titled = F.concat_ws("-", F.rtrim(F.left(slugged(F.lower(some(title))), F.lit(50)), F.lit("-")), F.left(F.sha2(some(title), 256), F.lit(8)))
    return F.coalesce(some(arxiv), slugged(some(doi_)), F.when(some(title).isNotNull(), titled), F.concat(F.lit("ref-"), F.left(F.sha2(F.coalesce(raw, F.lit("")), 256), F.lit(12))))


def meta_tag(html: Column, name: str) -> Column:
    return _first(html, rf'(?i)<meta[^>]+name="{name}"[^>]+content="([^"]*)"')


def page_title(html: Column) -> Column:
    return _first(html, r"(?is)<title>(.*?)</title>")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1))
