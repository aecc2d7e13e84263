"""Search of references through stages of sources, merging of all answers, and the workflow of both with a check of the PDF.

Sources and references are those of ``enrichment``. References that nothing answers stay, with null answers. An answer counts only with the link
that its stage needs. Of several answers of a stage the least ``source_id`` comes first, so ties and repeated records have one
result; empty tables and stages without a source's rows give no answers. No candidate is left out before it is checked.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import enrichment as E
from lexiloom.operators import pdfcheck
from lexiloom.operators.graph import written

_ANSWER = ["ref", "stage", "source", "key", "source_id", *E.FIELDS]


@dataclass(frozen=True)
class Stage:
    """A source asked by ``key`` (arxiv_id, doi or title). Its answers need a ``link``: pdf, direct (a PDF that isn't a DOI's
    address) or any (an article will do). With ``through``, answers that name an arXiv id become that source's record of it."""

    name: str
    source: DataFrame
    key: str
    link: str = "direct"
    through: DataFrame | None = None


def _usable(link: str) -> Column:
    pdf = T.clean_str(F.col("pdf_url")).isNotNull()
    if link == "any":
        return pdf | T.clean_str(F.col("article_url")).isNotNull()
    return pdf & ~F.col("pdf_url").startswith("https://doi.org/") if link == "direct" else pdf


def _by_id(refs: DataFrame, stage: Stage) -> DataFrame:
    return E.lookup(refs, stage.source, stage.key)


def _asked(refs: DataFrame) -> DataFrame:
    """``ref``, ``unit``, ``ask`` (its search words), ``forms`` (its titles and years); references that ask the same are one unit."""
    words = F.array_sort(E.title_words(F.col("title")))
    rows = refs.select("ref", E.title_of(F.col("title")).alias("title"), "year").where("ref is not null and title is not null").withColumn("ask", F.when(F.size(words) > 0, words))
    rows = rows.groupBy("ref").agg(F.min("ask").alias("ask"), F.sort_array(F.collect_set(F.struct("title", "year"))).alias("forms")).where("ask is not null")
    return rows.select("ref", F.md5(F.to_json(F.struct("ask", "forms"))).alias("unit"), "ask", "forms")


def _records(number: int, stage: Stage) -> DataFrame:
    """Usable answers that a stage by title can give: one a ``source_id``, with its ``c_title``, ``c_year`` and ``haves``, the lists of words that find it."""
    c = F.col
    rows = stage.source.where("source_id is not null").groupBy("source_id").agg(F.sort_array(F.collect_set(E.record_words(c("title")))).alias("haves"), F.min(F.struct(*E.FIELDS)).alias("_r"))
    rows = rows.select("source_id", "haves", c("_r.title").alias("c_title"), c("_r.year").alias("c_year"), "_r.*")
    if stage.through is not None:
        better = E.lookup(rows.select(c("arxiv_id").alias("ref"), "arxiv_id").distinct(), stage.through, "arxiv_id").select(c("ref").alias("_a"), F.struct(*E.FIELDS).alias("_b"))
        own = F.coalesce("arxiv_id", F.concat(F.lit("-"), "source_id"))  # records without an id, which find nothing, are dealt out
        rows = rows.join(better, own == c("_a"), "left").select("source_id", "haves", "c_title", "c_year", *[F.when(c("_b").isNotNull(), c(f"_b.{f}")).otherwise(c(f)).alias(f) for f in E.FIELDS])
    return rows.where(_usable(stage.link)).withColumns({"stage": F.lit(number), "source": F.lit(stage.name), "key": F.lit(stage.key)})


def _by_title(asked: DataFrame, stages: list[tuple[int, Stage]]) -> DataFrame:
    """Answers by title of all stages, by ``unit`` in place of ``ref``: titles are compared once for all stages, years and copies, so
    a title's rows grow with its copies and not with their square."""
    records = written(reduce(DataFrame.unionByName, [_records(i, s) for i, s in stages]))
    forms = asked.select("unit", "ask", "forms").dropDuplicates(["unit"]).select("unit", "ask", F.explode("forms").alias("f")).select("unit", "ask", "f.*")
    shapes = records.select("haves", "c_title").distinct().select(F.explode("haves").alias("have"), "haves", "c_title")
    pairs = E.word_pairs(asked, shapes).join(forms.select("ask", "title").distinct(), "ask").join(shapes, "have").select("ask", "title", "haves", "c_title").distinct()
    none = F.lit(None).cast("int")
    kept = written(E.valid_candidates(pairs.withColumns({"year": none, "c_year": none})).drop("year", "c_year"))
    near = F.coalesce(F.abs(F.col("_y") - F.col("c_year")) <= 2, F.lit(True))
    met = kept.join(forms.withColumnRenamed("year", "_y"), ["ask", "title"]).drop("title").join(records, ["haves", "c_title"]).where(near)
    return written(met.select("unit", *_ANSWER[1:]))


def _found(refs: DataFrame, stages: list[Stage], all_stages: bool = False) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """Answers by id; ``_asked`` and its answers by title. None where there are no such stages."""
    titles = [(i, s) for i, s in enumerate(stages) if s.key == "title"]
    parts = []
    for i, s in enumerate(stages):
        if s.key != "title":
            parts.append(_by_id(refs, s).where(_usable(s.link)).withColumns({"stage": F.lit(i), "source": F.lit(s.name), "key": F.lit(s.key)}).select(*_ANSWER))
    direct = reduce(DataFrame.unionByName, parts) if parts else None
    if not titles:
        return direct, None, None
    if direct is not None:
        direct = written(direct)
        refs = refs if all_stages else refs.join(direct.select("ref").distinct(), "ref", "left_anti")
    asked = written(_asked(refs))
    return direct, asked, _by_title(asked, titles)


def _by_ref(found, f) -> DataFrame:
    """``f`` (of rows and their key) of the answers by id, and that of a unit's answers by title for each of its references."""
    direct, asked, titled = found
    parts = [] if direct is None else [f(direct, "ref").withColumn("unit", F.lit(None).cast("string"))]
    if titled is not None:
        parts.append(asked.select("ref", "unit").join(f(titled, "unit"), "unit"))
    return reduce(DataFrame.unionByName, parts)


def answers(refs: DataFrame, stages: list[Stage], all_stages: bool = False) -> DataFrame:
    """``ref``, ``stage`` (its number), ``source``, ``key``, ``source_id`` and the record of every usable answer.

    Stages by id are equi-joins and are all asked. Titles are searched for the references that no id found only, as that is
    the dear part, or for all with ``all_stages``. Every answer of every reference grows with the square of equal titles; what
    needs the first ones only asks ``first_answers``.
    """
    return _by_ref(_found(refs, stages, all_stages), lambda rows, key: rows).select(*_ANSWER)


def first(found: DataFrame, key: str = "ref") -> DataFrame:
    """Of ``answers`` the first stage's with the least ``source_id``, one row a reference."""
    best = found.groupBy(key).agg(F.min(F.struct(*_ANSWER[1:])).alias("a"))
    return best.select(key, "a.*")


def first_answers(refs: DataFrame, stages: list[Stage]) -> DataFrame:
    """``first`` of ``answers``, taken before references with the same titles are told apart."""
    return _by_ref(_found(refs, stages), first).select(*_ANSWER)


def _folded(found: DataFrame, key: str) -> DataFrame:
    """A row a ``key``: for each field the first answer's value and source, ``_urls`` are all addresses by stage.

    Answers are folded in one aggregation that combines before its shuffle; only the addresses are gathered, whose number is that of a key's answers.
    """
    order = F.struct("stage", "source_id")
    value = {c: F.col(c) if c == "year" else F.nullif(T.collapse_space(T.clean_str(F.col(c))), F.lit("")) for c in E.FIELDS}
    best = [F.min_by(F.struct(v.alias("v"), F.col("source").alias("s")), F.when(v.isNotNull(), order)).alias(f"_{c}") for c, v in value.items()]
    links = F.collect_set(F.struct("stage", "source_id", F.array_compact(F.array(value["pdf_url"], value["article_url"])).alias("u"))).alias("_links")
    urls = F.array_distinct(F.flatten(F.transform(F.sort_array("_links"), lambda x: x["u"])))
    return found.groupBy(key).agg(*best, links).withColumn("_urls", urls).drop("_links")


def _filled(refs: DataFrame, folded: DataFrame) -> DataFrame:
    """``refs`` with their fields filled, ``origin`` and what else ``folded`` has."""
    own = {c: F.col(c) if c == "year" else T.clean_str(F.col(c)) for c in E.FIELDS}
    rows = refs.join(folded, "ref", "left")
    filled = {c: F.coalesce(own[c], F.col(f"_{c}.v")) for c in E.FIELDS}
    entries = [F.when(own[c].isNotNull(), F.struct(F.lit(c).alias("key"), F.lit("reference").alias("value"))).when(F.col(f"_{c}.v").isNotNull(), F.struct(F.lit(c).alias("key"), F.col(f"_{c}.s").alias("value"))) for c in E.FIELDS]
    rest = [c for c in refs.columns if c not in E.FIELDS and c != "ref"]
    more = [c for c in folded.columns if c != "ref" and c.removeprefix("_") not in E.FIELDS]
    return rows.select("ref", *[v.alias(c) for c, v in filled.items()], *rest, F.map_from_entries(F.array_compact(F.array(*entries))).alias("origin"), *more)


def _others(pdf: str) -> Column:
    """Addresses other than the reference's own."""
    return F.filter(F.coalesce("_urls", F.array().cast("array<string>")), lambda u: ~F.coalesce(u == F.col(pdf), F.lit(False)) & ~F.coalesce(u == F.col("article_url"), F.lit(False)))


def merged(refs: DataFrame, found: DataFrame) -> DataFrame:
    """``refs`` with every field of ``enrichment.FIELDS`` from the reference itself, else from the first answer, by stage, that has it;
    ``origin`` maps each filled field to ``reference`` or the source, ``more_urls`` are the answers' other addresses by stage."""
    return _filled(refs, _folded(found, "ref")).withColumn("more_urls", _others("pdf_url")).drop("_urls")


def resolved(refs: DataFrame, stages: list[Stage], arxiv: DataFrame, registry: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """The workflow: ids from all fields, all answers merged, PDFs gathered and the best one checked last.

    ``arxiv`` and ``registry`` tell the titles of arXiv ids and DOIs; ``pages`` (``pdf_url``, ``text``: the text of first pages) is what
    PDFs themselves say. ``found_by`` is the key of the first answer.
    """
    raw = F.col("raw_text") if "raw_text" in refs.columns else F.lit(None).cast("string")
    c = F.col
    keyed = written(refs.withColumns({"arxiv_id": E.arxiv_of(c("doi"), c("article_url"), c("pdf_url"), raw, c("arxiv_id")), "doi": E.doi_of(c("doi"), c("article_url"), raw)}))
    found = direct, asked, titled = _found(keyed, stages)
    slim = lambda rows, key: _folded(rows, key).withColumn("_urls", F.col("_urls") if key == "ref" else F.lit(None).cast("array<string>"))
    whole = written(_filled(keyed, _by_ref(found, slim)))
    how = F.when(c("key") == "title", "title").when(c("key") == "doi", "doi").otherwise("own_arxiv")
    offered = keyed.select("ref", "pdf_url", F.lit("page").alias("how"))
    if direct is not None:
        offered = offered.unionByName(direct.select("ref", "pdf_url", how.alias("how")))
    if titled is not None:  # the best of a unit's PDFs is the best of any of its references
        rows = titled.select(c("unit").alias("ref"), "pdf_url", F.lit("title").alias("how"), "arxiv_id")
        best = E.best_pdf(E.pdf_candidates(rows.where("false"), rows)).select(c("ref").alias("unit"), "pdf_url", F.lit("title").alias("how"))
        offered = offered.unionByName(asked.select("ref", "unit").join(best, "unit").drop("unit"))
    pdf = E.best_pdf(E.pdf_candidates(whole, offered))
    by = _by_ref(found, first).select("ref", c("key").alias("found_by"))
    rows = written(whole.withColumnRenamed("pdf_url", "_pdf").join(pdf, "ref", "left").join(by, "ref", "left"))
    own = F.nullif(F.regexp_extract(F.lower(F.coalesce("pdf_url", F.lit(""))), r"arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,})", 1), F.lit(""))
    told = E.lookup(rows.select("ref", own.alias("arxiv_id")), arxiv, "arxiv_id").select("ref", F.col("title").alias("arxiv_title"))
    said = E.lookup(rows.select("ref", "doi"), registry, "doi").select("ref", F.col("title").alias("doi_title"))
    rows = rows.join(told, "ref", "left").join(said, "ref", "left")
    if pages is None:
        rows = rows.withColumns({k: F.lit(None).cast("string") for k in ("found_title", "found_doi", "found_arxiv")})
    else:
        facts = pages.where("pdf_url is not null").groupBy("pdf_url").agg(F.min("text").alias("_t")).withColumns(pdfcheck.first_page_facts(F.col("_t"))).drop("_t")
        rows = rows.join(facts, "pdf_url", "left")
    rows = written(pdfcheck.judged(rows))  # long chains of patterns on either side
    if titled is not None:  # lists of addresses come last, as each reference of a unit has all of them
        rows = rows.where("unit is null").unionByName(rows.where("unit is not null").drop("_urls").join(_folded(titled, "unit").select("unit", "_urls"), "unit"))
    done = pdfcheck.settled(rows.withColumn("more_urls", _others("_pdf")))
    article = F.coalesce("article_url", F.nullif(E.X.article_url(F.col("pdf_url")), F.lit("")))
    return done.withColumn("article_url", article).drop("arxiv_title", "doi_title", "found_title", "found_doi", "found_arxiv", "unit", "_urls", "_pdf")
