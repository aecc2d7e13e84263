"""Resolution of references against landed source tables, field by field.

A source is a table of records (``source_id``, ``title``, ``year``, ``authors``, ``doi``, ``arxiv_id``,
``article_url``, ``pdf_url``) that stands for a service's answers; nothing here reaches the network. References
have ``ref`` and the same fields. Everywhere: missing is null, blank or the words nan, none, null; null
keys match nothing; of several records under one key the least ``source_id`` is taken, so ties and
repeated rows have one result; empty tables give no matches; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import extract as X
from lexiloom.functions import similarity as S
from lexiloom.functions import text as T
from lexiloom.operators import references as R
from lexiloom.operators.graph import cut_lineage, written

FIELDS = ("title", "year", "authors", "doi", "arxiv_id", "article_url", "pdf_url")
#: Domains whose papers are trusted, and those that searches leave out.
TRUSTED = (
    "arxiv.org", "ieee.org", "acm.org", "springer.com", "springerlink.com", "elsevier.com", "sciencedirect.com", "nature.com", "science.org", "cell.com",
    "pubmed.ncbi.nlm.nih.gov", "pmc.ncbi.nlm.nih.gov", "biorxiv.org", "medrxiv.org", "openreview.net",
)
BLOCKED = ("youtube.com", "facebook.com", "twitter.com", "linkedin.com", "pinterest.com", "amazon.com", "ebay.com", "reddit.com", "wikipedia.org")
#: Confidence of a PDF by how it was found.
CONFIDENCE = {"own_arxiv": 1.0, "unpaywall_doi": 0.95, "doi": 0.9, "scholar_doi": 0.85, "page": 0.85, "scholar_title": 0.75, "title": 0.7}


def _any(url: Column, domains: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    return reduce(lambda a, b: a | b, [low.contains(d) for d in domains])


def trusted(url: Column) -> Column:
    return _any(url, TRUSTED)


def blocked(url: Column) -> Column:
    return _any(url, BLOCKED)


def names_pdf(url: Column) -> Column:
    """An address that counts as a PDF by its form: the ending, or ``.pdf`` in its last part."""
    low = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    return low.endswith(".pdf") | F.substring_index(F.element_at(F.split(low, "/"), -1), "?", 1).contains(".pdf")


def valid_arxiv(x: Column) -> Column:
    """An arXiv id without its version; null if it isn't one."""
    bare = F.substring_index(x, "v", 1)
    return F.when(bare.rlike(r"^\d{4}\.\d{4,6}$"), bare)


def arxiv_of(doi: Column, article: Column, pdf: Column, raw: Column, own: Column) -> Column:
    """The first valid arXiv id: of a DOI that names arXiv, of the article's and PDF's address, of the raw
    text, of the field itself."""
    fields = F.array(F.when(F.lower(doi).contains("arxiv"), doi), article, pdf, raw)
    found = F.transform(fields, lambda f: valid_arxiv(X.arxiv_id(T.clean_str(f))))
    return F.coalesce(F.get(F.array_compact(found), F.lit(0)), valid_arxiv(T.clean_str(own)))


def doi_of(own: Column, article: Column, raw: Column) -> Column:
    """The field's DOI without its address, else the first in the article's address, else in the raw text."""
    bare = F.trim(F.replace(F.replace(T.clean_str(own), F.lit("https://doi.org/"), F.lit("")), F.lit("http://doi.org/"), F.lit("")))
    return F.coalesce(F.when(bare.startswith("10."), bare), X.doi(T.clean_str(article)), X.doi(T.clean_str(raw)))


def title_of(title: Column) -> Column:
    """A title of ten characters or more."""
    t = T.clean_str(title)
    return F.when(F.length(t) >= 10, t)


def article_url(raw: Column) -> Column:
    """First address in a text that isn't a PDF's; empty if there is none."""
    pdf = lambda u: F.lower(u).endswith(".pdf") | F.lower(u).contains("/pdf/") | F.lower(u).endswith("/pdf") | F.lower(u).contains("filetype=pdf")
    return F.coalesce(F.get(F.filter(X.urls(raw), lambda u: ~pdf(u)), F.lit(0)), F.lit(""))


def pdf_in_list(links: Column) -> Column:
    """First full address of a list (or its JSON) that ends in ``.pdf`` or has ``/pdf`` before a question mark."""
    ok = lambda u: u.rlike("^https?://") & (F.lower(u).endswith(".pdf") | F.substring_index(F.lower(u), "?", 1).contains("/pdf"))
    return F.coalesce(F.get(F.filter(F.transform(links, lambda u: F.trim(u)), ok), F.lit(0)), F.lit(""))


def url_list(value: Column) -> Column:
    """Addresses of a JSON list, else of a text split at ``;``, ``,`` or blanks; null gives none."""
    parsed = F.from_json(value, "array<string>")
    split = F.filter(F.split(F.coalesce(value, F.lit("")), r"[;,\s]+"), lambda u: F.trim(u) != "")
    return F.when(F.trim(value).startswith("[") & parsed.isNotNull(), parsed).otherwise(split)


def merged_urls(a: Column, b: Column) -> Column:
    """Union in order of first appearance; blanks left out."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(F.coalesce(a, none), F.coalesce(b, none)), lambda u: F.trim(u) != ""))


def year_of(value: Column) -> Column:
    """A whole number, else the first four characters as one."""
    return F.coalesce(value.try_cast("int"), F.left(value.cast("string"), F.lit(4)).try_cast("int"))


def author_list(value: Column) -> Column:
    """Authors of a list literal in brackets, else split at the first of ``;``, ``|`` and ``,`` that occurs."""
    v = T.clean_str(value)
    parts = lambda sep: F.filter(F.transform(F.split(v, sep), lambda a: F.trim(a)), lambda a: a != "")
    listed = F.transform(F.regexp_extract_all(v, F.lit(r"""'([^']*)'|"([^"]*)\""""), F.lit(0)), lambda a: F.trim(F.substring(a, F.lit(2), F.length(a) - 2)))
    some = F.filter(listed, lambda a: a != "")
    none = F.array().cast("array<string>")
    return (
        F.when(v.isNull() | (v == "[]"), none)
        .when(v.startswith("[") & v.endswith("]"), some)
        .when(v.contains(";"), parts(";"))
        .when(v.contains("|"), parts(r"\|"))
        .when(v.contains(","), parts(","))
        .otherwise(F.array(v))
    )


def lookup(refs: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """``ref`` and the source's record with the same ``doi`` (in lower case) or ``arxiv_id``."""
    clean = F.lower(T.clean_str(F.col(key))) if key == "doi" else valid_arxiv(T.clean_str(F.col(key)))
    known = source.withColumn("_k", clean).where("_k is not null").groupBy("_k").agg(F.min_by(F.struct("source_id", *FIELDS), "source_id").alias("r"))
    return refs.select("ref", clean.alias("_k")).join(known, "_k").select("ref", "r.*")


def title_words(title: Column, most: int = 6) -> Column:
    """The words that a title search asks for: the first six of three or more letters, digits and hyphens."""
    return F.array_distinct(F.slice(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(r"[a-z0-9\-]{3,}"), F.lit(0)), 1, most))


def _lists(rows: DataFrame, keys: list[str], value: str, most: int = 1000) -> DataFrame:
    """``keys`` and lists of at most ``most`` values, as many rows as it takes."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    return rows.withColumn("_n", F.floor((place - 1) / most)).groupBy(*keys, "_n").agg(F.collect_list(value).alias(f"_{value}")).drop("_n")


def expanded(pairs: DataFrame, refs: DataFrame, source: DataFrame, most_years: int | None = None) -> DataFrame:
    """``ref``, ``source_id`` of all members of the pairs (``ask``, ``have``) of titles; ``refs`` has ``ref``, ``ask``, ``source`` has ``source_id``, ``have``.

    Members travel in lists, which are dealt anew before they are taken apart, so that titles which many rows share land in
    no single task. With ``most_years``, ``year`` and ``c_year`` must not lie further apart; a missing one fits all.
    """
    years = ([], []) if most_years is None else (["year"], ["c_year"])
    met = pairs.join(_lists(refs, ["ask", *years[0]], "ref"), "ask").join(_lists(source, ["have", *years[1]], "source_id"), "have")
    if most_years is not None:
        met = met.where(F.coalesce(F.abs(F.col("year") - F.col("c_year")) <= most_years, F.lit(True)))
    dealt = met.select("_ref", "_source_id").repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.select(F.explode("_ref").alias("ref"), "_source_id").select("ref", F.explode("_source_id").alias("source_id"))


def record_words(title: Column) -> Column:
    """All the words of a record's title that a search can ask for, each once, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(r"[a-z0-9\-]{3,}"), F.lit(0))))


def word_pairs(asked: DataFrame, records: DataFrame) -> DataFrame:
    """``ask``, ``have`` of the distinct lists of words where the second has all of the first.

    The rarest of the words finds the candidates by an equi-join; the others are checked on them.
    """
    posted = records.select("have").distinct().select("have", F.explode("have").alias("w"))
    counts = posted.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    rare = asked.select("ask").distinct().select("ask", F.explode("ask").alias("w")).join(counts, "w").groupBy("ask").agg(F.min_by("w", F.struct("n", "w")).alias("w"), F.count(F.lit(1)).alias("known"))
    return rare.where(F.col("known") == F.size("ask")).join(posted, "w").where(F.size(F.array_except("ask", "have")) == 0).select("ask", "have")


def title_search(refs: DataFrame, source: DataFrame, most: int | None = None) -> DataFrame:
    """``ref``, ``source_id`` of the records whose titles have all of the reference's search words; with ``most``, the first of them by ``source_id``.

    Titles of the same words are compared once.
    """
    records = cut_lineage(source.select("source_id", record_words(F.col("title")).alias("have")))
    asked = cut_lineage(refs.select("ref", F.array_sort(title_words(F.col("title"))).alias("ask")).where("size(ask) > 0").groupBy("ref").agg(F.min("ask").alias("ask")))
    pairs = word_pairs(asked, records)
    if most is None:
        return expanded(pairs, asked, records)
    first = lambda key: F.row_number().over(Window.partitionBy(key).orderBy("source_id")) <= most
    least = lambda rows, key: rows.withColumn("_f", first(key)).where("_f").drop("_f")
    return asked.join(least(pairs.join(least(records, "have"), "have"), "ask"), "ask").select("ref", "source_id")


def valid_candidates(pairs: DataFrame, strict: bool = True, most_years: int = 2) -> DataFrame:
    """The pairs (``title``, ``year`` and ``c_title``, ``c_year``) that can be the same work: titles strictly alike,
    or softly (similarity of 0.85, lengths within 0.3), and no more than two years apart. Authors don't
    decide, since lists of them are often incomplete."""
    a, b = R.normal_title(T.clean_str(F.col("title"))), R.normal_title(T.clean_str(F.col("c_title")))
    near = F.coalesce(F.abs(F.col("year") - F.col("c_year")) <= most_years, F.lit(True))
    rows = pairs.where(near).withColumns({"_a": a, "_b": b}).where("_a <> '' and _b <> ''")
    x, y = F.col("_a"), F.col("_b")
    if strict:
        kept = rows.where(R.strict_title_match(x, y))
    else:
        length = F.abs(F.length(x) - F.length(y)) / F.greatest(F.length(x), F.lit(1)) <= 0.3
        kept = rows.where(length).where(S.indel_column(x, y) / 100 >= 0.85)
    return kept.drop("_a", "_b")


def by_priority(refs: DataFrame, sources: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """``ref``, ``source`` and the record of the first source that answers, in the order given."""
    parts = [lookup(refs, s, key).withColumns({"_p": F.lit(i), "source": F.lit(name)}) for i, (name, s) in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("ref").orderBy("_p"))).where("_n = 1").drop("_n", "_p")


def all_candidates(refs: DataFrame, sources: list[tuple[str, DataFrame]], most: int = 3) -> DataFrame:
    """``ref``, ``source``, ``source_id``: title hits of all sources, ``most`` from each, without records
    whose DOI, or lacking one arXiv id, an earlier source gave."""
    parts = []
    for i, (name, s) in enumerate(sources):
        hits = title_search(refs, s, most).join(s.select("source_id", "doi", "arxiv_id"), "source_id")
        place = F.row_number().over(Window.partitionBy("ref").orderBy("source_id"))
        parts.append(hits.withColumn("_n", place).where(F.col("_n") <= most).withColumns({"_p": F.lit(i), "source": F.lit(name)}))
    doi, arxiv = F.lower(T.clean_str(F.col("doi"))), T.clean_str(F.col("arxiv_id"))
    name = F.coalesce(F.concat(F.lit("doi:"), doi), F.concat(F.lit("arxiv:"), arxiv))
    rows = reduce(DataFrame.unionByName, parts).withColumn("_id", name)
    first = F.row_number().over(Window.partitionBy("ref", F.coalesce("_id", F.concat_ws(":", "source", "source_id"))).orderBy("_p", "_n"))
    return rows.withColumn("_f", first).where("_f = 1").select("ref", "source", "source_id")


def filled(base: DataFrame, more: DataFrame, key: str = "ref") -> DataFrame:
    """``base`` with what it lacks from ``more``: a field that has a value keeps it; blanks lack one."""
    m = more.select(key, *[F.col(c).alias(f"_m_{c}") for c in FIELDS])
    text = lambda c: F.coalesce(T.clean_str(F.col(c)), F.nullif(T.collapse_space(T.clean_str(F.col(f"_m_{c}"))), F.lit("")))
    value = {c: text(c) for c in FIELDS if c != "year"} | {"year": F.coalesce("year", year_of(F.col("_m_year").cast("string")))}
    rest = [c for c in base.columns if c != key and c not in FIELDS]
    return base.join(m, key, "left").select(key, *[value[c].alias(c) for c in FIELDS], *rest)


def pdf_candidates(refs: DataFrame, found: DataFrame) -> DataFrame:
    """``ref``, ``url``, ``how``, ``confidence``: the reference's own arXiv paper, and PDFs of matched records
    (``ref``, ``how``, ``pdf_url``), best first in ``place``. An address counts once, whatever its query and case."""
    own = refs.select("ref", valid_arxiv(T.clean_str(F.col("arxiv_id"))).alias("a")).where("a is not null")
    own = own.select("ref", F.concat(F.lit("https://arxiv.org/pdf/"), "a", F.lit(".pdf")).alias("url"), F.lit("own_arxiv").alias("how"))
    rows = own.unionByName(found.where(T.clean_str(F.col("pdf_url")).isNotNull()).select("ref", F.trim("pdf_url").alias("url"), "how")).where(~blocked(F.col("url")))
    how = F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))])
    scored = rows.withColumn("confidence", F.coalesce(how[F.col("how")], F.lit(0.5)))
    key = F.lower(F.substring_index("url", "?", 1))
    once = scored.withColumn("_n", F.row_number().over(Window.partitionBy("ref", key).orderBy(F.desc("confidence"), "url", "how"))).where("_n = 1").drop("_n")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("confidence"), "url")))


def best_pdf(candidates: DataFrame) -> DataFrame:
    """``ref``, ``pdf_url``: the first candidate that isn't a DOI's address, else the first."""
    plain = ~F.lower(F.col("url")).rlike("^https?://(dx\\.)?doi\\.org/")
    return candidates.groupBy("ref").agg(F.min_by("url", F.struct((~plain).cast("int"), "place")).alias("pdf_url"))


def with_cache(refs: DataFrame, cache: DataFrame, ask) -> tuple[DataFrame, DataFrame]:
    """Answers of ``ask`` (a function of the references that aren't in the cache, giving ``ref`` and ``answer``), the
    cached ones before them, and the cache with the new ones. A null answer is cached too. What was asked is written down, so
    that reading both results asks once."""
    known = cache.groupBy("ref").agg(F.max_by("answer", "answer").alias("answer"))
    fresh = written(ask(refs.join(known, "ref", "left_anti")).select("ref", "answer"))
    return refs.select("ref").join(known, "ref").unionByName(fresh), known.unionByName(fresh)


class Registry:
    """Named source tables in order, which can be switched off."""

    def __init__(self):
        self._sources: dict[str, tuple[DataFrame, bool]] = {}

    def register(self, name: str, source: DataFrame, enabled: bool = True) -> None:
        self._sources[name] = (source, enabled)

    def enable(self, name: str, on: bool = True) -> None:
        self._sources[name] = (self._sources[name][0], on)

    def names(self) -> list[str]:
        return list(self._sources)

    def enabled(self) -> list[tuple[str, DataFrame]]:
        return [(k, s) for k, (s, on) in self._sources.items() if on]


def enrich(refs: DataFrame, registry: Registry) -> DataFrame:
    """The workflow's steps in order: ids from all fields, records by DOI, by arXiv id, by title (validated,
    where the others found nothing), fields filled, PDFs gathered and the best one taken.

    ``refs`` with filled fields, ``found_by`` (doi, arxiv_id, title, or null) and ``source``.
    """
    raw = F.col("raw_text") if "raw_text" in refs.columns else F.lit(None).cast("string")
    keyed = refs.withColumns(
        {
            "arxiv_id": arxiv_of(F.col("doi"), F.col("article_url"), F.col("pdf_url"), raw, F.col("arxiv_id")),
            "doi": doi_of(F.col("doi"), F.col("article_url"), raw),
        }
    )
    keyed = cut_lineage(keyed)  # many later steps read the ids, which take long chains of patterns
    sources = registry.enabled()
    hits = [by_priority(keyed, sources, k).withColumns({"found_by": F.lit(k), "_s": F.lit(i)}) for i, k in enumerate(("doi", "arxiv_id"))]
    direct = hits[0].unionByName(hits[1])
    left = keyed.join(direct.select("ref").distinct(), "ref", "left_anti").withColumn("title", title_of(F.col("title"))).where("title is not null")
    asked = all_candidates(left, sources)
    records = reduce(DataFrame.unionByName, [s.select("source_id", *FIELDS).withColumn("source", F.lit(n)) for n, s in sources])
    pairs = asked.join(records.withColumnsRenamed({c: f"c_{c}" for c in FIELDS}), ["source", "source_id"]).join(left.select("ref", "title", "year"), "ref")
    order = F.array_position(F.array(*[F.lit(n) for n, _ in sources]), F.col("source"))
    place = F.row_number().over(Window.partitionBy("ref").orderBy(order, "source_id"))
    named = valid_candidates(pairs).withColumn("_n", place).where("_n = 1")
    titled = named.select("ref", "source_id", *[F.col(f"c_{c}").alias(c) for c in FIELDS], "source", F.lit("title").alias("found_by"), F.lit(2).alias("_s"))
    best = direct.unionByName(titled).withColumn("_n", F.row_number().over(Window.partitionBy("ref").orderBy("_s"))).where("_n = 1")
    best = cut_lineage(best.drop("_n"))
    whole = filled(keyed, best).join(best.select("ref", "found_by", "source"), "ref", "left")
    how = F.when(F.col("found_by") == "title", "title").otherwise("doi")
    pdf = best_pdf(pdf_candidates(whole, whole.withColumn("how", how)))
    return whole.drop("pdf_url").join(pdf, "ref", "left").withColumn("article_url", F.coalesce("article_url", F.nullif(X.article_url(F.col("pdf_url")), F.lit(""))))


#: Columns of a record, in order.
RECORD = ("title", "authors", "year", "venue", "doi", "article_url", "pdf_url")
_WORKS = (
    "title string, display_name string, doi string, publication_year int, authorships array<struct<author:struct<display_name:string>>>, host_venue struct<display_name:string>, "
    "primary_location struct<landing_page_url:string,pdf_url:string>"
)
_MESSAGE = (
    "title array<string>, author array<struct<given:string,family:string>>, `container-title` array<string>, DOI string, URL string, `published-print` struct<`date-parts`:array<array<int>>>, "
    "`published-online` struct<`date-parts`:array<array<int>>>, issued struct<`date-parts`:array<array<int>>>"
)


def work_record(answer: Column) -> dict[str, Column]:
    """A record of an index's JSON of a work: authors joined by ``; ``, the first location's addresses, the bare DOI.
    Text that isn't JSON, and null, give nulls."""
    j = F.from_json(answer, _WORKS)
    clean = lambda c: T.collapse_space(c)
    names = F.filter(F.transform(j["authorships"], lambda a: clean(a["author"]["display_name"])), lambda n: n.isNotNull())
    return {
        "title": clean(F.coalesce(F.nullif(j["title"], F.lit("")), j["display_name"])), "authors": F.array_join(names, "; "), "year": j["publication_year"], "venue": clean(j["host_venue"]["display_name"]),
        "doi": F.regexp_replace(clean(j["doi"]), "^https://doi.org/", ""), "article_url": clean(j["primary_location"]["landing_page_url"]), "pdf_url": clean(j["primary_location"]["pdf_url"]),
    }


def message_record(answer: Column) -> dict[str, Column]:
    """A record of a registry's JSON message: given and family names, the first title and container, and the year of the first
    date that is there (print, online, issued)."""
    j = F.from_json(answer, _MESSAGE)
    clean = lambda c: T.collapse_space(c)
    names = F.transform(j["author"], lambda a: clean(F.concat_ws(" ", a["given"], a["family"])))
    year = F.coalesce(*[F.get(F.get(j[f]["date-parts"], F.lit(0)), F.lit(0)) for f in ("published-print", "published-online", "issued")])
    first = lambda c: clean(F.get(j[c], F.lit(0)))
    return {"title": first("title"), "authors": F.array_join(names, "; "), "year": year, "venue": first("container-title"), "doi": clean(j["DOI"]), "article_url": clean(j["URL"]), "pdf_url": F.lit(None).cast("string")}


def backfilled(refs: DataFrame) -> DataFrame:
    """References with an arXiv id from the article's address or else the first address in the raw text that has one, and an
    article's address from the PDF's, where those lack."""
    some = lambda c: T.clean_str(F.col(c))
    inside = F.get(F.filter(F.transform(X.urls(F.col("raw_text")), lambda u: X.arxiv_id(u)), lambda a: a.isNotNull()), F.lit(0))
    return refs.withColumns(
        {"arxiv_id": F.coalesce(some("arxiv_id"), X.arxiv_id(F.col("article_url")), inside), "article_url": F.coalesce(some("article_url"), F.nullif(X.article_url(F.col("pdf_url")), F.lit("")))}
    )


def display_rows(refs: DataFrame, most: int = 100) -> DataFrame:
    """References as rows of a table for people: ``n`` by title, authors shortened behind the third, titles behind ``most``
    characters, and the best link."""
    listed = author_list(F.col("authors"))
    people = F.when(F.size(listed) > 3, F.concat(F.array_join(F.slice(listed, 1, 3), ", "), F.lit(" et al."))).otherwise(F.array_join(listed, ", "))
    title = F.coalesce(T.clean_str(F.col("title")), F.lit("untitled"))
    short = F.when(F.length(title) > most, F.concat(F.left(title, F.lit(most)), F.lit("..."))).otherwise(title)
    doi = F.concat(F.lit("https://doi.org/"), T.clean_str(F.col("doi")))
    return refs.select("ref", short.alias("title"), people.alias("people"), F.coalesce(T.clean_str(F.col("pdf_url")), T.clean_str(F.col("article_url")), doi, F.lit("")).alias("link"))
