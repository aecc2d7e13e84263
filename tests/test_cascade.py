"""The staged search, merging of answers and the check of PDFs against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import similarity as S
from lexiloom.operators import cascade as C
from lexiloom.operators import enrichment as E
from lexiloom.operators import pdfcheck as P

RECORD = "source_id string, title string, year int, authors string, doi string, arxiv_id string, article_url string, pdf_url string"
REF = "ref long, title string, year int, authors string, doi string, arxiv_id string, article_url string, pdf_url string, raw_text string, note string"
DEEP, WIDE = "Deep networks for sparse graphs", "A wide survey of stochastic parsers"


@pytest.fixture(scope="module")
def tables(spark):
    archive = spark.createDataFrame(
        [("x1", DEEP, 2001, "Ann", None, "2001.00001", None, "https://arxiv.org/pdf/2001.00001.pdf"), ("x2", "Another thing entirely", 2002, None, None, "2001.00002", None, None)], RECORD
    )
    index = spark.createDataFrame(
        [
            ("i2", DEEP, 2001, None, "10.1000/A", "2001.00001v3", "http://a", None),
            ("i1", WIDE, 2010, "nan", "10.1000/b", None, "http://b", "https://doi.org/10.1000/b"),
            ("i1", WIDE, 2010, "nan", "10.1000/b", None, "http://b", "https://doi.org/10.1000/b"),
            ("i3", WIDE, 2011, "Bob;  Eve", "10.1000/c", None, "http://c", "http://c.pdf"),
            ("i4", None, None, None, None, None, None, None),
        ],
        RECORD,
    )
    return archive, index


@pytest.fixture(scope="module")
def refs(spark):
    return spark.createDataFrame(
        [
            (1, "t", None, None, None, "2001.00001", None, None, None, "x"), (2, DEEP.upper(), None, None, None, None, None, None, None, "x"), (3, WIDE + " ii", 2010, None, "10.1000/B", None, None, None, None, None),
            (4, WIDE, 2030, None, None, None, None, None, None, None), (5, None, None, None, None, None, None, None, None, None), (6, "Another thing entirely", None, None, None, "2001.00002", None, None, None, None),
            (7, WIDE, None, None, "10.1000/c", None, None, None, None, None),
        ],
        REF,
    )


def stages(archive, index):
    return [C.Stage("archive", archive, "arxiv_id", "pdf"), C.Stage("index", index, "doi"), C.Stage("index", index, "title", through=archive), C.Stage("index", index, "title", "any")]


def test_stages(tables, refs):
    got = {r["ref"]: (r["stage"], r["source_id"], r["pdf_url"]) for r in C.first(C.answers(refs, stages(*tables))).collect()}
    # 1 by its id; 2 by title, then by the arXiv id of the answer; 3 by title, as its DOI's PDF is the DOI's address; 4 is too far in time,
    # 5 has nothing, 6 is known without a PDF; 7 by its DOI
    arxiv = "https://arxiv.org/pdf/2001.00001.pdf"
    assert got == {1: (0, "x1", arxiv), 2: (2, "i2", arxiv), 3: (2, "i3", "http://c.pdf"), 7: (1, "i3", "http://c.pdf")}


def test_answers_of_all_stages(tables, refs):
    rows = {(r["ref"], r["stage"], r["source_id"]) for r in C.answers(refs, stages(*tables), all_stages=True).collect()}
    assert {(3, 2, "i3"), (3, 3, "i1"), (3, 3, "i3"), (7, 1, "i3"), (7, 2, "i3"), (7, 3, "i1"), (7, 3, "i3")} == {x for x in rows if x[0] in (3, 7)}


def test_merged(tables, refs):
    found = C.answers(refs, stages(*tables), all_stages=True)
    rows = {r["ref"]: r for r in C.merged(refs, found).collect()}
    assert set(rows) == set(range(1, 8))
    assert rows[1]["title"] == "t" and rows[1]["authors"] == "Ann" and rows[1]["origin"] == {"title": "reference", "arxiv_id": "reference", "year": "archive", "authors": "archive", "pdf_url": "archive"}
    assert rows[7]["authors"] == "Bob; Eve" and rows[7]["more_urls"] == ["https://doi.org/10.1000/b", "http://b"] and rows[7]["note"] is None
    assert rows[5]["origin"] == {} and rows[5]["more_urls"] == [] and rows[5]["pdf_url"] is None and rows[5]["authors"] is None


def test_empty_tables(spark, tables, refs):
    none = [t.where("false") for t in tables]
    assert C.answers(refs, stages(*none)).count() == 0
    assert C.merged(refs.where("false"), C.answers(refs, stages(*tables))).count() == 0
    rows = C.resolved(refs, stages(*none), none[0], none[1]).collect()
    assert len(rows) == 7 and {r["found_by"] for r in rows} == {None}


def test_workflow(spark, tables, refs):
    pages = spark.createDataFrame([("http://c.pdf", f"Vol. 3\n{WIDE}\nAuthor line here\ndoi: 10.1000/c"), ("http://c.pdf", None), (None, "x")], "pdf_url string, text string")
    rows = {r["ref"]: r for r in C.resolved(refs, stages(*tables), *tables, pages).collect()}
    told = {k: (r["found_by"], r["judged_by"], r["validated"], r["pdf_url"]) for k, r in rows.items()}
    arxiv = "https://arxiv.org/pdf/2001.00001.pdf"
    assert told[2] == ("title", "arxiv", True, arxiv) and told[7] == ("doi", "content", True, "http://c.pdf")
    # a title of one letter is part of the paper's title; the difference of lengths takes 0.15 of the score
    assert told[1] == ("arxiv_id", "arxiv", True, arxiv)
    # the pages name another DOI than the reference has: the PDF goes, its address is kept
    assert told[3] == ("title", None, False, None) and "http://c.pdf" in rows[3]["more_urls"]
    assert told[5] == (None, None, None, None)


def _plain(s):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", s.lower())).strip()


def _like(a, b):
    a, b = _plain(a or ""), _plain(b or "")
    if not a or not b:
        return None
    ratio = (S.indel_ratio if len(a) > 50 else S.partial_ratio)(a, b) / 100
    return max(0.0, ratio - (0.15 if abs(len(a) - len(b)) / max(len(a), len(b)) > 0.3 else 0))


def _judge(r):
    url = (r["pdf_url"] or "").lower()
    if not url:
        return 0.0, None
    m = re.search(r"arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,})", url)
    s = _like(r["title"], r["arxiv_title"]) if m and m.group(1) == r["arxiv_id"] else None
    if s is not None and s >= 0.75:
        return 0.85 + (s - 0.75) * 0.15, "arxiv"
    s = _like(r["title"], r["doi_title"]) if r["doi"] and (r["doi"].lower() in url or "doi.org" in url) else None
    if s is not None and s >= 0.85:
        return 0.9 + (s - 0.85) * 0.1, "registry"
    least = 0.8 if any(d in url for d in E.TRUSTED) else 0.85
    s = _like(r["title"], r["found_title"])
    score = s if s is not None and s >= least else 0.0
    for want, have in ((r["doi"], r["found_doi"]), (r["arxiv_id"], r["found_arxiv"])):
        if want and have:
            score = min(1.0, score + 0.1) if want.lower() == have.lower() else 0.0
    return (score, "content") if score >= least else (0.0, None)


def test_confidence(spark):
    titles = [None, "", "Short name", "A longer title of a work that has more than fifty characters", "A longer titel of a work, that has more than 50 characters", "Short names and a tail that goes on and on", "else"]
    urls = [None, "https://arxiv.org/pdf/2001.00001v1.pdf", "http://x.org/10.1000/a.pdf", "https://ieee.org/p.pdf"]
    rows = [
        (u, t, d, "2001.00001" if i % 2 else None, o, titles[(i + 3) % 7], f, "10.1000/a" if i % 3 == 0 else None, "2001.00001" if i % 5 == 0 else "2001.00009" if i % 5 == 1 else None)
        for i, (u, t, d, o, f) in enumerate((u, t, d, o, f) for u in urls for t in titles for d in (None, "10.1000/A", "10.1000/b") for o in titles[2:4] for f in titles)
    ]
    names = ["pdf_url", "title", "doi", "arxiv_id", "arxiv_title", "doi_title", "found_title", "found_doi", "found_arxiv"]
    got = P.judged(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))).collect()
    assert len(got) == len(rows) and {r["judged_by"] for r in got} == {None, "arxiv", "registry", "content"}
    for r in got:
        score, by = _judge(r.asDict())
        assert r["judged_by"] == by and abs(r["confidence"] - score) < 1e-9, r


def test_decision(spark):
    rows = [(1, "http://x/p.pdf", 0.0, None, None), (2, "https://ieee.org/p.pdf", 0.0, None, None), (3, "http://x/q.pdf", 0.9, "content", None), (4, None, 0.0, None, None), (5, "http://x/r.pdf", 0.0, None, "openalex"), (6, " ", 0.0, None, None)]
    got = {r["i"]: (r["pdf_url"], r["more_urls"], r["validated"]) for r in P.settled(spark.createDataFrame(rows, "i int, pdf_url string, confidence double, judged_by string, finder string")).collect()}
    assert got == {
        1: (None, ["http://x/p.pdf"], False), 2: ("https://ieee.org/p.pdf", ["https://ieee.org/p.pdf"], False), 3: ("http://x/q.pdf", [], True), 4: (None, [], None),
        5: ("http://x/r.pdf", ["http://x/r.pdf"], False), 6: (None, [], None),
    }


def test_first_pages(spark):
    texts = [
        None, "", "Journal of X\nA title that is\nlong enough to go on\nAuthors: A, B\nAbstract\nText", "short\nAbstract. This sentence is about nothing at all. Received later",
        "x\n" * 40 + "A title that stands too far down\n", "doi: 10.1000/Abc) arXiv: 2001.00001v2 " + "word " * 99, "Fifteen letters\n",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", *[v.alias(k) for k, v in P.first_page_facts(F.col("text")).items()]).collect()
    got = {r["i"]: (r["found_title"], r["found_doi"], r["found_arxiv"]) for r in rows}
    assert got[0] == got[1] == (None, None, None)
    assert got[2][0] == "Journal of X A title that is long enough to go on"
    assert got[3][0] == "this sentence is about nothing at all"
    assert got[4][0] == "x x x x x x x x x x x x x x x x x x x x x x x x x x x x x x x x x x x x x x x x a title that stands too far down"
    assert got[5][1:] == ("10.1000/abc", "2001.00001") and got[6][0] == "Fifteen letters"


def test_filtered_scores(spark):
    from lexiloom.operators import retrieval as R

    docs = spark.createDataFrame([(1, "red fox", "en"), (2, "red hen", None), (3, "fox fox", "de"), (4, None, "en")], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(9, "Fox red")], "query_id long, text string")
    whole = {r["doc_id"]: r["score"] for r in R.bm25(docs, asked).collect()}
    assert {r["doc_id"]: r["score"] for r in R.bm25(docs, asked, lang="en").collect()} == {1: whole[1]} and set(whole) == {1, 2, 3}


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """400 pages of one title, which only a search by title finds."""
    folder = tmp_path_factory.mktemp("copies")
    title = "One title of many pages that no id tells apart"
    rows = [(i, f"http://h/{i}", f"<html><title>{title}</title><p>{title}</p></html>") for i in range(400)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(folder / "pages.parquet"))
    return str(folder)


def _near(i):
    """Records of source ``a`` no more than two years apart, the least id first."""
    return sorted((k for k in range(400) if abs(k % 20 - i % 20) <= 2), key=lambda k: f"a{k}")


def _most_rows(plan):
    """The most rows that a node of an executed plan gave."""
    inner = [getattr(plan, f)() for f, kind in (("executedPlan", "AdaptiveSparkPlanExec"), ("plan", "QueryStageExec")) if plan.getClass().getSimpleName().endswith(kind)]
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().get("numOutputRows")
    return max([own.get().value() if own.isDefined() else 0, *map(_most_rows, inner + below)])


def test_copies_of_a_title_meet_once(spark, copies, monkeypatch):
    from lexiloom.plans import catalogue

    sizes, write = [], C.written
    monkeypatch.setattr(C, "written", lambda df: (sizes.append((out := write(df)).count()), out)[1])
    rows = catalogue.queries()["cascade_stages"](spark, copies)
    got = {r["ref"]: (r["stage"], r["source_id"], r["pdf_url"]) for r in rows.collect()}
    assert got == {i: (4, f"a{_near(i)[0]}", f"http://h/{_near(i)[0]}.pdf") for i in range(400)}
    # 20 years of at most 100 records of either source, where all pairs of pages are 160,000
    assert _most_rows(rows._jdf.queryExecution().executedPlan()) < 5000 and max(sizes) < 5000


def test_workflow_of_copies(spark, copies, monkeypatch):
    from lexiloom.plans import catalogue

    sizes, write = [], C.written
    monkeypatch.setattr(C, "written", lambda df: (sizes.append((out := write(df)).count()), out)[1])
    rows = catalogue.queries()["resolved_references"](spark, copies).collect()
    assert len(rows) == 400 and {r["found_by"] for r in rows} == {"title"}
    for r in rows:
        a, b = _near(r["ref"]), [k for k in range(400) if abs(k % 20 + 1 - r["ref"] % 20) <= 2]
        want = {f"http://h/{k}{x}" for k in a for x in ("", ".pdf")} | {f"http://h/{k}#b" for k in b}
        # the first answer's PDF gives way to that of its arXiv id
        want = want - {f"http://h/{a[0]}.pdf"} | {f"https://arxiv.org/pdf/2{a[0]:03}.{a[0]:05}.pdf"}
        assert {*r["more_urls"].split(), r["pdf_url"], r["article_url"]} - {None} == want
    assert max(sizes) < 5000
