"""Nulls, ties, repeats, empty tables and clashing columns in the library's operators; readers and writers."""

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import alignment, corpus, enrichment, graph, hierarchy, layout, matching, rdf, retrieval, topicflow
from lexiloom.sources import files
from lexiloom.sources import rdf as rdf_files

DOCS = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "word " * 1500), (5, "x" * 30_000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(DOCS, "doc_id long, text string")
    return rows.withColumns({"tokens": F.lit("t"), "chunk": F.lit("c"), "n": F.lit(1), "score": F.lit(0.5)})


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def test_chunks_and_statistics(docs, nothing):
    words = corpus.word_chunks(docs).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in words} == {2: 1, 3: 2, None: 4, 5: 1}
    chars = {r["doc_id"]: r["count"] for r in corpus.char_chunks(docs).groupBy("doc_id").count().collect()}
    assert 1 not in chars and 2 not in chars and chars[5] == 43
    assert corpus.word_chunks(nothing).count() == corpus.char_chunks(nothing).count() == 0
    terms = {r["token"]: (r["tf"], r["df"]) for r in corpus.term_statistics(corpus.tokenized(docs)).collect()}
    assert terms["word"] == (1500, 1) and terms["one"] == (2, 1)
    assert corpus.term_statistics(corpus.tokenized(nothing)).count() == 0


def test_retrieval_of_nothing_and_of_ties(docs, nothing):
    ask = docs.where("doc_id = 3").limit(1).select(F.lit(7).alias("query_id"), "text")
    found = retrieval.top_k(retrieval.bm25(docs, ask), 3).collect()
    assert [r["doc_id"] for r in found] == [3]
    assert retrieval.bm25(nothing, ask).count() == retrieval.bm25(docs, ask.where("false")).count() == 0


def test_cascade_and_containment(spark, docs, nothing):
    refs = spark.createDataFrame([(1, "a", "x"), (2, None, "x"), (3, None, None), (1, "a", "x")], "ref int, p string, q string")
    source = spark.createDataFrame([(9, "a", "x"), (8, "a", "x"), (7, None, "x")], "id int, p string, q string")
    rows = {(r["ref"], r["id"], r["stage"]) for r in matching.cascade(refs, source, "ref", "id", [["p"], ["q"]]).collect()}
    assert rows == {(1, 8, 0), (2, 7, 1)}
    lexicon = spark.createDataFrame([("e", "one two"), ("f", None)], "entity string, surface string")
    assert [tuple(r) for r in matching.containment(docs.select("doc_id", "text"), lexicon, [2]).collect()] == [("e", 3)]
    assert matching.containment(nothing.select("doc_id", "text"), lexicon, [2]).count() == 0


def test_depths_of_long_chains_and_cycles(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(90)], "child long, parent long")
    assert hierarchy.depths(chain).agg(F.max("depth")).collect()[0][0] == 90
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", None), (None, "d"), ("e", "e"), ("e", "c")], "child string, parent string")
    got = {r["node"]: r["depth"] for r in hierarchy.depths(loop).collect()}
    assert set(got) == {"a", "b", "c", "d", "e"} and got["d"] == 0 and got["c"] == got["a"] + 1 and got["e"] == got["c"] + 1
    assert got["a"] == got["b"] == 0
    assert hierarchy.depths(chain.where("false")).count() == 0
    beside = spark.createDataFrame([tuple(x.split("-")) for x in "a-b b-a a-m m-z z-y y-z".split()], "child string, parent string")
    assert {r["node"]: r["depth"] for r in hierarchy.depths(beside).collect()} == {"a": 2, "b": 2, "m": 1, "z": 0, "y": 0}


def depths_by_hand(pairs):
    """Components by mutual reach, then longest paths over them."""
    nodes = {x for p in pairs for x in p}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            reach[a] |= reach[b]
    place = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}
    depth = dict.fromkeys(nodes, 0)
    for _ in nodes:
        for a, b in pairs:
            if place[a] != place[b]:
                deep = max(depth[x] for x in nodes if place[x] == place[b])
                for x in nodes:
                    if place[x] == place[a]:
                        depth[x] = max(depth[x], deep + 1)
    return place, depth


@pytest.mark.parametrize("seed", [1, 2])
def test_depths_and_components_of_random_graphs(spark, seed):
    draw = random.Random(seed)
    pairs = {(draw.randrange(60), draw.randrange(60)) for _ in range(70)}
    place, depth = depths_by_hand(pairs)
    rows = spark.createDataFrame(list(pairs), "child long, parent long")
    assert {r["node"]: r["depth"] for r in hierarchy.depths(rows).collect()} == depth
    found = {r["node"]: r["component"] for r in hierarchy.strong_components(rows.toDF("a", "b").where("a <> b")).collect()}
    many = [c for c in place.values() if list(place.values()).count(c) > 1]
    assert found == {n: c for n, c in place.items() if c in many}


def test_providers_and_caches(spark, tmp_path):
    calls = tmp_path / "calls"

    def provider(x):
        with open(calls, "a") as f:
            f.write(x + "\n")
        if x == "bad" or calls.read_text().count(x) < 2:
            raise ValueError("not yet")
        return x.upper()

    rows = spark.createDataFrame([("a",), ("bad",)], "payload string").coalesce(1)
    got = {r["payload"]: (r["answer"], r["why"]) for r in topicflow.ask(rows, provider, wait=0.01, reason="why").collect()}
    assert got == {"a": ("A", None), "bad": (None, "ValueError: not yet")}
    calls.write_text("")
    refs, cache = spark.createDataFrame([("r",), ("s",)], "ref string"), spark.createDataFrame([("s", "old")], "ref string, answer string")
    answers, after = enrichment.with_cache(refs, cache, lambda misses: topicflow.ask(misses, provider, "ref", 2))
    assert {tuple(r) for r in answers.collect()} == {tuple(r) for r in after.collect()} and calls.read_text().count("r") == 2


def test_unions_whose_lists_come_back(spark):
    triples = [("p", "rdfs:domain", "u"), ("u", "owl:unionOf", "c0"), ("q", "rdfs:domain", "v"), ("v", "owl:unionOf", "rdf:nil"), ("q", "rdfs:domain", "K")]
    triples += [(f"c{i}", "rdf:first", f"K{i}") for i in range(5)] + [(f"c{i}", "rdf:rest", f"c{(i + 1) % 5}") for i in range(5)]
    got = rdf.expanded(spark.createDataFrame(triples, "s string, p string, o string"), "rdfs:domain").collect()
    assert sorted(tuple(r) for r in got) == sorted([("p", f"K{i}") for i in range(5)] + [("q", "K")])


def test_graph_measures_of_nothing(spark):
    none = spark.createDataFrame([], "s string, p string, o string, literal boolean")
    assert rdf.stats(none).collect()[0].asDict() == {"triples": 0, "resources": 0, "literals": 0, "blank_nodes": 0}
    assert rdf.typed_counts(none).collect()[0]["typed_ratio"] == 1.0
    assert rdf.richness(none).collect()[0]["inheritance_richness"] == 0.0
    assert rdf.supports(none).count() == rdf.entity_edges(none).count() == rdf.expanded(none, "rdfs:domain").count() == 0
    odd = spark.createDataFrame([("a", None, "b", False), (None, "p", "b", True), ("a", "p", "b", False), ("a", "p", "b", False)], none.schema)
    assert rdf.statements(odd).count() == 1


def test_supports_by_file_and_without_chunk(spark):
    rows = [("_:1", "rdf:type", "kg:Support"), ("_:2", "rdf:type", "kg:Support"), ("_:2", "prov:wasDerivedFrom", "kg:chunk/c2"), ("_:2", "kg:score", "no number"), ("kg:chunk/c2", "kg:docId", "own")]
    g = spark.createDataFrame([(*r, False) for r in rows], "s string, p string, o string, literal boolean")
    got = rdf.supports(g).collect()
    assert [(r["chunk_id"], r["doc_id"], r["score"], r["has_prov"]) for r in got] == [("c2", "own", 0.0, True)]
    told = spark.createDataFrame([("c2", "file")], "chunk_id string, doc_id string")
    assert rdf.supports(g, told).collect()[0]["doc_id"] == "file"


def test_alignment_rules(spark):
    triples = [("o#GraphModel", "rdf:type", "owl:Class"), ("o#uses_data", "rdf:type", "owl:ObjectProperty"), ("o#x", "rdf:type", "owl:DatatypeProperty"), ("o#x", "rdfs:label", "the curve")]
    names = alignment.lexicon(spark.createDataFrame([(*t, False) for t in triples], "s string, p string, o string, literal boolean"))
    questions = spark.createDataFrame([(1, "Which data uses it?"), (2, None), (3, ""), (4, "A curve?"), (5, "graphmodel"), (6, "How many?")], "id int, text string")
    rows = {r["id"]: r for r in alignment.grounding(questions, names).collect()}
    assert rows[1]["properties"] == ["o#uses_data"] and rows[4]["properties"] == ["o#x"] and rows[5]["classes"] == ["o#GraphModel"]
    assert not rows[2]["grounded"] and not rows[3]["grounded"] and rows[6]["intents"] == ["numeric"] and not rows[6]["supported"]
    assert alignment.grounding(questions.where("false"), names).count() == 0


def test_enrichment_of_odd_references(spark):
    c = F.col
    rows = spark.createDataFrame([(1, "nan", None, "https://arxiv.org/abs/2101.00001v3"), (2, "https://doi.org/10.1234/abc", "none", None), (3, None, None, None)], "ref int, doi string, raw string, url string")
    got = {r["ref"]: (r["a"], r["d"]) for r in rows.select("ref", enrichment.arxiv_of(c("doi"), c("url"), F.lit(None).cast("string"), c("raw"), F.lit("x")).alias("a"), enrichment.doi_of(c("doi"), c("url"), c("raw")).alias("d")).collect()}
    assert got == {1: ("2101.00001", None), 2: (None, "10.1234/abc"), 3: (None, None)}
    lists = spark.createDataFrame([("['A B', \"C\"]",), ("A; B",), (None,), ("[]",)], "a string").select(enrichment.author_list(c("a")).alias("l")).collect()
    assert [r["l"] for r in lists] == [["A B", "C"], ["A", "B"], [], []]
    pair = spark.createDataFrame([("Deep learning of large graphs", 2020, "Deep learning of large graphs.", 2023), ("Deep learning of large graphs", 2020, "Deep Learning of Large Graphs", None), ("a", 1, "", 1)], "title string, year int, c_title string, c_year int")
    assert enrichment.valid_candidates(pair).count() == 1 and enrichment.valid_candidates(pair, strict=False).count() == 1
    assert enrichment.valid_candidates(pair.where("false")).count() == 0


def test_layout_of_odd_texts(spark):
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "1. First heading here\n" + "x" * 120 + "\nMETHODS\n" + "y" * 50 + "\n2. Too close heading\nREFERENCES\n[1] A. B, \"A quoted title here\", 2020.\n[2] C\n")], "doc int, text string")
    heads = [(r["doc"], r["heading"]) for r in layout.headings(texts).orderBy("start").collect()]
    assert heads == [(3, "First heading here"), (3, "METHODS")]
    refs = {(r["number"], r["raw"]) for r in layout.numbered_references(texts).where("doc = 3").collect()}
    assert {n for n, _ in refs} >= {1, 2}
    page = spark.createDataFrame([("JOURNAL OF L ATEX CLASS FILES\nauto-\nencoder\n\n 12 \nﬁne",), (None,)], "t string").select(layout.clean_page(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in page] == ["autoencoder fine", ""]


def test_topics_and_providers(spark):
    rows = spark.createDataFrame([(i, "p%d" % i) for i in range(45)], "index int, payload string").repartition(3)
    sizes = {r["batch"]: len(r["items"]) for r in topicflow.batches(rows).collect()}
    assert sizes == {0: 20, 1: 20, 2: 5} and topicflow.batches(rows.where("false")).count() == 0
    calls = []

    def failing(text):
        calls.append(text)
        raise OSError("no answer")

    assert topicflow.ask(rows.limit(1), failing).collect()[0]["answer"] is None
    with pytest.raises(Exception, match="no list of papers"):
        spark.createDataFrame([("{}",)], "d string").select(topicflow.papers(F.col("d"))).collect()
    labelled = spark.createDataFrame([(1, None), (2, -1), (3, 7), (4, 7)], "index int, label int")
    assert sorted((r["cluster_id"] or "", r["size"]) for r in topicflow.clusters(labelled).collect()) == [("", 1), ("", 1), ("CLUSTER_0000", 2)]


def test_turtle_and_rdf_xml_say_the_same(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(
        '@prefix ex: <http://e.org/> .\n# note\nex:A a ex:Class ; ex:label "one \\"x\\""@en , \'two\' ; ex:of [ ex:n 1.5 ] .\nex:P ex:in ( ex:A ex:B ) .\n'
    )
    got = {(r["s"], r["p"], r["o"], r["literal"]) for r in rdf_files.graph(spark, str(tmp_path / "a.ttl")).collect()}
    e, r = "http://e.org/", rdf_files.RDF
    assert {(e + "A", r + "type", e + "Class", False), (e + "A", e + "label", 'one "x"', True), (e + "A", e + "label", "two", True)} <= got
    assert len(got) == 3 + 2 + 1 + 4
    (tmp_path / "b.rdf").write_text(
        f'<?xml version="1.0"?><rdf:RDF xmlns:rdf="{r}" xmlns:ex="{e}"><ex:Class rdf:about="{e}A"><ex:label>two</ex:label><ex:of><rdf:Description ex:n="1.5"/></ex:of></ex:Class>'
        f'<rdf:Description rdf:about="{e}P"><ex:in rdf:parseType="Collection"><rdf:Description rdf:about="{e}A"/><rdf:Description rdf:about="{e}B"/></ex:in></rdf:Description></rdf:RDF>'
    )
    xml = {(x["s"], x["p"], x["o"], x["literal"]) for x in rdf_files.graph(spark, str(tmp_path / "b.rdf")).collect()}
    plain = lambda rows: {x for x in rows if "_:" not in x[0] + x[2]}
    assert plain(xml) == plain(got) - {(e + "A", e + "label", 'one "x"', True)} and len(xml) == len(got) - 1
    short = rdf_files.shortened(rdf_files.graph(spark, str(tmp_path / "b.rdf")), {"rdf:": r, "ex:": e})
    assert short.where("p = 'rdf:type' and o = 'ex:Class' and s = 'ex:A'").count() == 1
    (tmp_path / "c.ttl").write_text("@prefix ex: <http://e.org/> .\nex:A ex:b")
    with pytest.raises(Exception, match="ends in the middle"):
        rdf_files.graph(spark, str(tmp_path / "c.ttl")).collect()


def test_numbered_lines_and_writers(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"text": "a"}\n\nnot json\n')
    with pytest.raises(Exception, match="bad line 3 of q.jsonl"):
        files.numbered_json_lines(spark, str(tmp_path / "q.jsonl"), "text string").collect()
    (tmp_path / "g.jsonl").write_text('{"text": "a"}\n\n{"text": "b"}\n')
    assert [r["text"] for r in files.numbered_json_lines(spark, str(tmp_path / "g.jsonl"), "text string").collect()] == ["a", "b"]
    rows = spark.createDataFrame([("a", 0.5, None), ("b", 0.9, 2), ("c", 0.9, 1)], "name string, evidence_coverage double, shacl_violations int")
    files.write_metrics(rows, str(tmp_path / "m"), ["name", "evidence_coverage", "missing"], str(tmp_path / "r"), rdf.ranked)
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).columns == ["name", "evidence_coverage", "missing"]
    assert [r["name"] for r in spark.read.option("header", True).csv(str(tmp_path / "r")).collect()] == ["c", "b", "a"]
    files.write_document(rows.agg(F.lit(float("nan")).alias("x"), F.count(F.lit(1)).alias("n")), str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).collect()[0].asDict() == {"n": 3, "x": None}
    assert files.write_table(rows, str(tmp_path / "t")) == "parquet"
    files.write_by_dataset(rows.withColumn("dataset", F.col("name")), str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).where("dataset = 'b'").count() == 1
    files.write_lines(rows.select("name"), str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).count() == 3


def test_a_field_that_both_sides_lack_stays_missing(spark):
    kinds = "ref long, title string, year int, authors string, doi string, arxiv_id string, article_url string, pdf_url string"
    base = spark.createDataFrame([(i, " ", None, None, "nan", None, None, None) for i in (1, 2, 3)], kinds)
    more = spark.createDataFrame([(1, " a  b ", 2001, None, "none", None, None, None), (2, None, None, "", None, None, None, "　")], kinds)
    got = {r["ref"]: tuple(r)[1:] for r in enrichment.filled(base, more).collect()}
    assert got == {1: ("a b", 2001, None, None, None, None, None), 2: (None,) * 7, 3: (None,) * 7}


def test_batches_hold_every_row_once_over_many_ranges(spark):
    rows = spark.range(120_010).select(F.col("id").alias("index"), F.sha2(F.col("id").cast("string"), 256).alias("name"))
    got = topicflow.batches(rows).select("batch", F.transform("items", lambda s: s["index"]).alias("i")).collect()
    assert {r["batch"]: r["i"] for r in got} == {b: list(range(20 * b, min(20 * b + 20, 120_010))) for b in range(6001)}


def test_titles_that_many_rows_share_are_compared_once(spark):
    names = ["alpha beta gamma", "gamma beta alpha delta", "delta alpha", "", "x", "epsilon zeta"]
    refs = [(i, names[i % 6].upper(), 2000 + i % 7 if i % 11 else None) for i in range(260)] + [(7, names[1].upper(), 2001)]
    have = [(f"s{i:04d}", names[i * i % 6], 2000 + i % 5) for i in range(1300)]
    r = spark.createDataFrame(refs, "ref long, title string, year int")
    s = spark.createDataFrame(have, "source_id string, title string, year int")
    words = lambda t: {w for w in t.lower().split() if len(w) > 2}
    want = {(a, b) for a, t, _ in refs for b, u, _ in have if words(t) and words(t) <= words(u)}
    got = [tuple(x) for x in enrichment.title_search(r, s).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    first = {a: sorted(b for x, b in want if x == a)[:3] for a in {a for a, _ in want}}
    assert {tuple(x) for x in enrichment.title_search(r, s, 3).collect()} == {(a, b) for a, bs in first.items() for b in bs}
    pairs = spark.createDataFrame([(n.upper(), n) for n in names], "ask string, have string")
    met = enrichment.expanded(pairs, r.withColumnRenamed("title", "ask").distinct(), s.select("source_id", F.col("title").alias("have"), F.col("year").alias("c_year")), 2)
    assert {tuple(x) for x in met.collect()} == {(a, b) for a, t, y in refs for b, u, z in have if t == u.upper() and (y is None or abs(y - z) <= 2)}


def test_near_pairs_send_numbers_and_lose_none(spark, monkeypatch):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(3, 30))] for _ in range(12)]
    texts = [" ".join(b if rng.random() > 0.05 else b + "x" for b in rng.choice(base)) for _ in range(60)] + ["one two", "", None]
    kinds, written = [], matching.written
    monkeypatch.setattr(matching, "written", lambda df: kinds.append(dict(df.dtypes)) or written(df))
    got = matching.near_duplicate_pairs(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    sets = {t: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts if t and len(t.split()) > 2}
    want = sorted(round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert want and sorted(round(r["score"], 6) for r in got) == want and all(r["key_a"] < r["key_b"] for r in got)
    assert kinds[0]["s"] == "array<bigint>" and kinds[1] == {"t": "bigint", "id": "bigint", "n": "int"}


def test_near_pairs_leave_no_shuffles_behind(spark):
    import time

    texts = [" ".join(f"w{(i // 2 + j) % 90}" for j in range(40)) + (" x" if i % 2 else "") for i in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {n for n in (f.getName() for f in iter_java(disk.getAllFiles())) if n.startswith("shuffle_")}
    before = files()
    pairs = matching.near_duplicate_pairs(rows)
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    assert pairs.count() == sum(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[i + 1 :])
    assert matching.near_duplicate_pairs(rows, slices=1).exceptAll(pairs).count() == 0


def iter_java(found):
    return [found.apply(i) for i in range(found.size())]
