"""Regularized topic models against plain numpy, their scores, the bootstrap and the search for K."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import artm


@pytest.fixture(scope="module")
def tokens(spark):
    draw = random.Random(4)
    themes = [[f"a{i}" for i in range(8)], [f"b{i}" for i in range(8)], [f"c{i}" for i in range(8)]]
    rows = []
    for d in range(60):
        for _ in range(30):
            words = themes[d % 3] if draw.random() < 0.85 else [f"x{i}" for i in range(4)]
            rows.append((0, d, draw.choice(words), 1, 0))
    return spark.createDataFrame([*rows, (0, None, "a1", 1, 0), (0, 1, None, 1, 0), (0, 1, "a1", 0, 0)], "fit int, doc long, word string, n int, block int")


def plain(rows, phi, words, rounds, passes, phi_tau, theta_tau, decor, background, smooth):
    docs = sorted({d for d, _ in rows})
    n = np.zeros((len(docs), len(words)))
    for (d, w), c in rows.items():
        n[docs.index(d), words.index(w)] = c
    seen = []
    for _ in range(rounds):
        theta = np.full((len(docs), phi.shape[1]), 1 / phi.shape[1])
        for _ in range(passes):
            q = n / np.maximum(theta @ phi.T, 1e-300)
            counts = np.maximum(theta * (q @ phi) + theta_tau, 0)
            size = counts.sum(1, keepdims=True)
            theta = np.where(size > 0, counts / np.where(size > 0, size, 1), theta)
        mix = np.maximum(theta @ phi.T, 1e-300)
        seen.append(float(np.exp(-(n * np.log(mix)).sum() / n.sum())))
        m = phi * ((n / mix).T @ theta)
        k = phi.shape[1] - background
        apart = np.zeros_like(phi)
        apart[:, :k] = decor * phi[:, :k] * (phi[:, :k].sum(1, keepdims=True) - phi[:, :k])
        tau = np.array([phi_tau] * k + [smooth] * background)
        m = np.where(m > 0, np.maximum(m + tau - apart, 0), 0)
        phi = m / m.sum(0, keepdims=True)
    return phi, seen


@pytest.mark.parametrize("how", [{}, {"phi_tau": -0.3, "theta_tau": -0.05, "decorrelation": 50.0, "background": 1, "smooth": 0.2}])
def test_against_numpy(spark, tokens, how):
    topics = spark.createDataFrame([(0, 3)], "fit int, k int")
    got, scores = artm.fit(tokens, topics, rounds=3, passes=4, pairs=100, **how)
    rows = {(r["doc"], r["word"]): r["n"] for r in artm.blocks(tokens).collect()}
    words = sorted({w for _, w in rows})
    first = np.zeros((len(words), 3))
    for r in artm.start(artm.blocks(tokens), topics, 1).collect():
        first[words.index(r["word"]), r["t"]] = r["p"]
    phi, seen = plain(rows, first, words, 3, 4, how.get("phi_tau", 0), how.get("theta_tau", 0), how.get("decorrelation", 0), how.get("background", 0), how.get("smooth", 0))
    found = np.zeros_like(phi)
    for r in got.collect():
        found[words.index(r["word"]), r["t"]] = r["p"]
    assert np.allclose(found, phi, atol=1e-9)
    assert np.allclose([r["perplexity"] for r in scores.orderBy("round").collect()], seen)


def test_scores_move_as_asked(spark, tokens):
    topics = spark.createDataFrame([(0, 3)], "fit int, k int")
    _, free = artm.fit(tokens, topics, rounds=6)
    line = [r["perplexity"] for r in free.orderBy("round").collect()]
    assert all(b <= a * (1 + 1e-9) for a, b in zip(line, line[1:], strict=False))
    _, sparse = artm.fit(tokens, topics, rounds=6, phi_tau=-1.0, theta_tau=-0.2)
    last, other = (x.orderBy(F.desc("round")).first() for x in (free, sparse))
    assert other["sparsity_phi"] > last["sparsity_phi"] and other["sparsity_theta"] > last["sparsity_theta"]

    def overlap(phi):
        pairs = phi.groupBy("word").agg((F.pow(F.sum("p"), 2) - F.sum(F.col("p") * F.col("p"))).alias("o"))
        return pairs.agg(F.sum("o")).first()[0]

    near, far = (artm.fit(tokens, topics, rounds=4, decorrelation=x)[0] for x in (0.0, 200.0))
    assert overlap(far) < overlap(near)


def test_bootstrap_has_its_size(spark, tokens):
    some = tokens.where("n > 0 and doc is not null and word is not null").groupBy("doc", "word").agg(F.sum("n").alias("n"))
    size = some.groupBy("doc").agg(F.sum("n").alias("n")).count()
    drawn = artm.resampled(some, [(0, 7), (1, 7), (2, 8)], 1.5)
    own = some.groupBy("doc").agg(F.sum("n").alias("all"))
    times = drawn.groupBy("fit", "doc").agg(F.sum("n").alias("n")).join(own, "doc").groupBy("fit").agg(F.sum(F.col("n") / F.col("all")).alias("draws")).collect()
    assert {r["fit"]: round(r["draws"]) for r in times} == dict.fromkeys((0, 1, 2), round(1.5 * size))
    sets = [{(r["doc"], r["word"], r["n"]) for r in drawn.where(F.col("fit") == f).collect()} for f in (0, 1, 2)]
    assert sets[0] == sets[1] != sets[2]


def test_search_and_nothing(spark):
    texts = [(i, " ".join(random.Random(i).choices([f"{'kmp'[i % 3]}word{chr(97 + j)}" for j in range(6)], k=20))) for i in range(45)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = {r["k"]: r for r in artm.search(docs, [2, 3], rounds=4, words=5).collect()}
    assert set(rows) == {2, 3} and sum(r["best"] for r in rows.values()) == 1 and all(0 <= r["stability"] <= 1 and 0 < r["diversity"] <= 1 for r in rows.values())
    none = spark.createDataFrame([], "fit int, doc long, word string, n int")
    phi, scores = artm.fit(none, spark.createDataFrame([(0, 2)], "fit int, k int"), rounds=2)
    assert phi.count() == 0 and scores.count() == 0


def test_packing_in_small_pieces(spark, tokens, monkeypatch):
    """One row a block and word is sent; small pieces and chunks, a document's rows apart and names that clash give the same model."""
    topics = spark.createDataFrame([(0, 3), (1, 2)], "fit int, k int")
    both = tokens.unionByName(tokens.withColumn("fit", F.lit(1))).repartition(3, "word")
    phi, scores = artm.fit(both, topics, rounds=2, pairs=100)
    dealt, _, _ = artm.prepared(both, 100, 1)
    assert dealt.where("part = -2").groupBy("corpus", "block", "word").count().where("count > 1").count() == 0
    monkeypatch.setattr(artm, "HELD", 50)
    monkeypatch.setattr(artm, "CHUNK", 16)
    name = artm.named
    monkeypatch.setattr(artm, "named", lambda word, salt: F.length(word).cast("long") if salt == 0 else name(word, salt))
    other, told = artm.fit(both, topics, rounds=2, pairs=100)
    rows = lambda x: {(r["fit"], r["word"], r["t"]): r["p"] for r in x.collect()}
    a, b = rows(phi), rows(other)
    assert set(a) == set(b) and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    line = lambda x: [tuple(r) for r in x.orderBy("fit", "round").collect()]
    assert np.allclose(line(scores), line(told)) and {f for f, *_ in line(told)} == {0, 1}


def test_fits_that_share_blocks(spark, tokens):
    """A bootstrap by weights is the fit of the documents written out, and rare words are left out with the documents that have no other."""
    more = tokens.unionByName(spark.createDataFrame([(0, 900, "rare", 3, 0), (0, 901, "rarer", 1, 0), (0, 901, "a1", 2, 0)], tokens.schema))
    dealt, number, dictionary = artm.prepared(more, 200, 1)
    common = dealt.where("part = -2").groupBy("corpus", "word").agg(F.sum("df").alias("df")).where("df >= 3").select("corpus", "word")
    dealt = artm.restricted(dealt, number, common)
    assert dealt.agg(F.sum("docs")).first()[0] == 61 and {r["word"] for r in dictionary.join(common, dictionary["id"] == common["word"]).select(dictionary["word"]).collect()}.isdisjoint({"rare", "rarer"})
    drawn = artm.weighed(dealt, number, 2, [(0, 5), (1, 6)], 0.8)
    phi, scores = artm.learnt(drawn, number, dictionary, artm.Layout([(0, 0, 2, 5), (0, 1, 3, 6)]), "int", 2, 5)
    rows = []
    for b in drawn.where("part >= 0").collect():
        words = np.frombuffer(drawn.where((F.col("part") == -1) & (F.col("block") == b["block"])).first()["index"], np.int64)
        sizes = artm.large(b["sizes"]).astype(int)
        times = artm.large(b["times"]).reshape(2, -1)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        for d, i, n in zip(doc.tolist(), artm.large(b["index"]).tolist(), artm.large(b["n"]).tolist(), strict=True):
            rows += [(f, b["block"] * 1000 + b["part"] * 100 + d, int(words[i]), float(n * times[f, d])) for f in (0, 1) if times[f, d]]
    assert len({r[:2] for r in rows if r[0] == 0}) <= round(0.8 * 61)
    plain_rows = spark.createDataFrame(rows, "fit int, doc long, id long, n double").join(dictionary, "id")
    other, told = artm.fit(plain_rows, spark.createDataFrame([(0, 2, 5), (1, 3, 6)], "fit int, k int, seed int"), rounds=2)
    at = lambda x: {(r["fit"], r["word"], r["t"]): r["p"] for r in x.collect()}
    a, b = at(phi), at(other)
    assert set(a) == set(b) and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    line = lambda x: [tuple(r) for r in x.orderBy("fit", "round").collect()]
    assert np.allclose(line(scores), line(told))
