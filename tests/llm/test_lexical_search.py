"""Lexical search against brute force, whole and in small parts, and its odd cases."""

import collections
import math
import random
import re

import pytest

from lexiloom.llm import lexical_search as ls

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, key long, w int, term string, words double"
ITEMS = "item_id long, text string, item int, keys string"


def brute(docs, items, k):
    bags = [(i, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_words = len(bags), sum(n for _, _, n in bags)
    df = collections.Counter(t for _, b, _ in bags for t in b)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(TERM.findall((t or "").translate(LOWER)))
    out = {}
    for item, wanted in asked.items():
        scores = []
        for i, b, n in bags:
            m = 50 + 50 * n * n_docs // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 20 * m)) for t in wanted if t in b)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out[item] = [(None if null else i, -s) for s, null, i in sorted(scores)[:k]]
    return {i: x for i, x in out.items() if x}


def found(spark, docs, items, k, **limits):
    d = spark.createDataFrame([(*x, 1, 2, "t", 0.5) for x in docs], DOCS)
    i = spark.createDataFrame([(*x, 1, "k") for x in items], ITEMS)
    got = collections.defaultdict(dict)
    for r in ls.search(d, i, k, **limits).collect():
        assert r["rank"] not in got[r["item_id"]]
        got[r["item_id"]][r["rank"]] = (r["doc_id"], r["score"])
    return {i: [x[n] for n in range(1, len(x) + 1)] for i, x in got.items()}


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(draw.choices(words, [1 / (i + 1) for i in range(300)], k=n))
    docs = [(i, text(draw.choice([1, 5, 40, 300]))) for i in range(600)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)]  # ties at the bound
    items = [(i, text(25)) for i in range(12)] + [(50, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("limits", [{}, {"part": 16}, {"most_terms": 0, "part": 64}])
def test_against_brute_force(spark, corpus, limits):
    docs, items = corpus
    assert found(spark, docs, items, 5, **limits) == brute(docs, items, 5)


def test_odd_cases(spark):
    docs = [(1, None), (2, ""), (3, "!?"), (None, "Ärger ärger straße x"), (5, "A-b a_b 漢字 x"), (5, "a b"), (5, "a b"), (7, "a " * 50_000 + "B"), (8, "K É")]
    items = [(1, "a B"), (2, None), (3, "- -"), (None, "Straße x É"), (4, "unknown"), (6, "漢字"), (6, "b")]
    want = brute(docs, items, 50)
    assert found(spark, docs, items, 50) == want and set(want) == {1, None, 6}
    assert len(want[1]) == 4 and found(spark, docs, items, 2) == brute(docs, items, 2)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")], 5) == {} and found(spark, [(1, "a")], [], 5) == {} and found(spark, [(1, None)], [(1, "a")], 5) == {}
