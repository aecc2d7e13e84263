"""Fixtures of the column builders, with values worked out by hand."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import extract as X
from lexiloom.functions import similarity as S
from lexiloom.functions import text as T
from lexiloom.operators import corpus as C


def value(spark, make, *args):
    names = [f"c{i}" for i in range(len(args))]
    kinds = ["array<string>" if isinstance(a, list) else "double" if isinstance(a, float) else "string" for a in args]
    rows = spark.createDataFrame([args], ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    return rows.select(make(*[F.col(n) for n in names]).alias("v")).collect()[0]["v"]


def test_three_tokenizers_differ(spark):
    x = "the u-net3 model is state-of-the-art, e.g. ai & b2b"
    assert value(spark, lambda c: T.find_all(c, T.TOPIC_TOKEN), x) == ["the", "u-net", "model", "is", "state-of-the-art", "ai"]
    assert value(spark, T.k_tokens, x) == ["the", "u-net3", "model", "state-of-the-art", "b2b"]
    assert value(spark, T.word_tokens, "naïve über café-bar привет") == ["naïve", "über", "café", "bar", "привет"]


def test_hyphenation(spark):
    assert value(spark, T.fix_hyphenation, "auto- encoder and well-known pre-\ntrained") == "autoencoder and well-known pretrained"


def test_cleaning_equals_the_plain_patterns(spark):
    draw = random.Random(3)
    signs = ["a", "B", "é", "1", "_", "-", "-", " ", "\n", "\u00ad", "–", "\0", "@", ".", "co", "http://", "www.", "%", "+", "a@b.com1@c.de", "x- y- z"]
    rows = [("".join(draw.choices(signs, k=draw.randint(0, 25))),) for _ in range(4000)]
    x, word = F.col("x"), r"[\p{L}\p{N}_]+"
    y = F.regexp_replace(F.regexp_replace(x, "\u00ad", ""), "[‐‒–—−]", "-")
    y = F.regexp_replace(F.regexp_replace(y, rf"({word})-\s+({word})", "$1$2"), r"\s*\n\s*", " ")
    y = F.regexp_replace(F.regexp_replace(F.regexp_replace(y, "\0", " "), T.URL, " "), T.EMAIL, " ")
    tokens = F.transform(T.find_all(F.lower(y), T.TOPIC_TOKEN), lambda t: F.regexp_replace(t, "^-+|-+$", ""))
    tokens = F.filter(tokens, lambda t: (F.length(t) >= 2) & ~t.isin(T.STOPWORDS))
    got = spark.createDataFrame([*rows, (None,)], "x string").select("x", T.clean_text(x).alias("clean"), y.alias("plain"), T.topic_tokens(x).alias("got"), tokens.alias("tokens")).collect()
    assert [r for r in got if r["clean"] != r["plain"] or r["got"] != r["tokens"]] == []


def test_cleaning_long_words_takes_no_square(spark):
    began = time.time()
    x = "a" * 300_000 + " a@b " + "b" * 300_000
    assert value(spark, T.topic_tokens, x) == ["a" * 300_000, "b" * 300_000]
    assert value(spark, T.clean_text, x) == x
    assert time.time() - began < 30


def test_bigrams_bridge_removed_words(spark):
    tokens = value(spark, T.topic_tokens, "graph of networks")
    assert tokens == ["graph", "networks"]
    assert value(spark, lambda c: T.ngrams(c, 2), tokens) == ["graph_networks"]
    assert value(spark, lambda c: T.ngrams(c, 3), tokens) == []


def test_word_chunks(spark):
    rows = [(1, "0 1 2 3 4 5 6 7 8 9"), (2, "a  b"), (3, "")]
    got = C.word_chunks(spark.createDataFrame(rows, "doc_id long, text string"), 4, 1).orderBy("doc_id", "chunk_index").collect()
    assert [r["chunk"] for r in got] == ["0 1 2 3", "3 4 5 6", "6 7 8 9", "9", "a  b", ""]


def test_char_chunks(spark):
    docs = spark.createDataFrame([(1, "x" * 2100), (2, "x" * 150), (3, "x" * 900 + " " * 1000 + "y" * 50)], "doc_id long, text string")
    got = C.char_chunks(docs).orderBy("doc_id", "chunk_index").collect()
    assert [(r["doc_id"], r["start_char"], r["end_char"]) for r in got] == [(1, 0, 1000), (1, 700, 1700), (1, 1400, 2100), (3, 0, 1000), (3, 700, 1700)]


def test_identifiers(spark):
    assert value(spark, X.doi, "see https://doi.org/10.1234/ABC.5).") == "10.1234/abc.5"
    assert value(spark, X.arxiv_id, "arXiv:2405.00334v2") == "2405.00334"
    assert value(spark, X.arxiv_id, "10.48550/arxiv.2405.00334") is None
    assert value(spark, X.arxiv_id_in_doi, "10.48550/arxiv.2405.00334") == "2405.00334"


def test_indel():
    assert S.indel_ratio("abcd", "abxd") == 75.0
    assert round(S.indel_ratio("deep active learning for image tasks", "deep active learning for text tasks"), 4) == 90.1408
    assert S.partial_ratio("abc", "xxabcxx") == 100.0


def test_jaccard_of_empty_sets(spark):
    assert value(spark, lambda a, b: S.jaccard(a, b), [], []) == 0.0
    assert value(spark, lambda a, b: S.jaccard(a, b, 1.0), [], []) == 1.0


@pytest.mark.parametrize("counts, want", [((2, 3, 2), 0.415037), ((3, 3, 2), -0.169925), ((3, 1, 0), 0.0)])
def test_npmi(spark, counts, want):
    got = value(spark, lambda a, b, ab: S.npmi(a, b, ab, F.lit(4.0)), *map(float, counts))
    assert math.isclose(got, want, abs_tol=1e-6)


def test_rank_statistics(spark):
    rows = spark.createDataFrame([(5,), (1,), (9,), (3,)], "n long")
    assert tuple(C.rank_statistics(rows, "n").collect()[0]) == (1, 5, 5, 5)
