"""The registered opN_ queries on the smallest tables, against libraries, SQL and brute force."""

import base64
import collections
import hashlib
import math
import os
import zlib

import duckdb
import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from lexiloom.llm import line_dedup, queries  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    return {i: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}


def test_op1(spark, ids):
    rows = queries.op1_packing(spark, SF).collect()
    at = collections.defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(own)
        at[r["doc_id"]] += r["length"]
        assert zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    assert all(at[i] == len(x) for i, x in ids.items())
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    for (s, o, n), (t, p, _) in zip(places, places[1:], strict=False):
        assert (t, p) in ((s, o + n), (s + 1, 0)) and o + n <= 2048


def test_op2(spark, texts):
    rows = {r["doc_id"]: r for r in queries.op2_fingerprints(spark, SF).collect()}
    order = sorted(texts)
    prints = collections.defaultdict(set)
    for i, n in zip(order, order[1:] + order[:1], strict=True):
        t, half = texts[i], len(texts[i]) // 2
        assert rows[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + texts[n][:half]).encode()).hexdigest()
        assert rows[i]["n_chars"] == len(t) and 0 <= rows[i]["near_edited"] <= 1
        prints[t].add(rows[i]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_op3(spark, texts):
    """All pairs of lines of fitting length, verified one by one."""
    first = {}
    for d in sorted(texts):
        for i, x in line_dedup.counted(texts[d], 1):
            first.setdefault(x, (d, i))
    lines = sorted(first, key=len)
    up = {x: x for x in lines}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    size = [len(x) for x in lines]
    pairs = [(lines[i], lines[j]) for i in range(len(lines)) for j in range(i + 1, int(np.searchsorted(size, size[i] + line_dedup.allowed(size[i], line_dedup.EDITS), "right")))]
    near = [line_dedup.within([x for x, _ in pairs[lo : lo + 5000]], [y for _, y in pairs[lo : lo + 5000]]) for lo in range(0, len(pairs), 5000)]
    for (x, y), ok in zip(pairs, np.concatenate(near), strict=True):
        if ok and root(x) != root(y):
            a, b = sorted((root(x), root(y)), key=first.get)
            up[b] = a
    want = {}
    for d, t in texts.items():
        kept = "\n".join(x for i, x in enumerate(t.split("\n")) if not (x in first and first[root(x)] != (d, i)))
        want[d] = hashlib.sha256(kept.encode()).hexdigest()
    assert {r["doc_id"]: r["text_sha256"] for r in queries.op3_line_dedup(spark, SF).collect()} == want


def test_op4(spark, ids):
    seen = collections.defaultdict(int)
    for r in queries.op4_token_output(spark, SF).collect():
        line, sizes = [], np.diff(r["cu_seqlens"])
        for doc, start, n in zip(r["doc_ids"], r["starts"], sizes.tolist(), strict=True):
            line.append(ids[doc][start : start + n])
            assert len(line[-1]) == n
            seen[doc] += n
        data = np.zeros(2048, "<u4")
        data[: r["n_tokens"]] = np.concatenate(line)
        place = np.zeros(2048, "<u4")
        place[: r["n_tokens"]] = np.concatenate([np.arange(n) for n in sizes])
        assert zlib.crc32(data.tobytes()) == r["ids_crc32"] and zlib.crc32(place.tobytes()) == r["positions_crc32"]
    assert seen == {i: len(x) for i, x in ids.items()}


def test_op5(spark, texts):
    tokens = {i: [*t.encode().lower().split(), b"\n"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = collections.Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    for r in queries.op5_lm_scoring(spark, SF).collect():
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"], r["n_known"]) == (held[r["doc_id"]], len(t), n, sum(w in counts for w in t))
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9, abs_tol=1e-6)
        assert r["score"] < 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = db.sql(queries.oracle_sql()[name])
    assert columns == sorted(want.columns)
    plain = lambda rows: sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows)
    assert plain(map(tuple, got.select(*columns).collect())) == plain(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", ["op6_quality_classifier", "op10_toxicity"])
def test_classifier_queries(spark, texts, name):
    threshold = 0.3 if name.startswith("op6") else 0.5
    rows = queries.queries()[name](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_op9(spark, texts):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op9_byte_bpe(spark, SF).collect():
        own = np.array(library.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(own), hashlib.sha256(own.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
