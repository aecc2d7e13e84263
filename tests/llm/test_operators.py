"""The ten operators against brute force, on small fixtures with the odd cases."""

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from lexiloom.llm import bpe, components, fingerprints, gbdt, line_dedup, lm_scoring, ngram_join, packing, quality_classifier, quality_rules, token_output, toxicity  # noqa: E402

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Columns that clash with names the operators use inside.
SCHEMA = "doc_id long, text string, source string, token string, size int, score double, component int, n long, kind int, lid int"
ODD = [
    (1, None, None), (2, "", "a"), (None, "a b", "a"), (4, "x", None), (4, "x", None), (5, "word " * 3000, "b"), (6, "a" * 700, "b"),
    (7, "Été don't\n\n  stop\tnow é <|endoftext|> 漢字 \x1c ok", "b"), (8, "line one is here\nline one is here\nother", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, s, "t", 1, 0.5, 2, 3, 4, 5) for i, t, s in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 1, 1), (4, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def family(n=90, seed=1, words=60):
    """An original and near copies of it, with one word changed each; unrelated texts; copies."""
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(words)]
    texts = [" ".join(base)]
    for i in range(n):
        own = list(base)
        for _ in range(rng.choice([1, 1, 2])):
            own[rng.randrange(words)] = "new%d_%d" % (i, rng.randrange(9))
        texts.append(" ".join(own))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 30))) for _ in range(40)]
    return texts + texts[:3] + ["", "one", "one two", "one two"]


def test_packing_is_a_partition_of_all_ids(spark, odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    want = collections.Counter()
    for i, t, _ in ODD:
        want[i, tuple(library.encode(t or "", add_special_tokens=False).ids + [1])] += 1
    rows = packing.pack(odd.repartition(3), WORDS, length=64).collect()
    places = sorted((r["sequence_id"] * 64 + r["offset"], r["length"]) for r in rows)
    at = 0
    for start, size in places:
        assert start == at
        at += size
    assert at == sum(len(ids) * c for (_, ids), c in want.items())
    assert all(r["offset"] + r["length"] <= 64 and r["length"] > 0 for r in rows)
    got = collections.defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]))
    long = sorted(got[5])
    assert [x for _, ids, _ in long for x in ids] == list(next(ids for i, ids in want if i == 5))
    assert sum(len(ids) for _, ids, _ in got[4]) == sum(len(ids) * c for (i, ids), c in want.items() if i == 4)
    assert packing.pack(empty, WORDS).count() == 0


def test_matrices_hold_every_piece_once(spark, odd, empty):
    rows = token_output.matrices(odd.repartition(2), WORDS, length=32, shard_tokens=500).collect()
    seen = collections.Counter()
    for r in rows:
        ids, pos, cu = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["position_ids"], "<u4"), r["cu_seqlens"]
        assert len(ids) == 32 and cu[0] == 0 and cu[-1] == r["n_tokens"] and len(cu) == len(r["doc_ids"]) + 1
        for a, z, doc, start in zip(cu, cu[1:], r["doc_ids"], r["starts"], strict=False):
            assert pos[a:z].tolist() == list(range(z - a))
            seen[doc, start, tuple(ids[a:z])] += 1
        assert not ids[cu[-1] :].any()
    total = sum(len(k[2]) * c for k, c in seen.items())
    assert total == sum(r["doc_tokens"] for r in packing.pack(odd, WORDS).where("start = 0").collect())
    assert token_output.matrices(empty, WORDS).count() == 0


def test_best_fit_takes_the_fullest_that_holds():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 33) for _ in range(500)]
    bins = token_output.best_fit(sizes, 32)
    assert sorted(i for b in bins for i in b) == list(range(500)) and all(sum(sizes[i] for i in b) <= 32 for b in bins)
    free, plain = [], 0  # plain best fit in falling size uses as many sequences
    for s in sorted(sizes, reverse=True):
        fits = [f for f in free if f >= s]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - s)
        else:
            free.append(32 - s)
            plain += 1
    assert len(bins) == plain


def test_fingerprints(spark, odd, empty):
    got = collections.defaultdict(set)
    for r in fingerprints.fingerprint(odd).collect():
        got[r["doc_id"]].add(r["fingerprint"])
    assert len(got[4]) == 1 and got[1] == got[2] != got[5]
    texts = [t for t in family(30) if t][:60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = {r["doc_id"]: r for r in fingerprints.with_edited(docs, parts=4).collect()}
    assert len(rows) == len(texts)
    errors = []
    for i, t in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and rows[i]["n_chars"] == len(t)
        a, b = collections.Counter(t.lower().split()), collections.Counter(edited.lower().split())
        errors.append(abs(sum((a & b).values()) / sum((a | b).values()) - rows[i]["near_edited"]))
    assert np.mean(errors) < 0.08 and max(errors) < 0.3
    assert fingerprints.with_edited(odd, parts=3).count() == len(ODD)
    assert fingerprints.with_edited(empty).count() == 0


def test_error_of_the_likeness():
    """128 samples: a standard error of 0.044 at a likeness of one half."""
    same = {"s%d" % i: 1 for i in range(40)}
    errors = []
    for k in range(150):
        a, b = (collections.Counter(same | {"%s%d_%d" % (x, k, i): 1 for i in range(20)}) for x in "ab")
        errors.append(fingerprints.likeness(*fingerprints.signatures([a, b])) - 0.5)
        same = {"s%d_%d" % (k, i): 1 for i in range(40)}
    assert np.sqrt(np.mean(np.square(errors))) < 0.052


def test_slices_of_a_large_text_give_the_same_signature():
    rng = random.Random(4)
    c = collections.Counter(str(rng.randrange(900)).encode() for _ in range(3000))
    assert (fingerprints.signatures([c]) == fingerprints.signatures([c], most=100)).all()


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutated(rng, s, k):
    s = list(s)
    for _ in range(k):
        i, kind = rng.randrange(len(s) + 1), rng.randrange(3)
        if kind == 0 or not s:
            s.insert(i, rng.choice("abé"))
        elif kind == 1:
            s.pop(min(i, len(s) - 1))
        else:
            s[min(i, len(s) - 1)] = rng.choice("abé")
    return "".join(s)


def test_banded_distance_and_segment_keys():
    rng = random.Random(3)
    a = ["".join(rng.choice("abé ") for _ in range(rng.randrange(70))) for _ in range(600)]
    b = [mutated(rng, x, rng.randrange(6)) for x in a]
    for edits in (((1, 1),), ((1, 2),), ((1, 3),), ((5, 1), (20, 2), (35, 3), (50, 4))):
        most = [line_dedup.allowed(min(len(x), len(y)), edits) for x, y in zip(a, b, strict=True)]
        want = [levenshtein(x, y) <= k for x, y, k in zip(a, b, most, strict=True)]
        assert line_dedup.within(a, b, edits).tolist() == want
        lines, plans = sorted({*a, *b} - {""}), line_dedup.Plans(edits)
        key, owner = line_dedup.keys(lines, plans)
        index, all_keys = collections.defaultdict(set), collections.defaultdict(set)
        for k, i in zip(key.tolist(), owner.tolist(), strict=True):
            all_keys[lines[i]].add(k >> 1)
            if not k & 1:
                index[lines[i]].add(k >> 1)
        for x, y, near in zip(a, b, want, strict=True):
            if near and min(len(x), len(y)) > 8 and x != y:
                short, long = sorted((x, y), key=len)
                assert index[short] & all_keys[long]
        bag = line_dedup.bags(lines)
        for x, y in zip(a, b, strict=True):
            if x and y:
                i, j = lines.index(x), lines.index(y)
                assert abs(bag[i] - bag[j]).sum() <= 2 * levenshtein(x, y)


def test_long_near_equal_lines_in_bounded_memory(spark):
    """2,000 lines of 5,000 characters within one edit of another, under a limit of memory."""
    import tracemalloc

    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    lines = [base[:at] + "#" + base[at + 1 :] for at in range(0, 5000, 10)] * 4
    tracemalloc.start()
    assert line_dedup.within(lines, lines[1:] + lines[:1]).all()
    line_dedup.bags(lines)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
    docs = spark.createDataFrame([(i, x + "%d" % i) for i, x in enumerate(lines[:400])], "doc_id long, text string").repartition(4)
    assert line_dedup.dedup(docs).where("n_kept > 0").count() == 1


def expected_lines(docs, edits=line_dedup.EDITS, least=1):
    lines = {}
    for d, t in docs:
        for i, x in enumerate((t or "").split("\n")):
            if len(x.split()) >= least:
                lines[x] = min(lines.get(x, (math.inf, 0)), (d, i))
    up = {x: x for x in lines}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in lines:
        for y in lines:
            most = line_dedup.allowed(min(len(x), len(y)), edits)
            if abs(len(x) - len(y)) <= most and root(x) != root(y) and levenshtein(x, y) <= most:
                a, b = sorted((root(x), root(y)), key=lines.get)
                up[b] = a
    return {d: "\n".join(x for i, x in enumerate((t or "").split("\n")) if not (x in lines and lines[root(x)] != (d, i))) for d, t in docs}


def test_line_dedup(spark, odd, empty, monkeypatch):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(50)) for _ in range(4)]
    docs = [(i, "\n".join(mutated(rng, rng.choice(base), rng.randrange(4)) if rng.random() < 0.7 else "some unique line %d %d here" % (i, k) for k in range(4))) for i in range(60)]
    docs += [(100, docs[3][1]), (101, ""), (102, "a b\na b")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    options = {"edits": ((20, 2),), "least_words": 3}
    want = expected_lines(docs, ((20, 2),), 3)
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup(frame, **options).collect()} == want
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup(frame, most=0, **options).collect()} == want  # by joins
    kept = {r["doc_id"]: r["text"] for r in line_dedup.keep(frame, **options).collect()}
    assert kept == {d: want[d] for d, t in docs if want[d].strip() or not t.strip()}
    monkeypatch.setattr(line_dedup, "FEW", 2)  # ties, families and blocks
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup(frame, **options).collect()} == want
    got = line_dedup.keep(odd)
    assert got.columns == odd.columns and {r["text"] for r in got.where("doc_id = 8").collect()} == {"line one is here\nother"}
    assert line_dedup.dedup(empty).count() == 0


def test_line_dedup_as_in_production(spark, monkeypatch):
    """The query's own thresholds, over lines of 10 to 450 characters, against brute force."""
    rng = random.Random(15)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (10, 23, 25, 40, 63, 64, 66, 100, 159, 162, 200, 399, 402, 450)]
    docs = [(i, "\n".join(mutated(rng, rng.choice(base), rng.randrange(5)) for _ in range(3))) for i in range(50)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = expected_lines(docs)
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup(frame).collect()} == want
    monkeypatch.setattr(line_dedup, "FEW", 2)
    monkeypatch.setattr(line_dedup, "BLOCK", 5)
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup(frame).collect()} == want


def test_short_lines_and_lines_without_blanks_are_deduped(spark):
    """By default, every line with a non-blank character counts."""
    url = "https://example.org/" + "".join("%x" % (i * 7 % 16) for i in range(60))
    docs = [(1, "Menu\n\n  \n漢字漢字\nabout us"), (2, "Menu\n\n  \nnew\n漢字漢字"), (3, url + "\nabout us"), (4, url[:40] + "x" + url[41:] + "\nMenu\nMenu")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    want = {1: docs[0][1], 2: "\n  \nnew", 3: url, 4: ""}
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup(frame).collect()} == want
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup(frame, most=0).collect()} == want
    assert {r["doc_id"]: r["text"] for r in line_dedup.keep(frame).collect()} == {k: v for k, v in want.items() if v}


def test_lm_scores(spark, odd, empty):
    texts = family(20)
    docs = list(enumerate(texts))
    rows = {r["doc_id"]: r for r in lm_scoring.score(spark.createDataFrame(docs, "doc_id long, text string"), most_words=16).collect()}
    tokens = lambda t: [*t.lower().encode().split(), b"\n"]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    counts = collections.Counter(w for i, t in docs if not held[i] for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in docs:
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[i], len(tokens(t)), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in tokens(t)) and r["score"] < 0
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), abs_tol=1e-6)
    assert lm_scoring.score(odd).count() == len(ODD)
    assert lm_scoring.score(empty).count() == 0


def trained_model(texts, most_words=40, bits=12):
    tokens = lm_scoring.Tokens(texts)
    h, c = np.unique(tokens.hash, return_counts=True)
    order = np.argsort(-c, kind="stable")
    order = order[c[order] > 1][:most_words]
    by_byte = np.bincount(tokens.words.data, minlength=256)
    model = lm_scoring.Model(h[order], c[order], lm_scoring.Code([*c[order].tolist(), len(tokens.hash) - int(c[order].sum())]), lm_scoring.Code(by_byte), bits)
    model.learn(tokens, model.table.find(tokens.hash), 64)
    for mixer in (model.by_word, model.by_byte):
        mixer.tables, mixer.chart = [lm_scoring.states(t) for t in mixer.tables], lm_scoring.map_of(mixer.hits)
        mixer.finish()
    return model


def plain_log10(mixer, symbol, contexts, flag):
    """One symbol, decision by decision, in plain Python."""
    total, (a, b) = 0.0, mixer.gated
    for step in range(int(mixer.code.size[symbol])):
        at = int(mixer.code.start[symbol]) + step
        node, turn = int(mixer.code.node[at]), int(mixer.code.turn[at])
        x, grade = [float(mixer.code.static[node])], []
        for i, (bits, c, table) in enumerate(zip(mixer.bits, contexts, mixer.tables, strict=True)):

            def state(n):
                v = (int(c) ^ (n * 0x9E3779B1)) & 0xFFFFFFFF
                v = v * 0x85EBCA6B & 0xFFFFFFFF
                v ^= v >> 15
                return int(table[(v * 0xC2B2AE35 & 0xFFFFFFFF) >> (32 - bits)])

            here = 128 if i in mixer.rare and not state(len(mixer.code.static) - 1) >> 8 else state(node)
            x.append(((here & 255) - 128) / 10)
            grade.append(here >> 8)
        gate = 16 * int(flag) + 4 * grade[a] + grade[b]
        z = sum(v * float(w) for v, w in zip(x, mixer.weights[:, gate], strict=True))
        z = max(-lm_scoring.REACH, min(lm_scoring.REACH, z))
        cell = (max(-7.99, min(7.99, z)) + 8) * (lm_scoring.CELLS - 1) / 16
        low, chart = int(cell), mixer.chart[gate]
        p = 0.5 / (1 + math.exp(-z)) + 0.5 * (chart[low] * (1 - cell + low) + chart[low + 1] * (cell - low))
        total += math.log10(p if turn else 1 - p)
    return total


def test_lm_scores_against_plain_python():
    texts = family(12)[:20] + ["A b. A b. c", "", "never seen"]
    model = trained_model(texts)
    tokens = lm_scoring.Tokens(texts)
    ids = model.table.find(tokens.hash)
    got = model.log10(tokens, ids, 50)
    assert (ids < 0).any() and (ids >= 0).any()
    for k in range(len(ids)):
        want = plain_log10(model.by_word, ids[k] if ids[k] >= 0 else model.escape, [c[k] for c in tokens.contexts], tokens.flag[k])
        if ids[k] < 0 and tokens.word[k] >= 0:
            byte, contexts, flag, _ = tokens.spelt(np.array([k]))
            word = tokens.words.bytes_of(tokens.word[[k]])[0]
            assert bytes(byte.tolist()) == word + b" "
            want += sum(plain_log10(model.by_byte, b, [c[i] for c in contexts], flag[i]) for i, b in enumerate(byte.tolist()))
        assert math.isclose(got[k], want, rel_tol=0.01, abs_tol=0.01)


def test_lm_decisions_add_up_to_one():
    """Over all symbols of either code the probabilities in one context sum to 1."""
    model = trained_model(family(12)[:20])
    for mixer, n in ((model.by_word, model.escape + 1), (model.by_byte, 256)):
        for seed in range(3):
            contexts = [np.full(n, (seed * 7919 + i) * 2654435761 % 2**32, np.uint32) for i in range(len(mixer.bits))]
            p = 10 ** mixer.log10(np.arange(n), contexts, np.full(n, seed % 2, np.uint8))
            assert math.isclose(p.sum(), 1, abs_tol=1e-4)


def test_huffman_code_is_the_shortest():
    weights = [random.Random(4).randrange(1, 500) for _ in range(60)]
    code, heap = lm_scoring.Code(weights), sorted(w + 0.5 for w in weights)
    total = 0
    while len(heap) > 1:
        a, b = heap.pop(0), heap.pop(0)
        total += a + b
        heap = sorted([*heap, a + b])
    assert math.isclose(sum(n * (w + 0.5) for n, w in zip(code.size.tolist(), weights, strict=True)), total)


def test_contexts_start_anew_with_each_text():
    """A text is scored alike alone and behind others."""
    texts = ["one two. three", "x one two", "", "two"]
    model = trained_model(family(12)[:20] + texts)
    together = lm_scoring.Tokens(texts)
    got = np.bincount(together.doc, model.log10(together, model.table.find(together.hash)), len(texts))
    for t, s in zip(texts, got, strict=True):
        alone = lm_scoring.Tokens([t])
        assert math.isclose(model.log10(alone, model.table.find(alone.hash)).sum(), s, rel_tol=1e-6)


def test_word_order_counts(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)]
    texts = []
    for _ in range(150):
        k = rng.randrange(40)
        texts.append(" ".join(words[(k + i) % 40] for i in range(30)))
    ordered = list(enumerate(texts))
    mixed = [(1000 + i, " ".join(rng.sample(t.split(), 30))) for i, t in ordered]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    docs = ordered + [d for d in mixed if held(d[0])]
    rows = {r["doc_id"]: r["score"] for r in lm_scoring.score(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r["held_out"]}
    assert np.mean([v for i, v in rows.items() if i < 1000]) > 0.7 * np.mean([v for i, v in rows.items() if i >= 1000])


def test_trees_learn_and_traverse():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.5)).astype(float)
    model = gbdt.fit(x, y, rounds=30)
    assert ((model.proba(x) > 0.5) == y).mean() > 0.95
    one = model.base  # a plain walk down every tree
    for f, c, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
        node = 0
        for _ in range(model.depth):
            node = 2 * node + 1 + bool(x[7, f[node]] > c[node])
        one += leaf[node - (2**model.depth - 1)]
    assert math.isclose(model.raw(x[7:8])[0], one, rel_tol=1e-5)
    assert gbdt.fit(x[:0], y[:0]).proba(x[:2]).tolist() == [0.5, 0.5]


def corpus(spark, n=600):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeinrstlo") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(30, 120))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            for k in range(3):
                words[rng.randrange(len(words))] = "zork" + rng.choice(["ling", "er", "atron"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_classifiers_on_held_out_rows(spark, odd, empty, labels):
    docs, marks = corpus(spark)
    for module, column in ((quality_classifier, "quality"), (toxicity, "toxic")):
        rows = module.score(docs, marks).join(marks, "doc_id").where("held_out").collect()
        assert len(rows) > 60
        assert np.mean([r["predicted"] == r[column] for r in rows]) > 0.95
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
        for d, m in ((odd, labels), (odd, labels.limit(0)), (empty, labels)):
            got = module.score(d, m).collect()
            assert len(got) == d.count() and all(0 <= r["score"] <= 1 for r in got)
            assert module.keep(d, m).columns == d.columns


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.4
    rates = [(0.8, 0.02), (0.7, 0.05), (0.3, 0.01), (0.6, 0.3)]
    votes = np.column_stack([rng.random(4000) < np.where(y, a, b) for a, b in rates])
    votes = np.column_stack([votes, votes[:, 3]])  # a voter that repeats another
    post, model = toxicity.label_model(votes)
    assert ((post > 0.5) == y).mean() > 0.85
    assert model.rates[1, 0] > model.rates[1, 2]
    # the pair that repeats itself is an edge of the tree, and the repetition says next to nothing
    child, parent = (4, 3) if model.parent[4] == 3 else (3, 4)
    assert model.parent[child] == parent
    assert abs(model.given[1, 1, child] - model.given[0, 1, child]) < 0.02 and model.given[0, 1, child] > 0.98
    said = np.where(rng.random(4000) < 0.05, ~y, y)  # labels with errors
    assert ((toxicity.label_model(votes, said)[0] > 0.5) == y).mean() > 0.95
    assert len(toxicity.label_model(votes[:0])[0]) == 0


def test_host_rates_are_the_same_by_either_join(spark):
    docs = [(i, "word " * 60 if i % 3 else "a b", "h%d" % (i % 7) if i % 5 else None) for i in range(140)] + [(None, "x", None)] * 3
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = lambda **o: sorted(map(repr, quality_rules.judge(frame, **o).collect()))
    want = rows()
    assert "host_rate=None" not in "".join(want)
    assert rows(most_hosts=0) == want  # every host is large
    assert rows(most_hosts=0, share=6) == want  # only the null host is
    assert rows(most_hosts=0, share=1) == want  # none is


def test_host_rules(spark, odd, empty):
    rows = [(i, "a b c " * 40 if i % 4 else "word%d " % i + " ".join("w%d_%d" % (i, k) for k in range(60)), "bad" if i < 40 else "good") for i in range(80)]
    rows = [(i, t if h == "bad" else " ".join("w%d_%d" % (i, k) for k in range(60)), h) for i, t, h in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    salted = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, most_hosts=0).collect()}
    assert {i: r["kept"] for i, r in got.items()} == salted
    assert all(got[i]["kept"] for i in range(40, 80)) and not any(got[i]["kept"] for i in range(40) if i % 4)
    assert quality_rules.judge(odd).count() == len(ODD) and quality_rules.judge(empty).count() == 0


@pytest.mark.parametrize("text", ["", "a b c a b c", "a a a a", "x\nx\n\n\nx y", "é# *", "a b c d a b c", "one two"])
def test_counts(text):
    words = text.split()
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip()]
    want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))
    assert quality_rules.counts(text) == want


def brute_groups(docs, n, num, den):
    sets = {}
    for d, t in docs:
        w = (t or "").lower().split()
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.mark.parametrize("n, num, share", [(3, 90, 1e-4), (3, 80, 1e-9), (5, 80, 0.05), (2, 70, 1e-9)])
def test_ngram_join(spark, monkeypatch, n, num, share):
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    docs = list(enumerate(family()))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.groups(frame, n, num, 100, share).collect()}
    assert got == brute_groups(docs, n, num, 100)


def test_classes_that_only_share_shingles_dont_meet_in_full(spark, monkeypatch):
    """Every 30 texts share one line; ties by it connect them, and a line in a chain connects all."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    lines = [" ".join(word() for _ in range(6)) for _ in range(20)]
    docs = []
    for i in range(240):
        own = [word() for _ in range(rng.randrange(8, 60))]
        docs.append(" ".join([*own, lines[i % 20], lines[(i // 20) % 20]]))
        if i % 6 == 0:
            docs.append(docs[-1] + " " + word())
    rows = list(enumerate(docs))
    monkeypatch.setattr(ngram_join, "FEW", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 10)
    monkeypatch.setattr(ngram_join, "WIDE", 16)
    sizes, links = [], ngram_join.true_links

    def spied(docs, named, family, rule):
        sizes.extend(r["count"] for r in family.groupBy("component").count().collect())
        return links(docs, named, family, rule)

    monkeypatch.setattr(ngram_join, "true_links", spied)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows, 3, 90, 100)
    assert max(sizes) <= 10


def test_bitmaps_lose_no_link():
    rng = np.random.default_rng(4)
    for rule in (ngram_join.Rule(3, 90, 100), ngram_join.Rule(5, 80, 100)):
        for size in (12, 90, 700):
            sets = []
            for _ in range(12):
                a = rng.integers(0, 2**63, size).astype(np.uint64)
                sets += [np.unique(np.concatenate([a[rng.random(size) > 0.05], rng.integers(0, 2**63, rng.integers(0, 3)).astype(np.uint64)])) for _ in range(4)]
            n, bits = np.array([len(s) for s in sets]), [ngram_join.bitmap(s) for s in sets]
            left = rng.random(len(sets)) < 0.5
            for side in (np.ones(len(sets), bool), left):
                label = ngram_join.near_forest(n, bits, side, rule)
                for i, a in enumerate(sets):
                    for j, b in enumerate(sets):
                        if (side.all() or (side[i] and not side[j])) and rule.linked(len(np.intersect1d(a, b)), len(a), len(b)):
                            assert label[i] == label[j]
                assert len(np.unique(label)) >= 12


def test_ngram_join_keeps_one(spark, odd, empty):
    docs = list(enumerate(family(20)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_groups(docs, 5, 80, 100)
    got = sorted(r["doc_id"] for r in ngram_join.keep_one(frame).collect())
    assert got == sorted(d for d, (size, root) in want.items() if size == 0 or root == d)
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 4").count() == 1 and kept.count() == len(ODD) - 1
    assert ngram_join.groups(odd).count() == len(ODD) and ngram_join.groups(empty).count() == 0


@pytest.mark.parametrize("copies, most, shuffled", [(1, 40, False), (4, 100, False), (1, 3, True)])
def test_keep_one_joins_the_shorter_list(spark, copies, most, shuffled):
    """What stays grows with the corpus; texts are shuffled only where what goes is beyond the bound too."""
    rng = random.Random(5)
    own = [" ".join(rng.choices("abcdefgh", k=30)) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(own)] + [(100 + i, t) for i, t in enumerate((own * copies)[: 20 if copies == 1 else None])]
    rows += [(7, own[7]), (7, own[7]), (None, "one of a kind"), (None, "one of a kind"), (200, ""), (200, ""), (201, None)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), most_broadcast=most)
        assert ("SortMergeJoin" in kept._jdf.queryExecution().executedPlan().toString()) == shuffled
        got = sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == sorted([*((str(i), t) for i, t in enumerate(own)), ("None", "one of a kind"), ("200", ""), ("200", ""), ("201", "")])


def test_signatures_are_shared_within_the_threshold():
    rng = np.random.default_rng(8)
    rule = ngram_join.Rule(3, 80, 100)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(4, 120)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.08], rng.integers(0, 2**63, rng.integers(0, 6)).astype(np.uint64)]))
        both = np.union1d(a, b)
        often = both[rng.random(len(both)) < rng.choice([0, 0.5, 1])]
        inter = len(np.intersect1d(a, b))
        if rule.linked(inter, len(a), len(b)) and inter < len(both):
            x, y = (np.concatenate(ngram_join.signatures(s, np.isin(s, often), rule)) for s in (a, b))
            assert len(np.intersect1d(x, y))


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1100)]
    forest = components.Forest()
    for a, b in pairs:
        forest.join(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame([p for p in pairs if p[0] != p[1]], "a long, b long")).collect()}
    assert got == {x: forest.root(x) for p in pairs if p[0] != p[1] for x in p}


def test_byte_bpe(spark, odd, empty):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choice(rng.choice(["ab", "abcdefgh thes", "aé \n\t x1 2", "日本 🙂\x1c\x85 !?", "  \n ab"])) for _ in range(rng.choice([0, 1, 5, 300]))) for _ in range(300)]
    texts += ["a" * 3000, "ab" * 700, "don't they'll", " lead", "trail ", "a  b", "\nq", "q\n", "a\n\nb"]
    own = bpe.ByteBpe(BYTES, public_tokenizers.PATTERN)
    for t, ids in zip(texts, own.encode_batch(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(t) and own.decode(ids) == t.encode()
    rows = bpe.encode(odd, BYTES, public_tokenizers.PATTERN, with_ids=True).collect()
    want = sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in ODD)
    assert sorted((str(r["doc_id"]), r["decoded_sha256"]) for r in rows) == want
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in rows) and bpe.encode(empty, BYTES, public_tokenizers.PATTERN).count() == 0


def test_word_tokenizer():
    from tokenizers import Tokenizer

    from lexiloom.llm import word_tokenizer

    library, own = Tokenizer.from_file(WORDS), word_tokenizer.WordBpe(WORDS)
    texts = [t or "" for _, t, _ in ODD] + ["İstanbul ΣΑΣ é ﬁ x y \x85z a.b,c. 12 1,000 it's 'sup'", "a​b ﻿q ÀÖ ß ǅ Ⅷ ²"]
    for t, ids in zip(texts, own.encode_batch(texts), strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, marks = corpus(spark, 200)
    docs = docs.union(spark.createDataFrame([(900, "x"), (901, None), (902, "x")], "doc_id long, text string"))
    docs = docs.union(docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 1000))
    full = docs.withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    full.write.parquet(str(tmp_path / "documents.parquet"))
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, at = at, stage(spark, at, str(tmp_path)).cache()
        assert at.columns == full.columns, name
        assert {r["doc_id"] for r in at.collect()} <= {r["doc_id"] for r in before.collect()}
    left = {r["doc_id"]: r["text"] for r in at.collect()}
    known = {r["doc_id"]: (r["quality"], r["toxic"]) for r in marks.collect()}
    assert not any(i - 1000 in left for i in left)
    assert sum(known[i] == (1, 0) for i in left if i in known) / sum(k == (1, 0) for k in known.values()) > 0.9
    assert not any(known[i][1] for i in left if i in known)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == set(left)


def test_packing_leaves_little_in_its_worker(spark, monkeypatch):
    """A worker outlives its task: what packing remembers of words goes with the task, and ids stay the same."""
    from lexiloom.llm import word_tokenizer

    monkeypatch.setattr(word_tokenizer, "IDLE", 50)
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(20)]
    own = word_tokenizer.WordBpe(WORDS)
    before = [x.tolist() for x in own.encode_batch(texts)]
    assert own.table.n > 50
    own.rest()
    assert own.table.n == 0 and own.used == 0 and [x.tolist() for x in own.encode_batch(texts)] == before
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)

    def left(frames):
        import pandas as pd

        for pdf in frames:
            pass
        yield pd.DataFrame({"n": [sum(t.table.n for t in word_tokenizer._LOADED.values())]})

    many = spark.createDataFrame([(i, " ".join(f"{a}{i}q" for a in range(6000))) for i in range(30)], "doc_id long, text string").coalesce(1)
    assert packing.token_table(docs, WORDS).count() == 20
    assert packing.token_table(many, WORDS).count() == 30
    assert all(r["n"] <= 100_000 for r in spark.range(8).repartition(4).mapInPandas(left, "n long").collect())
