"""Personal data: base spans against plain patterns, bootstrapping against plain Python, and odd cases."""

import collections
import hashlib
import math
import random
import re
import time

import pytest

from lexiloom.llm import pii, queries

SCHEMA = "doc_id long, text string, key long, base int, found string, kind int, value int"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for place, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            if kind == "card":
                double = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
                if not 14 <= len(digits) <= 19 or sum(x - 9 * (x > 9) for x in double) % 10:
                    continue
            out.append((m.start(), place, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_plain_patterns():
    draw = random.Random(9)
    for alphabet in ("a@.-%é ", "0129. ", "0123456789 -", "+0123() .-", "a1@.+ -()2é\n"):
        for _ in range(1500):
            text = "".join(draw.choices(alphabet, k=draw.randrange(60)))
            assert pii.base_spans(text) == plain_spans(text), text
    card = "4111 1111-1111 1111"
    assert pii.base_spans(f"x {card} +1 (743) 555-3824 a.b@c.d.e 1.2.3.4.5.6.7.8 300.1.1.1") == plain_spans(f"x {card} +1 (743) 555-3824 a.b@c.d.e 1.2.3.4.5.6.7.8 300.1.1.1")


def test_time_grows_with_the_length():
    began = time.time()
    for text in ("1" * 400_000, "1." * 200_000, "a" * 400_000, "a@" * 200_000, "+1 " * 130_000, "1 " * 200_000, "at " * 130_000, "(at)" * 100_000):
        base = pii.base_spans(text)
        list(pii.looks(text, base))
    assert time.time() - began < 60


def luhn(prefix):
    return next(prefix + str(d) for d in range(10) if pii.luhn(prefix + str(d)))


def bootstrapped(texts, least=pii.LEAST, accept=pii.ACCEPT):
    """The same rounds in plain Python: (text number, kind, start, end) added."""
    found, edges, allowed, filled, seeds = [], collections.defaultdict(set), collections.Counter(), collections.Counter(), {}
    for i, t in enumerate(texts):
        base = pii.base_spans(t)
        for lo, hi, kinds, seed in [(lo, hi, 1 << k, True) for lo, k, hi in base] + [(*x, False) for x in pii.looks(t, base)]:
            v = pii.value(kinds, t[lo:hi])
            found.append((i, lo, hi, seed, v))
            allowed[v] |= kinds
            if seed:
                seeds.setdefault(v, set()).add(kinds.bit_length() - 1)
            for p in pii.contexts(t, lo, hi):
                edges[p].add(v)
                filled[p] += 1
    slots = collections.Counter()
    for t in texts:
        w = re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m.group().lower(), t)).split()
        if w:
            slots.update([f"1 {x}" for x in [*w, "^"]] + [f"2 {a} {b}" for a, b in zip(w, w[1:], strict=False)] + [f"3 {a} {b}" for a, b in zip(["^", *w], [*w[1:], "$"], strict=False)])
    known, new = {v: set(k) for v, k in seeds.items()}, {}
    while True:
        score = collections.defaultdict(float)
        for p, values in edges.items():
            if len(values) >= least:
                for kind in range(4):
                    hits = sum(kind in known.get(v, ()) for v in values)
                    c = hits / (len(values) + 1) * min(1.0, filled[p] / max(filled[p], slots[p]))
                    if hits >= least and c >= 0.1:
                        for v in values:
                            if v not in known and allowed[v] >> kind & 1:
                                score[v, kind] += math.log(1 - c)
        top = {}
        for (v, kind), x in score.items():
            top[v] = max(top.get(v, (0, 0)), (round(1 - math.exp(x), 9), -kind))
        more = {v: -k for v, (x, k) in top.items() if x >= accept}
        if not more:
            return {(i, pii.KINDS[new[v]], lo, hi) for i, lo, hi, seed, v in found if not seed and v in new}
        new |= more
        known |= {v: {k} for v, k in more.items()}


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(2)
    words = lambda n: " ".join(draw.choices(["the", "of", "on", "house", "tree", "runs", "and", "a12", "b7"], k=n))
    digits = lambda n: "".join(draw.choices("123456789", k=n))
    texts = [f"{words(9)} card no: {luhn(digits(15))} {words(5)}" for _ in range(9)]
    texts += [f"{words(9)} Card no: {digits(13)}0 and {words(5)}" for _ in range(4)]  # not by Luhn, or too short
    texts += [f"{words(4)} call me {f'+1 {digits(10)}'} {words(4)}" for _ in range(8)]
    texts += [f"{words(4)} call me 0{digits(9)} now" for _ in range(5)]
    texts += [t.rsplit(" ", 1)[0].replace("call me", "ring back at") for t in texts[-5:]] + [f"ring back at 0{digits(8)} {words(2)}" for _ in range(2)]  # second round
    texts += [f"mail to: user{i}@mail{i}.org" for i in range(7)] + ["mail to: jane (at) example (dot) org", "mail to: root@localhost"]
    texts += [f"{words(5)} the {digits(16)} of {words(30)}" for _ in range(3)] + [f"{words(2)} the {luhn(digits(15))} house" for _ in range(6)]
    texts += [f"once id {luhn(digits(15))}"] * 50 + ["once id 1234567890123451"]  # copies are one instance
    return texts + [words(40) for _ in range(30)]


@pytest.mark.parametrize("most", [pii.MOST, 7])
def test_bootstrapping(spark, corpus, most):
    docs = spark.createDataFrame([(i, t, 1, 2, "x", 3, 4) for i, t in enumerate(corpus)], SCHEMA)
    rows = pii.find(docs, most=most).collect()
    got = {(r["doc_id"], x["kind"], x["start"], x["end"]) for r in rows for x in r["added"]}
    assert got == bootstrapped(corpus) and len(rows) == len(corpus)
    said = {(k, corpus[i][lo:hi]) for i, k, lo, hi in got}
    assert {("email", "jane (at) example (dot) org"), ("email", "root@localhost")} <= said
    assert len([1 for k, _ in said if k == "card"]) >= 3 and len([1 for k, _ in said if k == "phone"]) >= 7
    plain = [i for i, t in enumerate(corpus) if " the " in f" {t} " and not re.search("no:|me |back|id|to:", t)]
    assert not any(i in plain for i, *_ in got)
    for r in rows:
        assert [(x["start"], pii.KINDS.index(x["kind"]), x["end"]) for x in r["base"]] == plain_spans(corpus[r["doc_id"]])


def test_odd_cases(spark):
    text = "é漢 a@b.c"
    docs = spark.createDataFrame([(i, t, 1, 2, "x", 3, 4) for i, t in [(1, None), (2, ""), (None, text), (4, text), (4, text), (5, "a@b.c " * 20_000)]], SCHEMA)
    rows = pii.find(docs).collect()
    assert sorted(len(r["base"]) for r in rows) == [0, 0, 1, 1, 1, 20_000] and all(r["added"] == [] for r in rows)
    assert [tuple(x) for r in rows if r["doc_id"] is None for x in r["base"]] == [("email", 3, 8)]
    assert pii.find(docs.where("false")).count() == 0


def test_the_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op12_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    added = collections.Counter(i for i, *_ in bootstrapped([texts[i] for i in sorted(texts)]))
    for r in rows:
        base = plain_spans(texts[r["doc_id"]])
        said = ",".join(f"{pii.KINDS[k]}:{lo}:{hi}" for lo, k, hi in base)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in base) for i in range(4)]
        assert set(said.split(",")) <= set(r["spans"].split(",")) and r["n_added"] == added[sorted(texts).index(r["doc_id"])]
