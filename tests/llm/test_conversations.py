"""Conversation repair against all edit strings of small conversations, and its odd cases."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lexiloom.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, gone boolean, position int, cost string, edit int"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def first_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def by_all_edits(rows, inserts=3):
    """Cheapest (cost, audit, repaired rows): every way of up to so many inserts in each gap."""
    faults, best = first_faults(rows), None
    per_row = [("D",) if f in ("blank", "duplicate") else ("K", "Ru", "Ra", "D") for f in faults]
    gaps = [""] + ["".join(x) for n in range(1, inserts) for x in itertools.product("ua", repeat=n)]
    for edits in itertools.product(*per_row):
        for filled in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for i, gap in enumerate(filled):
                for role in gap:
                    cost, audit = cost + 2, audit + "I"
                    out.append(({"u": "user", "a": "assistant"}[role], ""))
                if i < len(rows):
                    e = edits[i]
                    audit += e[0]
                    cost += {"K": 0, "R": 2, "D": 3}[e[0]] + (faults[i] == "truncated" and e != "D")
                    if e != "D":
                        out.append(({"K": rows[i][0], "Ru": "user", "Ra": "assistant"}[e], rows[i][1]))
            if GRAMMAR.fullmatch("".join(r[:1] or "?" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def test_against_all_edits(spark):
    draw = random.Random(5)
    convs = {i: sorted((draw.choice(["user", "assistant", "system", "tool", ""]), draw.choice(["a.", "b", " ", "c!", "d?"])) for _ in range(draw.randrange(0, 4))) for i in range(70)}
    convs = {i: draw.sample(x, len(x)) for i, x in convs.items()}
    rows = [(i, k, *x, False, 1, "x", 2) for i, conv in convs.items() for k, x in enumerate(conv)]
    got = {r["conv_id"]: r for r in c.digests(c.repair(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert set(got) == {i for i, x in convs.items() if x}
    for i, conv in convs.items():
        if conv:
            cost, audit, out = by_all_edits(conv)
            r = got[i]
            assert (r["cost"], r["audit"]) == (cost, audit), conv
            assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
            faults = first_faults(conv)
            assert [r[k] for k in ("blank", "duplicate", "truncated")] == [faults.count(k) for k in ("blank", "duplicate", "truncated")]
            pairs = ["".join(x) for x in itertools.pairwise([a[:1] for a, _ in conv])]
            assert r["illegal"] == sum(p not in ("su", "ua", "au") for p in pairs)


def test_long_conversations_settle_as_they_go():
    """What waits stays small, and the result is that of a pass that carries whole audits."""
    draw = random.Random(1)
    now, layer, most = c.Conversation(1), c.closed([(0, ""), None, None, None]), 0
    out = []
    for k in range(4000):
        role, text = draw.choice(["user", "assistant", "system"]), draw.choice([f"t{k}.", f"t{k}", " "])
        now.add(k, role, text)
        fault = first_faults([(role, text)])[0]
        layer = c.step(layer, role[:1], fault == "blank", fault == "truncated")
        out += now.settled()
        most = max(most, len(now.waiting))
    out += now.end()
    cost, audit = min(x for x in (layer[c.START], layer[c.ASSISTANT]) if x)
    assert (now.count["cost"], "".join(now.audit)) == (cost, audit) and most < 200
    assert GRAMMAR.fullmatch("".join(x[3][0] for x in out if x[1] is not None))


def test_repaired_rows_and_odd_cases(spark):
    rows = [
        (1, 0, "user", "Hi.", False, 0, "", 0), (1, 2, "assistant", "Yes", False, 0, "", 0),
        (2, None, "user", None, False, 0, "", 0), (3, 1, "user", "a.", True, 0, "", 0),
        (None, 5, None, "x.", False, 0, "", 0), (None, 5, None, "x.", False, 0, "", 0),
        (4, None, "assistant", "y" * 100_000 + ".", False, 0, "", 0), (4, 3, "user", "q?", False, 0, "", 0),
    ]
    repaired = c.repair(spark.createDataFrame(rows, SCHEMA))
    turns = {i: [(r["turn"], r["role"], r["edit"]) for r in sorted(g, key=lambda r: r["position"])] for i, g in itertools.groupby(sorted(repaired.where("position is not null").collect(), key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0)), key=lambda r: r["conv_id"])}
    assert turns[1] == [(0, "user", "K"), (2, "assistant", "K")]
    assert turns[4] == [(None, "user", "I"), (None, "assistant", "K"), (3, "user", "K"), (None, "assistant", "I")]
    assert None not in turns and 2 not in turns
    whole = {r["conv_id"]: r for r in c.digests(repaired).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert whole[2]["audit"] == "D" and whole[2]["repaired_sha256"] == nothing and whole[2]["blank"] == 1
    assert whole[3]["audit"] == "" and whole[3]["cost"] == 0 and whole[3]["n_rows"] == 0 and whole[3]["repaired_sha256"] == nothing
    assert whole[1]["gaps"] == 1 and whole[1]["truncated"] == 1 and whole[4]["gaps"] == 0 and (whole[None]["duplicate"], whole[None]["audit"]) == (1, "DD")
    assert c.digests(c.repair(spark.createDataFrame([], SCHEMA))).count() == 0


def test_damage(spark):
    rows = [(i, t, "system", f"A. b! {i}?", False, 0, "", 0) for i in range(60) for t in (0, 1, None)] + [(None, None, None, None, False, 0, "", 0)]
    got = {}
    for r in c.damaged(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"], r["gone"]))
    kinds = set()
    for i, t, *_ in rows:
        kind = zlib.crc32(f"{' ' if i is None else i}:{' ' if t is None else t}".encode()) % 20
        text, role = (" ", " ") if i is None else (f"A. b! {i}?", "system")
        text = {0: "", 1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        assert got[i, t] == [("user" if kind == 4 else role, text, kind == 0)] * (2 if kind == 3 else 1)
        kinds.add(min(kind, 5))
    assert kinds == {0, 1, 2, 3, 4, 5}


@pytest.mark.parametrize("column", ["conv_id", "turn", "role", "text"])
def test_nulls_in_every_column(spark, column):
    rows = spark.createDataFrame([(1, 0, "user", "a.", False, 0, "", 0), (1, 1, "assistant", "b.", False, 0, "", 0)], SCHEMA)
    kind = dict(rows.dtypes)[column]
    out = c.digests(c.repair(c.damaged(rows.withColumn(column, F.lit(None).cast(kind))))).collect()
    assert len(out) == 1
