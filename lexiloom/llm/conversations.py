"""Repair of conversations to the grammar ``(system? (user assistant)+)?``.

Every row of a conversation is kept, gets another role or is deleted, and empty turns are inserted, at least
cost. The states of the grammar are start, after system, after user and after assistant; a forward Viterbi pass
carries for each the minimum of (cost, audit string), where the audit holds the edits' initials in order. A turn's
layer is closed by inserts: two reach every state that can be reached, and more would only come back at a higher
cost. An audit fixes the cost and the repaired rows, so of two audits of one layer with equal cost neither begins
the other and their order never changes: the minimum of a state is final, and ties go to the least string.

A conversation streams through one task in the order of its turns, as its digest and its order ask for. States that
can't win any more are given up, and what all others have in common is settled and handed on, so texts wait only
until the survivors agree; per distinct turn 16 bytes stay, by which repeated ones are known. Spark deals
conversations by id and sorts them on disk.

Edge cases: null roles and texts count as one space (a blank row of no role); null turns come first, null ids are
one conversation; rows of one turn are ordered by role and text; an empty role is none of the grammar's; a
conversation without rows left, or with all rows deleted, has no repaired rows; an empty table gives no rows; texts are
taken whole; further columns are not read.
"""

from __future__ import annotations

import hashlib
import os.path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, lean

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_SPACE = " \t\n\x0b\x0c\r"
COUNTS = ("n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SCHEMA = "conv_id long, position long, turn long, role string, text string, edit string, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string"
_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("position", pa.int64()), ("turn", pa.int64()), *[(c, pa.string()) for c in ("role", "text", "edit")], *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string())]
)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows damaged by the check sum of ``conv_id:turn`` modulo 20: 0 drops a row (it stays with ``gone``, so that its
    conversation is known), 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's."""
    space = F.lit(" ")
    named = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(named[0], F.lit(":"), named[1])) % 20
    told = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), named[2].alias("role"), named[3].alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") < 2, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("time")
    return told.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), times).drop("time")


def after(state: int, initial: str) -> int | None:
    """The state that a turn with this role initial leads to, if the grammar takes it."""
    if state == USER:
        return ASSISTANT if initial == "a" else None
    if initial == "u":
        return USER
    return SYSTEM if initial == "s" and state == START else None


def wanted(state: int) -> int:
    """The state that an inserted turn, or one whose role is set, leads to."""
    return ASSISTANT if state == USER else USER


def closed(layer: list) -> list:
    """The layer with up to two inserts after each state."""
    for _ in range(2):
        for state in range(4):
            if layer[state] is not None:
                cost, audit = layer[state]
                to, new = wanted(state), (cost + INSERT, audit + "I")
                if layer[to] is None or new < layer[to]:
                    layer[to] = new
    return layer


def step(layer: list, initial: str, must_go: bool, truncated: bool) -> list:
    """The closed layer after one more row."""
    new: list = [None] * 4

    def offer(state, cost, audit):
        if new[state] is None or (cost, audit) < new[state]:
            new[state] = (cost, audit)

    for state in range(4):
        if layer[state] is None:
            continue
        cost, audit = layer[state]
        offer(state, cost + DELETE, audit + "D")
        if not must_go:
            stays = cost + TRUNCATED * truncated
            kept = after(state, initial)
            if kept is not None:
                offer(kept, stays, audit + "K")
            offer(wanted(state), stays + REROLE, audit + "R")
    return pruned(closed(new))


def pruned(layer: list) -> list:
    """Without states that can't win: whatever follows a system turn can follow an assistant's too, which may also
    end; from the start alone a system turn can be kept, which the assistant's state can delete instead."""
    last = layer[ASSISTANT]
    if last is not None:
        if layer[SYSTEM] is not None and layer[SYSTEM] > last:
            layer[SYSTEM] = None
        if layer[START] is not None and layer[START][0] > last[0] + DELETE:
            layer[START] = None
    return layer


class Conversation:
    """The pass over one conversation; ``add`` takes its rows in order, and ``settled`` and ``end`` give repaired rows."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.layer = pruned(closed([(0, ""), None, None, None]))
        self.waiting: list[tuple] = []  # rows whose edits aren't settled
        self.state, self.position, self.audit = START, 0, []
        self.seen: set[bytes] = set()
        self.count = dict.fromkeys(COUNTS, 0)
        self.low = self.high = self.turn = self.initial = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        count, initial, bare = self.count, role[:1], text.rstrip(_SPACE)
        count["n_rows"] += 1
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        if self.initial is not None:
            count["illegal"] += self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        key = hashlib.blake2b(b"%d:" % len(role) + (role + text).encode("utf-8", "replace"), digest_size=16).digest()
        blank, again = not bare, key in self.seen
        self.seen.add(key)
        cut = not blank and not again and bare[-1] not in ".!?"
        count["blank"] += blank
        count["duplicate"] += again and not blank
        count["truncated"] += cut
        self.layer = step(self.layer, initial, blank or again, cut)
        self.waiting.append((turn, role, text))

    def settled(self):
        """Repaired rows by the edits that all survivors share."""
        alive = [x for x in self.layer if x is not None]
        shared = os.path.commonprefix([audit for _, audit in alive])
        if shared:
            self.layer = [x and (x[0], x[1][len(shared) :]) for x in self.layer]
            yield from self.told(shared)

    def told(self, edits: str):
        self.audit.append(edits)
        at = 0
        for edit in edits:
            turn, role, text = (None, "", "") if edit == "I" else self.waiting[at]
            at += edit != "I"
            if edit == "D":
                continue
            self.state = after(self.state, role[:1]) if edit == "K" else wanted(self.state)
            yield (self.conv_id, self.position, turn, role if edit == "K" else ROLES[self.state], text, edit, *[None] * (len(COUNTS) + 1))
            self.position += 1
        del self.waiting[:at]

    def end(self):
        """The rest of the repaired rows, and the row of the conversation."""
        cost, rest = min(x for x in (self.layer[START], self.layer[ASSISTANT]) if x is not None)
        yield from self.told(rest)
        self.count["cost"] = cost
        self.count["gaps"] = 0 if self.low is None else self.high - self.low + 1 - self.turns
        yield (self.conv_id, *[None] * 5, *self.count.values(), "".join(self.audit))


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


def repair(rows: DataFrame) -> DataFrame:
    """Repaired rows of (``conv_id``, ``turn``, ``role``, ``text``; optional ``gone``), in order, and after them one row
    of each conversation whose ``position`` is null.

    A repaired row has its ``position``, ``turn`` (null if inserted), ``role``, ``text`` and ``edit`` (K, R or I). The row of
    the conversation has the counts of first faults, ``gaps`` of turns, ``illegal`` pairs of roles, ``cost`` and ``audit``. Rows
    with ``gone`` count for nothing but that there is such a conversation.
    """
    if "gone" not in rows.columns:
        rows = rows.withColumn("gone", F.lit(False))
    told = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), "gone",
    )
    ordered = told.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        now: Conversation | None = None
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for conv, turn, role, text, gone in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        out += now.end()
                    now = Conversation(conv)
                if gone:
                    continue
                now.add(turn, role, text)
                size += len(text)
                if len(now.waiting) % 32 == 0 or size > BATCH_BYTES:
                    out += now.settled()
                    if size > BATCH_BYTES:
                        yield batch_of(out)
                        out, size = [], 0
            yield batch_of(out)
        if now is not None:
            yield batch_of(list(now.end()))

    return ordered.mapInArrow(lean(run), SCHEMA)


def digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``'s result, with ``repaired_sha256`` of its ``role:text`` rows joined by line
    ends. It reads the rows in the order they come in, in the same task."""

    def run(batches):
        sha, started = hashlib.sha256(), False
        for batch in batches:
            found, at = [], []
            for i, (position, role, text) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("position", "role", "text")], strict=True)):
                if position is None:
                    found.append(sha.hexdigest())
                    at.append(i)
                    sha, started = hashlib.sha256(), False
                    continue
                sha.update((("\n" if started else "") + f"{role}:{text}").encode("utf-8", "replace"))
                started = True
            kept = batch.select(["conv_id", *COUNTS, "audit"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.string())], names=[*kept.schema.names, "repaired_sha256"])

    return repaired.mapInArrow(lean(run), "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")
