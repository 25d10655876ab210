"""Conversation structure repair.

A conversation should be an optional system turn and then pairs of a user and an assistant turn, or
nothing. Turns may be kept, given another role, deleted, or inserted empty, at a price each.

Dynamic programming over retained subsequences: a state is the role of the last retained turn. A turn
retained in a role follows the cheapest retained turn of each role before it; all between are deleted,
which prefix sums of deletions price, so that one running minimum a role stands for all places before.
The pair of roles tells which turns must be inserted between the two. Among equal prices the edits whose
initials are ASCII-least win: the four minima are kept in the order of their audits, which one more edit
each can only refine, so audits are never compared as strings.

One pass streams a conversation's turns in order. It holds four running hashes of repaired text and four
bytes a turn, no texts, since a repaired conversation's digest and audit are one row by definition.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: What the edits cost, and what an unfinished turn that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Blank characters, and what a finished text ends with.
BLANKS, ENDS = r"\x20\x09-\x0D", ".!?"
FULL = {"u": "user", "a": "assistant"}
#: States: nothing retained yet, or the role of the last retained turn.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = ("", "s", "u", "a")
#: (from, to): the roles that must be inserted between two retained turns; pairs not named cannot follow.
BETWEEN = {
    (START, SYSTEM): "", (START, USER): "", (SYSTEM, USER): "", (ASSISTANT, USER): "", (USER, USER): "a", (USER, ASSISTANT): "", (START, ASSISTANT): "u", (SYSTEM, ASSISTANT): "u", (ASSISTANT, ASSISTANT): "u",
}
#: What must be inserted at the end.
AFTER = {START: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}
#: A step's code in the path: its edits by number.
STEPS = ("D", "K", "R", "IK", "IR")
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Best(NamedTuple):
    """The cheapest way to a state: its price without the deletions of the whole prefix, and its text's running hash."""

    price: int
    digest: object
    begun: bool


class Repair:
    """The programme over one conversation; ``add`` takes its turns in order."""

    def __init__(self):
        self.minima: list[Best | None] = [Best(0, hashlib.sha256(), False), None, None, None]
        self.order = [0, 0, 0, 0]  # rank of each state's audit
        self.deleted = 0  # prefix sum of deletions
        self.path = bytearray()  # a turn's four steps, each 8 * parent + edit
        self.initial: str | None = None
        self.turns: tuple[int, int, int] | None = None  # least, last and number of distinct turns
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if turn is not None:
            least, last, n = self.turns or (turn, None, 0)
            self.turns = (least, turn, n + (turn != last))
        initial = role[:1]
        if self.initial is not None and (self.initial, initial) not in LEGAL:
            self.counts["illegal"] += 1
        self.initial = initial
        if fault:
            self.counts[fault] += 1
        # (price, rank of the parent's audit, edits, parent) of each way to a state; deleting the turn keeps the state.
        ways: list[list[tuple]] = [[] if (m := self.minima[q]) is None else [(m.price, self.order[q], "D", q)] for q in range(4)]
        if fault not in ("blank", "duplicate"):
            own = (TRUNCATED if fault == "truncated" else 0) - DELETE  # against the prefix sum, which has this turn deleted
            for (p, r), missing in BETWEEN.items():
                kept = initial == INITIALS[r]
                if (m := self.minima[p]) is not None and (kept or r != SYSTEM):
                    price = m.price + own + INSERT * len(missing) + (0 if kept else REROLE)
                    ways[r].append((price, self.order[p], "I" * len(missing) + ("K" if kept else "R"), p))
        best = [min(w) if w else None for w in ways]
        self.deleted += DELETE
        minima: list[Best | None] = []
        for q, b in enumerate(best):
            if b is None:
                minima.append(None)
                self.path.append(255)
                continue
            price, _, edits, p = b
            self.path.append(8 * p + STEPS.index(edits))
            m = self.minima[p]
            if edits != "D":
                said = [f"{FULL[x]}:" for x in BETWEEN[p, q]] + [f"{role if edits[-1] == 'K' else FULL[INITIALS[q]]}:{text}"]
                m = written(m, said)
            minima.append(Best(price, m.digest, m.begun))
        ranked = sorted((b[1], b[2], q) for q, b in enumerate(best) if b is not None)
        for rank, (_, _, q) in enumerate(ranked):
            self.order[q] = rank
        self.minima = minima

    def result(self) -> tuple:
        """gaps, the counts, cost, audit, repaired_sha256."""
        ends = [(m.price + self.deleted + INSERT * len(AFTER[q]), self.order[q], q) for q, m in enumerate(self.minima) if m is not None]
        cost, _, q = min(ends)
        digest = written(self.minima[q], [f"{FULL[x]}:" for x in AFTER[q]]).digest.hexdigest()
        edits, tail = [], "I" * len(AFTER[q])
        for at in range(len(self.path) - 4, -1, -4):
            step = self.path[at + q]
            edits.append(STEPS[step % 8])
            q = step // 8
        gaps = 0 if self.turns is None else self.turns[1] - self.turns[0] + 1 - self.turns[2]
        return (gaps, *self.counts.values(), cost, "".join(reversed(edits)) + tail, digest)


def written(m: Best, turns: list[str]) -> Best:
    """A way with more repaired turns in its hash."""
    if not turns:
        return m
    digest = m.digest.copy()
    digest.update((("\n" if m.begun else "") + "\n".join(turns)).encode())
    return Best(m.price, digest, True)


def in_order(turns: DataFrame) -> DataFrame:
    """Turns with their fault, conversation by conversation and in order: one shuffle by conv_id.

    ``turns``: conv_id, turn, role, text; optionally ``gone`` (the row only names its conversation), and
    ``order_role``, ``order_text``, ``copy``, which settle equal turns before role and text do.
    """
    have = turns.columns
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"),
        (F.coalesce("gone", F.lit(False)) if "gone" in have else F.lit(False)).alias("gone"), *[(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in ("order_role", "order_text")], (F.col("copy") if "copy" in have else F.lit(0)).cast("int").alias("copy"),
    )
    order = [F.asc_nulls_first("turn"), F.coalesce("order_role", "role"), F.coalesce("order_text", "text"), "copy"]
    seen = F.row_number().over(W.partitionBy("conv_id", "gone", "role", "text").orderBy(*order)) > 1
    last = F.regexp_extract("text", rf"([^{BLANKS}])[{BLANKS}]*\z", 1)
    fault = F.when(last == "", "blank").when(seen, "duplicate").when(~F.lit(ENDS).contains(last), "truncated").otherwise("")
    return t.repartition("conv_id").withColumn("fault", fault).sortWithinPartitions(F.asc_nulls_first("conv_id"), *order)


def repaired(turns: DataFrame) -> DataFrame:
    """One row a conversation: gaps in its turns, rows by fault, illegal neighbours, the cheapest repair's cost, audit and digest.

    Rows are taken in the order of turn, null first, equal ones in that of role and text. Null roles and
    texts are one space. Rows repeated whole are duplicates, so all but the first are deleted. Rows
    without a conv_id are one conversation. Texts of any length are hashed as they pass; a conversation
    of which all rows are ``gone`` has zeros and an empty audit; an empty table gives an empty result;
    other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now: tuple | None = None
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                for conv, turn, role, text, gone, fault in zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "fault")), strict=True):
                    if now is None or now[0] != conv:
                        if now is not None:
                            done.append((now[0], *now[1].result()))
                        now = (conv, Repair())
                    if not gone:
                        now[1].add(turn, role, text, fault)
            if done:
                yield as_batch(done)
                done = []
        if now is not None:
            yield as_batch([(now[0], *now[1].result())])

    return in_order(turns).select("conv_id", "turn", "role", "text", "gone", "fault").mapInArrow(run, REPAIRED)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in REPAIRED.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def audit_steps(audit: str) -> list[tuple[str, int | None, str | None]]:
    """(edit, number of the turn it takes from 0, role initial afterwards) of an audit; inserted turns have no number, deleted ones no role."""
    left = len(audit) - audit.count("D")
    roles = iter(("s" if left % 2 else "") + "ua" * (left // 2))
    out, at = [], 0
    for edit in audit:
        out.append((edit, None if edit == "I" else at, None if edit == "D" else next(roles)))
        at += edit != "I"
    return out


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, step, edit (K, R or I), turn, role, text, in the order of step.

    Each audit is read as edits and joined with the turns by place; inserted turns have no turn number
    and an empty text. Conditions are those of ``repaired``.
    """
    place = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.coalesce("order_role", "role"), F.coalesce("order_text", "text"), "copy")
    said = in_order(turns).filter("not gone").withColumn("at", (F.row_number().over(place) - 1).cast("long"))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, audit in zip(batch.column("conv_id").to_pylist(), batch.column("audit").to_pylist(), strict=True):
                found = [(i, *s) for i, s in enumerate(audit_steps(audit))]
                for k in range(0, len(found), 10_000):
                    part = found[k : k + 10_000]
                    columns = [[conv] * len(part), *([s[i] for s in part] for i in range(4))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["conv_id", "step", "edit", "at", "initial"])

    edits = repaired(turns).select("conv_id", "audit").mapInArrow(steps, "conv_id long, step long, edit string, at long, initial string").filter("edit <> 'D'").alias("e")
    own = said.select("conv_id", "at", "turn", "role", "text").alias("t")
    joined = edits.join(own, F.col("e.conv_id").eqNullSafe(F.col("t.conv_id")) & (F.col("e.at") == F.col("t.at")), "left")
    new = F.when(F.col("e.initial") == "u", "user").otherwise("assistant")
    return joined.select("e.conv_id", "e.step", "e.edit", "t.turn", F.when(F.col("e.edit") == "K", F.col("t.role")).otherwise(new).alias("role"), F.coalesce("t.text", F.lit("")).alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties it, 2 takes its ``.!?``, 3 repeats it, 4 makes it a user's.

    Nulls are one space, in the key too. Dropped rows stay as ``gone``, so that their conversation is
    known; equal turns are ordered by their role and text before the damage.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20)).cast("int")
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    k = F.col("kind")
    text: Column = F.when(k == 1, "").when(k == 2, F.regexp_replace("text", f"[{re.escape(ENDS)}]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return c.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (k == 0).alias("gone"), F.when(k == 4, F.col("role")).alias("order_role"), F.when(k.isin(1, 2), F.col("text")).alias("order_text"), copies)
