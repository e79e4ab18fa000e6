"""Repair of the structure of conversations by generalised LR parsing.

The roles of a conversation shall read ``(s?(ua)+)?`` (system, user, assistant). An LR automaton is built from that
grammar; its stacks are linked lists that share their lower ends, and every row offers weighted actions to each stack top:
keep, change of role, deletion, each after insertions where they help. Stacks with equal tops are merged, the one with the least
(cost, audit) stays. As a row adds to a handful of tops only, a conversation streams through a task that holds, besides
the audit itself (a byte a row), a few blocks of it.

One exchange by conversation serves everything: Spark marks repeated rows by a window and sorts by turn, a task parses and
passes the rows on, the same partitions are sorted again so that the audit comes first, and the repaired rows stream out.
A conversation is in one task, as the digest of its repaired text can only be taken in order; its rows are never held.

Nulls in role and text are one space; a null conv_id is a conversation of its own; null turns come first and don't count
as gaps; rows of one turn go by role and text. Further columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: The grammar of the roles' initials, and what the edits cost.
GRAMMAR = (("Z", "C"), ("C", ""), ("C", "B"), ("B", "P"), ("B", "sP"), ("P", "ua"), ("P", "Pua"))
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: Faults of a row.
SOUND, BLANK, DUPLICATE, CUT, DROPPED = range(5)
#: Edits of a block of the audit.
BLOCK = 4096

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
PASSED = "conv_id long, _at long, role string, text string, audit string, counts array<long>"
REPAIRED = "conv_id long, position long, edit string, role string, text string"

Stack = tuple  # (state, stack below)


@lru_cache(None)
def automaton() -> tuple[list[frozenset], dict]:
    """LR(0) states (sets of rule and dot) and the moves between them."""

    def closed(items: Iterable[tuple[int, int]]) -> frozenset:
        found, todo = set(items), list(items)
        while todo:
            rule, dot = todo.pop()
            for k, (left, _) in enumerate(GRAMMAR):
                if GRAMMAR[rule][1][dot : dot + 1] == left and (k, 0) not in found:
                    found.add((k, 0))
                    todo.append((k, 0))
        return frozenset(found)

    states, moves = [closed([(0, 0)])], {}
    for state in states:
        ahead: dict[str, list] = {}
        for rule, dot in state:
            if dot < len(GRAMMAR[rule][1]):
                ahead.setdefault(GRAMMAR[rule][1][dot], []).append((rule, dot + 1))
        for symbol, items in sorted(ahead.items()):
            new = closed(items)
            if new not in states:
                states.append(new)
            moves[states.index(state), symbol] = states.index(new)
    return states, moves


@lru_cache(None)
def reduced(stack: Stack) -> tuple[Stack, ...]:
    """The stack and all that reductions make of it."""
    states, moves = automaton()
    found = [stack]
    for top in found:
        for rule, dot in sorted(states[top[0]]):
            left, right = GRAMMAR[rule]
            if rule and dot == len(right):
                below = top
                for _ in right:
                    below = below[1]
                new = moves[below[0], left], below
                if new not in found:
                    found.append(new)
    return tuple(found)


@lru_cache(None)
def shifted(stack: Stack, symbol: str) -> tuple[Stack, ...]:
    to = automaton()[1].get((stack[0], symbol))
    return () if to is None else reduced((to, stack))


@lru_cache(None)
def inserted(stack: Stack) -> tuple[tuple[int, Stack], ...]:
    """Every top that insertions reach, with the fewest of them."""
    found, seen = [(0, stack)], {stack[0]}
    for n, top in found:
        for symbol in ROLES:
            for new in shifted(top, symbol):
                if new[0] not in seen:
                    seen.add(new[0])
                    found.append((n + 1, new))
    return tuple(found)


@lru_cache(None)
def actions(stack: Stack, initial: str, fault: int) -> tuple[tuple[int, str, Stack], ...]:
    """Cost, edits and stack after a row."""
    found = [(DELETE, "D", stack)]
    if fault in (SOUND, CUT):
        extra = TRUNCATED * (fault == CUT)
        for n, top in inserted(stack):
            ways = [(0, "K", new) for new in shifted(top, initial)] + [(REROLE, "R", new) for s in ROLES for new in shifted(top, s)]
            found += [(INSERT * n + cost + extra, "I" * n + edit, new) for cost, edit, new in ways]
    return tuple(found)


class Block:
    """A stretch of an audit and the block before it."""

    __slots__ = "before", "edits"

    def __init__(self, before: Block | None, edits: str):
        self.before, self.edits = before, edits


def block(link) -> Block:
    """The chain of single edits since the last block, as a block of its own."""
    edits = []
    while not isinstance(link, Block):
        link, edit = link
        edits.append(edit)
    return Block(link, "".join(reversed(edits)))


class Parse:
    """The tops of a conversation's graph-structured stack, by state: cost, rank of the audit, audit, stack.

    After a row no audit is the beginning of another (each names every row once and ends in a row's edit), so that audits are ordered
    by the rank of what was before, then by the row's own edits.
    """

    def __init__(self):
        start = Block(None, "")
        self.tops = {top[0]: (0, 0, start, top) for top in reduced((0, None))}
        self.n = 0

    def read(self, initial: str, fault: int) -> None:
        best: dict[int, tuple] = {}
        for cost, rank, link, stack in self.tops.values():
            for more, edit, new in actions(stack, initial, fault):
                held = best.get(new[0])
                if held is None or (cost + more, rank, edit) < held[:3]:
                    best[new[0]] = cost + more, rank, edit, link, new
        order = {x: k for k, x in enumerate(sorted({b[1:3] for b in best.values()}))}
        self.n += 1
        links: dict[tuple, object] = {}
        for _, rank, edit, link, _ in best.values():
            if (rank, edit) not in links:
                links[rank, edit] = block((link, edit)) if self.n % BLOCK == 0 else (link, edit)
        self.tops = {s: (cost, order[rank, edit], links[rank, edit], new) for s, (cost, rank, edit, _, new) in best.items()}

    def end(self) -> tuple[int, str]:
        """Cost and audit of the cheapest repair."""
        states, _ = automaton()
        ways = [
            (cost + INSERT * n, rank, "I" * n, link)
            for cost, rank, link, stack in self.tops.values() for n, top in inserted(stack) if (0, 1) in states[top[0]]
        ]
        cost, _, edit, link = min(ways, key=lambda w: w[:3])
        found, at = [], block((link, edit))
        while at is not None:
            found.append(at.edits)
            at = at.before
        return cost, "".join(reversed(found))


class Count:
    """What one conversation's rows say, in order."""

    def __init__(self):
        self.parse, self.faults, self.illegal, self.before = Parse(), [0] * 5, 0, None
        self.low = self.high = self.turn = None
        self.turns = 0

    def read(self, turn: int | None, initial: str, fault: int) -> None:
        if fault == DROPPED:
            return
        self.faults[fault] += 1
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        if turn is not None:
            self.turns += turn != self.turn
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        self.parse.read(initial if initial in ("s", *ROLES) else "", fault)

    def told(self) -> tuple[str, list[int]]:
        cost, audit = self.parse.end()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return audit, [gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT], self.illegal, cost]


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with planted faults by crc32 of conv_id:turn; rows that are dropped stay, marked by copy 0."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    draw = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(draw == 0, F.array(F.lit(0))).when(draw == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(draw == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(copies).alias("copy"),
    )


def judged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and fault of each row, ordered within the partition of its conversation."""
    space = F.lit(" ")
    copy = F.col("copy") if "copy" in rows.columns else F.lit(1)
    plain = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")], (copy == 0).alias("_gone"),
    ).repartition("conv_id")
    # Partitions by conversation are enough for this window, it needs no exchange of its own.
    same = Window.partitionBy("conv_id", "role", "text", "_gone").orderBy(F.col("turn").asc_nulls_first())
    fault = (
        F.when(F.col("_gone"), DROPPED).when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("_nth") > 1, DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(SOUND)
    )
    marked = plain.withColumn("_nth", F.row_number().over(same)).withColumn("fault", fault.cast("long"))
    return marked.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "_nth").select("conv_id", "turn", "role", "text", "fault")


def parsed(rows: DataFrame) -> DataFrame:
    """The rows as they are, by their place from 0, and at place -1 of every conversation its audit and counts."""
    kinds = pa.schema([("conv_id", pa.int64()), ("_at", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("audit", pa.string()), ("counts", pa.list_(pa.int64()))])

    def verdicts(found: list[tuple]) -> pa.RecordBatch:
        columns = [[f[0] for f in found], [-1] * len(found), [None] * len(found), [None] * len(found), [f[1] for f in found], [f[2] for f in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, count, at = None, None, 0
        for batch in batches:
            found, places = [], np.zeros(batch.num_rows, np.int64)
            initials = [r[:1] for r in batch.column("role").to_pylist()]
            rows = zip(batch.column("conv_id").to_pylist(), batch.column("turn").to_pylist(), initials, batch.column("fault").to_pylist())
            for k, (conv_id, turn, initial, fault) in enumerate(rows):
                if count is None or conv_id != own:
                    if count is not None:
                        found.append((own, *count.told()))
                    own, count, at = conv_id, Count(), 0
                count.read(turn, initial, fault)
                places[k] = at
                at += fault != DROPPED
            stay = batch.filter(pa.array(np.asarray(batch.column("fault")) != DROPPED)) if batch.num_rows else batch
            kept = places[np.asarray(batch.column("fault")) != DROPPED]
            nothing = [pa.nulls(len(kept), kinds.field(c).type) for c in ("audit", "counts")]
            yield pa.RecordBatch.from_arrays([stay.column("conv_id"), pa.array(kept), stay.column("role").cast(pa.string()), stay.column("text").cast(pa.string()), *nothing], schema=kinds)
            if found:
                yield verdicts(found)
        if count is not None:
            yield verdicts([(own, *count.told())])

    # The partitions stay as they are, so that a sort within them is enough.
    return judged(rows).mapInArrow(run, PASSED).sortWithinPartitions("conv_id", "_at")


def followed(rows: Iterable[tuple]) -> Iterator[tuple[tuple, Iterator[tuple[str, str, str]]]]:
    """The verdict of each conversation, and its rows after repair: edit, role, text; a deleted row has its old role and text."""
    for _, own in groupby(rows, key=lambda r: r[0]):
        verdict = next(own)

        def edited(audit=verdict[4], own=own):
            place = (len(audit) - audit.count("D")) % 2  # an odd length begins with a kept system row, users are at even places
            for edit in audit:
                role, text = ("", "") if edit == "I" else next(own)[2:4]
                yield edit, ROLES["ua"[place % 2]] if edit in "RI" else role, text
                place += edit != "D"

        yield verdict, edited()


def table_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def batched(rows: Iterable[tuple], kinds: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    schema, out = pa.schema(kinds), []
    for row in rows:
        out.append(row)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), edit (K, R or I), role, text. Deleted rows are left out."""
    kinds = [("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]

    def run(found: Iterable[tuple]) -> Iterator[tuple]:
        for verdict, edits in followed(found):
            stay = (e for e in edits if e[0] != "D")
            yield from ((verdict[0], k, *e) for k, e in enumerate(stay))

    return parsed(rows).mapInArrow(lambda batches: batched(run(table_rows(batches)), kinds), REPAIRED)


def digest(rows: DataFrame) -> DataFrame:
    """Per conversation: faults, cost and audit of the cheapest repair, and the digest of what it leaves."""
    kinds = [("conv_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())]

    def run(found: Iterable[tuple]) -> Iterator[tuple]:
        for verdict, edits in followed(found):
            text, first = hashlib.sha256(), True
            for edit, role, own in edits:
                if edit != "D":
                    text.update(f"{'' if first else chr(10)}{role}:{own}".encode())
                    first = False
            yield verdict[0], *verdict[5], verdict[4], text.hexdigest()

    return parsed(rows).mapInArrow(lambda batches: batched(run(table_rows(batches)), kinds), RESULT)
