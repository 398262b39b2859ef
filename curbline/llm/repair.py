"""Repair of conversations by Knuth's lightest derivation.

The reference records hold no dialogues, so the operator takes any table of
conversations: conv_id, turn, role, text.

A sound conversation is one system turn or none, then user and assistant turns
by twos; or nothing. Rows can be kept, given another role, or deleted, and empty
turns inserted. Item (i, s) says that the rows from i on can be repaired when
the turns before them left state s; the reading of a row (its edit, the turn it
becomes, the cost) and item (i + 1, t) deduce (i, s). An agenda pops items by
(cost, rows behind, first edit): every deduction adds rows or cost, so it is
superior, and what is popped is final. Two ways to one item begin with
different edits and never differ in the turns that one edit gives, so the first
edit alone decides ties of cost: the smaller audit string. The search ends when
the goal, item (0, nothing said), is popped.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Workspace, ship
from .common import shares

WHITE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)  # what was said last; a role's code is the same, START for any other role
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ENDS = (START, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)  # faults; a row's byte is 4 * fault + role
KEEP, REROLE, DELETE, INSERT = b"KRDI"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
CUT_COST = 1  # of a truncated row that stays
BLOCK = 100_000  # rows of a conversation that are one blob
TURN_ROWS = 20_000


def readings(row: int) -> list[tuple[int, int | None, int]]:
    """(edit, the turn it becomes, cost) of a row's byte."""
    fault, role = divmod(row, 4)
    out = [(DELETE, None, COST[DELETE])]
    if fault not in (BLANK, DUPLICATE):
        extra = CUT_COST if fault == TRUNCATED else 0
        out += [(REROLE, to, COST[REROLE] + extra) for to in NAMES]
        if role != START:
            out.append((KEEP, role, COST[KEEP] + extra))
    return out


#: deductions by the row's byte and the state behind it: (edit, state before it, cost)
BACK = [[[(edit, s, cost) for edit, to, cost in readings(row) for s in FOLLOWS if (s == t if to is None else t == to and to in FOLLOWS[s])] for t in range(4)] for row in range(16)]
GROWN = [[s for s in FOLLOWS if t in FOLLOWS[s]] if t in NAMES else [] for t in range(4)]  # before an inserted turn


def lightest(rows: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of a conversation's row bytes; of equals the least audit string."""
    n = len(rows)
    done = bytearray(4 * (n + 1))  # the first edit of a final item
    agenda = [(0, 0, 0, s) for s in ENDS]  # cost, rows behind, edit, state
    heapq.heapify(agenda)
    while True:
        cost, behind, edit, state = heapq.heappop(agenda)
        if done[4 * behind + state]:
            continue
        done[4 * behind + state] = edit or 1
        if behind == n and state == START:
            break
        for before in GROWN[state]:
            if not done[4 * behind + before]:
                heapq.heappush(agenda, (cost + COST[INSERT], behind, INSERT, before))
        if behind < n:
            for edit, before, more in BACK[rows[n - behind - 1]][state]:
                if not done[4 * behind + 4 + before]:
                    heapq.heappush(agenda, (cost + more, behind + 1, edit, before))
    audit, state, behind = bytearray(), START, n
    while (edit := done[4 * behind + state]) != 1:
        audit.append(edit)
        if edit == INSERT:
            state = inserted(state)
        else:
            state = said(edit, state, rows[n - behind] % 4)
            behind -= 1
    return cost, audit.decode()


def inserted(state: int) -> int:
    """The one turn of NAMES that may follow."""
    return next(t for t in FOLLOWS[state] if t in NAMES)


def said(edit: int, state: int, role: int) -> int:
    return state if edit == DELETE else inserted(state) if edit == REROLE else role


def kind_of(role):
    first = F.substring(role, 1, 1)
    return F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(START)


def in_order(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, and `mark`, a digest of the text: rows of a conversation stand by turn (nulls first), role, mark."""
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).withColumn("mark", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


ORDER = ("conv_id", "turn", "role", "mark")


def audits(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit): what is wrong with each conversation, and its cheapest repair.

    turns: conv_id, turn, role, text; other columns are left out. A null role or
    text is one space. Rows stand by turn (nulls first), those of one turn by role
    and a digest of the text, equal ones together; a null conv_id is a
    conversation of its own. The first fault of a row counts: blank (white space
    at most), duplicate (role and text seen before), truncated (the last sign but
    white space is none of . ! ?). gaps is maxTurn - minTurn + 1 - distinct turns,
    nulls left out (0 without any; null beyond a long); illegal counts neighbours
    whose roles' first letters are not su, ua or au. audit lists the edits K, R, D
    and I. No rows in, none out.

    Texts are not shuffled, only digests are: equal rows are one with a number
    before that. Rows are dealt by ranges, so that a long conversation is many
    tasks' work; each task packs its part into a byte a row. What meets in one
    task for a conversation is a byte a row too, as the audit itself.
    """
    ship()
    core = F.rtrim("text", F.lit(WHITE))
    fault = F.when(core == "", BLANK).when(~F.substring(core, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    facts = in_order(turns).select(*ORDER, (4 * fault + kind_of("role")).alias("row"))
    facts = Workspace(turns.sparkSession, "repair").write(facts.groupBy(*ORDER).agg(F.min("row").alias("row"), F.count("*").alias("copies")), "facts")
    conv = F.struct("conv_id").alias("conv")  # a struct of null equals another, as a group does
    of = facts.withColumn("key", conv)
    earlier = of.groupBy("key", "role", "mark").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    seen = (F.col("first").isNotNull()) & (F.struct("turn") > F.col("first"))
    again = F.when(F.floor(F.col("row") / 4) == BLANK, F.col("row")).otherwise(4 * DUPLICATE + F.col("row") % 4)  # a blank row stays blank
    rows = of.join(earlier, ["key", "role", "mark"], "left").select(*ORDER, "copies", F.when(seen, again).otherwise(F.col("row")).cast("int").alias("row"), again.cast("int").alias("again"))
    rows = rows.repartitionByRange(shares(facts, TURN_ROWS), *ORDER).sortWithinPartitions(*ORDER)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, key, held = TaskContext.get().partitionId(), 0, None, bytearray()
        kind = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([bytes(held)], pa.binary())], ["conv_id", "part", "seq", "rows"])

        for batch in batches:
            kind = batch.column("conv_id").type
            for c, n, row, more in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "copies", "row", "again"))):
                if held and (c != key or len(held) >= BLOCK):
                    yield out()
                    seq, held = seq + 1, bytearray()
                key = c
                held.append(row)
                held += bytes([more]) * (n - 1)
        if held:
            yield out()

    conv_type = turns.schema["conv_id"].dataType
    parts = rows.mapInArrow(pack, T.StructType([T.StructField("conv_id", conv_type), T.StructField("part", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("rows", T.BinaryType())]))
    whole = parts.repartition(shares(facts, TURN_ROWS), "conv_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "rows"))).alias("parts"))

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column("parts"):
                row = b"".join(p["rows"].as_py() for p in x)
                code = np.frombuffer(row, np.uint8)
                fault, role = code // 4, code % 4
                pair = role[:-1] * 4 + role[1:]
                fine = np.isin(pair, [4 * a + b for a, b in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))])
                found.append((*(int((fault == k).sum()) for k in (BLANK, DUPLICATE, TRUNCATED)), int((~fine).sum()), *lightest(row)))
            cols = list(zip(*found))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.string())], ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    counts = [T.StructField(c, T.LongType()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    told = whole.mapInArrow(derive, T.StructType([T.StructField("conv_id", conv_type), *counts, T.StructField("audit", T.StringType())]))
    turn = F.col("turn").cast("decimal(38,0)")
    spread = facts.select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count("turn"), F.lit(0)).alias("g"))
    spread = spread.select("conv_id", F.col("g").try_cast("long").alias("gaps"))
    gaps = spread.withColumnRenamed("conv_id", "_conv")
    return told.join(gaps, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", "gaps", *(c.name for c in counts), "audit")


REPAIRED = (T.StructField("position", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("edit", T.StringType()))


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, edit): the turns of every repaired conversation, in order.

    turns as in `audits`, found what it returned for them. A conversation's rows
    come in order in one partition, and none of another between. It is read as a
    stream, so memory does not grow with it. edit is K, R or I.
    """
    ship()
    conv_type = turns.schema["conv_id"].dataType
    none = F.lit(None)
    head = found.select("conv_id", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"), F.col("audit").alias("text"), none.cast("binary").alias("mark"))
    body = in_order(turns).withColumn("kind", F.lit(1)).select(head.columns)
    rows = head.unionByName(body).repartition(shares(turns, TURN_ROWS), "conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, at, state, position = None, "", 0, START, 0
        code = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
        for batch in batches:
            out: list[tuple] = []

            def insert():
                nonlocal at, state, position
                while at < len(audit) and audit[at] == "I":
                    state = inserted(state)
                    out.append((key, position, NAMES[state], "", "I"))
                    at, position = at + 1, position + 1

            for c, kind, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "kind", "role", "text"))):
                if kind == 0:
                    key, audit, at, state, position = c, text, 0, START, 0
                    insert()
                    continue
                edit = audit[at]
                at += 1
                if edit != "D":
                    state = said(ord(edit), state, code.get(role[:1], START))
                    out.append((key, position, NAMES[state] if edit == "R" else role, text, edit))
                    position += 1
                insert()
            if out:
                cols = list(zip(*out))
                kinds = (batch.column("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", *(f.name for f in REPAIRED)])

    return rows.mapInArrow(run, T.StructType([T.StructField("conv_id", conv_type), *REPAIRED]))


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, sha256) of `role:text` of the rows that `repaired` gives, joined by line feeds."""
    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, kind = None, None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([held.hexdigest()])], ["conv_id", "sha256"])
        for batch in batches:
            kind = batch.column("conv_id").type
            for c, position, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "position", "role", "text"))):
                if position == 0:
                    if held is not None:
                        yield row()
                    key, held = c, hashlib.sha256()
                else:
                    held.update(b"\n")
                held.update(f"{role}:{text}".encode())
        if held is not None:
            yield row()

    return rows.mapInArrow(run, T.StructType([rows.schema["conv_id"], T.StructField("sha256", T.StringType())]))
