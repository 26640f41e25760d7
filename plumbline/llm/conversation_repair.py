"""Repair the order of roles in conversations by generalised LR parsing with weighted edits.

A conversation is well formed if the initials of its roles are nothing, or an
optional system turn and then pairs of user and assistant: S -> e | s? T,
T -> u a | T u a. Rows are read in order. Each may be kept, given another role or
deleted, and turns without text may be inserted before it. All parses advance
together on a graph-structured stack; where two reach the same stack top only the
one of less (cost, audit) goes on, since what may follow depends on the top alone.
A top carries the digest of its repaired text so far, so a conversation is read
once, a batch at a time, and never held.

Two audits that have read equally many rows end in an action on a row, hence
neither is the beginning of the other and their order never changes later: tops
keep a rank instead of comparing whole audits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.merkle import CRC32_SQL

BLANK = " \t\n\x0b\f\r"
STOPS = ".!?"
# What the edits cost.
RELABEL, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
FINE, EMPTY, AGAIN, TRUNCATED = 0, 1, 2, 3

START, SYSTEM, USER, TURNS, NEXT = range(5)
SHIFT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (TURNS, "u"): NEXT}
# An assistant turn ends a production: how many states it takes off.
REDUCE = {USER: 1, NEXT: 2}
GOTO = {START: TURNS, SYSTEM: TURNS}
ACCEPT = (START, TURNS)
NAMES = {"u": "user", "a": "assistant"}
# Two insertions in a row reach every top that more of them could.
MOST_INSERTED = 2
CHUNK = 1024


def advance(stack: tuple[int, ...], initial: str) -> tuple[int, ...] | None:
    """The stack after one more role: shift, or reduce and go to; None if the role cannot follow."""
    top = stack[-1]
    if initial == "a":
        if top not in REDUCE:
            return None
        below = stack[: -REDUCE[top]]
        return (*below, GOTO[below[-1]])
    to = SHIFT.get((top, initial))
    return None if to is None else (*stack, to)


def inserted(stack: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], str]]:
    """The stack, and those after inserting one or more turns, with the initials inserted."""
    initials = ""
    for _ in range(MOST_INSERTED + 1):
        yield stack, initials
        step = next((i, s) for i in NAMES if (s := advance(stack, i)) is not None)
        initials, stack = initials + step[0], step[1]


class Top:
    """One top of the graph-structured stack and the best way to it."""

    __slots__ = ("stack", "cost", "rank", "tail", "chunks", "digest", "empty")

    def __init__(self, stack=(START,), cost=0, rank=0, tail="", chunks=None, digest=None, empty=True):
        self.stack, self.cost, self.rank = stack, cost, rank
        self.tail, self.chunks, self.empty = tail, chunks, empty
        self.digest = digest or hashlib.sha256()

    def after(self, stack, cost: int, rank: int, letters: str, turns: list[str]) -> Top:
        tail, chunks, digest = self.tail + letters, self.chunks, self.digest.copy()
        if len(tail) > CHUNK:
            tail, chunks = "", (chunks, tail)
        empty = self.empty
        for turn in turns:
            digest.update(turn.encode() if empty else b"\n" + turn.encode())
            empty = False
        return Top(stack, cost, rank, tail, chunks, digest, empty)

    def audit(self) -> str:
        parts, link = [self.tail], self.chunks
        while link:
            link, part = link
            parts.append(part)
        return "".join(reversed(parts))


class Parse:
    """All parses of one conversation's rows so far."""

    def __init__(self):
        self.tops = [Top()]

    def read(self, role: str, text: str, fault: int) -> None:
        """Take one more row; ``fault`` says whether it must go or costs more to stay."""
        best: dict[int, tuple] = {}
        must_go, extra = fault in (EMPTY, AGAIN), CUT_OFF if fault == TRUNCATED else 0
        for parent in self.tops:
            for stack, added in inserted(parent.stack):
                cost, letters = parent.cost + INSERT * len(added), "I" * len(added)
                ways = [(stack, cost + DELETE, letters + "D", None)]
                if not must_go:
                    # an empty role has no initial and can only be replaced
                    kept = advance(stack, role[:1]) if role else None
                    if kept:
                        ways.append((kept, cost + extra, letters + "K", role))
                    for initial, name in NAMES.items():
                        to = advance(stack, initial)
                        if to:
                            ways.append((to, cost + RELABEL + extra, letters + "R", name))
                for to, total, told, name in ways:
                    key = (total, parent.rank, told)
                    if to[-1] not in best or key < best[to[-1]][0]:
                        best[to[-1]] = (key, parent, to, added, name)
        # audits compare as (audit of the parent, letters added)
        order = sorted(best.values(), key=lambda b: b[0][1:])
        self.tops = [
            parent.after(to, key[0], rank, key[2], _turns(added, name, text))
            for rank, (key, parent, to, added, name) in enumerate(order)
        ]

    def end(self) -> tuple[int, str, str]:
        """(cost, audit, digest) of the cheapest repair."""
        ways = [
            (top.cost + INSERT * len(added), top.rank, "I" * len(added), top, stack, added)
            for top in self.tops
            for stack, added in inserted(top.stack)
            if stack[-1] in ACCEPT
        ]
        cost, _, letters, top, stack, added = min(ways, key=lambda w: w[:3])
        done = top.after(stack, cost, 0, letters, _turns(added, None, ""))
        return cost, done.audit(), done.digest.hexdigest()


def _turns(added: str, name: str | None, text: str) -> list[str]:
    turns = [f"{NAMES[i]}:" for i in added]
    return turns if name is None else [*turns, f"{name}:{text}"]


LEGAL = ("su", "ua", "au")


class Conversation:
    """Counts and parses of the conversation that is being read."""

    def __init__(self, conv):
        self.conv, self.parse = conv, Parse()
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def read(self, turn, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        self.parse.read(role, text, fault)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        cost, audit, digest = self.parse.end()
        return (self.conv, gaps, *self.faults[1:], self.illegal, cost, audit, digest)


def _result(conv_type: T.DataType) -> T.StructType:
    out = T.StructType().add("conv_id", conv_type)
    for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"):
        out = out.add(name, "long")
    return out.add("audit", "string").add("repaired_sha256", "string")


ROWS_OUT = 5_000


def _repair(schema: T.StructType):
    arrow = to_arrow_schema(schema)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "fault")]
            for conv, turn, role, text, fault in zip(*columns):
                if now is None or now.conv != conv:
                    if now is not None:
                        rows.append(now.row())
                    now = Conversation(conv)
                if fault is not None:  # else a row that only keeps its conversation in the table
                    now.read(turn, role, text, fault)
                if len(rows) >= ROWS_OUT:
                    yield table(rows)
                    rows = []
        if now is not None:
            rows.append(now.row())
        if rows:
            yield table(rows)

    return work


def repair_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    present: Column | None = None,
) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation.

    Rows are taken by turn, NULL first, then by role and text, both bytewise; a
    NULL role or text is one space. ``present`` tells rows that count from those
    that only keep their conversation in the result; a conversation without any
    has zeros, an empty audit and the digest of nothing. Each row's first fault
    counts: blank, duplicate (role and text seen earlier), truncated. Blank and
    duplicate rows are deleted; a role whose initial the grammar does not have,
    or an empty one, is replaced or its row deleted. The audit has the initials
    of Keep, Rerole, Delete and Insert in order, and ties are broken by it. Rows
    without an id are one conversation; an empty table gives no rows; other
    columns are not read.

    One shuffle, by conversation. As the digest of a conversation depends on its
    order, a task reads it from first to last, holding a batch and a letter per
    row for each of at most five tops, however long it is.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    df = rows.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), told(role).alias("role"), told(text).alias("text"),
        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"),
    )
    solid = F.rtrim("text", F.lit(BLANK))
    seen = Window.partitionBy("conv", "present", "role", F.md5("text")).orderBy(F.asc_nulls_first("turn"))
    fault = (
        F.when(~F.col("present"), F.lit(None))
        .when(solid == "", EMPTY)
        .when(F.row_number().over(seen) > 1, AGAIN)
        .when(~F.right(solid, F.lit(1)).isin(*STOPS), TRUNCATED)
        .otherwise(FINE)
    )
    together = df.repartition("conv").withColumn("fault", fault)
    # of equal rows the first one is no duplicate
    order = [*[F.asc_nulls_first(c) for c in ("conv", "turn", "role", "text")], F.col("fault").eqNullSafe(AGAIN)]
    # texts of rows that go are not read
    text_out = F.when(F.col("fault").isin(FINE, TRUNCATED), F.col("text")).otherwise("")
    ordered = together.sortWithinPartitions(*order).select("conv", "turn", "role", text_out.alias("text"), "fault")
    schema = _result(df.schema["conv"].dataType)
    return ordered.mapInArrow(_repair(schema), schema)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after the query's damage, with ``present`` false for those dropped."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20).alias("kind")
    df = rows.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind)
    text = (
        F.when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.translate("text", STOPS, ""))
        .when(F.col("kind") == 0, "")
        .otherwise(F.col("text"))
    )
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return df.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), copies.alias("copy"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repair_conversations(rows, present=F.col("present"))


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP13_SQL = f"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
kinds AS (SELECT *, ({CRC32_SQL.format(text="name")}) % 20 AS kind FROM given),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds JOIN (SELECT unnest([0, 1]) AS copy) ON copy = 0 OR kind = 3 WHERE kind <> 0),
counted AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM hurt),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS i,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) || role[1] AS pair,
    rtrim(text, {_SPACE}) AS solid FROM counted),
rows AS (
  SELECT conv_id, turn, role, text, i, pair, CASE WHEN solid = '' THEN 1 WHEN seen > 1 THEN 2
    WHEN solid[-1] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM numbered),
sizes AS (
  SELECT c.conv_id, count(r.i) AS n,
    coalesce(max(r.turn) - min(r.turn) + 1 - count(DISTINCT r.turn), 0) AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
  GROUP BY c.conv_id),
-- 0 nothing yet, 1 after the system turn, 2 after a user, 3 after an assistant; the turns that may be put in first
adds(frm, put, cost, told, made) AS (VALUES
  (0, 0, 0, '', []::VARCHAR[]), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']),
  (1, 1, 0, '', []), (1, 2, 2, 'I', ['user:']), (1, 3, 4, 'II', ['user:', 'assistant:']),
  (2, 2, 0, '', []), (2, 3, 2, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 2, 'I', ['user:'])),
goes(put, initial, too, name) AS (VALUES
  (0, 's', 1, NULL), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (3, 'u', 2, 'user'), (2, 'a', 3, 'assistant')),
parses AS (
  SELECT conv_id, n, 0 AS i, 0 AS top, 0 AS cost, '' AS told, []::VARCHAR[] AS made FROM sizes
  UNION ALL
  SELECT conv_id, n, i, top, cost, told, made FROM (
    SELECT p.conv_id, p.n, r.i, w.top, p.cost + w.cost AS cost, p.told || w.told AS told, p.made || w.made AS made
    FROM parses p JOIN rows r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1,
    LATERAL (
      SELECT a.put AS top, a.cost + 3 AS cost, a.told || 'D' AS told, a.made AS made FROM adds a WHERE a.frm = p.top
      UNION ALL
      SELECT g.too, a.cost + CASE WHEN r.fault = 3 THEN 1 ELSE 0 END, a.told || 'K', a.made || [r.role || ':' || r.text]
      FROM adds a JOIN goes g ON g.put = a.put WHERE a.frm = p.top AND g.initial = r.role[1] AND r.fault IN (0, 3)
      UNION ALL
      SELECT g.too, a.cost + 2 + CASE WHEN r.fault = 3 THEN 1 ELSE 0 END, a.told || 'R', a.made || [g.name || ':' || r.text]
      FROM adds a JOIN goes g ON g.put = a.put WHERE a.frm = p.top AND g.name IS NOT NULL AND r.fault IN (0, 3)) w)
  QUALIFY row_number() OVER (PARTITION BY conv_id, top ORDER BY cost, told) = 1),
ends AS (
  SELECT p.conv_id, p.cost + a.cost AS cost, p.told || a.told AS told, p.made || a.made AS made
  FROM parses p JOIN adds a ON a.frm = p.top WHERE p.i = p.n AND a.put IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + a.cost, p.told || a.told) = 1)
SELECT s.conv_id, s.gaps, s.blank, s.duplicate, s.truncated, s.illegal, e.cost::BIGINT AS cost, e.told AS audit,
  sha256(array_to_string(e.made, chr(10))) AS repaired_sha256
FROM sizes s JOIN ends e ON e.conv_id IS NOT DISTINCT FROM s.conv_id
"""
