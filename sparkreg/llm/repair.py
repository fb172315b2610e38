"""Conversation structure repair: secondary-sorted streaming with carried states.

A repaired conversation is empty or an optional system turn and then user and assistant turns by
turns. Each turn is kept (free), given the role of user or assistant (REROLE), or deleted (DELETE,
the only way for blank and repeated turns); empty turns are inserted for INSERT each; a cut-off turn
that stays costs TRUNCATED more. Of the cheapest edits those with the least string of initials count
(D < I < K < R). The automaton has four states (nothing yet, after system, after user, after
assistant), and from each of them each initial leads to one state only.

1. Turns are dealt by conversation and sorted there. Repeated turns are found by a running row number
   over equal role and text, within the partitions of that one exchange.
2. Each partition is sorted by conversation and falling turn and streamed. The cheapest costs from a
   turn to the end, one for each state, are carried from batch to batch; they differ by bounded
   amounts, so that (costs, turn's code) -> (costs, choices) is a small table. What each state would
   do at a turn is one byte, 2 bits a state.
3. A conversation of at most HELD_ROWS turns and HELD_CHARS characters is then walked in its task. Of a
   longer one each turn is written out with its byte to the shared folder, and a second exchange
   streams it in rising order: neither pass holds a conversation.

One conversation is one sequence: its states pass through one task, and so does its digest. That is
the method's nature; memory stays bounded whatever its length (but for its row of edits in the
digest, a character each, which is the result).

Nulls and edges: null roles and texts are one space; null turns come first and don't count for gaps;
a null conv_id is a conversation of its own; turns of equal number are ordered by role and text;
repeated rows are turns (and duplicates) of their own; roles that begin otherwise than s, u or a
(upper case, empty) can't be kept; other columns are ignored. Gaps over the largest long are that. An
empty table gives no rows; a conversation whose rows were all dropped gives zeros.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import discard, materialize

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: A conversation that a task holds.
HELD_ROWS = 4096
HELD_CHARS = 8 << 20
#: Rows in a batch that a task sends.
SEND = 1024

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
D, I, K, R = range(4)  # initials of edits in their order  # noqa: E741
FREE = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # where a new role or a new turn leads
KEEP = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: From each state to the end of the conversation.
LAST = (0, 2 * INSERT, INSERT, 0)
LEGAL = {"su", "ua", "au"}
LONG_MAX = (1 << 63) - 1


@cache
def step(costs: tuple[int, ...], initial: str, must_go: bool, truncated: bool) -> tuple[tuple[int, ...], int, int]:
    """Costs from before a turn, of which the least is taken off; what was taken off; the choices."""
    own = []
    for q in range(4):
        ways = [(DELETE + costs[q], D)]
        if not must_go:
            more = TRUNCATED * truncated
            ways.append((REROLE + more + costs[FREE[q]], R))
            if (q, initial) in KEEP:
                ways.append((more + costs[KEEP[q, initial]], K))
        own.append(min(ways))
    best = list(own)
    for q in (USER, ASSISTANT):  # two insertions in a row lead back and never pay
        best[q] = min(own[q], (INSERT + own[FREE[q]][0], I))
    for q in (EMPTY, SYSTEM):
        best[q] = min(own[q], (INSERT + best[USER][0], I))
    low = min(c for c, _ in best)
    return tuple(c - low for c, _ in best), low, sum(edit << 2 * q for q, (_, edit) in enumerate(best))


class Walk:
    """Follows the choices through a conversation's turns in rising order."""

    def __init__(self) -> None:
        self.state, self.audit, self.digest, self.any = EMPTY, bytearray(), hashlib.sha256(), False

    def _put(self, role: str, text: str) -> tuple[str, str]:
        self.digest.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True
        return role, text

    def _insert(self) -> tuple:
        self.state = FREE[self.state]
        self.audit += b"I"
        return "I", *self._put(NAMES[self.state], "")

    def turn(self, choices: int, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of each turn of the result, deleted ones included."""
        while (edit := choices >> 2 * self.state & 3) == I:
            yield self._insert()
        self.audit += b"DIKR"[edit : edit + 1]
        if edit == D:
            yield "D", role, text
        elif edit == K:
            self.state = KEEP[self.state, role[:1]]
            yield "K", *self._put(role, text)
        else:
            self.state = FREE[self.state]
            yield "R", *self._put(NAMES[self.state], text)

    def end(self) -> Iterator[tuple[str, str, str]]:
        while self.state in (SYSTEM, USER):
            yield self._insert()


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
STATS = pa.struct([(c, pa.int64()) for c in COUNTS])


class Conversation:
    """What the falling pass carries of a conversation."""

    def __init__(self) -> None:
        self.costs, self.cost, self.n, self.held, self.chars = LAST, 0, 0, [], 0
        self.faults, self.illegal, self.after = [0, 0, 0], 0, None
        self.high = self.low = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        if turn is not None:
            self.high = turn if self.high is None else self.high
            self.turns += turn != self.low
            self.low = turn
        fault = 0 if blank else 1 if duplicate else 2 if truncated else None
        if fault is not None:
            self.faults[fault] += 1
        initial = role[:1]
        self.illegal += self.after is not None and initial + self.after not in LEGAL
        self.after = initial
        self.costs, low, choices = step(self.costs, initial if initial in ("s", "u", "a") else "", fault in (0, 1), fault == 2)
        self.cost += low
        self.held.append((self.n, choices, role, text))
        self.chars += len(text)
        self.n += 1

    def stats(self) -> dict:
        gaps = 0 if self.high is None else min(self.high - self.low + 1 - self.turns, LONG_MAX)
        return dict(zip(COUNTS, (gaps, *self.faults, self.illegal, self.cost + self.costs[EMPTY]), strict=True))


def _batches(schema: pa.Schema, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= SEND:
            yield batch()
            held.clear()
    if held:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _results(key, walk: Walk, stats: dict, turns: bool, edits: Iterator[tuple[str, str, str]], place: int = 0) -> Iterator[tuple]:
    """Rows (conv_id, place, edit, role, text) of the last turns of a result, or its one digest."""
    for edit, role, text in edits:
        if turns:
            yield key, place, edit, role, text, None, None
            place += 1
    if not turns:
        yield key, None, walk.audit.decode(), None, walk.digest.hexdigest(), None, stats


def _schema(key: pa.DataType) -> pa.Schema:
    """place, edit, role, text: a turn of a result; without place: edits and digest of a whole one.
    Those with choices are turns of a conversation too long to hold, and its stats before them."""
    return pa.schema([("conv_id", key), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("choices", pa.int32()), ("stats", STATS)])


def _falling(turns: bool, rows_held: int, chars_held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return

        def rest() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        def spill(key, c: Conversation) -> Iterator[tuple]:
            for place, choices, role, text in c.held:
                yield key, place, None, role, text, choices, None
            c.held.clear()

        def close(key, c: Conversation, spilled: bool) -> Iterator[tuple]:
            if spilled:
                yield from spill(key, c)
                yield key, c.n, None, None, None, -1, c.stats()
                return
            walk = Walk()

            def edits() -> Iterator[tuple[str, str, str]]:
                for _, choices, role, text in reversed(c.held):
                    yield from walk.turn(choices, role, text)
                yield from walk.end()

            yield from _results(key, walk, c.stats(), turns, edits())

        def out() -> Iterator[tuple]:
            key, c, spilled = None, None, False
            for k, turn, role, text, dropped, blank, duplicate, truncated in _rows(rest()):
                if c is None or k != key:
                    if c:
                        yield from close(key, c, spilled)
                    key, c, spilled = k, Conversation(), False
                if dropped:
                    continue
                c.add(turn, role, text, blank, duplicate, truncated)
                if len(c.held) >= rows_held or c.chars >= chars_held:
                    spilled, c.chars = True, 0
                    yield from spill(key, c)
            yield from close(key, c, spilled)

        yield from _batches(_schema(first.schema.field(0).type), out())

    return run


def _rising(turns: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return

        def rest() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        def out() -> Iterator[tuple]:
            key, walk, stats, place = None, None, None, 0
            for k, role, text, choices, s in _rows(rest()):
                if choices < 0:  # a new conversation
                    if walk:
                        yield from _results(key, walk, stats, turns, walk.end(), place)
                    key, walk, stats, place = k, Walk(), s, 0
                    continue
                for edit, new_role, new_text in walk.turn(choices, role, text):
                    if turns:
                        yield key, place, edit, new_role, new_text, None, None
                    place += 1
            yield from _results(key, walk, stats, turns, walk.end(), place)

        yield from _batches(_schema(first.schema.field(0).type), out())

    return run


def faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, dropped) -> and blank, duplicate, truncated, dealt by conv_id."""
    t = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), "dropped",
    ).repartition("conv_id")
    same = Window.partitionBy("conv_id", "dropped", F.xxhash64("role", "text"), "role", "text").orderBy(F.col("turn").asc_nulls_first())
    return t.select(
        "*", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (F.row_number().over(same) > 1).alias("duplicate"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
    )


def repaired(rows: DataFrame, turns: bool = True, rows_held: int = HELD_ROWS, chars_held: int = HELD_CHARS) -> DataFrame:
    """rows (conv_id, turn, role, text, dropped: a mark that the conversation exists, no turn of it).

    turns: conv_id, place, edit, role, text: the turns of the results, with deleted ones where they
    stood. Else a row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit (initials of the edits), repaired_sha256.
    """
    order = [F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc(), F.col("duplicate").desc()]
    key = rows.schema["conv_id"].dataType
    long = T.LongType()
    schema = T.StructType([
        T.StructField("conv_id", key), T.StructField("place", long), T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()), T.StructField("choices", T.IntegerType()), T.StructField("stats", T.StructType([T.StructField(c, long) for c in COUNTS])),
    ])
    sorted_rows = faults(rows).sortWithinPartitions("conv_id", *order)
    first = materialize(sorted_rows.select("conv_id", "turn", "role", "text", "dropped", "blank", "duplicate", "truncated").mapInArrow(_falling(turns, rows_held, chars_held), schema))
    done, long_ones = first.filter("choices is null"), first.filter("choices is not null")
    if long_ones.isEmpty():
        out = done
    else:
        # the row of a conversation's counts has the largest place and comes first
        stream = long_ones.repartition("conv_id").sortWithinPartitions("conv_id", F.col("place").desc())
        out = done.unionByName(stream.select("conv_id", "role", "text", "choices", "stats").mapInArrow(_rising(turns), schema))
    if turns:
        return out.select("conv_id", "place", "edit", "role", "text")
    return out.select("conv_id", *[f"stats.{c}" for c in COUNTS], F.col("edit").alias("audit"), F.col("text").alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """What the query repairs: by a checksum of conversation and turn a row is dropped, emptied, loses
    its sentence ends, comes twice or is a user's."""
    sign = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = conversations.select("conv_id", "turn", sign("role").alias("role"), sign("text").alias("text"), (F.crc32(F.concat(sign("conv_id"), F.lit(":"), sign("turn")).cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    t = t.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind == 0).alias("dropped"), F.explode(F.array_repeat(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"))
    return t.drop("copy")


def op11_conversation_repair(conversations: DataFrame) -> DataFrame:
    return repaired(damaged(conversations), turns=False)


#: The same in SQL: checksums by a table made from their polynomial, costs and least edits from the last
#: turn to the first (for each state a cost and a string), roles by the place of a turn.
ORACLE = """
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM (SELECT unnest(range(256)) AS i))),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
hashed AS (
  SELECT keyed.* EXCLUDE (k), xor(list_reduce(list_transform(range(1, length(k) + 1), lambda j: CAST(ascii(substr(k, j, 1)) AS BIGINT)),
         lambda c, b: xor(c >> 8, crc_table.crc[CAST(xor(c, b) & 255 AS INTEGER) + 1]), 4294967295), 4294967295) % 20 AS kind
  FROM keyed, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS empty, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut,
         left(role, 1) AS initial FROM damaged),
faulty AS (
  SELECT *, empty AS blank, again AND NOT empty AS duplicate, cut AND NOT empty AND NOT again AS truncated,
         initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY place) AS pair FROM placed),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faulty GROUP BY conv_id),
-- states: e nothing yet, s after system, u after user, a after assistant
walk AS (
  SELECT conv_id, n AS pos, {'c': 0, 'w': ''} AS e, {'c': 6, 'w': 'II'} AS s, {'c': 3, 'w': 'I'} AS u, {'c': 0, 'w': ''} AS a FROM stats
  UNION ALL
  SELECT conv_id, pos - 1,
         list_min([ge, {'c': fu.c + 3, 'w': 'I' || fu.w}]), list_min([gs, {'c': fu.c + 3, 'w': 'I' || fu.w}]), fu, list_min([ga, {'c': gu.c + 3, 'w': 'I' || gu.w}])
  FROM (SELECT *, list_min([gu, {'c': ga.c + 3, 'w': 'I' || ga.w}]) AS fu FROM (
    SELECT w.conv_id, w.pos,
      list_min([{'c': e.c + 4, 'w': 'D' || e.w}, {'c': u.c + go + 3, 'w': 'R' || u.w}, CASE initial WHEN 's' THEN {'c': s.c + go, 'w': 'K' || s.w} WHEN 'u' THEN {'c': u.c + go, 'w': 'K' || u.w} END]) AS ge,
      list_min([{'c': s.c + 4, 'w': 'D' || s.w}, {'c': u.c + go + 3, 'w': 'R' || u.w}, CASE initial WHEN 'u' THEN {'c': u.c + go, 'w': 'K' || u.w} END]) AS gs,
      list_min([{'c': u.c + 4, 'w': 'D' || u.w}, {'c': a.c + go + 3, 'w': 'R' || a.w}, CASE initial WHEN 'a' THEN {'c': a.c + go, 'w': 'K' || a.w} END]) AS gu,
      list_min([{'c': a.c + 4, 'w': 'D' || a.w}, {'c': u.c + go + 3, 'w': 'R' || u.w}, CASE initial WHEN 'u' THEN {'c': u.c + go, 'w': 'K' || u.w} END]) AS ga
    FROM walk w JOIN (SELECT conv_id, place, initial, CASE WHEN blank OR duplicate THEN 1000000 WHEN truncated THEN 3 ELSE 0 END AS go FROM faulty) t
      ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.place = w.pos))),
best AS (SELECT conv_id, CAST(e.c AS BIGINT) AS cost, e.w AS audit FROM walk WHERE pos = 0),
edits AS (
  SELECT conv_id, j, substr(audit, CAST(j AS INTEGER), 1) AS edit, length(replace(substr(audit, 1, CAST(j AS INTEGER)), 'I', '')) AS place
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM best)),
kept AS (
  SELECT x.conv_id, j, edit, f.role, f.text, row_number() OVER (PARTITION BY x.conv_id ORDER BY j) AS k,
         first_value(edit = 'K' AND f.initial = 's') OVER (PARTITION BY x.conv_id ORDER BY j) AS led
  FROM edits x LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.place = x.place WHERE edit <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (k - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
         || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS whole
  FROM kept GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""
