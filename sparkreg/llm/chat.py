"""Chat formatting: cumulative-snapshot collapse, then rendering.

Logs often hold a conversation several times, each time some turns longer. Every turn gets a hash of
its place, role and text, and the sum of the hashes up to it is the rolling hash of the prefix (two
64-bit sums). A conversation whose full hash is the hash of a proper prefix of another is a snapshot;
anti-joins drop snapshots and all but the smallest conv_id of equal conversations. What stays is
rendered with role marks.

A conversation of any length is no task's burden: turns are numbered in blocks of BLOCK turn numbers,
sums run over blocks first, and text comes out in segments of a block each (segment 0 for all but
very long conversations).

Nulls and edges: null roles and texts are empty strings; rows with a null conv_id are dropped; null
turns come first; turns of equal number are ordered by role and text; repeated rows are turns of
their own; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

BLOCK = 4096
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, block, place, h1, h2, n, text: each turn's place in its conversation, and the rolling
    hash of the turns up to it."""
    t = turns.filter("conv_id is not null").select(
        "conv_id", F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    t = t.withColumn("block", F.floor(F.col("turn") / BLOCK))
    sizes = t.groupBy("conv_id", "block").agg(F.count("*").alias("c"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "block", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"), F.sum("c").over(Window.partitionBy("conv_id")).alias("n"))
    order = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    t = t.join(sizes, ["conv_id", "block"]).withColumn("place", F.col("first") + F.row_number().over(order))
    t = t.withColumn("g1", F.xxhash64("place", "role", "text")).withColumn("g2", F.xxhash64("text", "role", F.lit(1), "place"))
    # decimal sums of hashes modulo 2^61: nothing overflows under ANSI rules
    g = lambda c: F.pmod(F.col(c), F.lit(1 << 61)).cast("decimal(38,0)")
    sums = t.groupBy("conv_id", "block").agg(F.sum(g("g1")).alias("s1"), F.sum(g("g2")).alias("s2"))
    sums = sums.select("conv_id", "block", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"b{s}") for s in ("s1", "s2")])
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.join(sums, ["conv_id", "block"])
    h = [((F.col(f"bs{k}") + F.sum(g(f"g{k}")).over(run)) % F.lit(1 << 61)).cast("long").alias(f"h{k}") for k in (1, 2)]
    return t.select("conv_id", "block", "place", "n", *h, "role", "text")


def collapse(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n_turns) of maximal conversations, and the turns with their prefixes."""
    t = materialize(prefixes(turns))
    full = t.filter("place = n").select("conv_id", "n", "h1", "h2")
    one = full.groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    longer = t.filter("place < n").select(F.col("place").alias("n"), "h1", "h2").distinct()
    kept = one.join(longer, ["n", "h1", "h2"], "left_anti")
    return kept.select("conv_id", F.col("n").alias("n_turns")), t


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, segment, n_turns, text: maximal conversations, rendered."""
    kept, t = collapse(turns)
    t = t.join(kept, "conv_id").withColumn("segment", F.floor((F.col("place") - 1) / BLOCK))
    line = F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE + "\n"))
    lines = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    return t.groupBy("conv_id", "segment", "n_turns").agg(lines.alias("lines")).select(
        "conv_id", "segment", "n_turns", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text")
    )


def op1_chat_formatting(conversations: DataFrame) -> DataFrame:
    return rendered(conversations)


ORACLE = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY place) AS turns, count(*) AS n_turns FROM t GROUP BY conv_id),
kept AS (
  SELECT * FROM c a WHERE NOT EXISTS (
    SELECT 1 FROM c b WHERE b.turns[1].text = a.turns[1].text AND b.n_turns >= a.n_turns AND b.turns[1:a.n_turns] = a.turns
      AND (b.n_turns > a.n_turns OR b.conv_id < a.conv_id)))
SELECT kept.conv_id, CAST(0 AS BIGINT) AS segment, n_turns,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
FROM kept JOIN t ON t.conv_id = kept.conv_id GROUP BY kept.conv_id, n_turns
"""
