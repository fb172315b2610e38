"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets are filled like connected vessels: min(cap, level * weight), the level such that they sum to
the budget. A source takes floor(target / size) complete epochs first. The rest of its target is a
weighted sample without replacement: each document gets the key -ln(u) / quality, and documents are
taken in ascending key order until the prefix sum of their sizes meets the budget; the one at the cut
is taken up to it, so that a source's taken words equal its target, rounded.

No source is sorted in one task: keys fall into about sqrt(n) buckets, sizes are summed by bucket
before they are shuffled, prefix sums over buckets find the one bucket the budget ends in, and only
that bucket's keys are ordered. What comes out is one row a source (plan); a row of documents then
knows by its source's row alone how much of it is taken.

Nulls and edges: a null text has size 0 and is taken 0 times; a null source is a source of its own,
the last; u is a hash of doc_id and text, so reruns agree; rows equal in both share a key, and at the
cut they share what is left evenly, rounded down. Only one row a source meets in one task. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_EPOCHS = 2
_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)

SPACE = r"[\x20\x09-\x0D]"
SIZE = "CAST(coalesce(regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+'), 0) AS BIGINT)"
#: A document's weight within its source: the share of its characters that are not symbols or digits.
QUALITY = (
    "1e0 - 0.9e0 * CAST(length(text) - length(translate(text, '#*$%&|<>!=+~^0123456789', '')) AS DOUBLE)"
    " / CAST(greatest(length(text), 1) AS DOUBLE)"
)
#: Uniform in (0, 1): 52 bits of a digest of id and text.
UNIFORM = "(CAST(conv(substr(md5(concat(coalesce(CAST(doc_id AS STRING), ''), ':', coalesce(text, ''))), 1, 13), 16, 10) AS BIGINT) + 0.5e0) / 4503599627370496e0"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes (source, source_size) -> and target: weights are dealt to sources by code point, null
    last, repeating; percent of all sizes is shared by weight, none above epochs times its size."""
    name = Window.orderBy(F.col("source").asc_nulls_last())
    dealt = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(name) - 1) % len(weights) + 1).cast("int")))
    # sources reach their cap in the order of cap / weight; k is the number that do
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy().rowsBetween(*_ALL)
    cap = F.col("source_size") * epochs
    # all in integers, in units of 1/100 word
    x = dealt.select(
        "source", "source_size", "w", cap.alias("cap"),
        (F.sum("source_size").over(every) * percent).alias("budget"),
        F.sum("w").over(every).alias("w_all"),
        F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("w_before"),
    )
    # with all before it capped, this one is capped too if its cap is at most its share of what is left
    x = x.withColumn("left", F.col("budget") - F.col("cap_before") * 100).withColumn("w_left", F.col("w_all") - F.col("w_before"))
    capped = F.col("cap").cast("decimal(38,0)") * 100 * F.col("w_left") <= F.col("left").cast("decimal(38,0)") * F.col("w")
    x = x.withColumn("capped", capped)
    at = F.when(~F.col("capped"), F.struct("w_left", "left"))
    x = x.withColumn("free", F.max(at).over(every))
    share = F.col("free.left").cast("double") * F.col("w") / (F.col("free.w_left").cast("double") * 100)
    return x.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _keyed(docs: DataFrame) -> DataFrame:
    key = F.coalesce(-F.ln(F.expr(UNIFORM)) / F.expr(QUALITY), F.lit(0.0))
    return docs.select("doc_id", "source", F.expr(SIZE).alias("size"), key.alias("key"))


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, epochs: int = MAX_EPOCHS) -> DataFrame:
    """rows (source, size, key) -> source, source_size, target, epochs, rest, cut, share: what a
    source takes. Of its sample, rows with a key below cut are whole, those at cut give share words."""
    n, mean_key = rows.agg(F.count("*"), F.avg("key")).first()
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, epochs)
    words = F.round("target").cast("long")
    times = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    aims = materialize(aims.withColumn("epochs", times).withColumn("rest", words - times * F.col("source_size")))
    buckets = max(1, int(n**0.5))
    rows = rows.withColumn("bucket", F.floor((1 - F.exp(-F.col("key") / F.lit(mean_key or 1.0))) * buckets).cast("long"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    sums = sums.withColumn("before", F.coalesce(F.sum("s").over(before), F.lit(0)))
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    ends = sums.alias("a").join(aims.alias("b"), same).filter("before <= rest and before + s > rest").select("a.source", "bucket", "before", "rest")
    keys = (
        rows.alias("a").join(ends.alias("b"), same & (F.col("a.bucket") == F.col("b.bucket")))
        .groupBy("a.source", "before", "rest", "key").agg(F.sum("size").alias("s"), F.count("*").alias("c"))
    )
    inner = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    keys = keys.withColumn("before", F.col("before") + F.coalesce(F.sum("s").over(inner), F.lit(0)))
    cuts = keys.filter("before <= rest and before + s > rest").select(
        "source", F.col("key").alias("cut"), F.floor((F.col("rest") - F.col("before")) / F.col("c")).cast("long").alias("share")
    )
    # a source without a cut has nothing left to sample: its rest is 0 and no key is below minus one
    return materialize(
        aims.alias("a").join(cuts.alias("b"), same, "left").select(
            "a.source", "source_size", "target", "epochs", "rest", F.coalesce("cut", F.lit(-1.0)).alias("cut"), F.coalesce("share", F.lit(0)).alias("share")
        )
    )


def _taken(size, key):
    some = F.when(key < F.col("cut"), size).when(key == F.col("cut"), F.least(size, "share")).otherwise(0)
    return (F.col("epochs") * size + some).cast("long")


def op4_source_mixing(docs: DataFrame) -> DataFrame:
    rows = materialize(_keyed(docs))
    found = rows.alias("r").join(plan(rows).alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    return found.select("doc_id", "size", "source_size", "target", _taken(F.col("size"), F.col("key")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """docs as mixed: a row for each time it is taken; where a source's target ends within a
    document, its last copy ends there. Rows taken 0 times go."""
    cols = docs.columns
    whole = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"))
    key = F.expr(f"coalesce(-ln({UNIFORM}) / ({QUALITY}), 0.0e0)")
    p = plan(materialize(_keyed(docs))).select(*[F.col(c).alias(f"_mix_{c}") for c in ("source", "epochs", "cut", "share")])
    size = F.expr(SIZE)
    x = whole.join(p, F.col("source").eqNullSafe(F.col("_mix_source"))).withColumn("_mix_size", size).withColumn("_mix_key", key)
    some = F.when(F.col("_mix_key") < F.col("_mix_cut"), F.col("_mix_size")).when(
        F.col("_mix_key") == F.col("_mix_cut"), F.least("_mix_size", "_mix_share")
    ).otherwise(F.lit(0))
    x = x.withColumn("_mix_some", some)
    times = (F.col("_mix_epochs") + (F.col("_mix_some") == F.col("_mix_size")).cast("int")).cast("int")
    part = F.when((F.col("_mix_some") > 0) & (F.col("_mix_some") < F.col("_mix_size")), F.array(F.col("_mix_some").cast("int"))).otherwise(F.array().cast("array<int>"))
    x = x.filter("_mix_size > 0").withColumn("_mix_take", F.explode(F.concat(F.array_repeat(F.lit(-1), times), part)))
    words = F.split(F.regexp_replace("text", f"^{SPACE}+", ""), f"(?<={SPACE})(?!{SPACE})")
    cut = F.rtrim(F.array_join(F.slice(words, 1, F.greatest("_mix_take", F.lit(1))), ""))
    left = F.when(F.col("_mix_take") < 0, F.col("text")).otherwise(cut)
    return x.select(*[left.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in cols])


ORACLE = """
WITH docs AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0)
           / (1e0 - 0.9e0 * CAST(length(text) - length(translate(text, '#*$%&|<>!=+~^0123456789', '')) AS DOUBLE) / CAST(greatest(length(text), 1) AS DOUBLE)) AS key
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
dealt AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM sources),
vessels AS (
  SELECT *, source_size * 2 AS cap,
         sum(source_size) OVER () * 150 - 100 * coalesce(sum(source_size * 2) OVER o, 0) AS rest_words,
         sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS rest_w
  FROM dealt WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT rest_words, rest_w FROM vessels WHERE cap * 100 * rest_w > rest_words * w ORDER BY rest_w DESC LIMIT 1),
aims AS (
  SELECT source, source_size,
         CASE WHEN cap * 100 * v.rest_w <= v.rest_words * w THEN CAST(cap AS DOUBLE)
              ELSE CAST(l.rest_words AS DOUBLE) * w / (CAST(l.rest_w AS DOUBLE) * 100) END AS target
  FROM vessels v LEFT JOIN level l ON true),
epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM aims),
keyed AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, CAST(round(e.target) AS BIGINT) - e.epochs * e.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
           - sum(d.size) OVER (PARTITION BY d.source, d.key) AS before,
         count(*) OVER (PARTITION BY d.source, d.key) AS same
  FROM docs d JOIN epochs e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + CASE WHEN before + size * same <= rest THEN size
                                 ELSE least(size, greatest(0, (rest - before) // same)) END AS BIGINT) AS taken
FROM keyed
"""
