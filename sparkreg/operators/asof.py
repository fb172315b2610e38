"""As-of join: each row with the values of the last row of another table at or before it.

Both tables are dealt by ranges of (keys, time) into the same partitions and sorted there, so that a
key with a third of all rows lies in several partitions. Within a partition the last values are carried
along by a window; what a partition has to begin with comes from the few keys that cross a boundary,
of which there are fewer than partitions, and that table alone is broadcast.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidOptions


def asof_join(left: DataFrame, right: DataFrame, on: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    """left with the values of right's row of equal keys and the greatest `on` that is not above its own
    (of several with that `on` the one with the greatest values); NULL where there is none, and where
    `on` or a key is NULL. The sorted rows are held until ordering.release()."""
    by = by or []
    if not values or set(values) & set(left.columns):
        raise InvalidOptions("values that left has not are needed")
    keys = [f"_b{i}" for i in range(len(by))]
    key = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    rows, given = F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"), F.struct(*[F.col(f"`{c}`") for c in values]).alias("_values")
    none = lambda c, df: F.lit(None).cast(df.select(c).schema[0].dataType)
    known = lambda df: df.dropna(subset=[on, *by])
    both = known(right).select(*key, F.col(on).alias("_t"), F.lit(0).alias("_side"), given, none(rows, left).alias("_row")).unionByName(
        known(left).select(*key, F.col(on).alias("_t"), F.lit(1).alias("_side"), none(given, right).alias("_values"), rows)
    )
    x = both.repartitionByRange(*keys, "_t").withColumn("_part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    along = Window.partitionBy("_part", *keys).orderBy("_t", "_side", "_values").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = x.withColumn("_own", F.last("_values", ignorenulls=True).over(along)).filter("_side = 1")
    # keys that cross a boundary: what each of their partitions begins with
    spans = x.groupBy(*keys).agg(F.min("_part").alias("_first"), F.max("_part").alias("_last")).filter("_first < _last")
    spans = spans.select(*keys, F.explode(F.sequence("_first", "_last")).alias("_part"))
    ends = x.filter("_side = 0").groupBy("_part", *keys).agg(F.max(F.struct("_t", "_values")).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.join(ends, ["_part", *keys], "left").withColumn("_carried", F.last("_end", ignorenulls=True).over(before)["_values"])
    out = own.join(F.broadcast(carried.select("_part", *keys, "_carried")), ["_part", *keys], "left").withColumn("_found", F.coalesce("_own", "_carried"))
    out = out.select("_row.*", *[F.col("_found")[c].alias(c) for c in values])
    lost = F.lit(False)
    for c in [on, *by]:
        lost = lost | F.col(c).isNull()
    out = out.unionByName(left.filter(lost).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in values]))
    out._held = x
    return out
