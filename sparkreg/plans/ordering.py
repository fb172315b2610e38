"""Row numbers and order statistics without sorting everything into one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Values that an order statistic may bring to the driver at its end.
FEW = 10_000
BINS = 1024


def numbered(df: DataFrame, order_by: list[str], output: str = "row_number") -> DataFrame:
    """df with a number from 0 by order: a range partitioning, a number within each partition, and
    the partitions' sizes (one row a partition) added up. The partitioning is held until release()."""
    x = df.repartitionByRange(*[F.col(c) for c in order_by]).sortWithinPartitions(*order_by)
    x = x.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() % F.lit(1 << 33))
    x = x.persist()
    sizes = x.groupBy("_part").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))
    out = x.join(F.broadcast(starts), "_part").withColumn(output, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start", "_c")
    out._held = x
    return out


def release(df: DataFrame) -> None:
    """Lets go of what numbered() holds, once df and what is made of it have been read."""
    held = getattr(df, "_held", None)
    if held is not None:
        held.unpersist()


def order_statistics(df: DataFrame, value: Column, ranks: list[int]) -> list[float]:
    """The values of 0-based ranks: histograms close in on all ranks at once, pass by pass, until few
    values are left between their bounds; then these are counted one by one."""
    x = df.select(value.cast("double").alias("v")).filter("v is not null and not isnan(v)").persist()
    try:
        lo, hi, n = x.agg(F.min("v"), F.max("v"), F.count("*")).first()
        if not n:
            return [math.nan] * len(ranks)
        v = F.col("v")
        find = {r: (lo, hi, 0, n) for r in ranks}  # bounds, rows below them, rows within
        step = lambda a, b: b / BINS - a / BINS

        def cells(bounds: list[tuple], inner) -> DataFrame:
            case = [F.when((v >= F.lit(a)) & (v <= F.lit(b)), F.struct(F.lit(j).alias("j"), inner(a, b).alias("k"))) for j, (a, b) in enumerate(bounds)]
            return x.select("v", F.coalesce(*case).alias("c")).filter("c is not null").groupBy("c.j", "c.k")

        while True:
            wide = sorted({(a, b) for a, b, _, c in find.values() if c > FEW and a + step(a, b) > a})
            if not wide:
                break
            bins = cells(wide, lambda a, b: F.least(F.lit(BINS - 1), F.floor((v - F.lit(a)) / F.lit(step(a, b)))))
            rows = sorted(bins.agg(F.count("*"), F.min("v"), F.max("v")).collect())
            for rank, (a, b, below, _) in list(find.items()):
                if (a, b) in wide:
                    for _, _, c, low, high in (r for r in rows if r[0] == wide.index((a, b))):
                        if below + c > rank:
                            find[rank] = (low, high, below, c)
                            break
                        below += c
        left = sorted({(a, b) for a, b, _, _ in find.values() if b > a})
        counts = sorted(cells(left, lambda a, b: v).agg(F.count("*")).collect()) if left else []
        out = {}
        for rank, (a, b, below, _) in find.items():
            out[rank] = a
            if b > a:
                for _, value_, c in (r for r in counts if r[0] == left.index((a, b))):
                    below += c
                    if below > rank:
                        out[rank] = value_
                        break
        return [float(out[r]) for r in ranks]
    finally:
        x.unpersist()


def quantiles(df: DataFrame, value: Column, qs: list[float], n: int | None = None) -> list[float]:
    """Type 7 quantiles, exact, from one search for all of them."""
    n = df.filter(value.isNotNull() & ~F.isnan(value.cast("double"))).count() if n is None else n
    if not n:
        return [math.nan] * len(qs)
    at = [q * (n - 1) for q in qs]
    low = [math.floor(a) for a in at]
    ranks = sorted({r for k in low for r in (k, min(k + 1, n - 1))})
    found = dict(zip(ranks, order_statistics(df, value, ranks), strict=True))
    return [found[k] + (a - k) * (found[min(k + 1, n - 1)] - found[k]) for a, k in zip(at, low, strict=True)]


def quantile(df: DataFrame, value: Column, q: float, n: int | None = None) -> float:
    return quantiles(df, value, [q], n)[0]


def median(df: DataFrame, value: Column) -> float:
    return quantile(df, value, 0.5)
