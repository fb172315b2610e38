"""LOWESS (local constant, tricube weights) over the row order of a series, at a cost a row that does
not depend on the span.

Of n rows the nearest k = ceil(n * span) (2 at least) by index count, with weight (1 - u^3)^3 at u =
distance / h, where h = max(k // 2, k - 1 - i, k - n + i, 1) is the distance of the k-th. That is
1 - 3 u^3 + 3 u^6 - u^9, so that a window's sum is made of power sums of orders 0 to 9. These are
held about the middles of blocks of about h / 8 rows, in units of a block, so that nothing large
cancels: a window is some twenty whole blocks and two cut ones, whatever the span.

- Series whose k is at most NEAR: rows are dealt to tiles with as many rows to either side as a window
  reaches, and each tile is a numpy kernel over at most TILE + 4 * NEAR rows. Short series are one tile.
- Longer windows: running power sums within blocks, one row a row; what a window's ends need comes by
  two joins on row numbers. Whole blocks' sums are a table of 16 / span rows a series, which goes to
  the tasks (n / 16,000 rows of 80 bytes at most; 5 MB for a series of a thousand million rows).
"""

from __future__ import annotations

import math
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.ordering import numbered
from .base import number

NEAR = 1 << 18
TILE = 1 << 17
#: Rows of a frame up to which a window numbers a series in one task.
NUMBERED = 1 << 17
#: Blocks in half a window.
BLOCKS = 8
TRICUBE = {0: 1, 3: -3, 6: 3, 9: -1}
ORDER = 10


def lowess_span(n: int, span: float) -> int:
    return min(max(math.ceil(n * min(max(span, 0.0), 1.0)), 2), n)


def _gauge(a: np.ndarray, s: np.ndarray | float, side: int) -> list[np.ndarray]:
    """For each order q the factor of sum y x^q in sum y w((s x + a) * side)."""
    out = []
    for q in range(ORDER):
        g = sum(c * side**p * comb(p, q) * a ** (p - q) for p, c in TRICUBE.items() if p >= q)
        out.append(g * s**q)
    return out


def _half_width(i: np.ndarray, n: int, k: int) -> np.ndarray:
    return np.maximum(np.maximum(k // 2, k - 1 - i), np.maximum(k - n + i, 1))


def _weight_sums(left: np.ndarray, right: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sum of the weights of a row with so many rows to its left and right within h."""
    top = int(max(left.max(initial=0), right.max(initial=0)))
    d = np.arange(top + 1, dtype=float)
    powers = {p: np.cumsum((d / max(top, 1)) ** p) - (p == 0) for p in TRICUBE}
    u = max(top, 1) / h
    return 1 + sum(c * u**p * (powers[p][left] + powers[p][right]) for p, c in TRICUBE.items())


def smooth(y: np.ndarray, first: int, n: int, k: int, start: int, end: int) -> np.ndarray:
    """Smoothed rows start to end - 1 of a series of n rows, of which y has those from first on as far
    as the windows reach. NaN where a window has one."""
    i = np.arange(start, end)
    if k < 2:
        return y[i - first]
    h = _half_width(i, n, k)
    lo, hi = np.maximum(i - h + 1, 0), np.minimum(i + h - 1, n - 1)
    block = max(1, (k // 2) // BLOCKS)
    known = np.nan_to_num(y, nan=0.0)
    blocks = -(-len(y) // block)
    z = np.zeros(blocks * block)
    z[: len(y)] = known
    x = (np.arange(block) - (block - 1) / 2) / block
    sums = np.zeros((blocks, block + 1, ORDER))
    np.cumsum(z.reshape(blocks, block)[:, :, None] * x[:, None] ** np.arange(ORDER), axis=1, out=sums[:, 1:])
    top = np.zeros(len(i))
    at = i - first
    for side, s, e in ((1, at, hi + 1 - first), (-1, lo - first, at)):  # the row itself is at the right
        for b in range(int(((e - s + block - 1) // block).max(initial=0)) + 1):
            which = np.minimum(s // block + b, blocks - 1)
            cut = which * block
            beyond = s // block + b >= blocks
            u, v = np.clip(s - cut, 0, block), np.clip(e - cut, 0, block)
            v = np.where(beyond, u, np.maximum(u, v))
            live = np.flatnonzero(v > u)
            if not len(live):
                continue
            w, hl = which[live], h[live].astype(float)
            part = sums[w, v[live]] - sums[w, u[live]]
            gauge = _gauge((cut[live] + (block - 1) / 2 - at[live]) / hl, block / hl, side)
            top[live] += sum(part[:, q] * gauge[q] for q in range(ORDER))
    out = top / _weight_sums(i - lo, hi - i, h.astype(float))
    gaps = np.r_[0, np.cumsum(np.isnan(y))]
    return np.where(gaps[hi + 1 - first] > gaps[lo - first], np.nan, out)


def _tiled(x: DataFrame, columns: list[str], tile: int) -> DataFrame:
    """x (_series, _n, _k, _i, columns) -> _series, _i, smoothed columns: each row goes to the tiles
    whose windows may have it."""
    low, high = F.floor(F.greatest(F.col("_i") - F.col("_k"), F.lit(0)) / tile), F.floor(F.least(F.col("_i") + F.col("_k"), F.col("_n") - 1) / tile)
    dealt = x.withColumn("_tile", F.explode(F.sequence(low, high)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        first, n, k = (int(pdf[c].iloc[0]) for c in ("_i", "_n", "_k"))
        start, end = int(key[1]) * tile, min((int(key[1]) + 1) * tile, n)
        got = {c: smooth(pdf[c].to_numpy(dtype=float), first, n, k, start, end) for c in columns}
        return pd.DataFrame({"_series": key[0], "_i": np.arange(start, end), **got})

    schema = ", ".join(["_series long", "_i long", *[f"{c} double" for c in columns]])
    return dealt.groupBy("_series", "_tile").applyInPandas(run, schema)


def _joined(x: DataFrame) -> DataFrame:
    """The same by running sums within blocks: no task has more than a block's rows in order."""
    half = F.greatest(F.floor(F.col("_k") / 2), F.col("_k") - 1 - F.col("_i"), F.col("_k") - F.col("_n") + F.col("_i"), F.lit(1))
    x = x.withColumns({"_h": half, "_block": F.greatest(F.floor(F.floor(F.col("_k") / 2) / BLOCKS), F.lit(1))})
    x = x.withColumns({"_lo": F.greatest(F.col("_i") - F.col("_h"), F.lit(-1)), "_hi": F.least(F.col("_i") + F.col("_h") - 1, F.col("_n") - 1), "_at": F.floor(F.col("_i") / F.col("_block"))})
    u = (F.col("_i") - F.col("_at") * F.col("_block") - (F.col("_block") - 1) / 2) / F.col("_block")
    order = Window.partitionBy("_series", "_at").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    y = F.when(F.isnan("_y") | F.col("_y").isNull(), 0.0).otherwise(F.col("_y"))
    gap = F.sum((F.isnan("_y") | F.col("_y").isNull()).cast("double"))
    moments = [F.sum(y * F.pow(u, F.lit(q))) for q in range(ORDER)]
    run = x.withColumn("_run", F.array(*[m.over(order) for m in moments], gap.over(order)))
    # a window's running sums end at _hi, and begin after _lo
    ends = run.select("_series", F.col("_i").alias("_hi"), F.col("_run").alias("_run_hi"))
    starts = run.select("_series", F.col("_i").alias("_lo"), F.col("_run").alias("_run_lo"))
    wide = run.join(ends, ["_series", "_hi"]).join(starts, ["_series", "_lo"], "left")
    whole = x.groupBy("_series", "_at").agg(F.array(*moments, gap).alias("_sums")).collect()
    table: dict = {}
    for r in whole:
        table.setdefault(r["_series"], {})[r["_at"]] = r["_sums"]
    table = {s: np.array([v[b] for b in range(len(v))]) for s, v in table.items()}

    def one(pdf: pd.DataFrame, sums: np.ndarray) -> np.ndarray:
        i, lo, hi, h, n = (pdf[c].to_numpy().astype(np.int64) for c in ("_i", "_lo", "_hi", "_h", "_n"))
        block = int(pdf["_block"].iloc[0])
        none = [0.0] * (ORDER + 1)
        here, there, before = (np.array([none if r is None else r for r in pdf[c]]) for c in ("_run", "_run_hi", "_run_lo"))
        value = pdf["_y"].to_numpy(dtype=float)
        own, past = i // block, hi // block
        first = np.where(lo < 0, -1, lo // block)
        mid = (own * block + (block - 1) / 2 - i) / block
        itself = np.column_stack([np.nan_to_num(value)[:, None] * (-mid[:, None]) ** np.arange(ORDER), np.isnan(value)])
        top, gaps = np.zeros(len(i)), np.zeros(len(i))
        # the right side has rows i to hi, the left side lo + 1 to i - 1
        for side, a, b, until, since in ((1, own, past, there, here - itself), (-1, np.where(lo < 0, 0, first), own, here - itself, before)):
            for step in range(int((b - a).max(initial=0)) + 1):
                at = a + step
                live = np.flatnonzero(at <= b)
                if not len(live):
                    break
                part = np.where((at == b)[live, None], until[live], sums[np.minimum(at[live], len(sums) - 1)])
                part = part - (since[live] if step == 0 else 0)
                hl = h[live].astype(float)
                gauge = _gauge((at[live] * block + (block - 1) / 2 - i[live]) / hl, block / hl, side)
                top[live] += sum(part[:, q] * gauge[q] for q in range(ORDER))
                gaps[live] += part[:, ORDER]
        out = top / _weight_sums(i - np.maximum(lo + 1, 0), hi - i, h.astype(float))
        return np.where(gaps > 0.5, np.nan, out)

    def frames(batches):
        for pdf in batches:
            for s, g in pdf.groupby("_series", dropna=False):
                yield pd.DataFrame({"_series": s, "_i": g["_i"], "_smooth": one(g, table[s])})

    wide = wide.select("_series", "_i", "_n", "_h", "_block", "_lo", "_hi", "_y", "_run", "_run_hi", "_run_lo")
    return wide.mapInPandas(frames, "_series long, _i long, _smooth double")


def lowess(df: DataFrame, value: str | list[str], order_by: list[str], span: float = 0.3, keys: list[str] | None = None, output: str | list[str] = "smoothed") -> DataFrame:
    """df with the smoothed value (or values, each under its name in output). keys part the series;
    null keys are equal. A window with a null or NaN gives NaN. Of a long frame the numbered
    rows are held until ordering.release()."""
    values, names = ([value], [output]) if isinstance(value, str) else (list(value), list(output))
    part = keys or []
    series = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in part], *[F.col(c).isNull() for c in part]) if part else F.lit(0).cast("long")
    x = df.withColumn("_series", series)
    sizes = x.groupBy("_series").agg(F.count("*").alias("_n"))
    widest = sizes.agg(F.max("_n")).first()[0]
    if not widest:
        return df.withColumns({o: F.lit(None).cast("double") for o in names})
    held = None
    if widest <= NUMBERED:
        own = Window.partitionBy("_series")
        x = x.withColumns({"_i": F.row_number().over(own.orderBy(*order_by)).cast("long") - 1, "_n": F.count("*").over(own)})
    else:
        x = held = numbered(x, ["_series", *order_by], "_i")
        sizes = sizes.join(x.groupBy("_series").agg(F.min("_i").alias("_first")), "_series")
        x = x.join(sizes if part else F.broadcast(sizes), "_series")
        x = x.withColumn("_i", F.col("_i") - F.col("_first")).drop("_first")
    k = F.least(F.greatest(F.ceil(F.col("_n") * F.lit(float(min(max(span, 0.0), 1.0)))), F.lit(2)), F.col("_n")).cast("long")
    x = x.withColumn("_k", k)
    columns = [f"_y{j}" for j in range(len(values))]
    rows = x.select("_series", "_n", "_k", "_i", *[number(v).alias(c) for v, c in zip(values, columns, strict=True)])
    if lowess_span(widest, span) <= NEAR:
        found = [_tiled(rows, columns, TILE)]
    else:
        found = [_joined(rows.select("_series", "_n", "_k", "_i", F.col(c).alias("_y"))).withColumnRenamed("_smooth", c) for c in columns]
    for f in found:
        x = x.join(f, ["_series", "_i"])
    out = x.withColumns({o: F.col(c) for o, c in zip(names, columns, strict=True)}).drop("_series", "_n", "_i", "_k", *columns)
    if held is not None:
        out._held = held._held
    return out


def lowess_weights(df: DataFrame, columns: list[str], order_by: list[str], span: float = 0.3, keys: list[str] | None = None) -> DataFrame:
    """Smooths each weight column, clips at zero and rescales rows to one (uniform where all vanish)."""
    df = lowess(df, columns, order_by, span, keys, [f"_sm_{c}" for c in columns])
    total = sum((F.greatest(F.col(f"_sm_{c}"), F.lit(0.0)) for c in columns), F.lit(0.0))
    df = df.withColumn("_total", total)
    even = F.lit(1.0 / len(columns))
    df = df.withColumns({c: F.when(F.col("_total") > 1e-10, F.greatest(F.col(f"_sm_{c}"), F.lit(0.0)) / F.col("_total")).otherwise(even) for c in columns})
    return df.drop("_total", *[f"_sm_{c}" for c in columns])
