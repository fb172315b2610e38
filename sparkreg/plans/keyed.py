"""Iterative fits by key: coefficients are a table with a row a key.

A step joins the rows of unsettled keys to their candidate coefficients, sums what the step needs by
key (combined within tasks before anything is shuffled, so that a key with a third of all rows is one
row a task), and an update looks at each key's sums alone. Keys that have converged or failed keep
their row and are joined no more; the loop ends when none is left. The table is written after each
step. No group of rows is ever brought together, and the driver sees counts only.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RegressionError
from .moments import Moments, _pairs
from .written import dropped, written

STATE = T.StructType(
    [
        T.StructField("candidate", T.ArrayType(T.DoubleType())), T.StructField("b", T.ArrayType(T.DoubleType())), T.StructField("sums", T.ArrayType(T.DoubleType())),
        T.StructField("halved", T.IntegerType()), T.StructField("steps", T.IntegerType()), T.StructField("status", T.StringType()),
    ]
)


@dataclass
class Key:
    """A key's fit: candidate coefficients (None: the start), the last accepted ones, and the sums there."""

    candidate: np.ndarray | None = None
    b: np.ndarray | None = None
    sums: np.ndarray | None = None
    halved: int = 0
    steps: int = 0
    status: str | None = None
    now: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def row(self) -> tuple:
        lists = [None if v is None else [float(x) for x in v] for v in (self.candidate, self.b, self.sums)]
        return *lists, self.halved, self.steps, self.status


def sums_of(x: list[Column], z: Column, w: Column, more: list[Column]) -> list[Column]:
    """Aggregates of the moments of (x, z) with weight w about zero, and of more."""
    v = [*x, z]
    out = [F.count(w).cast("double"), F.sum((w > 1e-14).cast("double")), F.sum(w)]
    return out + [F.sum(a * w) for a in v] + [F.sum(v[i] * v[j] * w) for i, j in _pairs(len(v))] + [F.sum(c) for c in more]


def moments_of(sums: np.ndarray, p: int) -> tuple[Moments, np.ndarray]:
    """Moments and what else was summed."""
    q = np.zeros((p + 1, p + 1))
    pairs = _pairs(p + 1)
    for (i, j), v in zip(pairs, sums[4 + p :], strict=False):
        q[i, j] = q[j, i] = v
    return Moments(int(sums[0]), int(sums[1]), sums[2], sums[3 : 4 + p], q, np.zeros(p + 1)), sums[4 + p + len(pairs) :]


def fit_keys(rows: DataFrame, keys: list[str], ask: Callable[[Column, Column], list[Column]], update: Callable[[Key], None], limit: int) -> DataFrame:
    """rows (keys and what ask reads) -> keys and STATE. ask: from the candidate (an array; null at
    the start) and a flag that it is the start, the aggregates; update: from a Key whose sums are in
    now, its next candidate or its status."""
    names = [f"_k{i}" for i in range(len(keys))]
    types = [rows.schema[k] for k in keys]
    schema = T.StructType([*[T.StructField(n, t.dataType) for n, t in zip(names, types, strict=True)], *STATE])
    rows = rows.withColumnsRenamed(dict(zip(keys, names, strict=True))).persist(StorageLevel.MEMORY_AND_DISK)
    state, same = None, lambda a, b: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]

    def advance(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                get = lambda c: None if (v := getattr(r, c)) is None else np.array(v, dtype=float)  # noqa: B023, E731
                key = Key(get("candidate"), get("b"), get("sums"), int(r.halved), int(r.steps), None, np.array([math.nan if v is None else v for v in r.now], dtype=float))
                try:
                    update(key)
                except (RegressionError, np.linalg.LinAlgError) as error:
                    key.status = f"{type(error).__name__}: {error}"
                out.append((*[getattr(r, f"key{i}") for i in range(len(names))], *key.row()))
            yield pd.DataFrame(out, columns=schema.names)

    try:
        for _ in range(limit):
            if state is None:
                met = rows.withColumns({"candidate": F.lit(None).cast("array<double>"), "b": F.lit(None).cast("array<double>"), "sums": F.lit(None).cast("array<double>"), "halved": F.lit(0), "steps": F.lit(0)}).alias("r")
                first = [F.any_value(F.col(c)).alias(c) for c in STATE.names[:-1]]
                now = met.groupBy(*names).agg(F.array(*ask(F.col("candidate"), F.lit(True))).alias("now"), *first)
            else:
                live = state.filter("status is null")
                told = live.select(*names, "candidate")
                met = rows.alias("r").join(told.alias("s"), same("r", "s")).select("r.*", "s.candidate")
                now = met.groupBy(*names).agg(F.array(*ask(F.col("candidate"), F.lit(False))).alias("now"))
                now = now.alias("n").join(live.alias("s"), same("n", "s")).select("s.*", "n.now")
            asked = now.select(*[F.col(n).alias(f"key{i}") for i, n in enumerate(names)], "now", *STATE.names[:-1])
            new = asked.mapInPandas(advance, schema)
            if state is not None:
                new = new.unionByName(state.filter("status is not null"))
            old, state = state, written(new)
            if old is not None:
                dropped(old)
            if state.filter("status is null").isEmpty():
                break
        return state.withColumnsRenamed(dict(zip(names, keys, strict=True)))
    finally:
        rows.unpersist()
