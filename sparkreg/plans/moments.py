"""Sufficient statistics: one aggregation of cross products instead of a design matrix.

Up to NARROW columns the sums are Catalyst aggregates (code-generated, combined before the shuffle);
wider designs multiply Arrow batches by themselves and ship one small row a task. All sums are of
values minus a common shift (the global means), which keeps digits that raw sums of squares lose.
Moments add: merge() of parts equals the moments of the whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DimensionMismatch

NARROW = 8
#: Tasks that add up the rows of a wide design's tasks.
TREE = 64


@dataclass
class Moments:
    """Weighted sums over rows of z = (x1, ..., xp, y) - shift."""

    n: int
    positive: int
    sw: float
    s: np.ndarray
    q: np.ndarray
    shift: np.ndarray

    @property
    def p(self) -> int:
        return len(self.s) - 1

    def centred(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Sxx, Sxy, Syy about the weighted means."""
        q = self.q - np.outer(self.s, self.s) / self.sw if self.sw > 0 else self.q
        return q[:-1, :-1], q[:-1, -1], float(q[-1, -1])

    def means(self) -> tuple[np.ndarray, float]:
        m = self.shift + (self.s / self.sw if self.sw > 0 else 0)
        return m[:-1], float(m[-1])

    def raw(self) -> tuple[np.ndarray, np.ndarray, float]:
        """X'X, X'y, y'y about zero."""
        q = self.q + np.outer(self.s, self.shift) + np.outer(self.shift, self.s) + self.sw * np.outer(self.shift, self.shift)
        return q[:-1, :-1], q[:-1, -1], float(q[-1, -1])

    def augmented(self) -> np.ndarray:
        """[1 X]'[1 X]."""
        xx, _, _ = self.raw()
        sx = self.s[:-1] + self.sw * self.shift[:-1]
        return np.block([[np.array([[self.sw]]), sx[None, :]], [sx[:, None], xx]])

    def shifted(self, shift: np.ndarray) -> Moments:
        d = self.shift - shift
        q = self.q + np.outer(self.s, d) + np.outer(d, self.s) + self.sw * np.outer(d, d)
        return Moments(self.n, self.positive, self.sw, self.s + self.sw * d, q, shift)

    def merge(self, other: Moments) -> Moments:
        if len(self.s) != len(other.s):
            raise DimensionMismatch("moments of different numbers of columns")
        o = other.shifted(self.shift)
        return Moments(self.n + o.n, self.positive + o.positive, self.sw + o.sw, self.s + o.s, self.q + o.q, self.shift)

    @classmethod
    def empty(cls, p: int) -> Moments:
        return cls(0, 0, 0.0, np.zeros(p + 1), np.zeros((p + 1, p + 1)), np.zeros(p + 1))

    def push(self, x, y: float, w: float = 1.0) -> Moments:
        z = np.r_[np.asarray(x, dtype=float), y] - self.shift
        return Moments(self.n + 1, self.positive + (w > 1e-14), self.sw + w, self.s + w * z, self.q + w * np.outer(z, z), self.shift)


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _quoted(name: str):
    return F.col(name).cast("double")


def aggregates(columns: list[str], weight: str | None, shift: np.ndarray) -> list:
    """The sums as aggregate Columns; columns are the features and then the response."""
    z = [_quoted(c) - F.lit(float(a)) for c, a in zip(columns, shift, strict=True)]
    w = _quoted(weight) if weight else None
    one = w if weight else F.lit(1.0)
    out = [F.count("*").alias("_n"), F.sum((one > 1e-14).cast("long")).alias("_pos"), F.sum(one).alias("_sw")]
    out += [F.sum(z[i] * one if weight else z[i]).alias(f"_s{i}") for i in range(len(z))]
    return out + [F.sum(z[i] * z[j] * one if weight else z[i] * z[j]).alias(f"_q{i}_{j}") for i, j in _pairs(len(z))]


def from_row(row, k: int, shift: np.ndarray) -> Moments:
    get = (lambda c: row[c]) if not hasattr(row, "_asdict") else row._asdict().__getitem__
    val = lambda c: 0.0 if get(c) is None else float(get(c))
    q = np.zeros((k, k))
    for i, j in _pairs(k):
        q[i, j] = q[j, i] = val(f"_q{i}_{j}")
    return Moments(int(val("_n")), int(val("_pos")), val("_sw"), np.array([val(f"_s{i}") for i in range(k)]), q, shift)


def means(df: DataFrame, columns: list[str]) -> np.ndarray:
    row = df.agg(*[F.avg(_quoted(c)).alias(f"m{k}") for k, c in enumerate(columns)]).first()
    return np.array([0.0 if v is None or not np.isfinite(v) else v for v in row])


def _wide(k: int, weighted: bool, shift: np.ndarray, keys: int):
    """Partial sums by key of a task's rows, as flat arrays (n, positive, sw, s, q)."""

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        names = None
        types = None
        for b in batches:
            names, types = b.schema.names[:keys], [b.schema.field(i).type for i in range(keys)]
            z = np.stack([b.column(keys + i).to_numpy(zero_copy_only=False) for i in range(k)], axis=1).astype(float) - shift
            w = b.column(keys + k).to_numpy(zero_copy_only=False).astype(float) if weighted else np.ones(len(z))
            if keys:
                key = list(zip(*[b.column(i).to_pylist() for i in range(keys)], strict=True))
                code: dict[tuple, int] = {}
                at = np.fromiter((code.setdefault(x, len(code)) for x in key), np.int64, len(key))
                parts = [(x, np.flatnonzero(at == c)) for x, c in code.items()]
            else:
                parts = [((), slice(None))]
            for x, rows in parts:
                zz, ww = z[rows], w[rows]
                flat = np.r_[len(zz), (ww > 1e-14).sum(), ww.sum(), (zz * ww[:, None]).sum(0), ((zz * ww[:, None]).T @ zz).ravel()]
                sums[x] = sums[x] + flat if x in sums else flat
        if sums:
            ks = list(sums)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([x[i] for x in ks], types[i]) for i in range(keys)], pa.array([sums[x].tolist() for x in ks], pa.list_(pa.float64()))],
                [*names, "_flat"],
            )

    return wide


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the arrays of a partition."""
    total = None
    for b in batches:
        for row in b.column(0):
            x = row.values.to_numpy(zero_copy_only=False)
            total = x.copy() if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["_flat"])


def _unflat(flat: np.ndarray, k: int, shift: np.ndarray) -> Moments:
    return Moments(int(flat[0]), int(flat[1]), float(flat[2]), flat[3 : 3 + k], flat[3 + k :].reshape(k, k), shift)


def moments(df: DataFrame, features: list[str], label: str, weight: str | None = None, shift: np.ndarray | None = None, narrow: int = NARROW) -> Moments:
    """Moments of all rows: two scans, the first for the shift."""
    columns = [*features, label]
    k = len(columns)
    shift = means(df, columns) if shift is None else shift
    if k <= narrow + 1:
        return from_row(df.agg(*aggregates(columns, weight, shift)).first().asDict(), k, shift)
    cols = [_quoted(c).alias(f"z{i}") for i, c in enumerate([*columns, *([weight] if weight else [])])]
    flat = df.select(*cols).mapInArrow(_wide(k, bool(weight), shift, 0), "_flat array<double>")
    size = 3 + k + k * k
    row = flat.agg(*[F.sum(F.col("_flat")[i]) for i in range(size)]).first() if size <= 200 else None
    if row is not None:
        return _unflat(np.array([0.0 if v is None else v for v in row]), k, shift)
    # one row a task, added up in a second stage of TREE tasks at most, so that few reach the driver
    tree = flat.repartition(min(TREE, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(_add, "_flat array<double>")
    total = np.zeros(size)
    for r in tree.toLocalIterator():
        total += np.array(r[0])
    return _unflat(total, k, shift)


def grouped_moments(df: DataFrame, keys: list[str], features: list[str], label: str, weight: str | None = None, shift: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """One row of sums for each group, about the global means, and that shift."""
    columns = [*features, label]
    shift = means(df, columns) if shift is None else shift
    return df.groupBy(*keys).agg(*aggregates(columns, weight, shift)), shift
