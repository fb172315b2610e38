"""Tall-skinny QR: the triangular factor of a design whose rows are spread over tasks.

Each task folds its Arrow batches into one triangle, and triangles are folded into each other in a
tree, so that no task and not the driver has more than a few p x p matrices beside a batch. A Gram
matrix squares the condition of the design; a triangle does not, so that rank and coefficients have
the digits a factorization of the whole design would give.

For singular values beyond the reach of doubles, refined() divides the rows by the triangle in pairs
of doubles: what comes out is nearly orthonormal, its Gram matrix is a plain sum and corrects the
triangle by a factor, and a factor changes all singular values relatively.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Triangles that reach the driver, and that a task of a higher level folds.
TREE = 64
#: Rows that are folded at once.
FOLD = 4096
EPS = np.finfo(float).eps
#: What rounding leaves of a column that depends on others, at most, in epsilons of its norm (seen: 500).
ROUNDING = 2000


def upper(x: np.ndarray) -> np.ndarray:
    """Triangle with a diagonal that is not negative, p x p also for fewer rows."""
    p = x.shape[1]
    r = np.linalg.qr(np.vstack([x, np.zeros((max(0, p - len(x)), p))]), mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(b.num_columns)])


def _flat(x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.ravel().tolist()], pa.list_(pa.float64()))], ["flat"])


class _Pairs:
    """Triangles folded two of a height at a time, so that rounding grows with the height, not their number."""

    def __init__(self):
        self.by_height: dict[int, np.ndarray] = {}

    def add(self, r: np.ndarray) -> None:
        h = 0
        while h in self.by_height:
            r = upper(np.vstack([self.by_height.pop(h), r]))
            h += 1
        self.by_height[h] = r

    def one(self) -> np.ndarray | None:
        rest = [self.by_height[h] for h in sorted(self.by_height)]
        return upper(np.vstack(rest)) if rest else None


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = _Pairs()
    for b in batches:
        x = _matrix(b)
        for s in range(0, len(x), FOLD):
            pairs.add(upper(x[s : s + FOLD]))
    r = pairs.one()
    if r is not None:
        yield _flat(r)


def _fold_triangles(p: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _Pairs()
        for b in batches:
            for row in b.column(0):
                pairs.add(row.values.to_numpy(zero_copy_only=False).reshape(p, p))
        r = pairs.one()
        if r is not None:
            yield _flat(r)

    return fold


def r_factor(df: DataFrame, columns: list[Column]) -> np.ndarray:
    """R of the QR factorization of the columns, in their order; zeros for an empty frame."""
    p = len(columns)
    rows = df.select(*[c.cast("double").alias(f"q{i}") for i, c in enumerate(columns)])
    level = rows.mapInArrow(_fold, "flat array<double>")
    few = min(TREE, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    level = level.repartition(few).mapInArrow(_fold_triangles(p), "flat array<double>")
    pairs = _Pairs()
    for row in level.toLocalIterator():
        pairs.add(np.array(row[0]).reshape(p, p))
    r = pairs.one()
    return np.zeros((p, p)) if r is None else r


def pivoted_r(r: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Triangle of the column-pivoted factorization (largest remaining norm first, ties by index), and
    the columns in that order: the same from R as from the design."""
    a, p = r.astype(float).copy(), r.shape[1]
    order = list(range(p))
    for k in range(p):
        norms = np.linalg.norm(a[k:, k:], axis=0)
        j = k + int(np.argmax(norms > norms.max() * (1 - 1e-12)))
        a[:, [k, j]] = a[:, [j, k]]
        order[k], order[j] = order[j], order[k]
        v = a[k:, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
    return np.triu(a), order


def independent(r: np.ndarray, tolerance: float) -> list[int]:
    """Columns of full rank: pivoting ends at the first diagonal element within the tolerance, or
    within what rounding leaves of a column that depends on others."""
    t, order = pivoted_r(r)
    floor = ROUNDING * EPS * np.linalg.norm(r, axis=0)
    rank = 0
    for k, j in enumerate(order):
        if abs(t[k, k]) <= max(tolerance, floor[j]):
            break
        rank += 1
    return sorted(order[:rank])


# pairs of doubles


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = 134217729.0 * a
    high = c - (c - a)
    return high, a - high


def _product(a: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
    p = a * b
    (ah, al), (bh, bl) = _split(a), _split(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def _sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = a + b
    z = s - a
    return s, (a - (s - z)) + (b - z)


def _less(x: tuple, y: tuple, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """x - y * factor, all but the factor pairs."""
    p, e = _product(y[0], factor)
    s, t = _sum(x[0], -p)
    return _sum(s, t + (x[1] - e - y[1] * factor))


def _over(x: tuple, divisor: float) -> tuple[np.ndarray, np.ndarray]:
    q = x[0] / divisor
    p, e = _product(q, divisor)
    return _sum(q, ((x[0] - p) - e + x[1]) / divisor)


def _near_orthonormal(r: np.ndarray):
    p = len(r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((p, p))
        for b in batches:
            x = _matrix(b)
            out = []
            for j in range(p):
                col = (x[:, j], np.zeros(len(x)))
                for k in range(j):
                    if r[k, j]:
                        col = _less(col, out[k], r[k, j])
                out.append(_over(col, r[j, j]))
            q = np.column_stack([c[0] for c in out]) if len(x) else np.zeros((0, p))
            gram += q.T @ q
        yield _flat(gram)

    return run


def refined(df: DataFrame, columns: list[Column], r: np.ndarray) -> np.ndarray:
    """The factor C that makes C r the triangle to about 1e-13 of each singular value."""
    p = len(columns)
    rows = df.select(*[c.cast("double").alias(f"q{i}") for i, c in enumerate(columns)])
    flat = rows.mapInArrow(_near_orthonormal(r), "flat array<double>")
    sums = flat.select(F.posexplode("flat")).groupBy("pos").agg(F.sum("col").alias("v")).collect()
    gram = np.zeros(p * p)
    for s in sums:
        gram[s["pos"]] = s["v"]
    return np.linalg.cholesky(gram.reshape(p, p)).T


def _inverse(r: np.ndarray) -> np.ndarray:
    """Inverse of a triangle by pairs of doubles."""
    p = len(r)
    out: list[tuple] = []
    eye = np.eye(p)
    for j in range(p):
        col = (eye[:, j], np.zeros(p))
        for k in range(j):
            col = _less(col, out[k], r[k, j])
        out.append(_over(col, r[j, j]))
    return np.column_stack([c[0] for c in out])


def singular_values(df: DataFrame, columns: list[Column]) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors of the columns. The large ones are those
    of the triangle, the small ones those of its inverse, so that each has about 1e-9 of itself up to
    a condition of 1e14."""
    r = r_factor(df, columns)
    _, s, vt = np.linalg.svd(r)
    diagonal = np.diag(r)
    if not len(s) or diagonal.min() <= 4 * EPS * s[0]:
        return s, vt.T
    try:
        c = refined(df, columns, r)
    except np.linalg.LinAlgError:  # beyond what the triangle separates
        return s, vt.T
    _, s, vt = np.linalg.svd(c @ r)
    # (C r)^-1 = r^-1 C^-1, with C near one
    u, inverse, _ = np.linalg.svd(_inverse(r) @ np.linalg.inv(c))
    small = 1 / inverse[::-1]
    use = s * inverse[0] > np.sqrt(s[0] * inverse[0])  # above the geometric middle of the range
    return np.where(use, s, small), np.where(use[None, :], vt.T, u[:, ::-1])
