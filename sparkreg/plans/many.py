"""Many iterative fits over one frame.

A fit is a generator: it yields an Ask, aggregates over the rows that it needs next, and is sent their
values. together() advances all fits that still run by one aggregation a round; fits that have ended
or failed ask for nothing any more. So a set of families, subsets, starts or quantiles costs about the
steps of its slowest member, not their sum, and one fit alone is the same code.
"""

from __future__ import annotations

from collections.abc import Callable, Generator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import na
from ..errors import AllNa, NaValuesPresent, RegressionError
from .moments import NARROW, Moments, _pairs, moments

#: Row expressions and aggregates of one job: code that is much longer is not compiled by the JVM.
MOST_ROWS, MOST_SUMS = 24, 120
#: Jobs of different fits that run beside each other.
JOBS = 8


@dataclass
class Ask:
    """rows: expressions a row, by name; sums: from these (name -> Column) the aggregates. base:
    expressions that many of the rows' refer to, which are columns by then (rows is a function of them)."""

    rows: dict[str, Column] | Callable[[dict[str, Column]], dict[str, Column]]
    sums: Callable[[dict[str, Column]], list[Column]]
    base: dict[str, Column] = field(default_factory=dict)

    def named(self, i: int) -> tuple[list[Column], list[Column], list[Column]]:
        """Columns of the base, of the rows, and aggregates, under names of fit i."""
        base = {k: F.col(f"_{i}_b_{k}") for k in self.base}
        rows = self.rows(base) if callable(self.rows) else self.rows
        return (
            [c.alias(f"_{i}_b_{k}") for k, c in self.base.items()], [c.alias(f"_{i}_{k}") for k, c in rows.items()], self.sums({k: F.col(f"_{i}_{k}") for k in rows})
        )


@dataclass
class Direct:
    """What one aggregation cannot say (medians, wide designs): a function of the frame."""

    run: Callable[[DataFrame], list]


@dataclass
class View:
    """One fit's part of a frame that fits share: its features x, response y, offset o, case weight c,
    and which rows are its own (None: all)."""

    x: list[Column]
    y: Column
    o: Column = field(default_factory=lambda: F.lit(0.0))
    c: Column = field(default_factory=lambda: F.lit(1.0))
    own: Column | None = None

    @property
    def p(self) -> int:
        return len(self.x)

    def of(self, y: Column) -> View:
        return View(self.x, y, self.o, self.c, self.own)

    def eta(self, b: np.ndarray, intercept: bool) -> Column:
        """Linear predictor without the offset."""
        out = F.lit(float(b[0])) if intercept else F.lit(0.0)
        for v, x in zip(b[1:] if intercept else b, self.x, strict=True):
            out = out + x * F.lit(float(v))
        return out

    def mine(self, c: Column) -> Column:
        return c if self.own is None else F.when(self.own, c)

    def rows(self, df: DataFrame) -> DataFrame:
        return df if self.own is None else df.filter(self.own)

    def ask(self, **aggregates: Column) -> Generator:
        """Values of plain sums of row expressions, by name."""
        names = list(aggregates)
        values = yield Ask({k: self.mine(v) for k, v in aggregates.items()}, lambda r: [F.sum(r[k]) for k in names])
        return dict(zip(names, values, strict=True))

    def moments(self, z: Column, w: Column, **more: Column) -> Generator:
        """Moments of (x, z) with weight w, about zero, and further sums, in one Ask."""
        names, p = list(more), self.p
        if p > NARROW:
            def wide(df: DataFrame) -> list:
                x = self.rows(df).select(*[c.alias(f"x{j}") for j, c in enumerate(self.x)], z.alias("_z"), w.alias("_w"), *[c.alias(k) for k, c in more.items()])
                m = moments(x, [f"x{j}" for j in range(p)], "_z", "_w", shift=np.zeros(p + 1))
                return [m, *(x.agg(*[F.sum(k) for k in names]).first() if names else [])]

            m, *rest = yield Direct(wide)
            return m, dict(zip(names, rest, strict=True))

        def sums(r: dict[str, Column]) -> list[Column]:
            v, weight = [*self.x, r["z"]], r["w"]
            out = [F.count(weight), F.sum((weight > 1e-14).cast("long")), F.sum(weight)]
            out += [F.sum(a * weight) for a in v] + [F.sum(v[i] * v[j] * weight) for i, j in _pairs(p + 1)]
            return out + [F.sum(r[k]) for k in names]

        values = yield Ask({"z": self.mine(z), "w": self.mine(w), **{k: self.mine(c) for k, c in more.items()}}, sums)
        number = [0.0 if v is None else float(v) for v in values]
        q = np.zeros((p + 1, p + 1))
        for (i, j), v in zip(_pairs(p + 1), number[4 + p :], strict=False):
            q[i, j] = q[j, i] = v
        m = Moments(int(number[0]), int(number[1]), number[2], np.array(number[3 : 4 + p]), q, np.zeros(p + 1))
        return m, dict(zip(names, values[len(values) - len(names) :] if names else [], strict=True))


def with_points(df: DataFrame, points: list[np.ndarray]) -> tuple[DataFrame, list[Column]]:
    """df with each row once for each point (_point: its place), and the columns of a point's numbers.
    Points are data, not code: what is computed of them is compiled once for all rounds of a fit."""
    names = [f"_p{j}" for j in range(len(points[0]))]
    cells = F.array(*[F.struct(F.lit(i).alias("_point"), *[F.lit(float(v)).alias(n) for n, v in zip(names, p, strict=True)]) for i, p in enumerate(points)])
    x = df.select("*", F.explode(cells).alias("_at")).select("*", "_at.*").drop("_at")
    return x, [F.col(n) for n in names]


def at_points(df: DataFrame, points: list[np.ndarray], sums: Callable[[list[Column]], list[Column]], *steps: Callable[[list[Column]], dict[str, Column]]) -> np.ndarray:
    """Sums at each point, a row for each. steps name row expressions, later ones by means of earlier ones."""
    x, p = with_points(df, points)
    for step in steps:
        x = x.select("*", *[c.alias(k) for k, c in step(p).items()])
    found = {r[0]: list(r)[1:] for r in x.groupBy("_point").agg(*[c.alias(f"v{j}") for j, c in enumerate(sums(p))]).collect()}
    return np.array([[np.nan if v is None else v for v in found[i]] for i in range(len(points))], dtype=float)


def together(df: DataFrame, fits: list[Generator], keep_errors: bool = False) -> list:
    """Results of the fits, in their order. A fit that raises ends alone: its error is its result with
    keep_errors, else raised once all have ended."""
    results: list = [None] * len(fits)
    live: dict[int, Ask | Direct] = {}

    def advance(i: int, values) -> None:
        live.pop(i, None)
        try:
            live[i] = next(fits[i]) if values is None else fits[i].send(values)
        except StopIteration as end:
            results[i] = end.value
        except (RegressionError, np.linalg.LinAlgError) as error:
            results[i] = error

    for i in range(len(fits)):
        advance(i, None)
    while live:
        direct = [i for i, a in live.items() if isinstance(a, Direct)]
        with ThreadPoolExecutor(JOBS) as pool:
            got: dict[int, list] = dict(zip(direct, pool.map(lambda i: live[i].run(df), direct), strict=True))
        parts: list[list[tuple]] = [[]]
        for i, a in live.items():
            if isinstance(a, Ask):
                base, rows, sums = a.named(i)
                wide = sum(len(r) for _, _, r, _ in parts[-1]) + len(rows) > MOST_ROWS or sum(len(s) for *_, s in parts[-1]) + len(sums) > MOST_SUMS
                if wide and parts[-1]:
                    parts.append([])
                parts[-1].append((i, base, rows, sums))
        for part in parts:
            if part:
                x = df
                if bases := [c for _, base, _, _ in part for c in base]:
                    x = x.select("*", *bases)
                x = x.select("*", *[c for _, _, rows, _ in part for c in rows])
                row = iter(x.agg(*[s.alias(f"v{k}") for k, s in enumerate(s for *_, sums in part for s in sums)]).first())
                got |= {i: [next(row) for _ in sums] for i, _, _, sums in part}
        for i, values in got.items():
            advance(i, values)
    errors = [r for r in results if isinstance(r, Exception)]
    if errors and not keep_errors:
        raise errors[0]
    return results


def fit_together(df: DataFrame, estimators: list, keep_errors: bool = False) -> list:
    """Models of estimators that have inputs() (features, label, offset, weight) and steps(view), over
    one frame that holds each of their columns once. A row that lacks a value of one estimator is left
    out of that one only."""
    need: dict[str, str] = {}
    for e in estimators:
        features, label, offset, weight = e.inputs()
        for c in [*features, label, *[c for c in (offset, weight) if c]]:
            need.setdefault(c, f"c{len(need)}")
    # rows with all values: the frame of one estimator, or of estimators that share their gaps
    x = df.select(*[F.col(c).cast("double").alias(name) for c, name in need.items()])
    missing = {c: x[name].isNull() | F.isnan(x[name]) for c, name in need.items()}
    used = [sorted({*e.inputs()[0], e.inputs()[1], *[c for c in e.inputs()[2:] if c]}) for e in estimators]
    action = [getattr(e, "na_action", "omit") for e in estimators]
    alike = all(u == used[0] for u in used) and len(set(action)) == 1
    either = lambda u: reduce(lambda a, b: a | b, [missing[c] for c in u])
    if alike and action[0] != "pass":
        x = na.process(x, [need[c] for c in used[0]], action[0])
    x = x.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        own: list[Column | None] = [None] * len(estimators)
        if not alike:
            gaps = x.agg(*[F.max(either(u).cast("int")) for u in used]).first()
            for i, (u, gap) in enumerate(zip(used, gaps, strict=True)):
                if gap and action[i] == "fail":
                    raise NaValuesPresent("missing values in " + ", ".join(u))
                own[i] = ~either(u) if gap and action[i] != "pass" else None
        views = []
        for e, mine in zip(estimators, own, strict=True):
            features, label, offset, weight = e.inputs()
            col = lambda c: F.col(need[c])
            views.append(View([col(c) for c in features], col(label), col(offset) if offset else F.lit(0.0), col(weight) if weight else F.lit(1.0), mine))
        return together(x, [e.steps(v) for e, v in zip(estimators, views, strict=True)], keep_errors)
    except RegressionError:
        if not df.isEmpty() and x.isEmpty():
            raise AllNa("every row has a missing value") from None
        raise
    finally:
        x.unpersist()
