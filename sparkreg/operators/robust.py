"""Robust, quantile, monotone and online estimators, and local smoothing."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Generator, Iterator
from operator import mul

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import na
from ..errors import InsufficientObservations, InvalidOptions, SingularMatrix
from ..plans.irls import normal_equations, solve
from ..plans.moments import NARROW, _pairs
from ..plans.many import Direct, View, at_points, fit_together, with_points
from ..plans.ordering import median, numbered, quantile, release
from ..plans.solve import least_check, spatial_median
from .asof import asof_join
from .base import number
from .linear import OLS


class LinearModel:
    """Coefficients over named columns, without intervals."""

    def __init__(self, features, label, intercept, coefficients, **more):
        self.features, self.label, self.intercept, self.coefficients = list(features), label, intercept, np.asarray(coefficients)
        self.__dict__.update(more)

    def predict(self) -> Column:
        out = F.lit(float(self.intercept or 0.0))
        for f, v in zip(self.features, self.coefficients, strict=True):
            out = out + number(f) * F.lit(float(v))
        return out

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return df.withColumn(output, self.predict())

    def augment(self, df: DataFrame) -> DataFrame:
        return df.withColumn("fitted", self.predict()).withColumn("residual", number(self.label) - F.col("fitted"))


def _split(b: np.ndarray, intercept: bool) -> tuple[float | None, np.ndarray]:
    return (float(b[0]), b[1:]) if intercept else (None, b)


class Huber:
    """Huber's M-estimator by reweighting from OLS; the scale is the median absolute residual over
    0.6745, exact, at each step; alpha is a ridge on the slopes."""

    def __init__(self, features, label, epsilon: float = 1.35, alpha: float = 1e-4, max_iter: int = 100, tol: float = 1e-5, intercept: bool = True):
        if epsilon <= 1:
            raise InvalidOptions("epsilon must be over 1")
        self.features, self.label, self.epsilon, self.alpha = list(features), label, epsilon, alpha
        self.max_iter, self.tol, self.intercept = max_iter, tol, intercept

    def inputs(self) -> tuple:
        return self.features, self.label, None, None

    def fit(self, df: DataFrame) -> LinearModel:
        return fit_together(df, [self])[0]

    def steps(self, view: View) -> Generator:
        y = view.y
        m, _ = yield from view.moments(y, F.lit(1.0))
        n = m.n
        if n < len(self.features) + (2 if self.intercept else 1):
            raise InsufficientObservations(f"{n} rows")
        b = solve(*normal_equations(m, self.intercept))
        converged, sigma = False, 0.0
        for step in range(1, self.max_iter + 1):  # noqa: B007
            r = y - view.eta(b, self.intercept)
            (middle,) = yield Direct(lambda df, r=r: [median(view.rows(df), F.abs(r))])
            sigma = max(middle / 0.6745, 1e-10)
            u = F.abs(r / F.lit(sigma))
            m, _ = yield from view.moments(y, F.when(u <= self.epsilon, F.lit(1.0)).otherwise(self.epsilon / u))
            new = solve(*normal_equations(m, self.intercept, self.alpha))
            moved = abs(new - b).max()
            b = new
            if moved < self.tol:
                converged = True
                break
        a, c = _split(b, self.intercept)
        return HuberModel(self.features, self.label, a, c, scale=sigma, epsilon=self.epsilon, converged=converged, iterations=step, n=n)


class HuberModel(LinearModel):
    def outliers(self, df: DataFrame) -> DataFrame:
        return self.augment(df).withColumn("outlier", F.abs("residual") > self.epsilon * self.scale)


#: Rows nearest to the line among which vertices are looked for, and vertices that are tried at once.
NEAREST, VERTICES = 14, 91
#: Rows nearest to the line that the exact finish has on the driver at once.
BAND = 4096


class Quantile:
    """Quantile regression: reweighting by tau or 1 - tau over the absolute residual, and then an exact
    finish.

    Reweighting comes near the optimum and no further. The finish takes the rows nearest to the line as
    they are and all others by the side on which they lie, as their summed gradient. That is never above
    the loss and equal to it at the line; its optimum, found on few rows, is the next line, or a part of
    the way where the loss of all rows rises again. Where it is no better than the line, no line is."""

    def __init__(self, features, label, tau: float = 0.5, weight: str | None = None, max_iter: int = 100, tol: float = 1e-6, epsilon: float = 1e-6, intercept: bool = True):
        if not 0 < tau < 1:
            raise InvalidOptions("tau must lie in (0, 1)")
        self.features, self.label, self.tau, self.weight = list(features), label, tau, weight
        self.max_iter, self.tol, self.epsilon, self.intercept = max_iter, tol, epsilon, intercept

    def inputs(self) -> tuple:
        return self.features, self.label, None, self.weight

    def fit(self, df: DataFrame) -> LinearModel:
        return fit_together(df, [self])[0]

    def row(self, r: Column) -> Column:
        """Check loss of a residual."""
        return F.when(r >= 0, self.tau * r).otherwise((self.tau - 1) * r)

    def check(self, view: View, b: np.ndarray) -> Column:
        return view.c * self.row(view.y - view.eta(b, self.intercept))

    def design(self, view: View) -> list[Column]:
        return [*([F.lit(1.0)] if self.intercept else []), *view.x]

    def residual(self, view: View) -> Callable[[list[Column]], dict[str, Column]]:
        """Of the line whose coefficients are a point's numbers."""

        def named(p: list[Column]) -> dict[str, Column]:
            r = view.y
            for v, x in zip(p, self.design(view), strict=False):
                r = r - x * v
            return {"_r": r}

        return named

    def losses(self, view: View, lines: list[np.ndarray], row: Callable[[Column], Column] | None = None) -> Generator:
        """The loss (of a residual: row) of all rows at each line."""
        one = (row or self.row)(F.col("_r"))
        found = yield Direct(lambda df: at_points(view.rows(df), lines, lambda p: [F.sum(view.c * one)], self.residual(view)))
        return found[:, 0]

    def nearest(self, view: View, b: np.ndarray, most: int, distinct: bool) -> Generator:
        """Rows (design, y, weight, absolute residual) nearest to the line; distinct ones with their weights summed."""

        def run(df: DataFrame) -> list:
            x, p = with_points(view.rows(df), [b])
            d = [c.cast("double").alias(f"_d{j}") for j, c in enumerate([*self.design(view), view.y])]
            x = x.select("*", *[c.alias(k) for k, c in self.residual(view)(p).items()]).select(*d, view.c.alias("_w"), F.abs("_r").alias("_far"))
            if distinct:
                x = x.groupBy(*[f"_d{j}" for j in range(len(d))]).agg(F.sum("_w").alias("_w"), F.max("_far").alias("_far"))
            return [np.array([tuple(r) for r in x.orderBy("_far").limit(most).collect()], dtype=float)]

        (rows,) = yield Direct(run)
        return rows

    def vertices(self, view: View, b: np.ndarray, row: Callable[[Column], Column]) -> Generator:
        """The best of b and of lines through rows near it, its loss (of a residual: row), and whether
        that is b."""
        k = len(b)
        near = yield from self.nearest(view, b, 20 * NEAREST, False)
        if len({tuple(z) for z in near}) < min(len(near), k + 2):  # the same few rows again and again
            near = yield from self.nearest(view, b, NEAREST, True)
        points = list(dict.fromkeys(tuple(z[: k + 1]) for z in near))[:NEAREST]
        lines = [b]
        for rows in itertools.islice(itertools.combinations(points, k), VERTICES):
            z = np.array(rows)
            if np.linalg.matrix_rank(z[:, :-1]) == k:
                lines.append(np.linalg.solve(z[:, :-1], z[:, -1]))
        lines = list({tuple(np.round(v, 12)): v for v in lines}.values())
        loss = yield from self.losses(view, lines, row)
        at = int(np.argmin(loss))
        stays = loss[at] >= loss[0] - 1e-12 * max(1.0, abs(loss[0]))
        return (b, loss[0], True) if stays else (lines[at], loss[at], False)

    def finish(self, view: View, b: np.ndarray) -> Generator:
        """The next line from b, and whether b is an optimum already."""
        k, most = len(b), BAND
        near = yield from self.nearest(view, b, most, False)
        if len(near) == most and len(np.unique(near[near[:, -1] < near[-1, -1], : k + 1], axis=0)) <= k:
            near = yield from self.nearest(view, b, most, True)
        # rows at the last distance may be there in part only: they count as far ones
        edge = near[-1, -1] if len(near) == most and near[-1, -1] > near[0, -1] else math.inf
        far = F.abs("_r") >= F.col("_edge")
        side = view.c * F.when(F.col("_r") >= 0, self.tau).otherwise(self.tau - 1)
        sums = lambda p: [F.sum(view.c * self.row(F.col("_r"))), *[F.sum(F.when(far, side * x)) for x in self.design(view)]]
        at_line = lambda p: self.residual(view)(p) | {"_edge": p[-1]}
        (found,) = yield Direct(lambda df: [at_points(view.rows(df), [np.r_[b, edge]], sums, at_line)[0]])
        loss, g = found[0], -np.nan_to_num(found[1:])
        near = near[near[:, -1] < edge]
        x, y, c = near[:, :k], near[:, k], near[:, k + 1]
        model = lambda v: float(c @ np.maximum(self.tau * (y - x @ v), (self.tau - 1) * (y - x @ v)) + g @ (v - b))
        new = least_check(x, y, c, self.tau, g, b)
        if model(new) >= model(b) - 1e-12 * abs(loss):
            return b, True
        lines = [b + (new - b) * 0.5**i for i in range(16)]
        at = yield from self.losses(view, lines)
        best = int(np.argmin(at))
        return (b, True) if at[best] >= loss - 1e-13 * abs(loss) else (lines[best], False)

    def reweighted(self, view: View, b: np.ndarray) -> Generator:
        """Coefficients of the next step, and the loss at b."""
        if view.p > NARROW:
            r = view.y - view.eta(b, self.intercept)
            side = F.when(r >= 0, F.lit(self.tau)).otherwise(F.lit(1 - self.tau))
            m, more = yield from view.moments(view.y, view.c * side / F.greatest(F.abs(r), F.lit(self.epsilon)), check=self.check(view, b))
            return solve(*normal_equations(m, self.intercept)), more["check"]
        k, r = len(b), F.col("_r")
        weight = lambda p: {"_u": view.c * F.when(r >= 0, F.lit(self.tau)).otherwise(F.lit(1 - self.tau)) / F.greatest(F.abs(r), F.lit(self.epsilon))}
        columns = [*self.design(view), view.y]
        pairs = _pairs(k + 1)
        sums = lambda p: [F.sum(view.c * self.row(r)), *[F.sum(columns[i] * columns[j] * F.col("_u")) for i, j in pairs]]
        (found,) = yield Direct(lambda df: [at_points(view.rows(df), [b], sums, self.residual(view), weight)[0]])
        q = np.zeros((k + 1, k + 1))
        for (i, j), v in zip(pairs, found[1:], strict=True):
            q[i, j] = q[j, i] = v
        return solve(q[:k, :k], q[:k, k]), found[0]

    def steps(self, view: View, loss: Callable[[np.ndarray], Generator] | None = None) -> Generator:
        y, c = view.y, view.c
        m, _ = yield from view.moments(y, c)
        n = m.n
        if n < max(2, len(self.features) + (1 if self.intercept else 0)):
            raise InsufficientObservations(f"{n} rows")
        b = solve(*normal_equations(m, self.intercept))
        if self.intercept and not loss:  # begin at the height of the quantile
            (at,) = yield Direct(lambda df: view.rows(df).agg(F.percentile_approx(y - view.eta(b, True), self.tau)).first())
            b = np.r_[b[0] + at, b[1:]]
        before, near = None, False
        for _ in range(self.max_iter):
            new, check = yield from self.reweighted(view, b)
            moved = abs(new - b).max()
            if loss:
                now = yield from loss(new)
                near = before is not None and abs(now - before) < self.tol * (1 + abs(before))
                before = now
            else:
                # the finish begins as soon as the loss hardly falls
                near = moved < self.tol or (before is not None and before - check < 1e-4 * abs(before))
                before = check
            b = new
            if near:
                break
        converged = near if loss else False
        if not loss:
            for _ in range(self.max_iter):
                b, converged = yield from self.finish(view, b)
                if converged:
                    break
        (null,) = yield Direct(lambda df: [quantile(view.rows(df), y, self.tau, n)])
        found = yield from view.ask(loss=self.check(view, b), null=view.c * F.when(y >= null, self.tau * (y - null)).otherwise((self.tau - 1) * (y - null)))
        a, coef = _split(b, self.intercept)
        return LinearModel(
            self.features, self.label, a, coef, tau=self.tau, loss=found["loss"], pseudo_r_squared=1 - found["loss"] / found["null"] if found["null"] else math.nan, converged=converged, n=n
        )


class IsotonicModel:
    """Step function: the value of the last knot at or below x."""

    def __init__(self, x: np.ndarray, y: np.ndarray, increasing: bool, out_of_bounds: str):
        self.x, self.y, self.increasing, self.out_of_bounds = x, y, increasing, out_of_bounds

    def transform(self, df: DataFrame, feature: str, output: str = "prediction") -> DataFrame:
        knots, values, nan = self.x, self.y, self.out_of_bounds == "nan"

        @F.pandas_udf("double")
        def step(s: pd.Series) -> pd.Series:
            v = s.to_numpy(dtype=float, na_value=np.nan)
            at = np.clip(np.searchsorted(knots, v, "right") - 1, 0, len(knots) - 1)
            out = np.where(np.isnan(v), np.nan, values[at])
            return pd.Series(np.where((v < knots[0]) | (v > knots[-1]), np.nan, out) if nan else out)

        return df.withColumn(output, step(number(feature)))


    def steps(self, df: DataFrame, feature: str, output: str = "prediction") -> DataFrame:
        """As transform(), by an as-of join with a table of the knots: nothing of the model goes to every
        task, and rows meet their knots by range."""
        knots = df.sparkSession.createDataFrame(pd.DataFrame({"_x": self.x, output: self.y}))
        at = number(feature)
        rows = df.withColumn("_x", F.when(~F.isnan(at), at))
        out = asof_join(rows, knots, "_x", [output])
        held, low, high = out._held, float(self.x[0]), float(self.x[-1])
        none, clips = F.lit(None).cast("double"), self.out_of_bounds != "nan"
        value = F.when(F.col("_x").isNull(), none).when(F.col("_x") < low, F.lit(float(self.y[0])) if clips else none)
        if not clips:
            value = value.when(F.col("_x") > high, none)
        out = out.withColumn(output, value.otherwise(F.col(output))).drop("_x")
        out._held = held
        return out


class Isotonic:
    """Monotone regression. Rows of equal x are averaged by an aggregation; each range of x is pooled
    where it lies; while neighbouring ranges are out of order, their blocks are dealt to half as many
    ranges and pooled again, which gives the same fit as pooling all rows. The model's knots, one for
    each block, end on the driver, as they are the model."""

    def __init__(self, feature: str, label: str, weight: str | None = None, increasing: bool = True, out_of_bounds: str = "clip"):
        if out_of_bounds not in ("clip", "nan", "extrapolate"):
            raise InvalidOptions("out_of_bounds must be clip, nan or extrapolate")
        self.feature, self.label, self.weight, self.increasing, self.out_of_bounds = feature, label, weight, increasing, out_of_bounds

    def fit(self, df: DataFrame) -> IsotonicModel:
        cols = [self.feature, self.label, *([self.weight] if self.weight else [])]
        w = number(self.weight) if self.weight else F.lit(1.0)
        x = na.process(df, cols).groupBy(number(self.feature).alias("x")).agg(F.sum(w).alias("w"), (F.sum(w * number(self.label)) / F.sum(w)).alias("y"))
        sign = 1 if self.increasing else -1

        def pool(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # pools a stream of blocks by lo: (first x, last x, mean, weight)
            lo, hi, val, wt = [], [], [], []
            for pdf in parts:
                for a, end, v, u in zip(*(pdf[c].tolist() for c in ("lo", "hi", "v", "w")), strict=True):
                    first = a
                    while val and val[-1] > v:
                        total = wt[-1] + u
                        v = (val.pop() * wt[-1] + v * u) / total
                        u, first = total, lo.pop()
                        wt.pop()
                        hi.pop()
                    lo.append(first)
                    hi.append(end)
                    val.append(v)
                    wt.append(u)
            if val:
                yield pd.DataFrame({"lo": lo, "hi": hi, "v": val, "w": wt})

        blocks = x.select(F.col("x").alias("lo"), F.col("x").alias("hi"), (F.lit(sign) * F.col("y")).alias("v"), "w")
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        while True:
            pooled = blocks.repartitionByRange(ranges, "lo").sortWithinPartitions("lo").mapInPandas(pool, "lo double, hi double, v double, w double").persist()
            ends = pooled.groupBy(F.spark_partition_id().alias("part")).agg(F.min_by("v", "lo").alias("first"), F.max_by("v", "lo").alias("last"), F.min("lo").alias("lo"))
            ends = sorted(ends.collect(), key=lambda r: r["lo"])  # a row for each range
            blocks.unpersist()
            blocks = pooled
            if ranges == 1 or all(a["last"] <= b["first"] for a, b in itertools.pairwise(ends)):
                break
            ranges = max(1, ranges // 2)
        b = blocks.toPandas().sort_values("lo")
        blocks.unpersist()
        if b.empty:
            raise InsufficientObservations("no rows")
        fit = sign * b["v"].to_numpy()
        knots = np.r_[b["lo"].to_numpy(), b["hi"].to_numpy()[-1:]]
        return IsotonicModel(knots, np.r_[fit, fit[-1:]], self.increasing, self.out_of_bounds)


def splitmix64(seed: int) -> Iterator[int]:
    """The SplitMix64 generator (Steele, Lea and Flood, 2014)."""
    mask = (1 << 64) - 1
    while True:
        seed = (seed + 0x9E3779B97F4A7C15) & mask
        z = seed
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        yield z ^ (z >> 31)


def _sample(n: int, k: int, times: int, seed: int) -> list[tuple[int, ...]]:
    gen = splitmix64(seed)
    out = []
    for _ in range(times):
        got: list[int] = []
        while len(got) < k:
            i = next(gen) % n
            if i not in got:
                got.append(i)
        out.append(tuple(sorted(got)))
    return out


def _rows_by_number(x: DataFrame, wanted: set[int], columns: list[str]) -> dict[int, np.ndarray]:
    """Chosen rows, as many as there are numbers in wanted at most."""
    ids = x.sparkSession.createDataFrame([(i,) for i in sorted(wanted)], "row_number long")
    got = x.join(F.broadcast(ids), "row_number").select("row_number", *[number(c) for c in columns]).collect()
    return {r[0]: np.array(r[1:], dtype=float) for r in got}


class TheilSen:
    """Spatial median of exact fits to subsets: all of them up to max_subpopulation, else that many
    drawn ones. Only the drawn rows leave the cluster."""

    def __init__(self, features, label, order_by: list[str], max_subpopulation: int = 10_000, seed: int = 42, intercept: bool = True):
        self.features, self.label, self.order_by = list(features), label, list(order_by)
        self.max_subpopulation, self.seed, self.intercept = max_subpopulation, seed, intercept

    def fit(self, df: DataFrame) -> LinearModel:
        x = numbered(na.process(df, [*self.features, self.label]), self.order_by)
        n = x.count()
        k = len(self.features) + (1 if self.intercept else 0)
        if n < k:
            raise InsufficientObservations(f"{n} rows for {k} parameters")
        if math.comb(n, k) <= self.max_subpopulation:
            subsets = list(itertools.combinations(range(n), k))
        else:
            subsets = _sample(n, k, self.max_subpopulation, self.seed)
        rows = _rows_by_number(x, set(itertools.chain.from_iterable(subsets)), [*self.features, self.label])
        release(x)
        points = []
        for s in subsets:
            z = np.array([rows[i] for i in s])
            a = np.c_[np.ones(k), z[:, :-1]] if self.intercept else z[:, :-1]
            if abs(np.linalg.det(a)) > 1e-12:
                points.append(np.linalg.solve(a, z[:, -1]))
        if not points:
            raise SingularMatrix("no subset determines a fit")
        a, b = _split(spatial_median(np.array(points)), self.intercept)
        return LinearModel(self.features, self.label, a, b, n_subsets=len(points), n=n)


class Ransac:
    """Consensus of random exact fits: all trials are scored in one pass, the stopping rule is applied
    in their order, and OLS is fitted to the consensus."""

    def __init__(self, features, label, order_by: list[str], max_trials: int = 100, threshold: float | None = None, confidence: float = 0.99, seed: int = 42, intercept: bool = True):
        self.features, self.label, self.order_by = list(features), label, list(order_by)
        self.max_trials, self.threshold, self.confidence, self.seed, self.intercept = max_trials, threshold, confidence, seed, intercept

    def fit(self, df: DataFrame) -> LinearModel:
        x = numbered(na.process(df, [*self.features, self.label]), self.order_by)
        n = x.count()
        k = len(self.features) + 1
        if n < k + 1:
            raise InsufficientObservations(f"{n} rows")
        limit = self.threshold
        if limit is None:
            mid = median(x, number(self.label))
            limit = median(x, F.abs(number(self.label) - F.lit(mid)))
        subsets = _sample(n, k, self.max_trials, self.seed)
        rows = _rows_by_number(x, set(itertools.chain.from_iterable(subsets)), [*self.features, self.label])
        trials = []
        for s in subsets:
            z = np.array([rows[i] for i in s])
            a = np.c_[np.ones(len(z)), z[:, :-1]] if self.intercept else z[:, :-1]
            b, _, rank, _ = np.linalg.lstsq(a, z[:, -1], rcond=None)
            trials.append(LinearModel(self.features, self.label, *_split(b, self.intercept)) if rank == a.shape[1] else None)
        y = number(self.label)
        live = [t for t in trials if t is not None]
        if not live:
            raise SingularMatrix("no trial determines a fit")
        counts = x.agg(*[F.sum((F.abs(y - t.predict()) <= F.lit(float(limit))).cast("long")).alias(f"t{i}") for i, t in enumerate(live)]).first()
        best, best_n, need, done, at = None, -1, self.max_trials, 0, 0
        for t in trials:
            if done >= need:
                break
            done += 1
            if t is None:
                continue
            c, at = counts[at], at + 1
            if c > best_n:
                best, best_n = t, c
                share = (c / n) ** k
                need = 1 if share >= 1 else self.max_trials if share <= 0 else min(self.max_trials, math.ceil(math.log(1 - self.confidence) / math.log(1 - share)))
        inlier = F.abs(y - best.predict()) <= F.lit(float(limit))
        final = OLS(self.features, self.label, intercept=self.intercept).fit(x.filter(inlier))
        release(x)
        return RansacModel(self.features, self.label, final.intercept, np.nan_to_num(final.coefficients), threshold=limit, n_inliers=best_n, trials=done, candidate=best, n=n)


class RansacModel(LinearModel):
    def inliers(self, df: DataFrame) -> DataFrame:
        return df.withColumn("inlier", F.abs(number(self.label) - self.candidate.predict()) <= F.lit(float(self.threshold)))


def pa_step(w: np.ndarray, b: float, x: np.ndarray, y: float, c: float, epsilon: float, variant: str, intercept: bool = True) -> tuple[np.ndarray, float, float]:
    """One passive-aggressive update: (weights, intercept, loss before it)."""
    error = y - (w @ x + b)
    loss = max(0.0, abs(error) - epsilon)
    if loss > 0:
        norm = float(x @ x)
        tau = min(c, loss / norm) if variant == "pa1" and norm > 0 else c if variant == "pa1" else loss / (norm + 1 / (2 * c))
        move = math.copysign(tau, error)
        w = w + move * x
        b = b + move if intercept else b
    return w, b, loss


#: Groups from which passive-aggressive steps are taken together, and rows of groups that a task holds at once.
FEW_GROUPS, HELD_ROWS = 20, 1 << 20


class PassiveAggressive:
    """Online regression over rows in a stated order: a sequential kernel for each key; pa1 or pa2. A
    task's groups take their steps beside each other, a row of each at once.
    State for streams is in the streaming package."""

    def __init__(self, features, label, order_by: list[str], c: float = 1.0, epsilon: float = 0.1, variant: str = "pa1", epochs: int = 1000, tol: float = 1e-3,
                 shuffle: bool = False, seed: int = 42, intercept: bool = True):
        if variant not in ("pa1", "pa2") or c <= 0:
            raise InvalidOptions("variant must be pa1 or pa2, and c positive")
        self.features, self.label, self.order_by = list(features), label, list(order_by)
        self.c, self.epsilon, self.variant, self.epochs, self.tol = c, epsilon, variant, epochs, tol
        self.shuffle, self.seed, self.intercept = shuffle, seed, intercept

    def kernel(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, int]:
        n = len(y)
        w, b, best, stale = [0.0] * x.shape[1], 0.0, math.inf, 0
        x, y = x.tolist(), y.tolist()
        order = list(range(n))
        gen = splitmix64(self.seed)
        epoch = 0
        for epoch in range(1, self.epochs + 1):
            if self.shuffle:
                for i in range(n - 1, 0, -1):
                    j = next(gen) % (i + 1)
                    order[i], order[j] = order[j], order[i]
            w, b, total = self.once(w, b, [x[i] for i in order], [y[i] for i in order])
            if total < best - self.tol * n:
                best, stale = total, 0
            else:
                stale += 1
                if stale >= 5:
                    break
        return np.array(w), b, epoch

    def once(self, w: list[float], b: float, x: list[list[float]], y: list[float]) -> tuple[list[float], float, float]:
        """pa_step() over rows in their order, of plain numbers: weights, intercept and the losses' sum."""
        c, epsilon, first, total = self.c, self.epsilon, self.variant == "pa1", 0.0
        for row, target in zip(x, y, strict=True):
            error = target - (sum(map(mul, w, row)) + b)
            loss = abs(error) - epsilon
            if loss > 0:
                total += loss
                norm = sum(map(mul, row, row))
                if first:
                    tau = min(c, loss / norm) if norm > 0 else c
                else:
                    tau = loss / (norm + 1 / (2 * c))
                move = tau if error > 0 else -tau
                w = [v + move * u for v, u in zip(w, row, strict=True)]
                if self.intercept:
                    b += move
        return w, b, total

    def kernels(self, x: np.ndarray, y: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """kernel() for many groups, which begin at start in x and y: weights, intercepts and epochs."""
        m, p = len(start), x.shape[1]
        size = np.diff(np.r_[start, len(y)])
        if self.shuffle or m < FEW_GROUPS:
            found = [self.kernel(x[s : s + n], y[s : s + n]) for s, n in zip(start, size, strict=True)]
            return np.array([w for w, _, _ in found]).reshape(m, p), np.array([b for _, b, _ in found]), np.array([e for _, _, e in found], dtype=int)
        w, b, epochs = np.zeros((m, p)), np.zeros(m), np.zeros(m, dtype=int)
        best, stale = np.full(m, np.inf), np.zeros(m, dtype=int)
        live = np.argsort(-size, kind="stable")  # long groups first: those with a j-th row are the first ones
        for epoch in range(1, self.epochs + 1):
            wide = len(live) >= FEW_GROUPS
            total = np.zeros(len(live))
            n, at, wl, bl = size[live], start[live], w[live], b[live]
            if wide:
                count = np.searchsorted(-n, -np.arange(n[0]), "left")  # groups with more than j rows
                for j, c in enumerate(count):
                    rows = at[:c] + j
                    self.step(wl[:c], bl[:c], x[rows], y[rows], total[:c])
            else:  # few are left: each by itself
                for g, (s, e) in enumerate(zip(at, at + n, strict=True)):
                    wl[g], bl[g], total[g] = self.once(wl[g].tolist(), float(bl[g]), x[s:e].tolist(), y[s:e].tolist())
            w[live], b[live], epochs[live] = wl, bl, epoch
            better = total < best[live] - self.tol * n
            best[live] = np.where(better, total, best[live])
            stale[live] = np.where(better, 0, stale[live] + 1)
            live = live[stale[live] < 5]
            if not len(live):
                break
        return w, b, epochs

    def step(self, w: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, total: np.ndarray) -> None:
        """pa_step() of a row of each group, in place."""
        dot = lambda u, v: u[:, 0] * v[:, 0] if u.shape[1] == 1 else np.einsum("ij,ij->i", u, v)
        error = y - (dot(w, x) + b)
        loss = np.maximum(np.abs(error) - self.epsilon, 0.0)
        norm = dot(x, x)
        if self.variant == "pa1":
            tau = np.minimum(self.c, np.divide(loss, norm, out=np.full(len(norm), np.inf), where=norm > 0))
        else:
            tau = loss / (norm + 1 / (2 * self.c))
        move = np.where(loss > 0, np.copysign(tau, error), 0.0)
        w += move[:, None] * x
        if self.intercept:
            b += move
        total += loss

    def fit_by(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """keys, coefficients, intercept, epochs: one sequential run a group."""
        values = [f"_v{i}" for i in range(len(self.features) + 1)]
        x = na.process(df, [*self.features, self.label]).select(*keys, *self.order_by, *[number(c).alias(v) for c, v in zip([*self.features, self.label], values, strict=True)])
        kept = [F.col(k) for k in keys]
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        window = Window.partitionBy(*kept).orderBy(*[F.col(c).asc_nulls_last() for c in self.order_by])
        # a group begins at its row of number 1
        x = x.repartition(parts, *kept).withColumn("_n", F.row_number().over(window)).select(*keys, "_n", *values)
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema if f.name in keys] + ["coefficients array<double>", "intercept double", "epochs int"])

        def fitted(names: pa.RecordBatch, z: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
            w, b, epochs = self.kernels(z[:, :-1], z[:, -1], start)
            more = [pa.array(w.tolist(), pa.list_(pa.float64())), pa.array(b, pa.float64()), pa.array(epochs, pa.int32())]
            return pa.RecordBatch.from_arrays([*names.columns, *more], [*keys, "coefficients", "intercept", "epochs"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, held, firsts, rows = [], [], [], 0

            def out() -> pa.RecordBatch:
                whole = pa.Table.from_batches(names).combine_chunks().to_batches()[0]
                return fitted(whole, np.concatenate(held), np.concatenate(firsts))

            for batch in batches:
                z = np.column_stack([batch.column(v).to_numpy(zero_copy_only=False) for v in values]).astype(float)
                first = np.flatnonzero(batch.column("_n").to_numpy() == 1)
                if rows >= HELD_ROWS and len(first):  # all groups that are held end before the first new one
                    cut = int(first[0])
                    held.append(z[:cut])
                    yield out()
                    names, held, firsts, rows = [], [], [], 0
                    batch, z, first = batch.slice(cut), z[cut:], first - cut
                if len(first):
                    names.append(batch.select(keys).take(pa.array(first)))
                    firsts.append(first + rows)
                held.append(z)
                rows += len(z)
            if rows:
                yield out()

        return x.mapInArrow(run, schema)

    def fit(self, df: DataFrame) -> LinearModel:
        """The whole frame as one sequence, which one task works through: for many series use fit_by()."""
        r = self.fit_by(df.withColumn("_one", F.lit(1)), ["_one"]).first()
        return LinearModel(self.features, self.label, r["intercept"], np.array(r["coefficients"]), epochs=r["epochs"])
