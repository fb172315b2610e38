"""Least squares: OLS, WLS, ridge, recursive least squares."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import na
from ..errors import InsufficientObservations, InvalidOptions, InvalidWeights, NumericalError
from ..plans.moments import Moments, moments
from ..plans.ordering import numbered, release
from ..plans.qr import upper, independent, r_factor
from ..plans.solve import least_squares, spd_inverse
from .base import Fit, GramEstimator, Model, number


def gram_of(m: Moments, intercept: bool) -> tuple[np.ndarray, np.ndarray, float]:
    """Cross products about the means with an intercept, about zero without."""
    return m.centred() if intercept else m.raw()


def with_intercept(m: Moments, beta: np.ndarray, intercept: bool) -> float | None:
    if not intercept:
        return None
    mx, my = m.means()
    return float(my - np.nansum(beta * mx))


def full_cov(m: Moments, kept: list[int], inv: np.ndarray, intercept: bool) -> np.ndarray:
    """Inverse of [1 X]'[1 X] over the kept columns, from the inverse of the centred part."""
    if not intercept:
        return inv
    mx = m.means()[0][kept]
    top = -inv @ mx
    return np.block([[np.array([[1 / m.sw + mx @ inv @ mx]]), top[None, :]], [top[:, None], inv]])


def residual_ss(syy: float, sxx: np.ndarray, sxy: np.ndarray, beta: np.ndarray) -> float:
    b = np.nan_to_num(beta)
    return max(float(syy - 2 * b @ sxy + b @ sxx @ b), 0.0)


def centred_tss(m: Moments) -> float:
    return max(m.centred()[2], 0.0)


#: Least eigenvalue of the correlation matrix of the design below which moments have lost the digits
#: that a fit needs and the rows are factored.
GRAM_DIGITS = 1e-7


class OLS(GramEstimator):
    """Ordinary least squares. Aliased columns get NaN; the total sum of squares is about the mean
    also without an intercept.

    Moments carry a fit as long as the design is not near collinear. Where it is, fit() factors the
    rows (tall-skinny QR): columns count as aliased as the pivoted triangle's diagonal falls to
    rank_tolerance or to rounding. solver 'svd' always factors and solves by singular values over
    rank_tolerance of the largest one; 'cholesky' never does."""

    def solve(self, m: Moments) -> Fit:
        o = self.options
        sxx, sxy, syy = gram_of(m, o.intercept)
        beta, kept, inv = least_squares(sxx, sxy, o.rank_tolerance)
        if (np.abs(np.nan_to_num(beta)) > 1e120).any():
            raise NumericalError("coefficients out of range")
        k = len(kept) + (1 if o.intercept else 0)
        rss = residual_ss(syy, sxx, sxy, beta)
        mse = rss / (m.n - k) if m.n > k else np.nan
        return Fit(beta, with_intercept(m, beta, o.intercept), m.n, k, rss, centred_tss(m), mse, full_cov(m, kept, inv, o.intercept), kept, o).describe()

    def carried(self, m: Moments) -> bool:
        """Whether the moments have the digits."""
        o = self.options
        if type(self).solve is not OLS.solve or o.solver == "cholesky":
            return True
        gram = gram_of(m, o.intercept)[0]
        d = np.sqrt(np.maximum(np.diag(gram), 0))
        live = d > o.rank_tolerance
        scaled = gram[np.ix_(live, live)] / np.outer(d[live], d[live])
        return o.solver != "svd" and (not len(scaled) or np.linalg.eigvalsh(scaled)[0] > GRAM_DIGITS)

    def solve_rows(self, df: DataFrame, m: Moments) -> Fit:
        """From the triangle of (x, y), about their means with an intercept."""
        o, p = self.options, m.p
        mx, my = m.means() if o.intercept else (np.zeros(p), 0.0)
        root = F.sqrt(number(self.weight)) if self.weight else F.lit(1.0)
        columns = [(number(c) - F.lit(float(a))) * root for c, a in zip([*self.features, self.label], [*mx, my], strict=True)]
        r = r_factor(df, columns)
        constant = np.linalg.norm(r[:, :p], axis=0) <= o.rank_tolerance
        kept = [j for j in independent(r[:, :p], o.rank_tolerance) if not constant[j]]
        beta, inv = np.full(p, np.nan), np.zeros((len(kept), len(kept)))
        if kept and o.solver == "svd":
            live = np.flatnonzero(~constant)
            u, s, vt = np.linalg.svd(r[:, live], full_matrices=False)
            many = s > o.rank_tolerance * s[0]
            beta[live] = vt[many].T @ ((u.T @ r[:, p])[many] / s[many])
            kept, inv = live.tolist(), (vt[many].T / s[many] ** 2) @ vt[many]
            rank = int(many.sum())
        else:
            t = upper(r[:, [*kept, p]])
            rank = len(kept)
            if kept:
                back = np.linalg.solve(t[:rank, :rank], np.eye(rank))
                beta[kept], inv = back @ t[:rank, rank], back @ back.T
        if (np.abs(np.nan_to_num(beta)) > 1e120).any():
            raise NumericalError("coefficients out of range")
        rss = float(np.sum((r[:, p] - r[:, :p] @ np.nan_to_num(beta)) ** 2))
        k = rank + (1 if o.intercept else 0)
        mse = rss / (m.n - k) if m.n > k else np.nan
        return Fit(beta, with_intercept(m, beta, o.intercept), m.n, k, rss, centred_tss(m), mse, full_cov(m, kept, inv, o.intercept), kept, o).describe()

    def fit(self, df: DataFrame) -> Model:
        x = self.prepared(df)
        m = moments(x, self.features, self.label, self.weight)
        if m.n == 0 and not df.isEmpty():
            na.require_rows(0, 1)
        self.check(m)
        fit = self.solve(m) if self.carried(m) else self.solve_rows(x, m)
        return self.model(fit, self.features, self.label, self.weight)


class WLS(OLS):
    """Weighted least squares; rows with weight 0 count in the degrees of freedom."""

    def __init__(self, features, label, weight, **options):
        super().__init__(features, label, weight, **options)

    def prepared(self, df: DataFrame) -> DataFrame:
        df = super().prepared(df)
        low = df.agg(F.min(F.col(self.weight).cast("double"))).first()[0]
        if low is not None and low < 0:
            raise InvalidWeights("weights must not be negative")
        return df

    def check(self, m: Moments) -> None:
        if m.sw < 1e-14:
            raise InvalidWeights("weights sum to zero")
        if m.positive < m.p + (1 if self.options.intercept else 0):
            raise InsufficientObservations("too few rows with a positive weight")


class Ridge(GramEstimator):
    """Ridge with an unpenalised intercept; lam = 0 is OLS. scaling 'glmnet' multiplies lam by n."""

    def penalty(self, m: Moments) -> float:
        return self.options.lam * (m.n if self.options.scaling == "glmnet" else 1)

    def solve(self, m: Moments) -> Fit:
        o = self.options
        if o.lam == 0:
            return OLS.solve(self, m)
        sxx, sxy, syy = gram_of(m, o.intercept)
        lam = self.penalty(m)
        inv = spd_inverse(sxx + lam * np.eye(m.p))
        beta = inv @ sxy
        k = m.p + (1 if o.intercept else 0)
        rss = residual_ss(syy, sxx, sxy, beta)
        mse = rss / (m.n - k) if m.n > k else np.nan
        kept = list(range(m.p))
        raw = spd_inverse(m.raw()[0] + lam * np.eye(m.p))
        extra = {"std_errors": np.sqrt(np.maximum(np.diag(raw), 0) * max(mse, 0)), "intercept_std_error": float(np.sqrt(max(mse, 0) / m.n))} if mse == mse else {}
        return Fit(beta, with_intercept(m, beta, o.intercept), m.n, k, rss, centred_tss(m), mse, full_cov(m, kept, inv, o.intercept), kept, o, extra).describe()


#: Initial covariance of the recursion; its inverse is a tiny ridge that fades with forgetting.
RLS_START = 1e6
#: Rows of a path that a task runs through.
PATH_BLOCK = 1 << 17
#: Rows that the last rows with a weight may be for one task to number them.
RLS_TOP = 100_000


class RLS(GramEstimator):
    """Recursive least squares with forgetting, in closed form: the recursion's state after row n is
    (sum f^(n-i) x x' + f^n / 1e6 I)^-1 sum f^(n-i) x y. Rows are numbered once by order_by; with
    forgetting 1 not even that."""

    def __init__(self, features, label, order_by: list[str], forgetting: float = 0.99, **options):
        super().__init__(features, label, forgetting=forgetting, **options)
        if not order_by:
            raise InvalidOptions("RLS needs an order")
        self.order_by = list(order_by)

    def fit(self, df: DataFrame, keys: list[str] | None = None) -> Model:
        o = self.options
        x = self.prepared(df)
        whole = moments(x, self.features, self.label)
        self.check(whole)
        if o.forgetting < 1:
            # the newest row has age 0: ages beyond where the weight underflows need no exact number
            reach = int(-745 / np.log(o.forgetting)) + 1
            if reach <= RLS_TOP:
                age = F.row_number().over(Window.orderBy(*[F.col(c).desc() for c in self.order_by])) - 1
                x_aged = x.orderBy(*[F.col(c).desc() for c in self.order_by]).limit(reach)
            else:  # too many rows still count for one task to hold: number all of them
                x_aged = numbered(x, self.order_by, "_number")
                age = F.lit(whole.n - 1) - F.col("_number")
            aged = x_aged.withColumn("_w", F.pow(F.lit(o.forgetting), age.cast("double")))
            m = moments(aged, self.features, self.label, "_w", shift=np.zeros(len(self.features) + 1))
            release(x_aged)
        else:
            m = moments(x, self.features, self.label, shift=np.zeros(len(self.features) + 1))
        return Model(self.closed(m, whole), self.features, self.label)

    def closed(self, m: Moments, whole: Moments) -> Fit:
        o = self.options
        if o.intercept:
            a = m.augmented()
            rhs = np.r_[m.s[-1] + m.sw * m.shift[-1], m.raw()[1]]
        else:
            a, rhs, _ = m.raw()
        a = a + np.eye(len(a)) * (o.forgetting**whole.n / RLS_START)
        p_matrix = spd_inverse(a)
        b = p_matrix @ rhs
        beta, intercept = (b[1:], float(b[0])) if o.intercept else (b, None)
        # statistics of the final coefficients over all rows
        xx, xy, yy = whole.raw()
        v = np.r_[intercept, beta] if o.intercept else beta
        big = whole.augmented() if o.intercept else xx
        r = np.r_[whole.s[-1] + whole.sw * whole.shift[-1], xy] if o.intercept else xy
        rss = max(float(yy - 2 * v @ r + v @ big @ v), 0.0)
        k = len(v)
        mse = rss / (whole.n - k) if whole.n > k else np.nan
        fit = Fit(beta, intercept, whole.n, k, rss, centred_tss(whole), mse, p_matrix, list(range(len(beta))), o, {"p_matrix": p_matrix})
        fit.options = o.with_(inference=False)
        return fit.describe()

    def path(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """df with the prediction made before each row was learnt (_error: what it missed by) and the
        coefficients after it (_coefficients, the intercept first): the recursion row by row, as a scan.

        (information, vector) pairs add up with decay, so that a block of PATH_BLOCK rows is known by its
        own sums and length; blocks' sums meet on the driver, one short row each, which gives each block
        the state it begins with, and blocks then run beside each other. Incomplete rows are left out."""
        o, k = self.options, len(self.features) + (1 if self.options.intercept else 0)
        x = numbered(self.prepared(df), self.order_by, "_i")
        x = x.withColumn("_block", F.floor(F.col("_i") / PATH_BLOCK))
        v = [*([F.lit(1.0)] if o.intercept else []), *map(number, self.features)]
        y = number(self.label)
        # a row's weight at the end of its block, were that full; shorter ones are brought back by their length
        w = F.pow(F.lit(float(o.forgetting)), (F.col("_block") + 1) * PATH_BLOCK - 1 - F.col("_i"))
        sums = [F.sum(w * v[i] * v[j]) for i in range(k) for j in range(i, k)] + [F.sum(w * c * y) for c in v]
        blocks = x.groupBy("_block").agg(F.count("*").alias("n"), *[c.alias(f"s{i}") for i, c in enumerate(sums)]).orderBy("_block").collect()
        a, r, starts = np.eye(k) / RLS_START, np.zeros(k), []
        for b in blocks:
            starts.append((b["_block"], a.ravel().tolist(), r.tolist()))
            s = np.array(list(b)[2:], dtype=float)
            own = np.zeros((k, k))
            own[np.triu_indices(k)] = s[: k * (k + 1) // 2]
            own = own + np.triu(own, 1).T
            # only the last block is short, and nothing follows it
            a, r = o.forgetting ** b["n"] * a + own, o.forgetting ** b["n"] * r + s[k * (k + 1) // 2 :]
        states = df.sparkSession.createDataFrame(starts, "_block long, _a array<double>, _r array<double>")
        rows = x.select("_block", "_i", *[c.alias(f"_v{i}") for i, c in enumerate(v)], y.alias("_y"))
        forgetting = o.forgetting

        def run(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("_i")
            a, r = np.array(state["_a"].iloc[0], dtype=float).reshape(k, k), np.array(state["_r"].iloc[0], dtype=float)
            z, target = rows[[f"_v{i}" for i in range(k)]].to_numpy(dtype=float), rows["_y"].to_numpy(dtype=float)
            before, after = np.empty(len(z)), []
            # information and vector, not the gain: with forgetting the gain form loses its digits over thousands of rows
            b = np.linalg.solve(a, r)
            for j, u in enumerate(z):
                before[j] = u @ b
                a, r = forgetting * a + np.outer(u, u), forgetting * r + u * target[j]
                b = np.linalg.solve(a, r)
                after.append(b.tolist())
            return pd.DataFrame({"_i": rows["_i"], output: before, f"{output}_error": target - before, f"{output}_coefficients": after})

        found = rows.groupBy("_block").cogroup(states.groupBy("_block")).applyInPandas(run, f"_i long, `{output}` double, `{output}_error` double, `{output}_coefficients` array<double>")
        out = x.join(found, "_i").drop("_i", "_block")
        out._held = x._held if hasattr(x, "_held") else None
        return out


def detect_constant_columns(df: DataFrame, columns: list[str], tolerance: float = 1e-10) -> dict[str, bool]:
    row = df.agg(*[(F.max(F.col(c).cast("double")) - F.min(F.col(c).cast("double"))).alias(c) for c in columns]).first()
    return {c: row[c] is None or row[c] < tolerance for c in columns}


def center_columns(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, float]]:
    """df with the columns' means taken off, and the means."""
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first().asDict()
    return df.withColumns({c: F.col(c).cast("double") - F.lit(row[c]) for c in columns}), row


def is_full_rank(df: DataFrame, columns: list[str], tolerance: float = 1e-10) -> bool:
    """Whether no diagonal element of the pivoted triangle is within tolerance, or within rounding."""
    r = r_factor(na.process(df, columns), [number(c) for c in columns])
    return len(independent(r, tolerance)) == len(columns)
