"""Generalised linear models: families and links as Column builders, fitted by the shared loop."""

from __future__ import annotations

import math
from collections.abc import Callable, Generator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import na
from ..errors import ConvergenceFailed, InsufficientObservations, InvalidOptions, NumericalError, RegressionError
from ..functions.special import digamma, digamma_col, lgamma_col, norm_cdf_col, norm_pdf_col, norm_ppf, norm_sf2, trigamma, trigamma_col
from ..plans.irls import normal_equations, solve
from ..plans.keyed import Key, fit_keys, moments_of, sums_of
from ..plans.many import Ask, View, fit_together
from ..plans.solve import spd_inverse
from .base import number

ETA_LIMIT = 30.0


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def norm_ppf_col(p: Column) -> Column:
    """Normal quantile by Acklam's rational approximation (1e-9): used for starting values only."""
    a = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239]
    b = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
    c = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
    d = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]

    def horner(cs, x):
        out = F.lit(cs[0])
        for v in cs[1:]:
            out = out * x + F.lit(v)
        return out

    q = p - 0.5
    r = q * q
    centre = horner(a, r) * q / horner(b, r)
    t = F.sqrt(-2 * F.ln(F.when(p < 0.5, p).otherwise(1 - p)))
    tail = horner(c, t) / horner(d, t)
    return F.when(F.abs(q) <= 0.47575, centre).when(q < 0, tail).otherwise(-tail)


class Link:
    """eta = g(mu): g, its inverse and dmu/deta as Columns."""

    def __init__(self, name, g, inverse, slope):
        self.name, self.g, self.inverse, self.slope = name, g, inverse, slope


def power_link(q: float) -> Link:
    if q == 0:
        return LINKS["log"]
    if q == 1:
        return LINKS["identity"]
    inv = lambda e: F.pow(F.greatest(e, F.lit(1e-10)), F.lit(1 / q))
    return Link(f"power({q})", lambda m: F.pow(m, F.lit(q)), inv, lambda e: F.pow(F.greatest(e, F.lit(1e-10)), F.lit(1 / q - 1)) / q)


def _logistic(e: Column) -> Column:
    return 1 / (1 + F.exp(-clip(e, -ETA_LIMIT, ETA_LIMIT)))


LINKS = {
    "identity": Link("identity", lambda m: m, lambda e: e, lambda e: F.lit(1.0) + e * 0),
    "log": Link("log", lambda m: F.ln(m), lambda e: F.exp(clip(e, -ETA_LIMIT, ETA_LIMIT)), lambda e: F.exp(clip(e, -ETA_LIMIT, ETA_LIMIT))),
    "sqrt": Link("sqrt", lambda m: F.sqrt(m), lambda e: F.greatest(e, F.lit(1e-7)) ** 2, lambda e: 2 * F.greatest(e, F.lit(1e-7))),
    "inverse": Link("inverse", lambda m: 1 / m, lambda e: 1 / e, lambda e: -1 / (e * e)),
    "logit": Link("logit", lambda m: F.ln(m / (1 - m)), _logistic, lambda e: _logistic(e) * (1 - _logistic(e))),
    "probit": Link("probit", norm_ppf_col, norm_cdf_col, norm_pdf_col),
    "cloglog": Link(
        "cloglog", lambda m: F.ln(-F.ln(1 - m)), lambda e: 1 - F.exp(-F.exp(clip(e, -ETA_LIMIT, 4.0))),
        lambda e: F.exp(clip(e, -ETA_LIMIT, 4.0)) * F.exp(-F.exp(clip(e, -ETA_LIMIT, 4.0))),
    ),
}


def _xlogx(y: Column, ratio: Column) -> Column:
    return F.when(y > 0, y * F.ln(ratio)).otherwise(F.lit(0.0))


class Family:
    """Variance, deviance (per row), start and checks of a response; register() adds one by name."""

    def __init__(self, name, variance, deviance, start, valid, low=None, high=None, dispersion="fixed"):
        self.name, self.variance, self.deviance, self.start, self.valid = name, variance, deviance, start, valid
        self.low, self.high, self.dispersion = low, high, dispersion

    def bound(self, mu: Column) -> Column:
        if self.low is not None:
            mu = F.greatest(mu, F.lit(self.low))
        return mu if self.high is None else F.least(mu, F.lit(self.high))


def poisson() -> Family:
    return Family(
        "poisson", lambda m: F.greatest(m, F.lit(1e-10)), lambda y, m: 2 * (_xlogx(y, y / m) - (y - m)),
        lambda y, mean: F.greatest((y + mean) / 2, F.lit(1e-3)), lambda y: y >= 0, low=1e-14, dispersion="pearson_least_1",
    )


def binomial() -> Family:
    return Family(
        "binomial", lambda m: m * (1 - m), lambda y, m: 2 * (_xlogx(y, y / m) + _xlogx(1 - y, (1 - y) / (1 - m))),
        lambda y, mean: (y + 0.5) / 2, lambda y: (y >= 0) & (y <= 1), low=1e-10, high=1 - 1e-10,
    )


def negative_binomial(theta: float) -> Family:
    return Family(
        "negative_binomial", lambda m: m + m * m / theta,
        lambda y, m: 2 * (_xlogx(y, y / m) - (y + theta) * F.ln((y + theta) / (m + theta))),
        lambda y, mean: F.greatest((y + mean) / 2, F.lit(1e-3)), lambda y: y >= 0, low=1e-10, dispersion="pearson_least_1",
    )


def tweedie(p: float) -> Family:
    if 0 < p < 1:
        raise InvalidOptions("no Tweedie distribution has a variance power between 0 and 1")
    if p == 0:
        dev, low, ok = (lambda y, m: (y - m) ** 2), None, (lambda y: F.lit(True))
    elif p == 1:
        dev, low, ok = (lambda y, m: 2 * (_xlogx(y, y / m) - (y - m))), 1e-10, (lambda y: y >= 0)
    elif p == 2:
        dev, low, ok = (lambda y, m: 2 * (y / m - 1 - F.ln(y / m))), 1e-10, (lambda y: y > 0)
    else:
        def dev(y, m):
            first = F.when(y > 0, F.pow(y, F.lit(2 - p))).otherwise(F.lit(0.0)) / ((1 - p) * (2 - p))
            return 2 * (first - y * F.pow(m, F.lit(1 - p)) / (1 - p) + F.pow(m, F.lit(2 - p)) / (2 - p))

        low, ok = 1e-10, (lambda y: y >= 0) if p < 2 else (lambda y: y > 0)
    var = (lambda m: F.lit(1.0) + m * 0) if p == 0 else (lambda m: F.pow(m, F.lit(float(p))))
    return Family(f"tweedie({p})", var, dev, lambda y, mean: (y + mean) / 2, ok, low=low, dispersion="deviance")


FAMILIES = {"poisson": poisson, "binomial": binomial, "negative_binomial": negative_binomial, "tweedie": tweedie}


def register(name: str, builder) -> None:
    """Adds a family: a function of its parameters that returns a Family."""
    FAMILIES[name] = builder


class GLMModel:
    def __init__(self, est: GLM, b, cov, n, deviance, null_deviance, pearson, family, link, iterations, theta=None):
        o = est
        self.features, self.label, self.offset, self.has_intercept = o.features, o.label, o.offset, o.intercept
        self.b, self.cov, self.n, self.deviance, self.null_deviance, self.pearson = b, cov, n, deviance, null_deviance, pearson
        self.family, self.link, self.iterations, self.theta = family, link, iterations, theta
        self.k = len(b)
        df = n - self.k
        self.df = df
        self.dispersion = {
            "fixed": 1.0, "pearson_least_1": max(pearson / df, 1.0) if df > 0 else 1.0, "deviance": deviance / df if df > 0 else 1.0,
        }[family.dispersion]
        self.std_errors_all = np.sqrt(np.maximum(np.diag(cov) * self.dispersion, 0))
        k = self.k + (1 if theta is not None else 0)
        self.log_likelihood = -deviance / 2
        self.aic, self.bic = 2 * k + deviance, k * math.log(n) + deviance

    @property
    def intercept(self) -> float | None:
        return float(self.b[0]) if self.has_intercept else None

    @property
    def coefficients(self) -> np.ndarray:
        return self.b[1:] if self.has_intercept else self.b

    @property
    def std_errors(self) -> np.ndarray:
        return self.std_errors_all[1:] if self.has_intercept else self.std_errors_all

    @property
    def intercept_std_error(self) -> float | None:
        return float(self.std_errors_all[0]) if self.has_intercept else None

    @property
    def z_statistics(self) -> np.ndarray:
        return self.coefficients / self.std_errors

    @property
    def p_values(self) -> np.ndarray:
        return np.array([norm_sf2(z) for z in self.z_statistics])

    def eta(self, offset: str | None = None) -> Column:
        out = F.lit(self.intercept or 0.0)
        for f, v in zip(self.features, self.coefficients, strict=True):
            out = out + number(f) * F.lit(float(v))
        return out + number(offset) if offset else out

    predict_linear = predict_eta = eta

    def predict(self, offset: str | None = None) -> Column:
        """Mean response; the model's own offset column only where it is named."""
        return self.family.bound(self.link.inverse(self.eta(offset)))

    predict_mu = predict_count = predict_probability = predict
    predict_with_offset = predict

    def predict_with_se(self, df: DataFrame, level: float = 0.95, scale: str = "response", offset: str | None = None, output: str = "prediction") -> DataFrame:
        """df with the prediction, its standard error (delta method on the response scale) and the
        interval: link +- z se, carried back through the inverse link."""
        v = [*([F.lit(1.0)] if self.has_intercept else []), *map(number, self.features)]
        a = self.cov * self.dispersion
        var = F.lit(0.0)
        for i in range(len(v)):
            for j in range(i, len(v)):
                var = var + v[i] * v[j] * F.lit(float(a[i, j] * (1 if i == j else 2)))
        z = norm_ppf(0.5 + level / 2)
        df = df.withColumn("_eta", self.eta(offset)).withColumn("_se", F.sqrt(F.greatest(var, F.lit(0.0))))
        e, se = F.col("_eta"), F.col("_se")
        if scale == "link":
            cols = {output: e, f"{output}_se": se, f"{output}_lower": e - z * se, f"{output}_upper": e + z * se}
        else:
            ends = [self.link.inverse(e - z * se), self.link.inverse(e + z * se)]
            cols = {
                output: self.family.bound(self.link.inverse(e)), f"{output}_se": F.abs(self.link.slope(e)) * se,
                f"{output}_lower": F.least(*ends), f"{output}_upper": F.greatest(*ends),
            }
        return df.withColumns(cols).drop("_eta", "_se")

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return df.withColumn(output, self.predict(self.offset))

    def overdispersion_ratio(self, df: DataFrame) -> float:
        """Variance over mean at the mean fitted value of df: 1 + mean / theta for a negative binomial."""
        mean = df.agg(F.avg(self.predict(self.offset))).first()[0]
        return df.sparkSession.range(1).select(self.family.variance(F.lit(float(mean))) / F.lit(float(mean))).first()[0]

    def augment(self, df: DataFrame) -> DataFrame:
        """df with fitted, leverage and response, Pearson, deviance, working and standardised residuals."""
        df = df.withColumn("_eta", self.eta(self.offset)).withColumn("fitted", self.family.bound(self.link.inverse(F.col("_eta"))))
        y, mu, e = number(self.label), F.col("fitted"), F.col("_eta")
        v = self.family.variance(mu)
        slope = self.link.slope(e)
        x = [*([F.lit(1.0)] if self.has_intercept else []), *map(number, self.features)]
        h = F.lit(0.0)
        for i in range(len(x)):
            for j in range(i, len(x)):
                h = h + x[i] * x[j] * F.lit(float(self.cov[i, j] * (1 if i == j else 2)))
        df = df.withColumn("leverage", F.least(F.lit(1.0), F.greatest(F.lit(0.0), h * slope * slope / v)))
        df = df.withColumns(
            {
                "response_residual": y - mu, "pearson_residual": (y - mu) / F.sqrt(v), "working_residual": (y - mu) / slope,
                "deviance_residual": F.signum(y - mu) * F.sqrt(F.greatest(self.family.deviance(y, mu), F.lit(0.0))),
            }
        )
        gap = F.sqrt(F.lit(self.dispersion) * F.greatest(1 - F.col("leverage"), F.lit(1e-14)))
        df = df.withColumns({"standardized_pearson": F.col("pearson_residual") / gap, "standardized_deviance": F.col("deviance_residual") / gap})
        return df.drop("_eta")


class GLM:
    """Any family with any link; lam is a ridge on the slopes."""

    def __init__(self, features: list[str], label: str, family: Family, link: str | Link, offset: str | None = None, intercept: bool = True,
                 lam: float = 0.0, max_iter: int = 100, tol: float = 1e-8, na_action: str = "omit"):
        if lam < 0 or max_iter < 1 or tol <= 0:
            raise InvalidOptions("lam >= 0, max_iter >= 1 and tol > 0 are needed")
        self.features, self.label, self.family, self.offset, self.intercept = list(features), label, family, offset, intercept
        self.link = LINKS[link] if isinstance(link, str) else link
        self.lam, self.max_iter, self.tol, self.na_action = lam, max_iter, tol, na_action

    def inputs(self) -> tuple:
        return self.features, self.label, self.offset, None

    def fit(self, df: DataFrame) -> GLMModel:
        return fit_together(df, [self])[0]

    def fit_by(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """keys, coefficients, intercept, std_errors, intercept_std_error, deviance, dispersion, n,
        iterations, error: a fit for each group by steps that all groups take together. A group that
        fails has its error and NULLs. As fit(), without a null deviance."""
        family, link, p, at = self.family, self.link, len(self.features), 1 if self.intercept else 0
        cols = [*self.features, self.label, *([self.offset] if self.offset else [])]
        x = na.process(df, cols, self.na_action)
        own = [number(c).alias(f"_x{j}") for j, c in enumerate(self.features)]
        rows = x.select(*keys, *own, number(self.label).alias("_y"), (number(self.offset) if self.offset else F.lit(0.0)).alias("_o"))
        means = rows.groupBy(*keys).agg(F.avg("_y").alias("_mean"))
        same = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}")) for c in keys])
        rows = rows.alias("r").join(means.alias("m"), same).select("r.*", "m._mean")
        y, o, features = F.col("_y"), F.col("_o"), [F.col(f"_x{j}") for j in range(p)]

        def ask(b: Column, start: Column) -> list[Column]:
            linear = (b[0] if at else F.lit(0.0)) + sum((v * b[j + at] for j, v in enumerate(features)), F.lit(0.0)) + o
            first = link.g(family.bound(family.start(y, F.col("_mean"))))
            eta = F.when(start, first).otherwise(linear)
            mu = family.bound(F.when(start, family.start(y, F.col("_mean"))).otherwise(link.inverse(linear)))
            slope = link.slope(eta)
            w = F.when(F.abs(slope) < 1e-14, F.lit(1e-10)).otherwise(slope * slope / F.greatest(family.variance(mu), F.lit(1e-14)))
            z = eta - o + (y - mu) / F.when(F.abs(slope) < 1e-14, F.lit(1e-14)).otherwise(slope)
            return sums_of(features, z, w, [family.deviance(y, mu), (y - mu) ** 2 / family.variance(mu), (~family.valid(y)).cast("double")])

        intercept, lam, tol, most = self.intercept, self.lam, self.tol, self.max_iter
        need, name = p + at, family.name

        def update(key: Key) -> None:
            m, (dev, chi, bad) = moments_of(key.now, p)
            if m.n < max(2, need):
                raise InsufficientObservations(f"{m.n} rows for {need} parameters")
            if bad:
                raise RegressionError(f"{int(bad)} responses are outside the range of {name}")
            ridge = lambda b: lam * float(b[at:] @ b[at:]) if lam else 0.0
            change = moved = np.inf
            if key.candidate is not None and key.b is not None:
                before = moments_of(key.sums, p)[1][0] + ridge(key.b)
                better = math.isfinite(dev) and dev + ridge(key.candidate) <= before + 1e-7 * abs(before)
                if not better and key.halved < 10:
                    key.candidate, key.halved = (key.candidate + key.b) / 2, key.halved + 1
                    return
                moved = abs(key.candidate - key.b).max()
                change = abs(dev + ridge(key.candidate) - before) / (0.1 + abs(dev))
            key.b, key.sums, key.halved = key.candidate, key.now, 0
            if change < tol or moved < tol:
                key.status = ""
                return
            if key.steps >= most:
                raise ConvergenceFailed(f"no convergence in {most} steps")
            new = solve(*normal_equations(m, intercept, lam))
            if not np.isfinite(new).all():
                raise NumericalError("a step left the finite numbers")
            key.candidate, key.steps = new, key.steps + 1

        state = fit_keys(rows, keys, ask, update, 11 * (most + 2))
        out = "coefficients array<double>, intercept double, std_errors array<double>, intercept_std_error double, deviance double, dispersion double, n long, iterations int, error string"
        schema = T.StructType([*[state.schema[c] for c in keys], *T.StructType.fromDDL(out)])
        scale = family.dispersion

        def described(frames):
            for pdf in frames:
                found = []
                for r in pdf.to_dict("records"):
                    own = [r[c] for c in keys]
                    if r["status"]:
                        found.append((*own, None, None, None, None, None, None, None, int(r["steps"]), r["status"]))
                        continue
                    m, (dev, chi, _) = moments_of(np.array(r["sums"], dtype=float), p)
                    df_ = m.n - need
                    phi = {"fixed": 1.0, "pearson_least_1": max(chi / df_, 1.0) if df_ > 0 else 1.0, "deviance": dev / df_ if df_ > 0 else 1.0}[scale]
                    se = np.sqrt(np.maximum(np.diag(spd_inverse(normal_equations(m, intercept, lam)[0])) * phi, 0))
                    b = np.array(r["b"], dtype=float)
                    head = (float(b[0]), float(se[0])) if at else (None, None)
                    found.append((*own, b[at:].tolist(), head[0], se[at:].tolist(), head[1], dev, phi, m.n, int(r["steps"]), None))
                yield pd.DataFrame(found, columns=schema.names)

        return state.mapInPandas(described, schema)

    def checked(self, view: View) -> Generator:
        """Rows, mean and variance of the response."""
        values = yield Ask({"y": view.mine(view.y), "bad": view.mine((~self.family.valid(view.y)).cast("int"))}, lambda r: [F.count(r["y"]), F.avg(r["y"]), F.var_samp(r["y"]), F.sum(r["bad"])])
        n, mean, var, bad = values
        need = len(self.features) + (1 if self.intercept else 0)
        if n < max(2, need):
            raise InsufficientObservations(f"{n} rows for {need} parameters")
        if bad:
            raise RegressionError(f"{bad} responses are outside the range of {self.family.name}")
        return n, mean, var

    def steps(self, view: View) -> Generator:
        n, mean, _ = yield from self.checked(view)
        return (yield from self.loop(view, n, mean, self.family))

    def loop(self, view: View, n: int, mean: float, family: Family, start: np.ndarray | None = None, theta=None,
             loss: Callable[[Column], Column] | None = None, watch: Callable[[np.ndarray], Generator] | None = None) -> Generator:
        """Steps until the deviance or the coefficients stand; with a loss (of a row, by its mean) or
        watch (the loss of all rows, by the coefficients) until that stands, relative to one more."""
        y, o, link = view.y, view.o, self.link

        def step(b: np.ndarray | None) -> Generator:
            """Sums at b: the next step's normal equations and the deviance at b."""
            if b is None:
                mu = family.start(y, F.lit(float(mean)))
                eta = link.g(family.bound(mu))
            else:
                eta = view.eta(b, self.intercept) + o
                mu = link.inverse(eta)
            mu = family.bound(mu)
            slope = link.slope(eta)
            w = slope * slope / F.greatest(family.variance(mu), F.lit(1e-14))
            w = F.when(F.abs(slope) < 1e-14, F.lit(1e-10)).otherwise(w)
            z = eta - o + (y - mu) / F.when(F.abs(slope) < 1e-14, F.lit(1e-14)).otherwise(slope)
            m, more = yield from view.moments(z, w, dev=family.deviance(y, mu), chi=(y - mu) ** 2 / family.variance(mu), **({"loss": loss(mu)} if loss else {}))
            return m, more["dev"], more["chi"], more.get("loss")

        def penalised(b: np.ndarray | None, dev: float) -> float:
            """What a step is to lower: the deviance, and the ridge on the slopes."""
            return dev if b is None or not self.lam else dev + self.lam * float((b[1:] if self.intercept else b) @ (b[1:] if self.intercept else b))

        b, (m, dev, chi, lost) = start, (yield from step(start))
        done = False
        for k in range(1, self.max_iter + 1):
            a, r = normal_equations(m, self.intercept, self.lam)
            new = solve(a, r)
            if not np.isfinite(new).all():
                raise NumericalError("a step left the finite numbers")
            m2, dev2, chi2, lost2 = yield from step(new)
            for _ in range(10):
                old = penalised(b, dev)
                if b is None or (dev2 is not None and math.isfinite(dev2) and penalised(new, dev2) <= old + 1e-7 * abs(old)):
                    break
                new = (new + b) / 2
                m2, dev2, chi2, lost2 = yield from step(new)
            moved = np.inf if b is None else abs(new - b).max()
            change = abs(penalised(new, dev2) - penalised(b, dev)) / (0.1 + abs(dev2)) if b is not None else np.inf
            if watch:
                lost2 = yield from watch(new)
            stands = lost is not None and abs(lost2 - lost) < self.tol * (1 + abs(lost)) if loss or watch else change < self.tol or moved < self.tol
            b, m, dev, chi, lost = new, m2, dev2, chi2, lost2
            if stands:
                done = True
                break
        if not done:
            raise ConvergenceFailed(f"no convergence in {self.max_iter} steps")
        a, _ = normal_equations(m, self.intercept, self.lam)
        mu0 = family.bound(F.lit(float(mean)))
        null = (yield from view.ask(null=family.deviance(y, mu0)))["null"] if self.intercept else None
        return GLMModel(self, b, spd_inverse(a), n, dev, null, chi, family, link, k, theta)


class Poisson(GLM):
    def __init__(self, features, label, link: str = "log", **kw):
        if link not in ("log", "identity", "sqrt"):
            raise InvalidOptions("links of a Poisson model: log, identity, sqrt")
        super().__init__(features, label, poisson(), link, **kw)


class Binomial(GLM):
    def __init__(self, features, label, link: str = "logit", **kw):
        if link not in ("logit", "probit", "cloglog"):
            raise InvalidOptions("links of a binomial model: logit, probit, cloglog")
        super().__init__(features, label, binomial(), link, **kw)


class Tweedie(GLM):
    def __init__(self, features, label, var_power: float = 1.5, link_power: float | None = None, **kw):
        super().__init__(features, label, tweedie(var_power), power_link(1 - var_power if link_power is None else link_power), **kw)


class Gamma(Tweedie):
    def __init__(self, features, label, **kw):
        kw.setdefault("max_iter", 25)
        super().__init__(features, label, 2.0, 0.0, **kw)


class InverseGaussian(Tweedie):
    def __init__(self, features, label, **kw):
        super().__init__(features, label, 3.0, 0.0, **kw)


class NegativeBinomial(GLM):
    """Log link. theta fixed, or by maximum likelihood: mean and theta in turns."""

    def __init__(self, features, label, theta: float | None = None, **kw):
        super().__init__(features, label, negative_binomial(theta or 1.0), "log", **kw)
        self.theta = theta

    def theta_step(self, view: View, b: np.ndarray, theta: float, n: int) -> Generator:
        """Newton steps on log theta for the profile likelihood."""
        y, mu = view.y, F.exp(view.eta(b, self.intercept) + view.o)
        for _ in range(50):
            t = F.lit(theta)
            s = yield from view.ask(
                digamma=digamma_col(y + t), log=F.ln(t + mu), ratio=(y + t) / (t + mu), curve=2 / (t + mu) - (y + t) / (t + mu) ** 2, trigamma=trigamma_col(y + t)
            )
            score = s["digamma"] - n * float(digamma(theta)) + n * math.log(theta) + n - s["log"] - s["ratio"]
            slope = s["trigamma"] - n * float(trigamma(theta)) + n / theta - s["curve"]
            curve = slope * theta**2 + score * theta
            move = -score * theta / curve if curve < 0 else math.copysign(0.5, score)
            move = max(-2.0, min(2.0, move))
            theta = min(max(theta * math.exp(move), 1e-4), 1e7)
            if abs(move) < 1e-9:
                break
        return theta

    def steps(self, view: View) -> Generator:
        n, mean, var = yield from self.checked(view)
        if self.theta is not None:
            return (yield from self.loop(view, n, mean, negative_binomial(self.theta), theta=self.theta))
        theta = mean**2 / (var - mean) if var and var > mean else 100.0
        b = None
        for _ in range(25):
            model = yield from self.loop(view, n, mean, negative_binomial(theta), start=b, theta=theta)
            b = model.b
            new = yield from self.theta_step(view, b, theta, n)
            if abs(new - theta) < 1e-7 * (1 + theta):
                break
            theta = new
        return (yield from self.loop(view, n, mean, negative_binomial(theta), start=b, theta=theta))


class LogisticModel:
    def __init__(self, glm: GLMModel, threshold: float):
        self.glm, self.threshold = glm, threshold
        self.coefficients, self.intercept = glm.coefficients, glm.intercept

    def predict_proba(self) -> Column:
        return self.glm.predict()

    def decision_function(self) -> Column:
        return self.glm.eta()

    def predict(self) -> Column:
        return (self.predict_proba() >= self.threshold).cast("int")

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return df.withColumn("probability", self.predict_proba()).withColumn(output, (F.col("probability") >= self.threshold).cast("int"))

    def score(self, df: DataFrame) -> float:
        return df.agg(F.avg((self.predict() == number(self.glm.label)).cast("double"))).first()[0]


class Logistic:
    """Binary classifier; penalty None or 'l2' with strength lam (C = 1 / lam)."""

    def __init__(self, features, label, penalty: str | None = None, lam: float = 1.0, threshold: float = 0.5, **kw):
        if penalty not in (None, "l2"):
            raise InvalidOptions("penalty must be None or 'l2'")
        self.glm = Binomial(features, label, lam=lam if penalty else 0.0, **kw)
        self.glm.family = binomial()
        self.glm.family.valid = lambda y: (y == 0) | (y == 1)
        self.threshold = threshold

    def fit(self, df: DataFrame) -> LogisticModel:
        return LogisticModel(self.glm.fit(df), self.threshold)


__all__ = [
    "FAMILIES", "GLM", "LINKS", "Binomial", "Family", "GLMModel", "Gamma", "InverseGaussian", "Link", "Logistic", "NegativeBinomial",
    "Poisson", "Tweedie", "lgamma_col", "power_link", "register",
]
