"""Augmented linear models: 25 distributions, each maximising its stated log-likelihood.

Where the score has an exact reweighted form the fit is a least-squares, GLM or quantile fit, whose
scale is the distribution's own formula. The others maximise the likelihood over coefficients and log
scale by limited-memory BFGS from several starts: a step is one aggregation of likelihoods and
gradients (derivatives of the densities as Columns) at all step lengths of all starts, and the scale
is the one at the optimum. loss is what a reweighted fit watches to stop, as compute_loss() has it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InsufficientObservations, InvalidOptions, RegressionError
from ..functions.special import digamma_col, lgamma_col, norm_cdf_col
from ..plans.climb import climb
from ..plans.many import Direct, View, at_points, fit_together, together
from ..plans.ordering import order_statistics
from ..plans.solve import least_squares, spd_inverse
from .base import number
from .glm import LINKS

HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)


def _pos(c: Column) -> Column:
    return F.greatest(c, F.lit(1e-10))


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(1e-10), F.least(F.lit(1 - 1e-10), c))


def _count(y: Column) -> Column:
    return F.greatest(F.round(y), F.lit(0.0))


# Log-likelihood of a row: (y, mu, scale, extra) -> Column. scale may be a Column or a number.


def _normal(y, m, s, e):
    return -HALF_LOG_2PI - F.ln(s) - (y - m) ** 2 / (2 * s * s)


def _laplace(y, m, s, e):
    return -F.ln(2 * s) - F.abs(y - m) / s


def _student(y, m, s, e):
    z = (y - m) / s
    c = math.lgamma((e + 1) / 2) - math.lgamma(e / 2) - 0.5 * math.log(math.pi * e)
    return F.lit(c) - F.ln(s) - (e + 1) / 2 * F.ln(1 + z * z / e)


def _logistic(y, m, s, e):
    z = F.abs((y - m) / s)  # symmetric, and stable so
    return -z - 2 * F.ln(1 + F.exp(-z)) - F.ln(s)


def _asymmetric(y, m, s, e):
    d = y - m
    return F.lit(math.log(e * (1 - e))) - F.ln(s) - F.when(d >= 0, e * d).otherwise((e - 1) * d) / s


def _general(y, m, s, e):
    return F.ln(e / (2 * s)) - math.lgamma(1 / e) - F.pow(F.abs((y - m) / s), F.lit(e))


def _s(y, m, s, e):
    return -F.ln(4 * s * s) - F.sqrt(F.abs(y - m)) / s


def _on_log(f):
    return lambda y, m, s, e: f(F.ln(y), F.ln(m), s, e) - F.ln(y)


def _log_s(y, m, s, e):
    return F.ln(0.25 / s) - F.ln(y) - F.sqrt(F.abs(F.ln(y) - F.ln(m)) / s)


def _folded(y, m, s, e):
    a, b = (y - m) / s, (y + m) / s
    hi, lo = F.greatest(-a * a / 2, -b * b / 2), F.least(-a * a / 2, -b * b / 2)
    return hi + F.ln(1 + F.exp(lo - hi)) - F.ln(s) - HALF_LOG_2PI


def _rectified(y, m, s, e):
    return F.when(y > 0, _normal(y, m, s, e)).otherwise(F.ln(F.greatest(norm_cdf_col(-m / s), F.lit(1e-300))))


def _box_cox(y, m, s, e):
    t = (lambda v: F.ln(_pos(v))) if abs(e) < 1e-10 else (lambda v: (F.pow(_pos(v), F.lit(e)) - 1) / e)
    return -HALF_LOG_2PI - F.ln(s) - (t(y) - t(m)) ** 2 / (2 * s * s) + (e - 1) * F.ln(y)


def _gamma(y, m, s, e):
    return e * F.ln(e / m) + (e - 1) * F.ln(y) - e * y / m - math.lgamma(e)


def _inverse_gaussian(y, m, s, e):
    return 0.5 * F.ln(e / (2 * math.pi * F.pow(y, F.lit(3.0)))) - e * (y - m) ** 2 / (2 * m * m * y)


def _beta(y, m, s, e):
    a, b = m * s, (1 - m) * s
    return lgamma_col(a + b) - lgamma_col(a) - lgamma_col(b) + (a - 1) * F.ln(y) + (b - 1) * F.ln(1 - y)


def _logit_normal(y, m, s, e):
    return _normal(F.ln(y / (1 - y)), m, s, e) - F.ln(y) - F.ln(1 - y)


def _poisson(y, m, s, e):
    return _count(y) * F.ln(_pos(m)) - _pos(m) - lgamma_col(_count(y) + 1)


def _negative_binomial(y, m, s, e):
    k, p = _count(y), e / (e + _pos(m))
    return lgamma_col(k + e) - math.lgamma(e) - lgamma_col(k + 1) + e * F.ln(p) + k * F.ln(1 - p)


def _binomial(y, m, s, e):
    k, p = F.least(_count(y * e), F.lit(float(e))), _unit(m)
    return math.lgamma(e + 1) - lgamma_col(k + 1) - lgamma_col(e - k + 1) + k * F.ln(p) + (e - k) * F.ln(1 - p)


def _geometric(y, m, s, e):
    p = 1 / (1 + _pos(m))
    return F.ln(p) + _count(y) * F.ln(1 - p)


def _bernoulli(y, m, s, e):
    return y * F.ln(_unit(m)) + (1 - y) * F.ln(1 - _unit(m))


# Derivatives of a row's log-likelihood by mu and by log scale, of the same arguments.


def _sign_power(z: Column, power: float) -> Column:
    """sign(z) |z|^power; where that is infinite at zero, a large value."""
    return F.signum(z) * F.pow(F.greatest(F.abs(z), F.lit(1e-12)), F.lit(float(power)))


def _scores_of_z(slope: Callable[[Column, float], Column]):
    """Of a location-scale density with d log f / dz = -slope."""
    return lambda y, m, s, e: (slope((y - m) / s, e) / s, slope((y - m) / s, e) * (y - m) / s - 1)


def _scores_on_log(scores):
    def out(y, m, s, e):
        by_m, by_s = scores(F.ln(y), F.ln(m), s, e)
        return by_m / m, by_s

    return out


def _scores_s(y, m, s, e):
    return _sign_power(y - m, -0.5) / (2 * s), F.sqrt(F.abs(y - m)) / s - 2


def _scores_log_s(y, m, s, e):
    d = F.ln(y) - F.ln(m)
    return _sign_power(d, -0.5) / (2 * F.sqrt(F.lit(1.0) * s) * m), 0.5 * F.sqrt(F.abs(d) / s) - 1


def _scores_folded(y, m, s, e):
    a, b = (y - m) / s, (y + m) / s
    p = 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), (a * a - b * b) / 2))))
    return (p * a - (1 - p) * b) / s, p * a * a + (1 - p) * b * b - 1


def _scores_rectified(y, m, s, e):
    a, u = (y - m) / s, -m / s
    hazard = F.when(u < -30, -u).otherwise(F.exp(-u * u / 2 - HALF_LOG_2PI) / F.greatest(norm_cdf_col(u), F.lit(1e-300)))
    return F.when(y > 0, a).otherwise(-hazard) / s, F.when(y > 0, a * a - 1).otherwise(-u * hazard)


def _scores_box_cox(y, m, s, e):
    t = (lambda v: F.ln(_pos(v))) if abs(e) < 1e-10 else (lambda v: (F.pow(_pos(v), F.lit(e)) - 1) / e)
    q = (t(y) - t(m)) / s
    return F.when(m > 1e-10, q / s * F.pow(_pos(m), F.lit(e - 1.0))).otherwise(0.0), q * q - 1


def _scores_beta(y, m, s, e):
    a, b = m * s, (1 - m) * s
    da, db = digamma_col(a), digamma_col(b)
    odds = F.ln(y) - F.ln(1 - y)
    return s * (db - da + odds), s * (digamma_col(a + b) - m * da - (1 - m) * db + m * F.ln(y) + (1 - m) * F.ln(1 - y))


_NORMAL = _scores_of_z(lambda z, e: z)
_LAPLACE = _scores_of_z(lambda z, e: F.signum(z))
_GENERAL = _scores_of_z(lambda z, e: e * _sign_power(z, e - 1.0))
SCORES = {
    "normal": _NORMAL, "laplace": _LAPLACE, "student_t": _scores_of_z(lambda z, e: (e + 1) * z / (e + z * z)), "logistic": _scores_of_z(lambda z, e: F.tanh(z / 2)),
    "asymmetric_laplace": _scores_of_z(lambda z, e: F.when(z >= 0, F.lit(e)).otherwise(e - 1)), "generalised_normal": _GENERAL, "s": _scores_s,
    "log_normal": _scores_on_log(_NORMAL), "log_laplace": _scores_on_log(_LAPLACE), "log_s": _scores_log_s, "log_generalised_normal": _scores_on_log(_GENERAL),
    "folded_normal": _scores_folded, "rectified_normal": _scores_rectified, "box_cox_normal": _scores_box_cox, "beta": _scores_beta,
    "logit_normal": lambda y, m, s, e: _NORMAL(F.ln(y / (1 - y)), m, s, e),
    "gamma": lambda y, m, s, e: (e * (y - m) / (m * m), None), "inverse_gaussian": lambda y, m, s, e: (e * (y - m) / F.pow(m, F.lit(3.0)), None),
    "exponential": lambda y, m, s, e: ((y - m) / (m * m), None), "poisson": lambda y, m, s, e: (_count(y) / _pos(m) - 1, None),
    "negative_binomial": lambda y, m, s, e: (_count(y) / _pos(m) - (_count(y) + e) / (e + _pos(m)), None),
    "binomial": lambda y, m, s, e: ((F.least(_count(y * e), F.lit(float(e))) - e * _unit(m)) / (_unit(m) * (1 - _unit(m))), None),
    "geometric": lambda y, m, s, e: (_count(y) / _pos(m) - (_count(y) + 1) / (1 + _pos(m)), None),
    "cumulative_logistic": lambda y, m, s, e: ((y - _unit(m)) / (_unit(m) * (1 - _unit(m))), None),
    "cumulative_normal": lambda y, m, s, e: ((y - _unit(m)) / (_unit(m) * (1 - _unit(m))), None),
}


@dataclass(frozen=True)
class Distribution:
    name: str
    link: str
    loglik: Callable
    scaled: bool  # has a scale parameter of its own
    extra: float | None = None
    need: str = "any"  # any, positive, nonnegative, unit, share, binary
    way: str = "ml"  # ols, ols_log, ols_logit, glm, quantile, quantile_log, vertex, vertex_log, ml


DISTRIBUTIONS = {
    d.name: d
    for d in (
        Distribution("normal", "identity", _normal, True, way="ols"),
        Distribution("laplace", "identity", _laplace, True, way="quantile"),
        Distribution("student_t", "identity", _student, True, 5.0),
        Distribution("logistic", "identity", _logistic, True),
        Distribution("asymmetric_laplace", "identity", _asymmetric, True, 0.5, way="quantile"),
        Distribution("generalised_normal", "identity", _general, True, 2.0),
        Distribution("s", "identity", _s, True, way="vertex"),
        Distribution("log_normal", "log", _on_log(_normal), True, need="positive", way="ols_log"),
        Distribution("log_laplace", "log", _on_log(_laplace), True, need="positive", way="quantile_log"),
        Distribution("log_s", "log", _log_s, True, need="positive", way="vertex_log"),
        Distribution("log_generalised_normal", "log", _on_log(_general), True, 2.0, need="positive"),
        Distribution("folded_normal", "identity", _folded, True, need="nonnegative"),
        Distribution("rectified_normal", "identity", _rectified, True, need="nonnegative"),
        Distribution("box_cox_normal", "identity", _box_cox, True, 1.0, need="positive"),
        Distribution("gamma", "log", _gamma, False, 1.0, need="positive", way="glm"),
        Distribution("inverse_gaussian", "log", _inverse_gaussian, False, 1.0, need="positive", way="glm"),
        Distribution("exponential", "log", lambda y, m, s, e: -F.ln(m) - y / m, False, need="nonnegative", way="glm"),
        Distribution("beta", "logit", _beta, True, need="unit"),
        Distribution("logit_normal", "identity", _logit_normal, True, need="unit", way="ols_logit"),
        Distribution("poisson", "log", _poisson, False, need="nonnegative", way="glm"),
        Distribution("negative_binomial", "log", _negative_binomial, False, 1.0, need="nonnegative", way="glm"),
        Distribution("binomial", "logit", _binomial, False, 1.0, need="share", way="glm"),
        Distribution("geometric", "log", _geometric, False, need="nonnegative", way="glm"),
        Distribution("cumulative_logistic", "logit", _bernoulli, False, need="binary", way="glm"),
        Distribution("cumulative_normal", "probit", _bernoulli, False, need="binary", way="glm"),
    )
}

#: Likelihoods that may have several maxima: these are climbed from a wider scale too.
MANY_TOPS = ("student_t", "folded_normal", "box_cox_normal")
#: Rows to one distinct row from which a fit climbs over distinct rows and their numbers.
REPEATED = 4
LOSSES = ("likelihood", "mse", "mae", "ham", "role")


def _valid(need: str, y: Column) -> Column:
    return {
        "any": F.lit(True), "positive": y > 0, "nonnegative": y >= 0, "unit": (y > 0) & (y < 1), "share": (y >= 0) & (y <= 1), "binary": (y == 0) | (y == 1),
    }[need]


def log_likelihood(df: DataFrame, y: Column, mu: Column, distribution: str, scale: float = 1.0, extra: float | None = None) -> float:
    d = DISTRIBUTIONS[distribution]
    return df.agg(F.sum(d.loglik(y, mu, F.lit(float(scale)), d.extra if extra is None else extra))).first()[0]


def scale_steps(view: View, mu: Column, distribution: str, dof: float, extra: float | None = None) -> Generator:
    """The distribution's scale from fitted values; 1 where it has none."""
    y, m = view.y, mu

    def mean(c: Column) -> Generator:
        s = yield from view.ask(sum=c, n=F.lit(1.0))
        return s["sum"] / s["n"]

    def root(c: Column) -> Generator:
        return math.sqrt((yield from view.ask(sum=c))["sum"] / dof)

    def middle(c: Column) -> Generator:
        def run(df: DataFrame) -> list[float]:
            x = view.rows(df)
            return order_statistics(x, c, [x.count() // 2])

        (value,) = yield Direct(run)
        return value / 0.6745

    on_log = F.ln(y) - F.ln(m)
    if distribution in ("normal", "rectified_normal"):
        return (yield from root((y - m) ** 2))
    if distribution == "log_normal":
        return (yield from root(on_log**2))
    if distribution == "logit_normal":
        yy = F.greatest(F.lit(0.001), F.least(F.lit(0.999), y))
        return (yield from root((F.ln(yy / (1 - yy)) - m) ** 2))
    if distribution == "laplace":
        return (yield from mean(F.abs(y - m)))
    if distribution == "log_laplace":
        return (yield from mean(F.abs(on_log)))
    if distribution in ("student_t", "logistic", "generalised_normal", "box_cox_normal"):
        return (yield from middle(F.abs(y - m)))
    if distribution == "log_generalised_normal":
        return (yield from middle(F.abs(on_log)))
    if distribution == "s":
        return max((yield from mean(F.sqrt(F.abs(y - m)))) / 2, 1e-10)
    if distribution == "log_s":
        return max((yield from mean(F.sqrt(F.abs(on_log)))) / 2, 1e-10)
    if distribution == "asymmetric_laplace":
        a = DISTRIBUTIONS[distribution].extra if extra is None else extra
        return max((yield from mean(F.when(y >= m, a * (y - m)).otherwise((1 - a) * (m - y)))), 1e-10)
    if distribution == "folded_normal":
        return math.sqrt(max((yield from mean(y * y - m * m)), 0.01))
    if distribution == "beta":
        mm = F.greatest(F.lit(0.01), F.least(F.lit(0.99), m))
        s = yield from view.ask(v=mm * (1 - mm), n=F.lit(1.0), r=(y - m) ** 2)
        return max(s["v"] / s["n"] / max(s["r"] / max(dof, 1.0), 1e-10) - 1, 1.0)
    return 1.0


def estimate_scale(df: DataFrame, y: Column, mu: Column, distribution: str, dof: float, extra: float | None = None) -> float:
    x = df.select(y.cast("double").alias("y"), mu.cast("double").alias("m"))
    return together(x, [scale_steps(View([], F.col("y")), F.col("m"), distribution, dof, extra)])[0]


def compute_loss(df: DataFrame, y: Column, mu: Column, loss: str, distribution: str = "normal", scale: float = 1.0, extra: float | None = None, trim: float = 0.05) -> float:
    """To be minimised. role: minus the sum of row log-likelihoods without the share trim of worst rows."""
    if loss not in LOSSES:
        raise InvalidOptions(f"loss must be one of {LOSSES}")
    if loss == "likelihood":
        return -log_likelihood(df, y, mu, distribution, scale, extra)
    d = y - mu
    if loss != "role":
        return df.agg(F.avg({"mse": d * d, "mae": F.abs(d), "ham": F.sqrt(F.abs(d))}[loss])).first()[0]
    dist = DISTRIBUTIONS[distribution]
    x = df.select(dist.loglik(y, mu, F.lit(float(scale)), dist.extra if extra is None else extra).alias("l"))
    n = x.count()
    drop = min(math.ceil(n * trim), n - 1)
    if not drop:
        return -x.agg(F.sum("l")).first()[0]
    (cut,) = order_statistics(x, F.col("l"), [drop - 1])
    s, below, low = x.agg(F.sum("l"), F.sum((F.col("l") < F.lit(cut)).cast("long")), F.sum(F.when(F.col("l") < F.lit(cut), F.col("l")))).first()
    return -(s - (low or 0.0) - (drop - below) * cut)


class ALMModel:
    def __init__(self, est: ALM, b: np.ndarray, scale: float, ll: float, n: int, se: np.ndarray | None, converged: bool):
        self.features, self.label, self.has_intercept, self.dist, self.extra = est.features, est.label, est.intercept, est.dist, est.extra
        self.link = est.link
        self.b, self.scale, self.log_likelihood, self.n, self.std_errors_all, self.converged = b, scale, ll, n, se, converged
        k = len(b) + (1 if est.dist.scaled else 0)
        self.n_parameters = k
        self.aic, self.bic = 2 * k - 2 * ll, k * math.log(n) - 2 * ll
        self.aicc = self.aic + 2 * k * (k + 1) / (n - k - 1) if n - k - 1 > 0 else math.nan

    @property
    def intercept(self):
        return float(self.b[0]) if self.has_intercept else None

    @property
    def coefficients(self):
        return self.b[1:] if self.has_intercept else self.b

    def predict(self) -> Column:
        out = F.lit(self.intercept or 0.0)
        for f, v in zip(self.features, self.coefficients, strict=True):
            out = out + number(f) * F.lit(float(v))
        return LINKS[self.link].inverse(out)

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return df.withColumn(output, self.predict())

    def pointwise(self) -> Column:
        """Log-likelihood of a row."""
        return self.dist.loglik(number(self.label), self.predict(), F.lit(float(self.scale)), self.extra)


class ALM:
    """y ~ distribution(mu), g(mu) = Xb. extra: the distribution's own parameter (degrees of freedom,
    asymmetry, shape, Box-Cox power, size, trials)."""

    def __init__(self, features, label, distribution: str = "normal", link: str | None = None, extra: float | None = None, loss: str = "likelihood",
                 trim: float = 0.05, intercept: bool = True, inference: bool = True, max_iter: int = 200, tol: float = 1e-10):
        if distribution not in DISTRIBUTIONS:
            raise InvalidOptions(f"no such distribution: {distribution}")
        if loss not in LOSSES:
            raise InvalidOptions(f"loss must be one of {LOSSES}")
        self.features, self.label, self.intercept, self.inference = list(features), label, intercept, inference
        self.dist = DISTRIBUTIONS[distribution]
        self.link = link or self.dist.link
        if self.link not in LINKS:
            raise InvalidOptions(f"no such link: {self.link}")
        self.extra = self.dist.extra if extra is None else extra
        self.loss, self.trim, self.max_iter, self.tol = loss, trim, max_iter, tol

    def inputs(self) -> tuple:
        return self.features, self.label, None, None

    def fit(self, df: DataFrame) -> ALMModel:
        return fit_together(df, [self])[0]

    def steps(self, view: View) -> Generator:
        y = view.y
        found = yield from view.ask(n=F.lit(1.0), bad=(~_valid(self.dist.need, y)).cast("int"))
        n, bad = int(found["n"] or 0), found["bad"]
        k = len(self.features) + (1 if self.intercept else 0)
        if n < k + 1:
            raise InsufficientObservations(f"{n} rows for {k} coefficients")
        if bad:
            raise RegressionError(f"{bad} responses are outside the range of {self.dist.name}")
        b, converged, scale, ll = yield from self.coefficients(view, n)
        mu = LINKS[self.link].inverse(view.eta(b, self.intercept))
        if scale is None:
            scale = yield from scale_steps(view, mu, self.dist.name, n - k, self.extra)
        if ll is None:
            ll = (yield from view.ask(ll=self.dist.loglik(y, mu, F.lit(float(max(scale, 1e-12))), self.extra)))["ll"]
        se = None
        if self.inference and n > k:
            m, more = yield from view.moments(y, F.lit(1.0), r=(y - mu) ** 2)
            gram = m.augmented() if self.intercept else m.raw()[0]
            se = np.sqrt(np.maximum(np.diag(spd_inverse(gram)), 0) * more["r"] / (n - k))
        return ALMModel(self, b, scale, ll, n, se, converged)

    def coefficients(self, view: View, n: int) -> Generator:
        """Coefficients, whether they converged, and scale and log-likelihood where the way gives them."""
        from .glm import GLM, binomial, negative_binomial, poisson, tweedie
        from .robust import Quantile

        way = self.dist.way if self.link == self.dist.link else ("glm" if self.dist.way == "glm" else "ml")
        y = view.y
        k = len(self.features) + (1 if self.intercept else 0)
        watched = self.loss != "likelihood"
        if way == "glm":
            family = {
                "gamma": lambda: tweedie(2.0), "exponential": lambda: tweedie(2.0), "inverse_gaussian": lambda: tweedie(3.0), "poisson": poisson,
                "negative_binomial": lambda: negative_binomial(self.extra), "geometric": lambda: negative_binomial(1.0),
            }.get(self.dist.name, binomial)()
            if self.dist.name == "exponential":
                family.valid = lambda v: v >= 0
                family.deviance = lambda v, m: 2 * (v / m - 1 + F.ln(m))
            mean = (yield from view.ask(sum=y))["sum"] / n
            g = GLM(self.features, self.label, family, self.link, intercept=self.intercept, max_iter=self.max_iter, **({"tol": self.tol} if watched else {}))
            loss = {"mse": lambda m: (y - m) ** 2 / n, "mae": lambda m: F.abs(y - m) / n, "ham": lambda m: F.sqrt(F.abs(y - m)) / n}.get(self.loss)
            watch = (lambda b: self.trimmed(view, b, n, n - k)) if self.loss == "role" else None
            model = yield from g.loop(view, n, mean, family, loss=loss, watch=watch)
            return model.b, True, None, None
        response = {"ols_log": F.ln(y), "quantile_log": F.ln(y), "vertex_log": F.ln(y), "ols_logit": F.ln(y / (1 - y))}.get(way, y)
        if way.startswith("quantile"):
            tau = self.extra if self.dist.name == "asymmetric_laplace" else 0.5
            q = Quantile(self.features, self.label, tau, intercept=self.intercept, max_iter=self.max_iter, tol=self.tol)
            q = yield from q.steps(view.of(response), (lambda b: self.watched(view, b, n, n - k)) if watched else None)
            return np.r_[[q.intercept] if self.intercept else [], q.coefficients], q.converged, None, None
        if way.startswith("vertex"):
            # sums of roots have their minima at lines through rows, as sums of absolute values have
            q = Quantile(self.features, self.label, 0.5, intercept=self.intercept, max_iter=self.max_iter)
            shown = view.of(response)
            found = yield from q.steps(shown)
            b = np.r_[[found.intercept] if self.intercept else [], found.coefficients]
            root = lambda r: F.sqrt(F.abs(r))
            done = False
            for _ in range(10):
                b, lost, done = yield from q.vertices(shown, b, root)
                if done:
                    break
            return b, done, max((lost / n / 2) ** (2 if way == "vertex_log" else 1), 1e-10), None
        start, middle, spread = yield from self.start(view, response if way != "ml" else None)
        if way.startswith("ols"):
            return start, True, None, None
        scaled = self.dist.scaled
        s0 = 1.0
        if scaled:
            mu = LINKS[self.link].inverse(view.eta(start, self.intercept))
            s0 = max((yield from scale_steps(view, mu, self.dist.name, max(n - len(start), 1), self.extra)), 1e-3)
        # features are climbed about their means in units of their spread, the scale by its logarithm;
        # the first steps are those of a normal density of that scale
        at = 1 if self.intercept else 0
        unit = np.r_[np.ones(at), spread]

        def inward(b: np.ndarray) -> np.ndarray:
            return np.r_[[b[0] + b[at:] @ middle] if at else [], b[at:] * spread]

        def outward(b: np.ndarray) -> np.ndarray:
            b = b / unit
            return np.r_[[b[0] - b[at:] @ middle] if at else [], b[at:]]

        starts = [start, *([-start] if self.dist.name == "folded_normal" else [])]
        points = [np.r_[inward(b), math.log(s0 * f)] if scaled else inward(b) for b in starts for f in ((1.0, 3.0) if self.dist.name in MANY_TOPS else (1.0,))]
        first = np.r_[np.full(len(start), s0 * s0), [0.5] if scaled else []]
        frame, shown = yield from self.once_each(view, n)
        columns = [*([F.lit(1.0)] if at else []), *[(x - F.lit(float(m))) / F.lit(float(d)) for x, m, d in zip(shown.x, middle, spread, strict=True)]]

        def heights(points: list[np.ndarray]) -> Generator:
            k = len(start)
            found = yield from self.heights(shown, [np.r_[outward(p[:k]), p[k:]] for p in points], columns, frame)
            return [(f / n, g / n) for f, g in found]

        try:
            best = yield from climb(heights, points, first, self.max_iter, self.tol)
        finally:
            if frame is not None:
                frame.unpersist()
        best.x, best.f = np.r_[outward(best.x[: len(start)]), best.x[len(start) :]], best.f * n
        b, scale = (best.x[:-1], math.exp(best.x[-1])) if scaled else (best.x, None)
        if self.dist.name == "folded_normal" and b[0] < 0:
            b = -b  # the likelihood is the same for both signs
        return b, best.converged, scale, best.f

    def trimmed(self, view: View, b: np.ndarray, n: int, dof: float) -> Generator:
        """The loss 'role' at coefficients."""
        mu = LINKS[self.link].inverse(view.eta(b, self.intercept))
        scale = yield from scale_steps(view, mu, self.dist.name, dof, self.extra)
        (value,) = yield Direct(lambda df: [compute_loss(view.rows(df), view.y, mu, "role", self.dist.name, scale, self.extra, self.trim)])
        return value

    def watched(self, view: View, b: np.ndarray, n: int, dof: float) -> Generator:
        """Any loss at coefficients."""
        if self.loss == "role":
            return (yield from self.trimmed(view, b, n, dof))
        d = F.abs(view.y - LINKS[self.link].inverse(view.eta(b, self.intercept)))
        row = {"mse": d * d, "mae": d, "ham": F.sqrt(d)}[self.loss]
        return (yield from view.ask(loss=row))["loss"] / n

    def start(self, view: View, response: Column | None) -> Generator:
        """Least squares of the response on its link's scale, and the features' means and spreads."""
        y = view.y
        if response is None:
            response = {
                "log": F.ln(_pos(y)), "logit": F.ln(_unit(y) / (1 - _unit(y))), "sqrt": F.sqrt(y), "inverse": 1 / _pos(y),
                "probit": LINKS["probit"].g(_unit(y)), "cloglog": F.ln(-F.ln(1 - _unit(y))),
            }.get(self.link, y)
        centre = yield from view.ask(n=F.lit(1.0), y=response, **{f"x{j}": c for j, c in enumerate(view.x)})
        middle = [centre[f"x{j}"] / centre["n"] for j in range(view.p)] if self.intercept else [0.0] * view.p
        level = centre["y"] / centre["n"] if self.intercept else 0.0
        about = View([c - F.lit(float(a)) for c, a in zip(view.x, middle, strict=True)], view.y, own=view.own)
        m, _ = yield from about.moments(response - F.lit(float(level)), F.lit(1.0))
        gram, right, _ = m.raw()
        beta = np.nan_to_num(least_squares(gram, right)[0])
        spread = np.sqrt(np.maximum(np.diag(gram), 0) / max(centre["n"], 1.0))
        b = np.r_[[level - float(np.dot(beta, middle))] if self.intercept else [], beta]
        return b, np.array(middle, dtype=float), np.where(spread > 0, spread, 1.0)

    def once_each(self, view: View, n: int) -> Generator:
        """Where rows are repeated a lot, a held frame that has equal ones once, and its view, whose case
        weight is their number; else none and the view itself."""
        values = {**{f"_x{j}": x for j, x in enumerate(view.x)}, "_y": view.y}

        def run(df: DataFrame) -> list:
            rows = view.rows(df).select(*[c.alias(k) for k, c in values.items()])
            if rows.agg(F.approx_count_distinct(F.xxhash64(*values))).first()[0] > n / REPEATED:
                return [None]
            return [rows.groupBy(*values).agg(F.count("*").cast("double").alias("_c")).persist()]

        (frame,) = yield Direct(run)
        return frame, view if frame is None else View([F.col(k) for k in values if k != "_y"], F.col("_y"), c=F.col("_c"))

    def heights(self, view: View, points: list[np.ndarray], design: list[Column], frame: DataFrame | None = None) -> Generator:
        """Log-likelihood at each point and its derivatives by the coefficients of the design's columns
        and by the log scale, all in one aggregation (over frame, if there is one)."""
        link, scaled = LINKS[self.link], self.dist.scaled
        points = [np.r_[p[:-1], math.exp(min(max(p[-1], -30), 30))] if scaled else p for p in points]
        mu, slope, by_mu, by_scale = (F.col(f"_h_{n}") for n in ("mu", "slope", "m", "s"))

        def predicted(p: list[Column]) -> dict[str, Column]:
            b = p[:-1] if scaled else p
            eta = b[0] if self.intercept else F.lit(0.0)
            for v, x in zip(b[1:] if self.intercept else b, view.x, strict=True):
                eta = eta + x * v
            return {"_h_mu": link.inverse(eta), "_h_slope": link.slope(eta)}

        def rows(p: list[Column]) -> dict[str, Column]:
            s = p[-1] if scaled else F.lit(1.0)
            m, log_s = SCORES[self.dist.name](view.y, mu, s, self.extra)
            return {"_h_f": self.dist.loglik(view.y, mu, s, self.extra), "_h_m": m * slope, **({"_h_s": log_s} if scaled else {})}

        def sums(p: list[Column]) -> list[Column]:
            c = view.c
            return [F.sum(c * F.col("_h_f")), *[F.sum(c * by_mu * x) for x in design], *([F.sum(c * by_scale)] if scaled else [])]

        table = yield Direct(lambda df: at_points(view.rows(df if frame is None else frame), points, sums, predicted, rows))
        return [(row[0] if np.isfinite(row).all() else -math.inf, row[1:]) for row in table]
