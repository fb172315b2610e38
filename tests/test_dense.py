"""Estimators without a closed form, held against dense computations in numpy."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkreg import na
from sparkreg.functions import special as sp
from sparkreg.operators import aid, linear
from sparkreg.operators.alm import ALM
from sparkreg.operators.glm import NegativeBinomial
from sparkreg.operators.linear import OLS, RLS
from sparkreg.operators.lm_dynamic import LmDynamic
from sparkreg.operators.robust import Huber, Isotonic, PassiveAggressive, Quantile, TheilSen
from sparkreg.plans import ordering
from sparkreg.plans.moments import moments
from sparkreg.plans.solve import pava
from sparkreg.sources.io import from_matrix

N = 80
RNG = np.random.default_rng(11)
X = RNG.normal(size=N)
NOISE = RNG.standard_t(4, size=N)
HALF_LOG = 0.5 * math.log(2 * math.pi)

normal = lambda y, m, s: -HALF_LOG - np.log(s) - (y - m) ** 2 / (2 * s * s)
laplace = lambda y, m, s: -np.log(2 * s) - abs(y - m) / s
general = lambda y, m, s: math.log(1.5 / 2) - np.log(s) - math.lgamma(1 / 1.5) - abs((y - m) / s) ** 1.5
on_log = lambda f: lambda y, m, s: f(np.log(y), np.log(m), s) - np.log(y)
power = lambda v: 2 * np.sqrt(v) - 2

#: distribution -> (extra, response, log-likelihood of y, linear predictor, scale)
CASES = {
    "student_t": (5.0, 1 + X + NOISE, lambda y, e, s: math.lgamma(3) - math.lgamma(2.5) - 0.5 * math.log(5 * math.pi) - np.log(s) - 3 * np.log(1 + ((y - e) / s) ** 2 / 5)),
    "logistic": (None, 1 + X + NOISE, lambda y, e, s: -abs(y - e) / s - 2 * np.log1p(np.exp(-abs(y - e) / s)) - np.log(s)),
    "laplace": (None, 1 + X + NOISE, lambda y, e, s: laplace(y, e, s)),
    "asymmetric_laplace": (0.3, 1 + X + NOISE, lambda y, e, s: math.log(0.21) - np.log(s) - np.where(y >= e, 0.3 * (y - e), 0.7 * (e - y)) / s),
    "generalised_normal": (1.5, 1 + X + NOISE, lambda y, e, s: general(y, e, s)),
    "log_laplace": (None, np.exp(1 + X + 0.3 * NOISE), lambda y, e, s: on_log(laplace)(y, np.exp(e), s)),
    "log_generalised_normal": (1.5, np.exp(1 + X + 0.3 * NOISE), lambda y, e, s: on_log(general)(y, np.exp(e), s)),
    "folded_normal": (None, abs(2 + X + NOISE), lambda y, e, s: np.logaddexp(-((y - e) ** 2) / (2 * s * s), -((y + e) ** 2) / (2 * s * s)) - np.log(s) - HALF_LOG),
    "rectified_normal": (None, np.maximum(0.5 + X + NOISE, 0), lambda y, e, s: np.where(y > 0, normal(y, e, s), np.log(np.maximum(sp.norm_cdf(-e / s), 1e-300)))),
    "box_cox_normal": (0.5, np.exp(1 + 0.2 * X + 0.1 * NOISE), lambda y, e, s: -HALF_LOG - np.log(s) - (power(y) - power(np.maximum(e, 1e-10))) ** 2 / (2 * s * s) - 0.5 * np.log(y)),
    "beta": (None, 1 / (1 + np.exp(-0.3 * X - 0.4 * NOISE)), lambda y, e, s: (lambda a, b: sp.lgamma(a + b) - sp.lgamma(a) - sp.lgamma(b) + (a - 1) * np.log(y) + (b - 1) * np.log(1 - y))(s / (1 + np.exp(-e)), s / (1 + np.exp(e)))),
}


@pytest.mark.parametrize("name", CASES)
def test_alm_fits_are_optima(spark, name):
    extra, y, ll = CASES[name]
    m = ALM(["x1"], "y", name, extra=extra, inference=False).fit(from_matrix(spark, X, y))

    def best(b):
        return max(ll(y, b[0] + b[1] * X, s).sum() for s in np.exp(np.linspace(-4, 5, 400)))

    top = best(m.b)
    slack = 2e-3 if "laplace" in name else 2e-4 * max(1.0, abs(top))
    for d in itertools.product((-0.02, 0, 0.02), repeat=2):
        assert best(m.b + np.array(d)) <= top + slack, d


@pytest.mark.parametrize("name", ["s", "log_s"])
def test_roots_fit_no_worse_than_every_pair(spark, name):
    """The likelihoods of roots of distances have a peak at each line through two points."""
    y = (1 + X + 0.3 * NOISE)[:30]
    y = np.exp(y) if name == "log_s" else y
    m = ALM(["x1"], "y", name, inference=False).fit(from_matrix(spark, X[:30], y))
    z = np.log(y) if name == "log_s" else y
    loss = lambda b: np.sqrt(abs(z - b[0] - b[1] * X[:30])).sum()
    ols = np.polyfit(X[:30], z, 1)[::-1]
    assert loss(m.b) <= loss(ols) + 1e-9 and m.b[1] == pytest.approx(1.0, abs=0.3)


def test_huber_equals_dense_reweighting(spark):
    x = np.c_[X, RNG.normal(size=N)]
    y = 1 + x @ [2, -1] + NOISE
    m = Huber(["x1", "x2"], "y", tol=1e-9).fit(from_matrix(spark, x, y))
    a = np.c_[np.ones(N), x]
    b = np.linalg.lstsq(a, y, rcond=None)[0]
    for _ in range(200):
        r = y - a @ b
        s = np.median(abs(r)) / 0.6745
        w = np.minimum(1, 1.35 / np.maximum(abs(r / s), 1e-12))
        b = np.linalg.solve((a * w[:, None]).T @ a + np.diag([0, 1e-4, 1e-4]), a.T @ (w * y))
    assert np.allclose([m.intercept, *m.coefficients], b, atol=1e-6) and m.scale == pytest.approx(s, rel=1e-5)


@pytest.mark.parametrize("tau", [0.5, 0.9])
def test_quantile_reaches_the_least_loss(spark, tau):
    y = 1 + 2 * X + NOISE
    m = Quantile(["x1"], "y", tau, max_iter=300).fit(from_matrix(spark, X, y))
    loss = lambda a, b: (lambda r: np.where(r >= 0, tau * r, (tau - 1) * r).sum())(y - a - b * X)
    lines = []
    for i, j in itertools.combinations(range(N), 2):
        b = (y[j] - y[i]) / (X[j] - X[i])
        lines.append(loss(y[i] - b * X[i], b))
    assert loss(m.intercept, m.coefficients[0]) <= min(lines) * (1 + 1e-4)


def test_theil_sen_is_the_spatial_median_of_all_pairs(spark):
    x, y = X[:25], (1 + 2 * X + NOISE)[:25]
    m = TheilSen(["x1"], "y", ["row_id"]).fit(from_matrix(spark, x, y))
    points = np.array([np.linalg.solve([[1, x[i]], [1, x[j]]], [y[i], y[j]]) for i, j in itertools.combinations(range(25), 2)])
    total = lambda p: np.sqrt(((points - p) ** 2).sum(axis=1)).sum()
    b = np.array([m.intercept, m.coefficients[0]])
    assert all(total(b) <= total(b + d) + 1e-9 for d in ([1e-3, 0], [-1e-3, 0], [0, 1e-3], [0, -1e-3]))


def test_passive_aggressive_equals_plain_updates(spark):
    x, y = np.c_[X, X**2], 1 + 2 * X + 0.1 * NOISE
    for variant in ("pa1", "pa2"):
        m = PassiveAggressive(["x1", "x2"], "y", ["row_id"], variant=variant, epochs=3, tol=-1e9).fit(from_matrix(spark, x, y))
        w, b = np.zeros(2), 0.0
        for _ in range(3):
            for v, t in zip(x, y, strict=True):
                loss = max(0, abs(t - w @ v - b) - 0.1)
                step = min(1.0, loss / (v @ v)) if variant == "pa1" else loss / (v @ v + 0.5)
                step = math.copysign(step, t - w @ v - b) if loss else 0.0
                w, b = w + step * v, b + step
        assert np.allclose([*m.coefficients, m.intercept], [*w, b], atol=1e-9)


def test_order_statistics_of_ties_and_narrow_ranges(spark):
    for v in (RNG.integers(0, 5, 3000).astype(float), 1e15 + RNG.integers(0, 3, 3000), RNG.lognormal(sigma=6, size=3000), np.r_[np.full(2990, 7.0), RNG.normal(size=10)]):
        df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(3)
        old, ordering.FEW = ordering.FEW, 20
        try:
            ranks = [0, 1, 1499, 1500, 2998, 2999]
            assert ordering.order_statistics(df, F.col("v"), ranks) == np.sort(v)[ranks].tolist()
            assert ordering.quantile(df, F.col("v"), 0.3) == pytest.approx(np.quantile(v, 0.3), rel=1e-12)
        finally:
            ordering.FEW = old


@pytest.mark.parametrize("trend", [-1, 0.2, 5])
def test_isotonic_pools_across_ranges(spark, trend):
    x = np.arange(300.0)
    y = trend * x / 30 + RNG.normal(size=300) * 3
    m = Isotonic("x1", "y").fit(from_matrix(spark, x, y))
    got = m.transform(spark.createDataFrame([(float(v),) for v in x], "x1 double"), "x1", "f").toPandas().sort_values("x1")["f"].to_numpy()
    assert np.allclose(got, pava(y, np.ones(300)), atol=1e-9)


def test_rls_weights_are_the_same_either_way(spark, monkeypatch):
    df = from_matrix(spark, X, 1 + 2 * X + NOISE)
    a = RLS(["x1"], "y", ["row_id"], forgetting=0.95).fit(df)
    monkeypatch.setattr(linear, "RLS_TOP", 0)
    b = RLS(["x1"], "y", ["row_id"], forgetting=0.95).fit(df)
    w = 0.95 ** np.arange(N - 1, -1, -1)
    v = np.c_[np.ones(N), X]
    want = np.linalg.solve((v * w[:, None]).T @ v + np.eye(2) * 0.95**N / 1e6, v.T @ (w * (1 + 2 * X + NOISE)))
    for m in (a, b):
        assert np.allclose([m.intercept, m.coefficients[0]], want, atol=1e-9)


def test_wide_moments_add_up(spark):
    x = RNG.normal(size=(60, 20))
    df = from_matrix(spark, x, x.sum(axis=1))
    m = moments(df, [f"x{j + 1}" for j in range(20)], "y")
    z = np.c_[x, x.sum(axis=1)]
    assert m.n == 60 and np.allclose(m.raw()[0], x.T @ x) and np.allclose(m.raw()[1], x.T @ z[:, -1])


def test_lm_dynamic_intervals(spark):
    x = np.c_[X, RNG.normal(size=N)]
    df = from_matrix(spark, x, 1 + x @ [2, 0.5] + NOISE)
    m = LmDynamic(["x1", "x2"], "y", ["row_id"], span=None).fit(df)
    fitted = m.augment(df).toPandas().sort_values("row_id")
    mse = ((fitted["y"] - fitted["fitted"]) ** 2).sum() / (N - 3)
    v = np.c_[np.ones(N), x]
    h = ((v @ np.linalg.inv(v.T @ v)) * v).sum(axis=1)
    got = m.transform(df, "prediction", 0.9).toPandas().sort_values("row_id")
    assert np.allclose(got["prediction_se"], np.sqrt(mse * (1 + h)), rtol=1e-8)
    assert np.allclose(got["prediction_upper"] - got["prediction"], sp.t_ppf(0.95, N - 3) * got["prediction_se"], rtol=1e-8)


def test_overdispersion_expansion_and_profile(spark):
    y = RNG.negative_binomial(2, 0.4, size=N).astype(float)
    df = from_matrix(spark, X, y)
    m = NegativeBinomial(["x1"], "y", theta=2.0).fit(df)
    mean = np.exp(m.intercept + m.coefficients[0] * X).mean()
    assert m.overdispersion_ratio(df) == pytest.approx(1 + mean / 2, rel=1e-9)
    holes = spark.createDataFrame([(float(i), None if i % 4 == 0 else float(2 * i)) for i in range(20)], "a double, b double")
    fit = OLS(["a"], "b", na_action="exclude").fit(holes)
    out = na.expanded(holes, ["a", "b"], {"fitted": fit.predict(), "se": F.lit(1.0)}).toPandas().sort_values("a")
    assert out["fitted"].isna().tolist() == [i % 4 == 0 for i in range(20)] and out["se"].isna().sum() == 5
    s = pd.DataFrame([("a", t, float(v)) for t, v in enumerate([0, 0, 3, 4, 0, 5, 3, 4, 0, 0, 0, 2])], columns=["k", "t", "y"])
    frame = spark.createDataFrame(s)
    whole, bare = aid.profile(frame, ["k"], "y", ["t"]), aid.profile(frame, ["k"], "y", ["t"], detect_anomalies=False, ic="bic")
    odd = aid.profile(frame, ["k"], "y", ["t"], anomaly_alpha=3.0, threshold=-1.0).first()
    assert odd["anomaly_alpha"] == 0.5 and odd["demand_type"] == "intermittent" and whole.first()["anomaly_alpha"] == 0.05
    assert "stockout" in whole.columns and whole.first()["stockout"] == 4 and "stockout" not in bare.columns
