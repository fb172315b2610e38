"""Linear estimators against dense numpy, and known values."""

import numpy as np
import pytest

from sparkreg.errors import InsufficientObservations, InvalidOptions, InvalidWeights, NaValuesPresent
from sparkreg.operators import diagnostics as dg
from sparkreg.operators.base import Model, score_by
from sparkreg.operators.linear import OLS, RLS, WLS, Ridge, is_full_rank
from sparkreg.operators.shrinkage import ARD, BLS, LARS, NNLS, PLS, BayesianRidge, ElasticNet, Lasso, LassoLars, PSpline
from sparkreg.options import RegressionOptions
from sparkreg.plans.moments import Moments, moments
from sparkreg.plans.solve import bounded, elastic_net, lars
from sparkreg.sources.io import from_matrix

N = 120
FS = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(N, 3)) * [1, 3, 0.2] + [0, 10, 1]
    y = 1 + x @ [2.0, -1.0, 0.5] + rng.normal(size=N) * 0.5
    w = rng.uniform(0.5, 2, N)
    return x, y, w, from_matrix(spark, x, y, w).cache()


def test_ols_equals_dense(data):
    x, y, _, df = data
    a = np.c_[np.ones(N), x]
    b = np.linalg.lstsq(a, y, rcond=None)[0]
    m = OLS(FS, "y").fit(df)
    assert np.allclose(np.r_[m.intercept, m.coefficients], b, atol=1e-9)
    r = y - a @ b
    mse = r @ r / (N - 4)
    se = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * mse)
    assert np.allclose(np.r_[m.intercept_std_error, m.std_errors], se, atol=1e-9)
    assert m.r_squared == pytest.approx(1 - r @ r / ((y - y.mean()) ** 2).sum(), abs=1e-12)
    assert m.score(df) == pytest.approx(m.r_squared, abs=1e-10)
    h = np.diag(a @ np.linalg.inv(a.T @ a) @ a.T)
    i = dg.influence(m, df).toPandas().sort_values("row_id")
    assert np.allclose(i["leverage"], h, atol=1e-9)
    assert np.allclose(i["studentized"], r / np.sqrt(mse * (1 - h)), atol=1e-7)
    for kind, omega in (("HC0", r**2), ("HC1", r**2 * N / (N - 4)), ("HC2", r**2 / (1 - h)), ("HC3", (r / (1 - h)) ** 2)):
        inv = np.linalg.inv(a.T @ a)
        assert np.allclose(dg.hc_covariance(m, df, kind), inv @ (a.T * omega @ a) @ inv, atol=1e-9)


def test_analytic_hc(spark):
    df = from_matrix(spark, [1, 2, 3, 4, 5], [2.1, 4.3, 5.8, 8.2, 9.9])
    m = OLS(["x1"], "y").fit(df)
    want = {"HC0": (0.12235, 0.03178), "HC1": (0.15796, 0.04103), "HC2": (0.15488, 0.04185), "HC3": (0.20342, 0.05721)}
    for kind, v in want.items():
        assert np.allclose(dg.hc_standard_errors(m, df, kind), v, atol=2e-5)


def test_aliased_column_is_nan(spark):
    i = np.arange(20.0)
    df = from_matrix(spark, np.c_[i, 2 * i, i**2], 1 + 2 * i + 3 * i**2)
    m = OLS(FS, "y").fit(df)
    assert np.isnan(m.coefficients).sum() == 1
    assert m.r_squared == pytest.approx(1)
    assert not is_full_rank(df, FS)
    p = m.transform(df).toPandas()
    assert np.allclose(p["prediction"], p["y"], atol=1e-6)


def test_wide_equals_narrow(data):
    *_, df = data
    a, b = moments(df, FS, "y", "w"), moments(df, FS, "y", "w", narrow=1)
    assert np.allclose(a.q, b.q) and np.allclose(a.s, b.s) and a.n == b.n


def test_moments_merge_and_push(data):
    x, y, _, df = data
    whole = moments(df, FS, "y")
    m = Moments.empty(3)
    for row, v in zip(x[:50], y[:50], strict=True):
        m = m.push(row, v)
    rest = moments(df.filter("row_id >= 50"), FS, "y")
    both = m.merge(rest)
    assert np.allclose(OLS(FS, "y").fit_moments(both).coefficients, OLS(FS, "y").fit_moments(whole).coefficients, atol=1e-9)


def test_partitions_do_not_matter(data):
    *_, df = data
    a, b = OLS(FS, "y").fit(df.repartition(1)), OLS(FS, "y").fit(df.repartition(16))
    assert np.allclose(a.coefficients, b.coefficients, atol=1e-11)


def test_wls_and_ridge(data):
    x, y, w, df = data
    a = np.c_[np.ones(N), x]
    m = WLS(FS, "y", "w").fit(df)
    assert np.allclose(np.r_[m.intercept, m.coefficients], np.linalg.solve((a.T * w) @ a, (a.T * w) @ y), atol=1e-9)
    with pytest.raises(InvalidWeights):
        WLS(FS, "y", "neg").fit(df.selectExpr("*", "w - 1.2 AS neg"))
    c = x - x.mean(0)
    r = Ridge(FS, "y", lam=0.7).fit(df)
    assert np.allclose(r.coefficients, np.linalg.solve(c.T @ c + 0.7 * np.eye(3), c.T @ y), atol=1e-9)
    assert np.allclose(Ridge(FS, "y", lam=0.0).fit(df).coefficients, OLS(FS, "y").fit(df).coefficients)


def test_rls_equals_recursion(data):
    x, y, _, df = data
    for f in (1.0, 0.95):
        p, b = np.eye(4) * 1e6, np.zeros(4)
        for v, t in zip(np.c_[np.ones(N), x], y, strict=True):
            g = p @ v / (f + v @ p @ v)
            b, p = b + g * (t - v @ b), (p - np.outer(g, v @ p)) / f
        m = RLS(FS, "y", ["row_id"], forgetting=f).fit(df)
        assert np.allclose(np.r_[m.intercept, m.coefficients], b, atol=1e-5)


def test_elastic_net_is_the_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    y = x @ [3, 0, -2, 0.1] + rng.normal(size=60)
    g, r = x.T @ x, x.T @ y
    for l1, l2 in ((20.0, 5.0), (60.0, 0.0)):
        b = elastic_net(g, r, l1, l2)
        grad = 2 * (g @ b - r + l2 * b)
        on = b != 0
        assert np.allclose(grad[on], -l1 * np.sign(b[on]), atol=1e-5)
        assert (abs(grad[~on]) <= l1 + 1e-5).all()


def test_lasso_and_lassolars_agree(data):
    *_, df = data
    assert np.allclose(Lasso(FS, "y", 60.0).fit(df).coefficients, LassoLars(FS, "y", alpha_stop=30.0).fit(df).coefficients, atol=1e-6)
    assert np.allclose(LARS(FS, "y").fit(df).coefficients, OLS(FS, "y").fit(df).coefficients, atol=1e-7)
    assert np.allclose(PLS(FS, "y", 3).fit(df).coefficients, OLS(FS, "y").fit(df).coefficients, atol=1e-6)
    one = ElasticNet(FS, "y", 1.0, 0.0).fit(df)
    assert np.allclose(one.coefficients, Ridge(FS, "y", lam=1.0).fit(df).coefficients)


def test_lassolars_with_drops_equals_coordinate_descent():
    rng = np.random.default_rng(3)
    for _ in range(40):
        x = rng.normal(size=(30, 6)) @ (np.eye(6) + rng.normal(size=(6, 6)))
        y = x @ rng.normal(size=6) + rng.normal(size=30)
        g, r = x.T @ x, x.T @ y
        alpha = abs(r).max() * 0.02
        assert np.allclose(lars(g, r, True, alpha)[0], elastic_net(g, r, 2 * alpha, 0.0, tol=1e-13, steps=200_000), atol=1e-4)


def test_bounds_meet_kkt():
    rng = np.random.default_rng(4)
    for _ in range(50):
        x = rng.normal(size=(25, 4))
        y = x @ rng.normal(size=4) * 2 + rng.normal(size=25)
        lo, hi = np.array([-np.inf, -0.5, 0, -1]), np.array([0.3, np.inf, 1, 1.0])
        g, r = x.T @ x, x.T @ y
        b = bounded(g, r, lo, hi)
        grad = r - g @ b
        assert (b >= lo - 1e-9).all() and (b <= hi + 1e-9).all()
        inner = (b > lo + 1e-9) & (b < hi - 1e-9)
        assert np.allclose(grad[inner], 0, atol=1e-6)
        assert (grad[b <= lo + 1e-9] <= 1e-6).all() and (grad[b >= hi - 1e-9] >= -1e-6).all()


def test_bls_nnls_bayes_spline(data):
    x, y, _, df = data
    b = BLS(FS, "y", lower=-0.5, upper=1.0).fit(df).coefficients
    assert b.min() >= -0.5 and b.max() <= 1
    assert NNLS(FS, "y").fit(df).coefficients.min() >= 0
    ols = OLS(FS, "y").fit(df).coefficients
    assert np.allclose(BayesianRidge(FS, "y").fit(df).coefficients, ols, atol=0.1)
    assert np.allclose(ARD(FS, "y").fit(df).coefficients[:2], ols[:2], atol=0.1)
    m = PSpline("x1", "y", n_basis=8).fit(df)
    t = m.transform(df, level=0.9).toPandas()
    assert (t["prediction_lower"] <= t["prediction_upper"]).all() and m.edf < 8


def test_groups_errors_and_scoring(data, spark):
    x, y, _, df = data
    g = df.selectExpr("*", "CASE WHEN row_id < 2 THEN 9 ELSE row_id % 2 END AS g")
    models = OLS(FS, "y").fit_by(g, ["g"])
    rows = {r["g"]: r for r in models.collect()}
    assert rows[9]["coefficients"] is None and "InsufficientObservations" in rows[9]["error"]
    even = OLS(FS, "y").fit(g.filter("g = 0"))
    assert np.allclose(rows[0]["coefficients"], even.coefficients, atol=1e-8)
    scored = score_by(g, models, ["g"], FS).toPandas()
    assert scored["prediction"].isna().sum() == 2


def test_na_policies_and_options(data, spark, tmp_path):
    x, y, _, df = data
    holes = df.selectExpr("row_id", "CASE WHEN row_id % 10 = 0 THEN NULL ELSE x1 END AS x1", "x2", "x3", "CASE WHEN row_id % 10 = 1 THEN double('NaN') ELSE y END AS y")
    m = OLS(FS, "y").fit(holes)
    assert m.n == N - 24
    assert m.augment(holes).filter("fitted is null").count() == 12
    with pytest.raises(NaValuesPresent):
        OLS(FS, "y", na_action="fail").fit(holes)
    with pytest.raises(InsufficientObservations):
        OLS(FS, "y").fit(df.limit(2))
    for bad in ({"lam": -1}, {"alpha": 0.5}, {"confidence": 1}, {"forgetting": 0}, {"tolerance": 0}):
        with pytest.raises(InvalidOptions):
            RegressionOptions(**bad)
    m.save(spark, str(tmp_path / "model"))
    back = Model.load(spark, str(tmp_path / "model"))
    assert np.allclose(back.coefficients, m.coefficients)


def test_vif_condition_separation(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 2))
    x = np.c_[x, x[:, 0] + rng.normal(size=80) * 0.1]
    df = from_matrix(spark, x, (x[:, 0] > 0).astype(float))
    r = np.linalg.inv(np.corrcoef(x.T))
    assert np.allclose(list(dg.vif(df, FS).values()), np.diag(r), rtol=1e-6)
    a = np.c_[np.ones(80), x]
    assert dg.condition_number(df, FS) == pytest.approx(np.linalg.cond(a), rel=1e-6)
    assert dg.check_binary_separation(df, ["x1", "x2"], "y") == {"x1": "complete", "x2": "none"}
    assert dg.high_vif_predictors(dg.vif(df, FS)) == ["x1", "x3"]
