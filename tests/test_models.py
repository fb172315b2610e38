"""GLMs, ALM, robust estimators, demand classes, streaming: score equations and brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkreg.errors import ConvergenceFailed, InvalidOptions, RegressionError
from sparkreg.functions import special as sp
from sparkreg.operators import aid
from sparkreg.operators.alm import ALM, DISTRIBUTIONS, compute_loss
from sparkreg.operators.glm import LINKS
from sparkreg.operators.glm import Binomial, Logistic, NegativeBinomial, Poisson, Tweedie
from sparkreg.operators.lm_dynamic import LmDynamic
from sparkreg.operators.robust import Huber, Isotonic, PassiveAggressive, Quantile, Ransac, TheilSen
from sparkreg.operators.smoothing import lowess
from sparkreg.plans.ordering import numbered, quantile
from sparkreg.plans.solve import pava
from sparkreg.sources.io import from_matrix
from sparkreg.streaming.online import RlsState, merge_moments, moments_of, streaming_moments

N = 100
RNG = np.random.default_rng(7)
X = RNG.normal(size=N)
MU = np.exp(0.3 + 0.4 * X)


@pytest.fixture(scope="module")
def counts(spark):
    return from_matrix(spark, X, RNG.poisson(MU)).cache()


def column(df, c):
    return df.toPandas().sort_values("row_id")[c].to_numpy()


def test_special_functions(spark):
    z = np.linspace(-8, 8, 200)
    df = spark.createDataFrame([(float(v),) for v in z], "z double")
    out = df.select("z", sp.norm_cdf_col(F.col("z")).alias("c"), sp.lgamma_col(F.abs("z") + 0.1).alias("g"), sp.digamma_col(F.abs("z") + 0.1).alias("d")).toPandas()
    assert np.allclose(out["c"], sp.norm_cdf(out["z"]), atol=1e-14)
    assert np.allclose(out["g"], sp.lgamma(out["z"].abs() + 0.1), atol=1e-11)
    assert np.allclose(out["d"], sp.digamma(out["z"].abs() + 0.1), atol=1e-12)
    assert sp.t_ppf(0.975, 10) == pytest.approx(2.228138851986274, abs=1e-10)
    assert sp.t_sf2(2.228138851986274, 10) == pytest.approx(0.05, abs=1e-12)
    assert sp.f_sf(4.0, 1, 10) == pytest.approx(sp.t_sf2(2.0, 10), abs=1e-12)


def test_poisson_score_and_tweedie(counts):
    y = column(counts, "y")
    m = Poisson(["x1"], "y").fit(counts)
    mu = np.exp(m.intercept + m.coefficients[0] * X)
    assert abs((y - mu).sum()) < 1e-6 and abs(((y - mu) * X).sum()) < 1e-6
    t = Tweedie(["x1"], "y", 1.0, 0.0).fit(counts)
    assert np.allclose(t.b, m.b, atol=1e-6)
    a = m.augment(counts).toPandas()
    assert (a["deviance_residual"] ** 2).sum() == pytest.approx(m.deviance, rel=1e-9)
    ci = m.predict_with_se(counts).toPandas()
    assert (ci["prediction_lower"] < ci["prediction"]).all() and (ci["prediction"] < ci["prediction_upper"]).all()


def test_offset(spark):
    e = RNG.uniform(1, 5, N)
    y = RNG.poisson(MU * e)
    df = from_matrix(spark, X, y, np.log(e))
    m = Poisson(["x1"], "y", offset="w").fit(df)
    mu = np.exp(m.intercept + m.coefficients[0] * X) * e
    assert abs((y - mu).sum()) < 1e-5


def test_binomial_links(spark):
    y = (RNG.uniform(size=N) < 1 / (1 + np.exp(-X))).astype(float)
    df = from_matrix(spark, X, y)
    m = Binomial(["x1"], "y").fit(df)
    p = 1 / (1 + np.exp(-(m.intercept + m.coefficients[0] * X)))
    assert abs((y - p).sum()) < 1e-6
    q = Binomial(["x1"], "y", "probit").fit(df)
    z = q.intercept + q.coefficients[0] * X
    pq = sp.norm_cdf(z)
    w = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / (pq * (1 - pq))
    assert abs((w * (y - pq)).sum()) < 1e-4
    assert 0.5 < Logistic(["x1"], "y", penalty="l2").fit(df).score(df) <= 1
    separable = from_matrix(spark, X, (X > 0).astype(float))
    with pytest.raises((ConvergenceFailed, RegressionError)):
        Binomial(["x1"], "y", max_iter=5).fit(separable)
    with pytest.raises(InvalidOptions):
        Binomial(["x1"], "y", "log")


def test_negative_binomial_theta(spark):
    y = RNG.negative_binomial(2, 2 / (2 + MU), size=N)
    df = from_matrix(spark, X, y)
    m = NegativeBinomial(["x1"], "y").fit(df)

    def ll(theta):
        mu = np.exp(m.intercept + m.coefficients[0] * X)
        return (sp.lgamma(y + theta) - math.lgamma(theta) + theta * np.log(theta / (theta + mu)) + y * np.log(mu / (theta + mu))).sum()

    assert ll(m.theta) >= max(ll(m.theta * 1.05), ll(m.theta * 0.95))
    big = NegativeBinomial(["x1"], "y", theta=1e7).fit(df)
    assert np.allclose(big.b, Poisson(["x1"], "y").fit(df).b, atol=1e-4)


@pytest.mark.parametrize("name", ["student_t", "logistic", "beta"])
def test_alm_maximum(spark, name):
    eta = 0.2 + 0.5 * X + RNG.normal(size=N) * 0.4
    y = 1 / (1 + np.exp(-eta)) if name == "beta" else eta
    df = from_matrix(spark, X, y)
    est = ALM(["x1"], "y", name, inference=False)
    m = est.fit(df)
    # at the best scale for these coefficients no small move of them is better
    def best(b):
        mu = LINKS[est.link].inverse(F.lit(float(b[0])) + F.col("x1") * F.lit(float(b[1])))
        row = df.agg(*[F.sum(est.dist.loglik(F.col("y"), mu, F.lit(math.exp(s)), est.extra)) for s in np.linspace(-4, 4, 41)]).first()
        return max(v for v in row if v is not None and math.isfinite(v))

    top = best(m.b)
    assert all(best(m.b + d) <= top + 0.02 for d in ([0.05, 0], [-0.05, 0], [0, 0.05], [0, -0.05]))


def test_alm_reweighted_forms_and_losses(spark):
    y = 1 + 2 * X + RNG.normal(size=N)
    df = from_matrix(spark, X, y)
    normal = ALM(["x1"], "y").fit(df)
    assert np.allclose(normal.b, np.polyfit(X, y, 1)[::-1], atol=1e-8)
    fit = normal.b[0] + normal.b[1] * X
    assert compute_loss(df, F.col("y"), normal.predict(), "mae") == pytest.approx(abs(y - fit).mean())
    assert compute_loss(df, F.col("y"), normal.predict(), "ham") == pytest.approx(np.sqrt(abs(y - fit)).mean())
    ll = -0.5 * np.log(2 * np.pi * normal.scale**2) - (y - fit) ** 2 / (2 * normal.scale**2)
    assert normal.log_likelihood == pytest.approx(ll.sum())
    assert compute_loss(df, F.col("y"), normal.predict(), "role", "normal", normal.scale) == pytest.approx(-np.sort(ll)[5:].sum())
    assert len(DISTRIBUTIONS) == 25
    with pytest.raises(RegressionError):
        ALM(["x1"], "y", "gamma").fit(df)


def test_robust(spark):
    y = 1 + 2 * X + RNG.normal(size=N) * 0.1
    y[:10] += 30
    df = from_matrix(spark, X, y).cache()
    h = Huber(["x1"], "y").fit(df)
    assert abs(h.coefficients[0] - 2) < 0.2 and h.outliers(df).filter("outlier").count() >= 10
    r = Ransac(["x1"], "y", ["row_id"]).fit(df)
    assert abs(r.coefficients[0] - 2) < 0.1 and r.n_inliers >= 80
    t = TheilSen(["x1"], "y", ["row_id"], max_subpopulation=3000).fit(df)
    assert abs(t.coefficients[0] - 2) < 0.3
    q = Quantile(["x1"], "y", 0.5).fit(df)
    assert abs(q.coefficients[0] - 2) < 0.1
    side = (y > q.intercept + q.coefficients[0] * X + 1e-4).mean()
    assert 0.44 <= side <= 0.56
    p = PassiveAggressive(["x1"], "y", ["row_id"]).fit(df)
    assert math.isfinite(p.intercept)


def test_isotonic_equals_pooling(spark):
    x = RNG.integers(0, 30, 200)
    y = x * 0.1 + RNG.normal(size=200)
    w = RNG.uniform(0.5, 2, 200)
    df = from_matrix(spark, x, y, w)
    g = pd.DataFrame({"x": x, "wy": w * y, "w": w}).groupby("x").sum()
    want = dict(zip(g.index, pava((g["wy"] / g["w"]).to_numpy(), g["w"].to_numpy()), strict=True))
    got = Isotonic("x1", "y", "w").fit(df).transform(df, "x1").toPandas()
    assert np.allclose(got["prediction"], got["x1"].map(want))
    down = Isotonic("x1", "y", increasing=False).fit(df)
    assert (np.diff(down.y) <= 1e-12).all()


def test_quantile_and_numbers(spark):
    y = RNG.normal(size=501).round(1)
    df = from_matrix(spark, y, y)
    import sparkreg.plans.ordering as o

    few, o.FEW = o.FEW, 10
    try:
        for q in (0.0, 0.1, 0.5, 0.77, 1.0):
            assert quantile(df, F.col("y"), q) == pytest.approx(np.quantile(y, q), abs=1e-12)
    finally:
        o.FEW = few
    n = numbered(df.repartition(7), ["y", "row_id"]).toPandas().sort_values("row_number")
    assert n["row_number"].tolist() == list(range(501)) and (np.diff(n["y"]) >= 0).all()


def test_lowess_equals_nearest_neighbours(spark):
    for n, span in ((13, 0.3), (31, 0.47), (8, 1.0)):
        y = RNG.normal(size=n)
        k = min(max(math.ceil(n * span), 2), n)
        want = []
        for i in range(n):
            d = np.sort(abs(np.arange(n) - i))[k - 1]
            u = abs(np.arange(n) - i) / max(d, 1e-12)
            w = np.where(u < 1, (1 - u**3) ** 3, 0)
            want.append((w * y).sum() / w.sum() if w.sum() > 1e-10 else y[i])
        got = lowess(from_matrix(spark, y, y), "y", ["row_id"], span).toPandas().sort_values("row_id")["smoothed"]
        assert np.allclose(got, want, atol=1e-10)


def test_lm_dynamic(spark):
    rng = np.random.default_rng(8)
    n = 40
    x = rng.normal(size=(n, 2))
    y = 1 + x @ [2, 0.5] + rng.normal(size=n) * 0.3
    df = from_matrix(spark, x, y)
    m = LmDynamic(["x1", "x2"], "y", ["row_id"], span=None).fit(df)
    betas, ics = [], []
    for cols in ([0], [1], [0, 1]):
        a = np.c_[np.ones(n), x[:, cols]]
        b = np.linalg.lstsq(a, y, rcond=None)[0]
        k = a.shape[1]
        var = ((y - a @ b) ** 2).sum() / (n - k)
        ll = -0.5 * np.log(2 * np.pi * var) - (y - a @ b) ** 2 / (2 * var)
        ics.append(2 * k - 2 * ll + 2 * k * (k + 1) / (n - k - 1))
        full = np.zeros(3)
        full[[0, *[c + 1 for c in cols]]] = b
        betas.append(full)
    w = np.exp(-0.5 * (np.array(ics) - np.min(ics, axis=0)))
    w = (w / w.sum(axis=0)).T
    got = m.augment(df).toPandas().sort_values("row_id")
    assert m.model_specs == [[0], [1], [0, 1]]
    assert np.allclose(got[["w0", "w1", "w2"]], w, atol=1e-8)
    assert np.allclose(m.average, (w @ np.array(betas)).mean(axis=0), atol=1e-8)


def test_demand_classes(spark):
    rows = []
    for t in range(100):
        rows += [("counts", t, float(RNG.poisson(5))), ("sparse", t, float(RNG.poisson(1) if t % 3 == 0 else 0)), ("real", t, float(RNG.normal(100, 5)))]
        rows.append(("new", t, 0.0 if t < 15 else 5.0 + (t == 50) * 60))
        rows.append(("stock", t, 0.0 if t == 40 else 5.0))
    df = spark.createDataFrame(rows, "s string, t int, y double")
    c = {r["s"]: r for r in aid.classify(df, ["s"], "y").collect()}
    assert c["counts"]["demand_type"] == "regular" and c["counts"]["distribution"] in ("poisson", "negative_binomial", "normal")
    assert c["sparse"]["demand_type"] == "intermittent" and c["real"]["distribution"] in ("normal", "gamma", "log_normal")
    a = {r["s"]: r for r in aid.anomaly_counts(aid.anomalies(df, ["s"], "y", ["t"]), ["s"]).collect()}
    assert a["new"]["new_product"] == 15 and a["new"]["is_new_product"] and a["new"]["high_outlier"] == 1
    assert a["stock"]["stockout"] == 1


def test_streaming(spark, tmp_path):
    df = from_matrix(spark, X, 1 + 2 * X).selectExpr("row_id", "row_id % 2 AS g", "x1", "y")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_moments(stream, ["g"], ["x1"], "y").writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    from sparkreg.operators.linear import OLS

    sums = spark.table("sums")
    total = merge_moments(sums.filter("g = 0").withColumn("g", F.lit(9)), sums.filter("g = 1").withColumn("g", F.lit(9)), ["g"]).first()
    assert np.allclose(OLS(["x1"], "y").fit_moments(moments_of(total, 1)).coefficients, [2.0])
    s = RlsState(1)
    for x in X:
        s.update(np.array([x]), 1 + 2 * x)
    assert np.allclose(s.b, [1, 2], atol=1e-4)
    assert np.allclose(RlsState.load(s.dump()).b, s.b)


def test_keyed_state(spark, tmp_path):
    from sparkreg.streaming.online import streaming_pa, streaming_rls

    df = from_matrix(spark, X, 1 + 2 * X).selectExpr("row_id", "row_id % 2 AS g", "x1", "y")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for k, f in enumerate((streaming_rls, streaming_pa)):
        q = f(stream, ["g"], ["row_id"], ["x1"], "y").writeStream.format("memory").queryName(f"state{k}").start()
        q.processAllAvailable()
        q.stop()
        last = spark.table(f"state{k}").orderBy(F.desc("row_id")).first()
        assert np.allclose(last["coefficients"], [1, 2], atol=0.2)
    assert spark.table("state0").count() == N
