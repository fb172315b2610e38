"""Tall-skinny QR, local smoothing, fits that advance together, losses: against dense computations."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkreg.errors import AllNa, RegressionError
from sparkreg.operators import diagnostics as dg
from sparkreg.operators import smoothing
from sparkreg.operators.alm import ALM, SCORES, DISTRIBUTIONS, compute_loss
from sparkreg.operators.glm import Binomial, Gamma, NegativeBinomial, Poisson
from sparkreg.operators.linear import OLS, is_full_rank
from sparkreg.operators.robust import Huber, Quantile
from sparkreg.operators.smoothing import lowess, smooth
from sparkreg.plans.many import fit_together
from sparkreg.plans.qr import r_factor

RNG = np.random.default_rng(11)


def frame(spark, parts=5, **columns):
    return spark.createDataFrame(pd.DataFrame(columns)).repartition(parts)


# QR


def test_triangle_equals_dense(spark):
    x = RNG.normal(size=(500, 6))
    r = r_factor(frame(spark, 7, **{f"c{j}": x[:, j] for j in range(6)}), [F.col(f"c{j}") for j in range(6)])
    assert np.allclose(r.T @ r, x.T @ x, rtol=1e-12) and np.allclose(np.tril(r, -1), 0) and (np.diag(r) > 0).all()
    few = frame(spark, 3, a=[1.0, 2.0], b=[3.0, 4.0], c=[5.0, 6.0])
    assert r_factor(few, [F.col(c) for c in "abc"]).shape == (3, 3)
    assert (r_factor(few.filter("a > 9"), [F.col("a")]) == 0).all()


@pytest.mark.parametrize("far", [10**3, 10**6, 10**10, 3 * 10**12])
def test_condition_number_is_exact(spark, far):
    a = RNG.integers(1, 50, 400)
    e = RNG.integers(-9, 10, 400)
    x, y = [int(v) * far for v in a], [int(v) * far + int(w) for v, w in zip(a, e)]
    aa, ab, bb = (sum(u * v for u, v in zip(p, q)) for p, q in ((x, x), (x, y), (y, y)))
    det = sum(int(v) ** 2 for v in a) * sum(int(w) ** 2 for w in e) - sum(int(v) * int(w) for v, w in zip(a, e)) ** 2
    top = (aa + bb + math.sqrt((aa - bb) ** 2 + 4 * ab * ab)) / 2
    want = top / (math.sqrt(det) * far)
    df = frame(spark, a=np.array(x, float), b=np.array(y, float))
    assert dg.condition_number(df, ["a", "b"], intercept=False) == pytest.approx(want, rel=1e-6)


def test_rank_and_aliased_columns(spark):
    x, e = RNG.normal(size=300) * 1e3, RNG.normal(size=300)
    df = frame(spark, a=x, near=x + 1e-5 * e, same=2 * x, sum=x + e, e=e, y=3 + x + 2e5 * (1e-5 * e))
    assert is_full_rank(df, ["a", "near"]) and is_full_rank(df, ["a", "e"])
    assert not is_full_rank(df, ["a", "same"]) and not is_full_rank(df, ["a", "e", "sum"])
    m = OLS(["a", "near"], "y").fit(df)
    dense = np.linalg.lstsq(np.column_stack([np.ones(300), x, x + 1e-5 * e]), 3 + x + 2e5 * (1e-5 * e), rcond=None)[0]
    assert not np.isnan(m.coefficients).any() and m.coefficients == pytest.approx(dense[1:], rel=1e-4) and m.coefficients[1] == pytest.approx(2e5, rel=1e-5)
    alias = OLS(["a", "e", "sum"], "y").fit(df)
    assert np.isnan(alias.coefficients).sum() == 1 and alias.fit.n_parameters == 3
    least = OLS(["a", "e", "sum"], "y", solver="svd").fit(df)
    c = np.column_stack([x, e, x + e])
    y = 3 + x + 2e5 * (1e-5 * e)
    assert least.coefficients == pytest.approx(np.linalg.pinv(c - c.mean(0)) @ (y - y.mean()), rel=1e-6)


def test_sparsity_is_of_the_response(spark):
    flag = np.r_[np.ones(50), np.zeros(50)]
    sparse, usual = np.r_[np.zeros(96), np.ones(4)], np.r_[np.zeros(5), np.ones(95)]
    df = frame(spark, flag=flag, few=np.r_[np.ones(5), np.zeros(95)], wide=np.arange(100.0), none=np.zeros(100), sparse=sparse, usual=usual)
    assert dg.check_count_sparsity(df, ["flag", "few", "wide", "none"], "sparse") == {"flag": True, "few": True, "wide": False, "none": False}
    assert not any(dg.check_count_sparsity(df, ["flag", "few"], "usual").values())


# smoothing


def nearest(y, span):
    n = len(y)
    k = min(max(math.ceil(n * min(max(span, 0), 1)), 2), n)
    out = []
    for i in range(n):
        d = np.abs(np.arange(n) - i)
        h = np.sort(d)[k - 1]
        w = np.where(d < h, (1 - (d / max(h, 1)) ** 3) ** 3, 0) if h else (d == 0).astype(float)
        out.append((w * y).sum() / w.sum())
    return np.array(out)


@pytest.mark.parametrize("n,span", [(11, 0.3), (13, 0.37), (1, 0.5), (2, 0.9), (40, 1.7), (97, 0.21), (230, 0.004), (333, 0.5)])
def test_lowess_kernel_equals_nearest_neighbours(n, span):
    y = RNG.normal(size=n) + 100
    k = smoothing.lowess_span(n, span)
    assert smooth(y, 0, n, k, 0, n) == pytest.approx(nearest(y, span), rel=1e-11)


def test_lowess_in_tiles_and_joined(spark, monkeypatch):
    y = RNG.normal(size=157)
    df = spark.createDataFrame([(k // 100, k % 100, float(v)) for k, v in enumerate(y)], "s int, t int, v double").repartition(4)
    want = np.r_[nearest(y[:100], 0.23), nearest(y[100:], 0.23)]
    for near, tile, numbered in ((1 << 18, 7, 1 << 17), (3, 7, 1 << 17), (1 << 18, 16, 10), (3, 7, 10)):
        for name, value in (("NEAR", near), ("TILE", tile), ("NUMBERED", numbered)):
            monkeypatch.setattr(smoothing, name, value)
        got = lowess(df, "v", ["t"], 0.23, keys=["s"]).toPandas().sort_values(["s", "t"])
        assert got["smoothed"].to_numpy() == pytest.approx(want, rel=1e-9, abs=1e-11)
    gap = df.withColumn("v", F.when((F.col("s") == 1) & (F.col("t") == 30), None).otherwise(F.col("v")))
    for near in (1 << 18, 3):
        monkeypatch.setattr(smoothing, "NEAR", near)
        got = lowess(gap, "v", ["t"], 0.23, keys=["s"]).toPandas().sort_values(["s", "t"])["smoothed"].to_numpy()
        lost = np.isnan(got)
        assert lost.any() and not lost[:100].any() and got[~lost] == pytest.approx(want[~lost], rel=1e-9, abs=1e-11)
    assert lowess(df.filter("s > 5"), "v", ["t"]).count() == 0


def test_lowess_of_a_long_series_takes_several_tasks(spark):
    n = 200_000
    df = spark.range(n).select(F.col("id").alias("t"), (F.sin(F.col("id") / 5000) + F.rand(3)).alias("v")).repartition(4)
    x = df.toPandas().sort_values("t")["v"].to_numpy()
    got = lowess(df, "v", ["t"], 0.1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these rows are few for a task
    tasks = got.select(F.spark_partition_id().alias("p")).distinct().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    values = got.toPandas().sort_values("t")["smoothed"].to_numpy()
    assert tasks > 1 and values == pytest.approx(smooth(x, 0, n, 20_000, 0, n), rel=1e-10)
    i = 77_777
    d = np.abs(np.arange(n) - i) / 10_000
    w = np.where(d < 1, (1 - d**3) ** 3, 0)
    assert values[i] == pytest.approx((w * x).sum() / w.sum(), rel=1e-9)


# fits together


def test_fits_advance_together(spark):
    x = RNG.normal(size=400)
    count = RNG.poisson(np.exp(0.5 + 0.4 * x)).astype(float)
    flag = (RNG.random(400) < 1 / (1 + np.exp(-x))).astype(float)
    level = np.where(RNG.random(400) < 0.1, np.nan, 3 + x + RNG.normal(size=400))
    df = frame(spark, x=x, count=count, flag=flag, level=level, positive=np.exp(1 + 0.2 * x))
    makers = [lambda: Poisson(["x"], "count"), lambda: Binomial(["x"], "flag"), lambda: Gamma(["x"], "positive"), lambda: NegativeBinomial(["x"], "count", theta=2.0), lambda: Huber(["x"], "level"), lambda: Quantile(["x"], "level", 0.3), lambda: ALM(["x"], "level", "student_t")]
    jobs = spark.sparkContext._jsc.sc().dagScheduler()
    before = jobs.numTotalJobs()
    alone = [m().fit(df) for m in makers[:4]]
    middle = jobs.numTotalJobs()
    some = fit_together(df, [m() for m in makers[:4]])
    assert jobs.numTotalJobs() - middle < 0.5 * (middle - before)
    for a, b in zip(alone, some):
        assert a.b == pytest.approx(b.b, rel=1e-9) and a.n == b.n
    both = fit_together(df, [m() for m in makers])
    assert [m.n for m in both] == [400] * 4 + [int(np.isfinite(level).sum())] * 3
    assert both[4].coefficients == pytest.approx(makers[4]().fit(df).coefficients, rel=1e-6)
    wrong = fit_together(df, [Poisson(["x"], "count"), Binomial(["x"], "count")], keep_errors=True)
    assert wrong[0].b == pytest.approx(alone[0].b) and isinstance(wrong[1], RegressionError)
    none = frame(spark, x=[1.0, 2.0], y=[math.nan, math.nan])
    for e in (Poisson(["x"], "y"), Huber(["x"], "y"), ALM(["x"], "y")):
        with pytest.raises(AllNa):
            e.fit(none)


def test_scores_are_derivatives(spark):
    y = {"unit": 0.37, "binary": 1.0, "share": 0.4, "any": 2.2, "positive": 2.2, "nonnegative": 3.0}
    columns, names = [], []
    for name, d in DISTRIBUTIONS.items():
        yy, m, s, h = F.lit(y[d.need]), 0.3 if d.need in ("unit", "binary", "share") else 1.7, 1.3, 1e-5
        at = lambda dm, ds: d.loglik(yy, F.lit(m + dm), F.lit(s * math.exp(ds)), d.extra)
        by_mu, by_scale = SCORES[name](yy, F.lit(m), F.lit(s), d.extra)
        columns += [(at(h, 0) - at(-h, 0)) / (2 * h), by_mu]
        names.append(name)
        if d.scaled:
            columns += [(at(0, h) - at(0, -h)) / (2 * h), by_scale]
            names.append(name + " scale")
    got = list(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())
    for k, name in enumerate(names):
        assert got[2 * k + 1] == pytest.approx(got[2 * k], rel=2e-4, abs=1e-6), name


def test_losses_end_fits(spark):
    x = RNG.normal(size=300)
    y = RNG.poisson(np.exp(1 + 0.8 * x)).astype(float)
    df = frame(spark, x=x, y=y)
    full = ALM(["x"], "y", "poisson").fit(df)
    steps = {}
    for loss in ("mse", "mae", "ham", "role"):
        loose = ALM(["x"], "y", "poisson", loss=loss, trim=0.1, tol=1e-2).fit(df)
        tight = ALM(["x"], "y", "poisson", loss=loss, trim=0.1, tol=1e-12).fit(df)
        assert tight.b == pytest.approx(full.b, rel=1e-6)
        steps[loss] = abs(loose.b - full.b).max()
    assert max(steps.values()) > 1e-9 and len({round(v, 12) for v in steps.values()}) > 1
    pdf = df.toPandas()
    mu = np.exp(full.b[0] + full.b[1] * pdf["x"])
    ll = pdf["y"] * np.log(mu) - mu - pdf["y"].map(lambda v: math.lgamma(v + 1))
    want = -np.sort(ll)[math.ceil(300 * 0.1) :].sum()
    assert compute_loss(df, F.col("y"), full.predict(), "role", "poisson", trim=0.1) == pytest.approx(want, rel=1e-9)


def test_sums_of_roots_end_at_a_line_through_rows(spark):
    x = np.repeat(np.arange(20.0), 10)
    y = np.where(RNG.random(200) < 0.6, 2 + 3 * x, RNG.normal(size=200) * 40)
    m = ALM(["x"], "y", "s").fit(frame(spark, x=x, y=y))
    assert m.b == pytest.approx([2, 3], abs=1e-9) and m.scale == pytest.approx(np.sqrt(abs(y - 2 - 3 * x)).mean() / 2, rel=1e-9)
