"""Rounds of iterative fits: their code is compiled once, and where they end is an optimum."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkreg.operators.alm import ALM
from sparkreg.operators.robust import PassiveAggressive, Quantile, pa_step


def compiled(spark) -> int:
    return spark._jvm.org.apache.spark.metrics.source.CodegenMetrics.METRIC_COMPILATION_TIME().getCount()


def series(spark, n: int, seed: int):
    k = F.xxhash64("id", F.lit(seed))
    x = spark.range(n).select(F.pmod(k, F.lit(50)).cast("double").alias("x"), (F.pmod(k, F.lit(99991)) / 1000).alias("e"))
    return x.select("x", (10 + F.col("x") * (1 + F.col("e") / 20) + F.col("e")).alias("y"))


def test_rounds_of_another_quantile_fit_compile_little(spark):
    Quantile(["x"], "y", 0.9).fit(series(spark, 5000, 1))
    before = compiled(spark)
    m = Quantile(["x"], "y", 0.9).fit(series(spark, 5000, 2))
    assert m.converged and compiled(spark) - before < 20


def test_quantile_fit_of_many_rows_is_optimal(spark):
    df = series(spark, 20000, 3)
    m = Quantile(["x"], "y", 0.9).fit(df)
    z = np.array(df.collect(), dtype=float)
    X = np.c_[np.ones(len(z)), z[:, 0]]
    r = z[:, 1] - X @ np.r_[m.intercept, m.coefficients]
    on = np.abs(r) < 1e-7
    # no way from here is downhill: slopes of the loss to all sides, rows on the line paying on either
    for angle in np.linspace(0, 2 * np.pi, 720):
        d = X @ np.array([np.cos(angle), np.sin(angle)])
        slope = np.where(r[~on] > 0, -0.9, 0.1) @ d[~on] + np.maximum(-0.9 * d[on], 0.1 * d[on]).sum()
        assert slope > -1e-6


@pytest.mark.parametrize("name", ["logistic", "student_t"])
def test_climbing_compiles_no_code_a_round(spark, name):
    ALM(["x"], "y", name, inference=False).fit(series(spark, 5000, 4))
    before = compiled(spark)
    m = ALM(["x"], "y", name, inference=False).fit(series(spark, 5000, 5))
    assert m.converged and compiled(spark) - before < 20


@pytest.mark.parametrize("variant", ["pa1", "pa2"])
def test_passive_aggressive_groups_step_together(spark, variant, monkeypatch):
    rng = np.random.default_rng(6)
    size = rng.integers(1, 40, 60)
    x, y = rng.normal(size=(size.sum(), 2)), rng.normal(size=size.sum())
    x[3] = 0.0
    start = np.r_[0, np.cumsum(size)[:-1]]
    p = PassiveAggressive(["a", "b"], "y", ["i"], variant=variant, epochs=30)
    steps = []
    one = PassiveAggressive.step
    monkeypatch.setattr(PassiveAggressive, "step", lambda self, *a: (steps.append(1), one(self, *a)))
    w, b, epochs = p.kernels(x, y, start)
    assert 0 < len(steps) <= size.max() * epochs.max()  # as of the longest group, not of their sum
    for g, (s, n) in enumerate(zip(start, size, strict=True)):
        v, c, best, stale = np.zeros(2), 0.0, np.inf, 0
        for epoch in range(1, 31):
            total = 0.0
            for i in range(s, s + n):
                v, c, loss = pa_step(v, c, x[i], y[i], 1.0, 0.1, variant)
                total += loss
            stale = 0 if total < best - 1e-3 * n else stale + 1
            best = total if not stale else best
            if stale >= 5:
                break
        assert epochs[g] == epoch and b[g] == pytest.approx(c, abs=1e-9) and w[g] == pytest.approx(v, abs=1e-9)


def test_passive_aggressive_groups_across_batches_and_null_keys(spark, monkeypatch):
    rows = [(None if k == 3 else k, i, float((i * 7 + k) % 11), float((i * 5 + k) % 13)) for k in range(30) for i in range(1 + k)]
    df = spark.createDataFrame(rows, "k long, i long, x double, y double").repartition(7)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        p = PassiveAggressive(["x"], "y", ["i"], epochs=20)
        got = {r["k"]: r for r in p.fit_by(df, ["k"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert len(got) == 30
    for k in {r[0] for r in rows}:
        z = np.array([r[2:] for r in rows if r[0] == k])
        w, b, epochs = p.kernel(z[:, :1], z[:, 1])
        assert (got[k]["epochs"], got[k]["intercept"], got[k]["coefficients"]) == (epochs, pytest.approx(b), pytest.approx(w))


def test_climbing_over_repeated_rows_counts_them(spark):
    df = series(spark, 300, 7)
    many = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(8))))
    one, all_ = (ALM(["x"], "y", "logistic", inference=False).fit(d) for d in (df, many))
    assert all_.n == 8 * one.n and all_.log_likelihood == pytest.approx(8 * one.log_likelihood, rel=1e-9)
    assert all_.b == pytest.approx(one.b, rel=1e-4) and all_.scale == pytest.approx(one.scale, rel=1e-4)
