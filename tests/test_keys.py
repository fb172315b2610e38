"""Fits by key in common steps, at levels of keys, along a sequence and by event-time window."""

import datetime as dt
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkreg.operators import linear
from sparkreg.operators.asof import asof_join
from sparkreg.operators.glm import Binomial, NegativeBinomial, Poisson
from sparkreg.operators.linear import OLS, RLS
from sparkreg.operators.robust import Isotonic
from sparkreg.plans.ordering import release
from sparkreg.streaming.online import RlsState, dropped_late, window_moments

RNG = np.random.default_rng(21)


@pytest.fixture(scope="module")
def rows(spark):
    out = []
    for key, n in (("a", 400), ("b", 60), (None, 50), ("few", 1)):
        x, z = RNG.normal(size=n), RNG.normal(size=n)
        y = RNG.poisson(np.exp(0.4 + 0.5 * x - 0.2 * z))
        out += [(key, float(u), float(v), float(w), float(w > 1), 0.1) for u, v, w in zip(x, z, y)]
    out += [("bad", 1.0, 2.0, -1.0, 7.0, 0.0), ("bad", 2.0, 1.0, 3.0, 0.0, 0.0), ("bad", 2.0, 4.0, 3.0, 1.0, 0.0), ("bad", 3.0, 4.0, 3.0, 1.0, 0.0), ("a", None, 1.0, 5.0, 1.0, 0.1)]
    return spark.createDataFrame(out, "k string, x double, z double, y double, t double, o double").repartition(5)


def test_glm_by_key_equals_single_fits(rows):
    for maker in (lambda **kw: Poisson(["x", "z"], "y", **kw), lambda **kw: Binomial(["x"], "t", **kw), lambda **kw: NegativeBinomial(["x"], "y", theta=2.0, **kw), lambda **kw: Poisson(["x"], "y", offset="o", intercept=False, **kw)):
        got = {r["k"]: r for r in maker().fit_by(rows, ["k"]).collect()}
        assert set(got) == {"a", "b", None, "few", "bad"}
        assert "InsufficientObservations" in got["few"]["error"] or maker().intercept is False or got["few"]["n"] == 1
        assert "outside the range" in got["bad"]["error"] and got["bad"]["coefficients"] is None
        for key in ("a", "b", None):
            own = rows.filter(F.col("k").eqNullSafe(F.lit(key)))
            one, r = maker().fit(own), got[key]
            b = [*([] if r["intercept"] is None else [r["intercept"]]), *r["coefficients"]]
            se = [*([] if r["intercept"] is None else [r["intercept_std_error"]]), *r["std_errors"]]
            assert r["error"] is None and r["n"] == one.n and b == pytest.approx(one.b, rel=1e-8) and se == pytest.approx(one.std_errors_all, rel=1e-6) and r["deviance"] == pytest.approx(one.deviance, rel=1e-9)
    assert Poisson(["x"], "y").fit_by(rows.filter("k = 'none'"), ["k"]).count() == 0


def test_levels_equal_fits_of_their_rows(spark):
    n = 300
    pdf = pd.DataFrame({"g": RNG.choice(["u", "v", None], n), "h": RNG.integers(0, 3, n), "x": RNG.normal(size=n) + 1e5})
    pdf["y"] = 2 * pdf["x"] + RNG.normal(size=n)
    df = spark.createDataFrame(pdf)
    got = OLS(["x"], "y").fit_sets(df, [["g", "h"], ["g"], ["h"], []]).toPandas()
    assert len(got) == 9 + 3 + 3 + 1 and sorted(got["grouping"].unique()) == [0, 1, 2, 3]
    for r in got.itertuples():
        own = pdf
        if not r.grouping & 2:
            own = own[own["g"].isna() if pd.isna(r.g) else own["g"] == r.g]
        if not r.grouping & 1:
            own = own[own["h"] == r.h]
        slope, level = np.polyfit(own["x"] - 1e5, own["y"], 1)
        assert r.n_observations == len(own) and r.coefficients[0] == pytest.approx(slope, rel=1e-7) and r.intercept + r.coefficients[0] * 1e5 == pytest.approx(level, rel=1e-9)


@pytest.mark.parametrize("forgetting", [1.0, 0.95])
def test_path_equals_updates_in_turn(spark, monkeypatch, forgetting):
    n = 700
    x, z = RNG.normal(size=n), RNG.normal(size=n)
    y = 1 + 2 * x - z + np.linspace(0, 3, n) + RNG.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(n), "x": x, "z": z, "y": y})).repartition(6)
    monkeypatch.setattr(linear, "PATH_BLOCK", 128)
    p = RLS(["x", "z"], "y", ["t"], forgetting=forgetting).path(df)
    got = p.toPandas().sort_values("t")
    release(p)
    a, r, before, after = np.eye(3) / 1e6, np.zeros(3), [], []
    for u, v, w in zip(x, z, y):
        row = np.array([1.0, u, v])
        before.append(row @ np.linalg.solve(a, r))
        a, r = forgetting * a + np.outer(row, row), forgetting * r + row * w
        after.append(np.linalg.solve(a, r))
    s = RlsState(2)
    first = [s.update(np.array([u, v]), w, forgetting) for u, v, w in zip(x[:100], z, y)]
    assert before[:100] == pytest.approx(first, rel=1e-4, abs=1e-4)
    assert got["prediction"].to_numpy() == pytest.approx(np.array(before), rel=1e-6, abs=1e-6)
    assert np.stack(got["prediction_coefficients"])[50:] == pytest.approx(np.array(after)[50:], rel=1e-6, abs=1e-7)
    assert got["prediction_error"].to_numpy() == pytest.approx(y - got["prediction"].to_numpy())
    assert RLS(["x"], "y", ["t"], forgetting=forgetting).path(df.filter("t < 0")).count() == 0


def test_windows_close_by_watermark_and_late_rows_are_counted(spark, tmp_path):
    at = lambda day, hour=0: dt.datetime(2024, 1, day, hour)
    batches = [[(at(1), 1.0), (at(1, 5), 2.0), (at(2), 3.0)], [(at(9), 4.0)], [(at(1, 7), 100.0), (at(9, 1), 5.0), (at(20), 6.0)]]
    source, name = str(tmp_path / "in"), "w_" + uuid.uuid4().hex
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("ts timestamp, v double").parquet(source).withColumn("y", F.lit(1.0))
    q = window_moments(stream, "ts", "1 day", ["v"], "y", "2 days").writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for rows_ in batches:
            spark.createDataFrame(rows_, "ts timestamp, v double").coalesce(1).write.mode("append").parquet(source)
            q.processAllAvailable()
        found = {r["start"]: (r["_n"], r["_s0"]) for r in spark.table(name).collect()}
        assert found == {at(1): (2, 3.0), at(2): (1, 3.0), at(9): (2, 9.0)} and dropped_late(q) == 1
    finally:
        q.stop()
        spark.catalog.dropTempView(name)


def test_asof_join_equals_a_search(spark):
    left = [(int(k), float(t), f"r{i}") for i, (k, t) in enumerate(zip(RNG.choice([1, 1, 1, 2, 3], 400), RNG.integers(0, 60, 400)))] + [(None, 5.0, "x"), (1, None, "y"), (9, 5.0, "z")]
    right = [(int(k), float(t), float(v)) for k, t, v in zip(RNG.choice([1, 1, 2, 4], 120), RNG.integers(5, 60, 120), RNG.normal(size=120))] + [(None, 1.0, 7.0), (1, None, 8.0)]
    a, b = spark.createDataFrame(left, "k int, t double, name string"), spark.createDataFrame(right, "k int, t double, v double")
    out = asof_join(a.repartition(4), b.repartition(3), "t", ["v"], ["k"])
    got = {r["name"]: r["v"] for r in out.collect()}
    release(out)
    want = {n: max(((u, v) for j, u, v in right if j == k and u is not None and u <= t), default=(0, None))[1] if k is not None and t is not None else None for k, t, n in left}
    assert got == want and sum(v is not None for v in want.values()) > 100
    plain = asof_join(a.filter("k = 1"), b.filter("k = 2").drop("k"), "t", ["v"])
    assert plain.filter("v is not null").count() > 0 and asof_join(a, b.filter("k = 99"), "t", ["v"], ["k"]).filter("v is not null").count() == 0


def test_isotonic_steps_by_join(spark):
    x = RNG.integers(0, 40, 300).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": x / 10 + RNG.normal(size=300)}))
    more = spark.createDataFrame([(v, str(v)) for v in (-3.0, 0.0, 7.5, 39.0, 99.0, None, float("nan"))], "x double, s string")
    for bounds in ("clip", "nan"):
        m = Isotonic("x", "y", out_of_bounds=bounds).fit(df)
        a = {r["s"]: r["p"] for r in m.transform(more, "x", "p").collect()}
        b = {r["s"]: r["p"] for r in m.steps(more, "x", "p").collect()}
        assert {k: str(v) for k, v in a.items()} == {k: str(v) for k, v in b.items()}
