"""Registered queries over the driver's tables, and the same results as plain SQL."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import na
from .functions import metrics
from .operators import aid
from .operators import diagnostics as dg
from .operators.alm import ALM
from .operators.asof import asof_join
from .operators.base import score_by
from .operators.glm import Binomial, Gamma, Logistic, NegativeBinomial, Poisson, Tweedie
from .operators.alm import DISTRIBUTIONS, compute_loss
from .operators.linear import OLS, RLS, WLS, Ridge, center_columns, detect_constant_columns, is_full_rank
from .operators.lm_dynamic import LmDynamic
from .operators.robust import Huber, Isotonic, PassiveAggressive, Quantile, Ransac, TheilSen
from .operators.smoothing import lowess, lowess_weights
from .operators.shrinkage import ARD, BLS, LARS, NNLS, PLS, BayesianRidge, ElasticNet, Lasso, LassoLars, PSpline
from .plans.many import fit_together
from .plans.moments import grouped_moments, moments
from .plans.ordering import quantiles, release
from .sources.io import from_vectors, table
from .streaming.online import streaming_moments, window_moments

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
Y, X1, X2 = "l_extendedprice", "l_quantity", "l_discount"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def lineitem(spark: SparkSession, d: str) -> DataFrame:
    """Numeric columns and a binary covariate r (returned)."""
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_returnflag") == "R").cast("double").alias("r"),
    )


def rows(spark: SparkSession, schema: str, data: list[tuple]) -> DataFrame:
    clean = [tuple(v.item() if isinstance(v, np.generic) else v for v in row) for row in data]
    df = spark.createDataFrame(clean, schema)
    return df.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.simpleString() == "double" else f.name for f in df.schema])


# moments of (quantity, discount; price) as SQL
_M = """
m AS (SELECT count(*) AS n, avg(l_quantity) AS x1, avg(l_discount) AS x2, avg(l_extendedprice) AS y,
  covar_pop(l_quantity, l_quantity) * count(*) AS s11, covar_pop(l_quantity, l_discount) * count(*) AS s12,
  covar_pop(l_discount, l_discount) * count(*) AS s22, covar_pop(l_quantity, l_extendedprice) * count(*) AS s1y,
  covar_pop(l_discount, l_extendedprice) * count(*) AS s2y, covar_pop(l_extendedprice, l_extendedprice) * count(*) AS syy FROM lineitem)
"""
_B = """
b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM m),
f AS (SELECT *, y - b1 * x1 - b2 * x2 AS a, syy - b1 * s1y - b2 * s2y AS rss FROM b)
"""


@query(
    "WITH " + _M.replace("FROM lineitem", ", l_returnflag FROM lineitem GROUP BY l_returnflag") + "," + _B + """
SELECT l_returnflag, n AS n_observations, round(a, 6) AS intercept, round(b1, 6) AS b_quantity, round(b2, 6) AS b_discount,
  round(1 - rss / syy, 6) AS r_squared, round(sqrt(rss / (n - 3) * s22 / (s11 * s22 - s12 * s12)), 6) AS se_quantity FROM f"""
)
def ols_by_flag(spark, d):
    out = OLS([X1, X2], Y).fit_by(lineitem(spark, d), ["l_returnflag"])
    c, s = F.col("coefficients"), F.col("std_errors")
    return out.select(
        "l_returnflag", "n_observations", F.round("intercept", 6).alias("intercept"), F.round(c[0], 6).alias("b_quantity"), F.round(c[1], 6).alias("b_discount"),
        F.round("r_squared", 6).alias("r_squared"), F.round(s[0], 6).alias("se_quantity"),
    )


@query(
    "WITH " + _M + "," + _B + """, s AS (SELECT *, rss / (n - 3) AS mse, -n / 2.0 * (1 + ln(2 * pi()) + ln(rss / (n - 3))) AS ll FROM f)
SELECT round(a, 6) AS intercept, round(b1, 6) AS b1, round(b2, 6) AS b2, round(1 - rss / syy, 6) AS r_squared,
  round(1 - rss / syy * (n - 1) / (n - 3), 6) AS adj_r_squared, round(sqrt(mse), 5) AS rmse, round((syy - rss) / 2 / mse, 4) AS f_statistic,
  round(6 - 2 * ll, 4) AS aic, round(3 * ln(n) - 2 * ll, 4) AS bic, round(b1 / sqrt(mse * s22 / (s11 * s22 - s12 * s12)), 6) AS t1 FROM s"""
)
def ols_statistics(spark, d):
    m = OLS([X1, X2], Y).fit(lineitem(spark, d))
    r = lambda v, k: round(float(v), k)
    return spark.createDataFrame(
        [(r(m.intercept, 6), r(m.coefficients[0], 6), r(m.coefficients[1], 6), r(m.r_squared, 6), r(m.adj_r_squared, 6), r(m.rmse, 5), r(m.f_statistic, 4), r(m.aic, 4), r(m.bic, 4), r(m.t_statistics[0], 6))],
        "intercept double, b1 double, b2 double, r_squared double, adj_r_squared double, rmse double, f_statistic double, aic double, bic double, t1 double",
    )


@query(
    """SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS x_mean, round(avg(l_extendedprice), 5) AS y_mean,
  round(var_samp(l_quantity), 6) AS x_var, round(covar_samp(l_quantity, l_extendedprice), 3) AS xy_cov FROM lineitem GROUP BY l_returnflag"""
)
def moments_by_flag(spark, d):
    sums, shift = grouped_moments(lineitem(spark, d), ["l_returnflag"], [X1], Y)
    n = F.col("_n")
    return sums.select(
        "l_returnflag", n.alias("n"), F.round(F.col("_s0") / n + F.lit(float(shift[0])), 6).alias("x_mean"), F.round(F.col("_s1") / n + F.lit(float(shift[1])), 5).alias("y_mean"),
        F.round((F.col("_q0_0") - F.col("_s0") ** 2 / n) / (n - 1), 6).alias("x_var"), F.round((F.col("_q0_1") - F.col("_s0") * F.col("_s1") / n) / (n - 1), 3).alias("xy_cov"),
    )


@query("SELECT count(*) AS n, round(avg(l_quantity), 6) AS x_mean, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope FROM lineitem")
def moments_merged(spark, d):
    x = lineitem(spark, d)
    a = moments(x.filter("l_returnflag = 'R'"), [X1], Y)
    b = moments(x.filter("l_returnflag <> 'R'"), [X1], Y)
    m = a.merge(b)
    fit = OLS([X1], Y).fit_moments(m)
    return rows(spark, "n long, x_mean double, slope double", [(m.n, m.means()[0][0], fit.coefficients[0])])


@query(
    """WITH m AS (SELECT sum(l_quantity) AS w, sum(l_quantity * l_discount) / sum(l_quantity) AS x, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS y FROM lineitem),
s AS (SELECT sum(l_quantity * (l_discount - x) * (l_extendedprice - y)) / sum(l_quantity * (l_discount - x) * (l_discount - x)) AS b, any_value(x) AS x, any_value(y) AS y FROM lineitem, m)
SELECT round(y - b * x, 5) AS intercept, round(b, 5) AS slope FROM s"""
)
def wls_discount(spark, d):
    m = WLS([X2], Y, X1).fit(lineitem(spark, d))
    return spark.createDataFrame([(round(m.intercept, 5), round(float(m.coefficients[0]), 5))], "intercept double, slope double")


@query(
    "WITH " + _M + """, b AS (SELECT *, s11 + 50 AS p, s22 + 50 AS q FROM m)
SELECT round((s1y * q - s2y * s12) / (p * q - s12 * s12), 6) AS b1, round((s2y * p - s1y * s12) / (p * q - s12 * s12), 6) AS b2 FROM b"""
)
def ridge_two(spark, d):
    m = Ridge([X1, X2], Y, lam=50.0).fit(lineitem(spark, d))
    return rows(spark, "b1 double, b2 double", [tuple(m.coefficients)])


@query(
    """WITH m AS (SELECT covar_pop(l_quantity, l_quantity) * count(*) AS sxx, covar_pop(l_quantity, l_extendedprice) * count(*) AS sxy FROM lineitem)
SELECT 'elastic_net' AS model, round((abs(sxy) - 500000) / (sxx + 1000000) * sign(sxy), 6) AS slope FROM m UNION ALL
SELECT 'lasso', round((abs(sxy) - 1000000) / sxx * sign(sxy), 6) FROM m UNION ALL
SELECT 'lasso_lars', round((abs(sxy) - 1000000) / sxx * sign(sxy), 6) FROM m UNION ALL
SELECT 'bounded', round(least(100, greatest(0, sxy / sxx)), 6) FROM m"""
)
def penalised_slopes(spark, d):
    x = lineitem(spark, d)
    m = moments(x, [X1], Y)
    models = {
        "elastic_net": ElasticNet([X1], Y, 2e6, 0.5), "lasso": Lasso([X1], Y, 2e6), "lasso_lars": LassoLars([X1], Y, alpha_stop=1e6),
        "bounded": BLS([X1], Y, 0.0, 100.0),
    }
    return rows(spark, "model string, slope double", [(k, e.fit_moments(m).coefficients[0]) for k, e in models.items()])


@query(
    "WITH " + _M + "," + _B + """, w AS (SELECT *, (s1y * s1y + s2y * s2y) / (s1y * s1y * s11 + 2 * s1y * s2y * s12 + s2y * s2y * s22) AS k FROM f)
SELECT 'lars' AS model, round(b1, 5) AS b1, round(b2, 5) AS b2 FROM w UNION ALL SELECT 'pls2', round(b1, 5), round(b2, 5) FROM w UNION ALL
SELECT 'pls1', round(s1y * k, 5), round(s2y * k, 5) FROM w"""
)
def path_models(spark, d):
    m = moments(lineitem(spark, d), [X1, X2], Y)
    models = {"lars": LARS([X1, X2], Y), "pls2": PLS([X1, X2], Y, 2), "pls1": PLS([X1, X2], Y, 1)}
    data = [(k, *(round(float(v), 5) for v in e.fit_moments(m).coefficients)) for k, e in models.items()]
    return spark.createDataFrame(data, "model string, b1 double, b2 double")


@query(
    """WITH g AS (SELECT sum(l_quantity * l_quantity) AS a, sum(l_quantity * l_tax) AS b, sum(l_tax * l_tax) AS c,
  sum(l_quantity * l_extendedprice) AS u, sum(l_tax * l_extendedprice) AS v FROM lineitem),
s AS (SELECT *, (u * c - v * b) / (a * c - b * b) AS x, (v * a - u * b) / (a * c - b * b) AS y FROM g)
SELECT round(CASE WHEN x >= 0 AND y >= 0 THEN x WHEN y < 0 THEN u / a ELSE 0 END, 5) AS b1,
  round(CASE WHEN x >= 0 AND y >= 0 THEN y WHEN x < 0 THEN v / c ELSE 0 END, 4) AS b2 FROM s"""
)
def nnls_two(spark, d):
    b = NNLS([X1, "l_tax"], Y).fit(lineitem(spark, d)).coefficients
    return spark.createDataFrame([(round(float(b[0]), 5), round(float(b[1]), 4))], "b1 double, b2 double")


@query(
    """WITH g AS (SELECT count(*) + 1e-6 AS n, sum(l_quantity) AS x, sum(l_quantity * l_quantity) + 1e-6 AS xx, sum(l_extendedprice) AS y, sum(l_quantity * l_extendedprice) AS xy FROM lineitem)
SELECT round((y * xx - x * xy) / (n * xx - x * x), 5) AS intercept, round((n * xy - x * y) / (n * xx - x * x), 5) AS slope FROM g"""
)
def rls_all_rows(spark, d):
    m = RLS([X1], Y, ["l_orderkey", "l_linenumber"], forgetting=1.0).fit(lineitem(spark, d))
    return spark.createDataFrame([(round(m.intercept, 5), round(float(m.coefficients[0]), 5))], "intercept double, slope double")


@query(
    """WITH w AS (SELECT pow(0.99, row_number() OVER (ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC) - 1) AS w, l_quantity AS x, l_extendedprice AS y FROM lineitem),
g AS (SELECT sum(w) AS n, sum(w * x) AS x, sum(w * x * x) AS xx, sum(w * y) AS y, sum(w * x * y) AS xy FROM w)
SELECT round((y * xx - x * xy) / (n * xx - x * x), 6) AS intercept, round((n * xy - x * y) / (n * xx - x * x), 6) AS slope FROM g"""
)
def rls_forgetting(spark, d):
    m = RLS([X1], Y, ["l_orderkey", "l_linenumber", Y, X1], forgetting=0.99).fit(lineitem(spark, d))
    return rows(spark, "intercept double, slope double", [(m.intercept, m.coefficients[0])])


_G = "g AS (SELECT avg(CASE WHEN l_returnflag = 'R' THEN v END) AS m1, avg(CASE WHEN l_returnflag <> 'R' THEN v END) AS m0 FROM (SELECT l_returnflag, {} AS v FROM lineitem))"


@query(
    "WITH p AS (WITH " + _G.format("l_linenumber") + " SELECT * FROM g), q AS (WITH " + _G.format("l_extendedprice") + " SELECT * FROM g), b AS (WITH "
    + _G.format("CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.0 END") + """ SELECT * FROM g)
SELECT 'poisson' AS family, round(ln(m0), 5) AS intercept, round(ln(m1 / m0), 5) AS slope FROM p UNION ALL
SELECT 'poisson_sqrt', round(sqrt(m0), 5), round(sqrt(m1) - sqrt(m0), 5) FROM p UNION ALL
SELECT 'poisson_identity', round(m0, 5), round(m1 - m0, 5) FROM p UNION ALL
SELECT 'negative_binomial', round(ln(m0), 5), round(ln(m1 / m0), 5) FROM p UNION ALL
SELECT 'tweedie', round(ln(m0), 5), round(ln(m1 / m0), 5) FROM p UNION ALL
SELECT 'gamma', round(ln(m0), 5), round(ln(m1 / m0), 5) FROM q UNION ALL
SELECT 'logit', round(ln(m0 / (1 - m0)), 5), round(ln(m1 / (1 - m1)) - ln(m0 / (1 - m0)), 5) FROM b UNION ALL
SELECT 'cloglog', round(ln(-ln(1 - m0)), 5), round(ln(-ln(1 - m1)) - ln(-ln(1 - m0)), 5) FROM b"""
)
def glm_families(spark, d):
    x = lineitem(spark, d).withColumn("k", F.col("l_linenumber").cast("double")).withColumn("t", (F.col("l_tax") > 0.04).cast("double"))
    models = {
        "poisson": Poisson(["r"], "k"), "poisson_sqrt": Poisson(["r"], "k", "sqrt"), "poisson_identity": Poisson(["r"], "k", "identity"),
        "negative_binomial": NegativeBinomial(["r"], "k", theta=3.0), "tweedie": Tweedie(["r"], "k", 1.5, 0.0), "gamma": Gamma(["r"], Y),
        "logit": Binomial(["r"], "t"), "cloglog": Binomial(["r"], "t", "cloglog"),
    }
    fits = zip(models, fit_together(x, list(models.values())), strict=True)
    data = [(name, round(float(m.b[0]), 5), round(float(m.b[1]), 5)) for name, m in fits]
    return spark.createDataFrame(data, "family string, intercept double, slope double")


@query(
    """WITH g AS (SELECT avg(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS m1, avg(CASE WHEN l_returnflag <> 'R' THEN l_linenumber END) AS m0 FROM lineitem),
x AS (SELECT CAST(l_linenumber AS DOUBLE) AS y, CASE WHEN l_returnflag = 'R' THEN m1 ELSE m0 END AS m FROM lineitem, g)
SELECT round(sum((y - m) * (y - m) / m), 3) AS pearson_chi2, round(sum(2 * (y * ln(y / m) - (y - m))), 3) AS deviance, count(*) AS n FROM x"""
)
def glm_residuals(spark, d):
    x = lineitem(spark, d).withColumn("k", F.col("l_linenumber").cast("double"))
    m = Poisson(["r"], "k").fit(x)
    a = m.augment(x)
    return a.agg(F.round(F.sum(F.col("pearson_residual") ** 2), 3).alias("pearson_chi2"), F.round(F.sum(F.col("deviance_residual") ** 2), 3).alias("deviance"), F.count("*").alias("n"))


@query(
    """WITH g AS (SELECT avg(CASE WHEN l_returnflag = 'R' THEN t END) AS p1, avg(CASE WHEN l_returnflag <> 'R' THEN t END) AS p0 FROM (SELECT l_returnflag, CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.0 END AS t FROM lineitem))
SELECT round(avg(CASE WHEN (CASE WHEN l_returnflag = 'R' THEN p1 ELSE p0 END >= 0.5) = (l_tax > 0.04) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM lineitem, g"""
)
def logistic_accuracy(spark, d):
    x = lineitem(spark, d).withColumn("t", (F.col("l_tax") > 0.04).cast("double"))
    return rows(spark, "accuracy double", [(Logistic(["r"], "t").fit(x).score(x),)])


@query(
    """WITH x AS (SELECT l_quantity AS x, l_extendedprice AS y, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS r, CAST(l_linenumber - 1 AS DOUBLE) AS k, l_discount * 5 + 0.1 AS u FROM lineitem),
n AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM x), l AS (SELECT regr_slope(ln(y), x) AS b, regr_intercept(ln(y), x) AS a FROM x),
t AS (SELECT regr_slope(ln(u / (1 - u)), x) AS b, regr_intercept(ln(u / (1 - u)), x) AS a FROM x),
c AS (SELECT avg(CASE WHEN r = 1 THEN k END) AS m1, avg(CASE WHEN r = 0 THEN k END) AS m0 FROM x),
e AS (SELECT avg(CASE WHEN r = 1 THEN y END) AS m1, avg(CASE WHEN r = 0 THEN y END) AS m0 FROM x)
SELECT 'normal' AS distribution, round(a, 4) AS intercept, round(b, 5) AS slope FROM n UNION ALL SELECT 'log_normal', round(a, 4), round(b, 5) FROM l UNION ALL
SELECT 'logit_normal', round(a, 4), round(b, 5) FROM t UNION ALL SELECT 'poisson', round(ln(m0), 4), round(ln(m1 / m0), 5) FROM c UNION ALL
SELECT 'geometric', round(ln(m0), 4), round(ln(m1 / m0), 5) FROM c UNION ALL SELECT 'negative_binomial', round(ln(m0), 4), round(ln(m1 / m0), 5) FROM c UNION ALL
SELECT 'exponential', round(ln(m0), 4), round(ln(m1 / m0), 5) FROM e UNION ALL SELECT 'gamma', round(ln(m0), 4), round(ln(m1 / m0), 5) FROM e UNION ALL
SELECT 'inverse_gaussian', round(ln(m0), 4), round(ln(m1 / m0), 5) FROM e"""
)
def alm_closed_forms(spark, d):
    x = lineitem(spark, d).withColumn("k", (F.col("l_linenumber") - 1).cast("double")).withColumn("u", F.col("l_discount") * 5 + 0.1)
    models = (
        ("normal", X1, Y), ("log_normal", X1, Y), ("logit_normal", X1, "u"), ("poisson", "r", "k"), ("geometric", "r", "k"), ("negative_binomial", "r", "k"),
        ("exponential", "r", Y), ("gamma", "r", Y), ("inverse_gaussian", "r", Y),
    )
    fits = fit_together(x, [ALM([f], y, name, inference=False) for name, f, y in models])
    out = [(name, round(float(m.b[0]), 4), round(float(m.b[1]), 5)) for (name, _, _), m in zip(models, fits, strict=True)]
    return spark.createDataFrame(out, "distribution string, intercept double, slope double")


@query("SELECT q AS tau, round(quantile_cont(l_extendedprice, q), 6) AS value FROM lineitem, (SELECT unnest([0.05, 0.25, 0.5, 0.9]) AS q) GROUP BY q"
       .replace("quantile_cont(l_extendedprice, q)", "CASE q WHEN 0.05 THEN quantile_cont(l_extendedprice, 0.05) WHEN 0.25 THEN quantile_cont(l_extendedprice, 0.25) WHEN 0.5 THEN quantile_cont(l_extendedprice, 0.5) ELSE quantile_cont(l_extendedprice, 0.9) END")
       .replace("q AS tau", "CAST(q AS DOUBLE) AS tau"))
def exact_quantiles(spark, d):
    x = lineitem(spark, d)
    qs = [0.05, 0.25, 0.5, 0.9]
    return rows(spark, "tau double, value double", list(zip(qs, quantiles(x, F.col(Y), qs), strict=True)))


@query(
    """WITH k AS (SELECT l_quantity AS x, count(*) AS w, sum(l_tax) AS s FROM lineitem GROUP BY 1),
c AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS cw, sum(s) OVER (ORDER BY x) AS cs, w, s FROM k),
p AS (SELECT a.i, b.i AS j, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS m FROM c a JOIN c b ON b.i >= a.i),
q AS (SELECT c.x, p.i, min(m) AS m FROM c JOIN p ON p.i <= c.i AND p.j >= c.i GROUP BY c.x, p.i)
SELECT x, round(max(m), 8) AS fit FROM q GROUP BY x"""
)
def isotonic_fit(spark, d):
    x = lineitem(spark, d)
    m = Isotonic(X1, "l_tax").fit(x)
    return m.transform(x.select(F.col(X1).alias("x")).distinct(), "x", "fit").select("x", F.round("fit", 8).alias("fit"))


@query(
    """WITH s AS (SELECT date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS v FROM orders GROUP BY 1),
t AS (SELECT v, row_number() OVER (ORDER BY month) - 1 AS i, count(*) OVER () AS n FROM s),
-- the nearest k by index, and weights by the distance of the k-th
d AS (SELECT a.i, b.v, a.v AS own, abs(a.i - b.i) AS d, row_number() OVER (PARTITION BY a.i ORDER BY abs(a.i - b.i)) AS place, least(greatest(ceil(a.n * 0.27), 2), a.n) AS k FROM t a, t b),
w AS (SELECT i, v, own, d, max(d) FILTER (place = k) OVER (PARTITION BY i) AS h FROM d),
u AS (SELECT i, own, v, CASE WHEN d < h THEN pow(1 - pow(d / h, 3), 3) ELSE 0 END AS w FROM w)
SELECT CAST(i AS BIGINT) AS i, round(sum(w * v) / sum(w), 3) AS smoothed FROM u GROUP BY i"""
)
def lowess_monthly(spark, d):
    s = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(F.sum("o_totalprice").alias("v"))
    from pyspark.sql.window import Window

    out = lowess(s, "v", ["month"], 0.27)
    return out.select((F.row_number().over(Window.orderBy("month")) - 1).cast("long").alias("i"), F.round("smoothed", 3).alias("smoothed"))


_SERIES = "SELECT l_suppkey AS s, l_orderkey * 10 + l_linenumber AS t, CAST(l_linenumber - 1 AS DOUBLE) AS y FROM lineitem"


def _series(spark, d):
    x = lineitem(spark, d)
    return x.select(F.col("l_suppkey").alias("s"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("t"), (F.col("l_linenumber") - 1).cast("double").alias("y"))


@query(
    "WITH x AS (" + _SERIES + """),
a AS (SELECT s, count(*) AS n, sum(y) AS sy, avg(y) AS mu, var_pop(y) AS v, avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) AS z, sum(lgamma(y + 1)) AS lg FROM x GROUP BY s),
b AS (SELECT *, CASE WHEN v > mu AND mu > 0 THEN mu * mu / (v - mu) ELSE 1.0 END AS size FROM a),
g AS (SELECT x.s, sum(lgamma(y + size)) AS lgs FROM x JOIN b ON x.s = b.s GROUP BY x.s),
l AS (SELECT b.*, sy * ln(mu) - n * mu - lg AS poisson, n * ln(1 / (1 + mu)) + sy * ln(mu / (1 + mu)) AS geometric,
  lgs - n * lgamma(size) - lg + n * size * ln(size / (size + mu)) + sy * ln(mu / (size + mu)) AS nb,
  -n / 2.0 * ln(2 * pi() * v * n / (n - 1)) - (n - 1) / 2.0 AS normal FROM b JOIN g ON b.s = g.s),
c AS (SELECT *, 2 - 2 * poisson + 4.0 / (n - 2) AS ip, 2 - 2 * geometric + 4.0 / (n - 2) AS ig, 4 - 2 * nb + 12.0 / (n - 3) AS inb, 4 - 2 * normal + 12.0 / (n - 3) AS ino FROM l)
SELECT s, n, CASE WHEN z > 0.3 THEN 'intermittent' ELSE 'regular' END AS demand_type,
  CASE WHEN z > 0.3 THEN CASE WHEN inb <= ig AND inb <= ip THEN 'negative_binomial' WHEN ig <= ip THEN 'geometric' ELSE 'poisson' END
       ELSE CASE WHEN ip <= inb AND ip <= ino THEN 'poisson' WHEN inb <= ino THEN 'negative_binomial' ELSE 'normal' END END AS distribution,
  round(CASE WHEN z > 0.3 THEN least(inb, ig, ip) ELSE least(ip, inb, ino) END, 5) AS ic FROM c"""
)
def aid_classes(spark, d):
    return aid.classify(_series(spark, d), ["s"], "y").select("s", "n", "demand_type", "distribution", F.round("ic", 5).alias("ic"))


@query(
    "WITH x AS (" + _SERIES + """),
w AS (SELECT *, sum(CASE WHEN y <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 0 AS led,
  sum(CASE WHEN y <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) = 0 AS trail,
  max(y) OVER (PARTITION BY s ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) > 0 AS pre, max(y) OVER (PARTITION BY s ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) > 0 AS post,
  count(*) OVER (PARTITION BY s) AS n, avg(y) OVER (PARTITION BY s) AS m, stddev_pop(y) OVER (PARTITION BY s) AS sd FROM x),
v AS (SELECT *, sum(led::INT) OVER (PARTITION BY s) AS nl, sum(trail::INT) OVER (PARTITION BY s) AS nt FROM w),
k AS (SELECT s, CASE WHEN led AND nl > 0.1 * n THEN 'new_product' WHEN trail AND nt > 0.1 * n THEN 'obsolete_product'
  WHEN m > 0 AND NOT led AND NOT trail AND y = 0 AND pre AND post THEN 'stockout' WHEN sd > 0 AND y > m + 3 * sd THEN 'high_outlier'
  WHEN sd > 0 AND y > 0 AND y < m - 3 * sd THEN 'low_outlier' ELSE 'none' END AS a FROM v)
SELECT s, count(*) FILTER (a = 'stockout') AS stockout, count(*) FILTER (a = 'new_product') AS new_product, count(*) FILTER (a = 'obsolete_product') AS obsolete_product,
  count(*) FILTER (a = 'high_outlier') AS high_outlier, count(*) FILTER (a = 'low_outlier') AS low_outlier FROM k GROUP BY s"""
)
def aid_anomalies(spark, d):
    x = aid.anomalies(_series(spark, d), ["s"], "y", ["t"])
    return aid.anomaly_counts(x, ["s"]).select("s", "stockout", "new_product", "obsolete_product", "high_outlier", "low_outlier")


_S = """m AS (SELECT count(*) AS n, avg(l_quantity) AS mx, covar_pop(l_quantity, l_quantity) * count(*) AS sxx, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem),
e AS (SELECT l_returnflag, n, sxx, mx, l_quantity AS x, l_extendedprice - a - b * l_quantity AS e, 1.0 / n + (l_quantity - mx) * (l_quantity - mx) / sxx AS h FROM lineitem, m),
s AS (SELECT *, sum(e * e) OVER () / (n - 2) AS s2 FROM e)"""


@query(
    "WITH " + _S + """, c AS (SELECT *, e / sqrt(s2 * (1 - h)) AS r, e / sqrt((s2 * (n - 2) - e * e / (1 - h)) / (n - 3) * (1 - h)) AS t FROM s)
SELECT l_returnflag, count(*) AS n, round(sum(h), 8) AS leverage, round(sum(r * r * h / (1 - h) / 2), 8) AS cooks, round(max(abs(t)), 6) AS external,
  round(sum(abs(t * sqrt(h / (1 - h)))), 5) AS dffits, count(*) FILTER (h > 4.0 / n_all) AS high FROM (SELECT *, n AS n_all FROM c) GROUP BY l_returnflag"""
)
def influence_by_flag(spark, d):
    x = lineitem(spark, d)
    m = OLS([X1], Y).fit(x)
    i = dg.influence(m, x)
    return i.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.sum("leverage"), 8).alias("leverage"), F.round(F.sum("cooks_distance"), 8).alias("cooks"), F.round(F.max(F.abs("external")), 6).alias("external"),
        F.round(F.sum(F.abs("dffits")), 5).alias("dffits"), F.sum((F.col("leverage") > 4.0 / m.n).cast("long")).alias("high"),
    )


@query(
    "WITH " + _S + """, k AS (SELECT 'HC0' AS kind UNION ALL SELECT 'HC1' UNION ALL SELECT 'HC2' UNION ALL SELECT 'HC3')
SELECT kind, round(sqrt(sum((x - mx) * (x - mx) * e * e * CASE kind WHEN 'HC0' THEN 1.0 WHEN 'HC1' THEN n / (n - 2.0) WHEN 'HC2' THEN 1 / (1 - h) ELSE 1 / (1 - h) / (1 - h) END)) / any_value(sxx), 6) AS se
FROM s, k GROUP BY kind"""
)
def hc_slopes(spark, d):
    x = lineitem(spark, d)
    m = OLS([X1], Y).fit(x)
    return rows(spark, "kind string, se double", [(k, dg.hc_standard_errors(m, x, k)[1]) for k in ("HC0", "HC1", "HC2", "HC3")])


@query(
    "WITH " + _S + """ SELECT l_returnflag, round(avg(sqrt(s2 * h)), 6) AS mean_se, round(avg(sqrt(s2 * (1 + h))), 5) AS predict_se FROM s GROUP BY l_returnflag"""
)
def interval_widths(spark, d):
    x = lineitem(spark, d)
    m = OLS([X1], Y).fit(x)
    y = m.transform(m.transform(x, "confidence", output="c"), "prediction", output="p")
    return y.groupBy("l_returnflag").agg(F.round(F.avg("c_se"), 6).alias("mean_se"), F.round(F.avg("p_se"), 5).alias("predict_se"))


@query(
    """WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r, sum(l_quantity * l_quantity) AS a, sum(l_quantity * l_extendedprice) AS b, sum(l_extendedprice * l_extendedprice) AS c FROM lineitem)
SELECT round(1 / (1 - r * r), 6) AS vif, round(sqrt(((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b)) / ((a * c - b * b) / ((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b)))) / 1000, 4) AS condition FROM c"""
)
def collinearity(spark, d):
    x = lineitem(spark, d)
    v = dg.vif(x, [X1, Y])[X1]
    k = dg.condition_number(x, [X1, Y], intercept=False)
    return spark.createDataFrame([(round(v, 6), round(k / 1000, 4))], "vif double, condition double")


@query(
    """WITH g AS (SELECT sum(CAST(a AS HUGEINT) * a) AS aa, sum(CAST(a AS HUGEINT) * b) AS ab, sum(CAST(b AS HUGEINT) * b) AS bb
  FROM (SELECT CAST(l_quantity AS BIGINT) * 30000000000 AS a, CAST(l_quantity AS BIGINT) * 30000000000 + l_linenumber AS b FROM lineitem)),
-- sizes of a 2 x 2 Gram matrix: the product of its eigenvalues is the determinant, an exact integer
e AS (SELECT (CAST(aa AS DOUBLE) + CAST(bb AS DOUBLE)) / 2 + sqrt(pow((CAST(aa AS DOUBLE) - CAST(bb AS DOUBLE)) / 2, 2) + pow(CAST(ab AS DOUBLE), 2)) AS top, s.det FROM g,
  (SELECT CAST(sum(CAST(q AS HUGEINT) * q) * sum(CAST(l AS HUGEINT) * l) - sum(CAST(q AS HUGEINT) * l) * sum(CAST(q AS HUGEINT) * l) AS DOUBLE) * 30000000000.0 * 30000000000.0 AS det FROM (SELECT CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS l FROM lineitem)) s)
SELECT round(log10(top / sqrt(det)), 6) AS log_condition, CAST(3 + 2 AS DOUBLE) AS slopes, false AS aliased FROM e"""
)
def near_collinear(spark, d):
    a = F.col(X1) * 3e10
    x = lineitem(spark, d).select(a.alias("a"), (a + F.col("l_linenumber")).alias("b")).withColumn("y", 3 * (F.col("a") / 1e10) + 2 * (F.col("b") - F.col("a")))
    kappa = dg.condition_number(x, ["a", "b"], intercept=False)
    m = OLS(["a", "b"], "y").fit(x)
    # y = (3e-10 - 2) a + 2 b
    slopes = round(float((m.coefficients[0] + m.coefficients[1]) * 1e10 + m.coefficients[1]), 2)
    return spark.createDataFrame([(round(math.log10(kappa), 6), slopes, bool(np.isnan(m.coefficients).any()))], "log_condition double, slopes double, aliased boolean")


@query(
    """WITH x AS (SELECT CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS a, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END AS b FROM lineitem)
SELECT count(*) FILTER (a IS NULL) AS a, count(*) FILTER (b IS NULL) AS b, count(*) FILTER (a IS NULL OR b IS NULL) AS na_rows, count(*) AS n_rows, round(regr_slope(b, a), 6) AS slope FROM x"""
)
def missing_values(spark, d):
    x = lineitem(spark, d).select(F.when(F.col("l_orderkey") % 7 != 0, F.col(X1)).alias("a"), F.when(F.col("l_linenumber") != 3, F.col(Y)).otherwise(F.lit(float("nan"))).alias("b"))
    slope = OLS(["a"], "b", na_action="omit").fit(x).coefficients[0]
    return na.count_na(x, ["a", "b"]).withColumn("slope", F.lit(round(float(slope), 6)))


@query(
    """WITH x AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1500 AS f FROM lineitem)
SELECT l_returnflag, round(avg(abs(y - f)), 4) AS mae, round(avg((y - f) * (y - f)), 1) AS mse, round(sqrt(avg((y - f) * (y - f))), 4) AS rmse, round(100 * avg(abs((y - f) / y)), 6) AS mape,
  round(100 * avg(2 * abs(y - f) / (abs(y) + abs(f))), 6) AS smape, round(avg(CASE WHEN y >= f THEN 0.9 * (y - f) ELSE -0.1 * (y - f) END), 4) AS pinball FROM x GROUP BY l_returnflag"""
)
def forecast_metrics(spark, d):
    x = lineitem(spark, d).withColumn("f", F.col(X1) * 1500)
    return x.groupBy("l_returnflag").agg(
        F.round(metrics.mae(Y, "f"), 4).alias("mae"), F.round(metrics.mse(Y, "f"), 1).alias("mse"), F.round(metrics.rmse(Y, "f"), 4).alias("rmse"), F.round(metrics.mape(Y, "f"), 6).alias("mape"),
        F.round(metrics.smape(Y, "f"), 6).alias("smape"), F.round(metrics.pinball_loss(Y, "f", 0.9), 4).alias("pinball"),
    )


@query(
    """WITH x AS (SELECT o_custkey, o_totalprice AS y, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step FROM orders)
SELECT o_custkey, round(avg(abs(y - 100000)) / avg(abs(step)), 5) AS mase FROM x GROUP BY o_custkey HAVING count(step) > 0 AND avg(abs(step)) > 0"""
)
def mase_by_customer(spark, d):
    o = table(spark, d, "orders").withColumn("step", metrics.naive_step("o_totalprice", ["o_orderdate", "o_orderkey"], ["o_custkey"])).withColumn("f", F.lit(100000.0))
    out = o.groupBy("o_custkey").agg(F.round(metrics.mase("o_totalprice", "f", "step"), 5).alias("mase"), F.count("step").alias("c"))
    return out.filter("c > 0 and mase is not null").drop("c")


@query("""WITH m AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem GROUP BY 1)
SELECT l.l_returnflag, count(*) AS n, round(avg(a + b * l_quantity), 5) AS mean_fit, round(sqrt(avg(pow(l_extendedprice - a - b * l_quantity, 2))), 5) AS rmse FROM lineitem l JOIN m ON l.l_returnflag = m.l_returnflag GROUP BY 1""")
def grouped_scoring(spark, d):
    x = lineitem(spark, d)
    s = score_by(x, OLS([X1], Y).fit_by(x, ["l_returnflag"]), ["l_returnflag"], [X1])
    return s.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("prediction"), 5).alias("mean_fit"), F.round(metrics.rmse(Y, "prediction"), 5).alias("rmse"))


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 3) AS sx, round(sum(l_quantity * l_quantity), 3) AS sxx FROM lineitem GROUP BY l_returnflag")
def streaming_sums(spark, d):
    path = f"{d}/lineitem.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path + "*")
    name = "stream_" + uuid.uuid4().hex
    q = streaming_moments(stream, ["l_returnflag"], [X1], Y).writeStream.outputMode("complete").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    found = spark.createDataFrame(spark.table(name).collect(), spark.table(name).schema)  # a row for each flag
    spark.catalog.dropTempView(name)
    return found.select("l_returnflag", F.col("_n").alias("n"), F.round("_s0", 3).alias("sx"), F.round("_q0_0", 3).alias("sxx"))


@query("SELECT 'l_quantity' AS name, max(l_quantity) - min(l_quantity) < 1e-10 AS constant FROM lineitem UNION ALL SELECT 'one', true")
def constant_columns(spark, d):
    x = lineitem(spark, d).withColumn("one", F.lit(1.0))
    return spark.createDataFrame(list(detect_constant_columns(x, [X1, "one"]).items()), "name string, constant boolean")


# ---- saturated models, planted lines and densities: closed forms of what has none in general

_T = "CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.0 END"


@query(
    "WITH g AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS r, avg(" + _T + """) AS p FROM lineitem GROUP BY 1)
SELECT m AS model, CAST(r AS DOUBLE) AS r, round(p, 6) AS probability FROM g, (SELECT unnest(['probit', 'logit', 'binomial', 'cumulative_logistic', 'cumulative_normal']) AS m)"""
)
def saturated_probabilities(spark, d):
    """With one binary feature any link fits the groups' shares."""
    x = lineitem(spark, d).withColumn("t", (F.col("l_tax") > 0.04).cast("double")).select("r", "t")
    models = {"probit": Binomial(["r"], "t", "probit").fit(x), "logit": Binomial(["r"], "t").fit(x)}
    models |= {name: ALM(["r"], "t", name, inference=False).fit(x) for name in ("binomial", "cumulative_logistic", "cumulative_normal")}
    groups = x.select("r").distinct()
    return groups.select("r", F.explode(F.create_map(*[c for name, m in models.items() for c in (F.lit(name), F.round(m.predict(), 6))])).alias("model", "probability")).select("model", "r", "probability")


_ALM_X = """x AS (SELECT l_quantity / 10 AS x, l_extendedprice / 10000 AS y, l_discount * 5 + 0.1 AS u, CAST(l_linenumber - 1 AS DOUBLE) AS k, """ + _T + """ AS t, 0.7 AS s FROM lineitem),
v AS (SELECT *, 0.5 + 0.3 * x AS m, 0.2 + 0.1 * x AS p FROM x)"""
#: distribution -> (response, mean, parameter, log-likelihood in SQL) at scale s = 0.7.
_DENSITIES = {
    "normal": ("y", "m", None, "-0.5 * ln(2 * pi()) - ln(s) - pow(y - m, 2) / (2 * s * s)"),
    "laplace": ("y", "m", None, "-ln(2 * s) - abs(y - m) / s"),
    "student_t": ("y", "m", 5.0, "lgamma(3) - lgamma(2.5) - 0.5 * ln(5 * pi()) - ln(s) - 3 * ln(1 + pow((y - m) / s, 2) / 5)"),
    "logistic": ("y", "m", None, "-(y - m) / s - ln(s) - 2 * ln(1 + exp(-(y - m) / s))"),
    "asymmetric_laplace": ("y", "m", 0.3, "ln(0.21) - ln(s) - CASE WHEN y >= m THEN 0.3 * (y - m) ELSE 0.7 * (m - y) END / s"),
    "generalised_normal": ("y", "m", 1.5, "ln(1.5 / (2 * s)) - lgamma(1 / 1.5) - pow(abs(y - m) / s, 1.5)"),
    "s": ("y", "m", None, "-ln(4 * s * s) - sqrt(abs(y - m)) / s"),
    "log_normal": ("y", "m", None, "-0.5 * ln(2 * pi()) - ln(s) - pow(ln(y) - ln(m), 2) / (2 * s * s) - ln(y)"),
    "log_laplace": ("y", "m", None, "-ln(2 * s) - abs(ln(y) - ln(m)) / s - ln(y)"),
    "log_s": ("y", "m", None, "ln(0.25 / s) - ln(y) - sqrt(abs(ln(y) - ln(m)) / s)"),
    "log_generalised_normal": ("y", "m", 1.5, "ln(1.5 / (2 * s)) - lgamma(1 / 1.5) - pow(abs(ln(y) - ln(m)) / s, 1.5) - ln(y)"),
    "folded_normal": ("y", "m", None, "ln(exp(-pow((y - m) / s, 2) / 2) + exp(-pow((y + m) / s, 2) / 2)) - ln(s) - 0.5 * ln(2 * pi())"),
    "rectified_normal": ("y", "m", None, "-0.5 * ln(2 * pi()) - ln(s) - pow(y - m, 2) / (2 * s * s)"),
    "box_cox_normal": ("y", "m", 0.5, "-0.5 * ln(2 * pi()) - ln(s) - pow(2 * sqrt(y) - 2 * sqrt(m), 2) / (2 * s * s) - 0.5 * ln(y)"),
    "gamma": ("y", "m", 2.0, "2 * ln(2 / m) + ln(y) - 2 * y / m"),
    "inverse_gaussian": ("y", "m", 2.0, "0.5 * ln(1 / (pi() * pow(y, 3))) - pow(y - m, 2) / (m * m * y)"),
    "exponential": ("y", "m", None, "-ln(m) - y / m"),
    "beta": ("u", "p", None, "lgamma(s) - lgamma(p * s) - lgamma((1 - p) * s) + (p * s - 1) * ln(u) + ((1 - p) * s - 1) * ln(1 - u)"),
    "logit_normal": ("u", "p", None, "-0.5 * ln(2 * pi()) - ln(s) - pow(ln(u / (1 - u)) - p, 2) / (2 * s * s) - ln(u) - ln(1 - u)"),
    "poisson": ("k", "m", None, "k * ln(m) - m - lgamma(k + 1)"),
    "negative_binomial": ("k", "m", 2.0, "lgamma(k + 2) - lgamma(2) - lgamma(k + 1) + 2 * ln(2 / (2 + m)) + k * ln(m / (2 + m))"),
    "geometric": ("k", "m", None, "-ln(1 + m) + k * ln(m / (1 + m))"),
    "binomial": ("t", "p", 1.0, "t * ln(p) + (1 - t) * ln(1 - p)"),
    "cumulative_logistic": ("t", "p", None, "t * ln(p) + (1 - t) * ln(1 - p)"),
    "cumulative_normal": ("t", "p", None, "t * ln(p) + (1 - t) * ln(1 - p)"),
}


def _alm_frame(spark, d):
    x = lineitem(spark, d)
    q = F.col(X1) / 10
    return x.select(
        (F.col(Y) / 10000).alias("y"), (F.col("l_discount") * 5 + 0.1).alias("u"), (F.col("l_linenumber") - 1).cast("double").alias("k"),
        (F.col("l_tax") > 0.04).cast("double").alias("t"), (0.5 + 0.3 * q).alias("m"), (0.2 + 0.1 * q).alias("p"),
    )


@query("WITH " + _ALM_X + " " + " UNION ALL ".join(f"SELECT '{name}' AS distribution, round(sum({sql}), 3) AS loglik FROM v" for name, (_, _, _, sql) in _DENSITIES.items()))
def alm_densities(spark, d):
    """Log-likelihoods of all distributions at given parameters, in one aggregation."""
    sums = []
    for name, (y, m, extra, _) in _DENSITIES.items():
        dist = DISTRIBUTIONS[name]
        ll = dist.loglik(F.col(y), F.col(m), F.lit(0.7), dist.extra if extra is None else extra)
        sums.append(F.struct(F.lit(name).alias("distribution"), F.round(F.sum(ll), 3).alias("loglik")))
    return _alm_frame(spark, d).agg(F.array(*sums).alias("r")).select(F.explode("r").alias("r")).select("r.*")


@query("WITH " + _ALM_X + """ SELECT round(avg(pow(y - m, 2)), 6) AS mse, round(avg(abs(y - m)), 6) AS mae, round(avg(sqrt(abs(y - m))), 6) AS ham,
  round(-sum(-0.5 * ln(2 * pi()) - ln(s) - pow(y - m, 2) / (2 * s * s)), 3) AS likelihood FROM v""")
def alm_losses(spark, d):
    x = _alm_frame(spark, d)
    y, m = F.col("y"), F.col("m")
    r = [compute_loss(x, y, m, kind) for kind in ("mse", "mae", "ham")]
    return rows(spark, "mse double, mae double, ham double", [tuple(r)]).withColumn("likelihood", F.lit(round(compute_loss(x, y, m, "likelihood", "normal", 0.7), 3)))


_PLANTED = "x AS (SELECT l_quantity AS q, l_linenumber <= 5 AS clean, CASE WHEN l_linenumber <= 5 THEN 3 + 2 * l_quantity ELSE 500 + 7 * l_quantity * l_linenumber END AS y FROM lineitem)"


def _planted(spark, d):
    """A line that most rows lie on, and rows far above it."""
    x = lineitem(spark, d)
    far = 500 + 7 * F.col(X1) * F.col("l_linenumber")
    return x.select("l_orderkey", "l_linenumber", F.col(X1).alias("q"), F.when(F.col("l_linenumber") <= 5, 3 + 2 * F.col(X1)).otherwise(far).cast("double").alias("y"))


@query("WITH " + _PLANTED + """, c AS (SELECT regr_intercept(y, q) AS a, regr_slope(y, q) AS b, count(*) AS n FROM x WHERE clean)
SELECT m AS model, round(a, 3) AS intercept, round(b, 3) AS slope FROM c, (SELECT unnest(['ransac', 'theil_sen', 'median', 'laplace', 'asymmetric_laplace', 's']) AS m)""")
def planted_line(spark, d):
    """Consensus, spatial median and median regression all find a line that most rows lie on."""
    x = _planted(spark, d).persist()
    order = ["l_orderkey", "l_linenumber"]
    fits = {"ransac": Ransac(["q"], "y", order, threshold=0.5).fit(x), "theil_sen": TheilSen(["q"], "y", order).fit(x)}
    lines = {"median": Quantile(["q"], "y", 0.5), **{n: ALM(["q"], "y", n, inference=False) for n in ("laplace", "asymmetric_laplace", "s")}}
    fits |= dict(zip(lines, fit_together(x, list(lines.values())), strict=True))
    x.unpersist()
    return spark.createDataFrame([(n, round(float(m.intercept), 3), round(float(m.coefficients[0]), 3)) for n, m in fits.items()], "model string, intercept double, slope double")


@query("WITH " + _PLANTED + """ SELECT count(*) FILTER (abs(y - 3 - 2 * q) <= 0.5) AS inliers, count(*) AS n FROM x""")
def ransac_consensus(spark, d):
    x = _planted(spark, d)
    m = Ransac(["q"], "y", ["l_orderkey", "l_linenumber"], threshold=0.5).fit(x)
    return m.inliers(x).agg(F.sum(F.col("inlier").cast("long")).alias("inliers"), F.count("*").alias("n"))


@query(
    "WITH " + _M + """, b AS (SELECT *, s11 + 50 AS p, s22 + 50 AS q, s11 + n * x1 * x1 + 50 AS g11, s22 + n * x2 * x2 + 50 AS g22, s12 + n * x1 * x2 AS g12 FROM m),
c AS (SELECT *, (s1y * q - s2y * s12) / (p * q - s12 * s12) AS b1, (s2y * p - s1y * s12) / (p * q - s12 * s12) AS b2 FROM b),
e AS (SELECT *, (syy - 2 * (b1 * s1y + b2 * s2y) + b1 * b1 * s11 + 2 * b1 * b2 * s12 + b2 * b2 * s22) / (n - 3) AS mse FROM c),
f AS (SELECT *, sqrt(mse * g22 / (g11 * g22 - g12 * g12)) AS se1, sqrt(mse * g11 / (g11 * g22 - g12 * g12)) AS se2 FROM e)
SELECT round(se1, 6) AS se1, round(se2, 5) AS se2, round(b1 / se1, 4) AS t1, round(sqrt(mse / n), 5) AS intercept_se FROM f"""
)
def ridge_inference(spark, d):
    f = Ridge([X1, X2], Y, lam=50.0).fit_moments(moments(lineitem(spark, d), [X1, X2], Y))
    s = f.stats
    return spark.createDataFrame(
        [(round(float(s["std_errors"][0]), 6), round(float(s["std_errors"][1]), 5), round(float(s["t_statistics"][0]), 4), round(float(s["intercept_std_error"]), 5))],
        "se1 double, se2 double, t1 double, intercept_se double",
    )


#: The 97.5 % point of t at v degrees of freedom, by expansion about the normal point (exact to 1e-12 for v over 1,000).
_TCRIT = "(1.959963984540054 + (pow(1.959963984540054, 3) + 1.959963984540054) / (4 * v) + (5 * pow(1.959963984540054, 5) + 16 * pow(1.959963984540054, 3) + 3 * 1.959963984540054) / (96 * v * v))"


@query(
    "WITH " + _S + ", t AS (SELECT *, a + b * x AS fit, " + _TCRIT.replace("v", "(n - 2.0)") + """ AS c FROM s JOIN (SELECT a, b FROM m) ON true)
SELECT l_returnflag, round(avg(fit - c * sqrt(s2 * h)), 5) AS mean_lower, round(avg(fit + c * sqrt(s2 * h)), 5) AS mean_upper,
  round(avg(fit - c * sqrt(s2 * (1 + h))), 4) AS lower, round(avg(fit + c * sqrt(s2 * (1 + h))), 4) AS upper,
  round(any_value(b - c * sqrt(s2 / sxx)), 5) AS slope_lower, round(any_value(b + c * sqrt(s2 / sxx)), 5) AS slope_upper FROM t GROUP BY l_returnflag"""
)
def interval_bounds(spark, d):
    x = lineitem(spark, d)
    m = OLS([X1], Y).fit(x)
    y = m.transform(m.transform(x, "confidence", output="c"), "prediction", output="p")
    s = m.fit.stats
    return y.groupBy("l_returnflag").agg(
        F.round(F.avg("c_lower"), 5).alias("mean_lower"), F.round(F.avg("c_upper"), 5).alias("mean_upper"), F.round(F.avg("p_lower"), 4).alias("lower"), F.round(F.avg("p_upper"), 4).alias("upper"),
    ).withColumns({"slope_lower": F.lit(round(float(s["conf_lower"][0]), 5)), "slope_upper": F.lit(round(float(s["conf_upper"][0]), 5))})


@query(
    "WITH " + _S + """, k AS (SELECT 'HC0' AS kind UNION ALL SELECT 'HC3'),
e2 AS (SELECT kind, sqrt(sum((x - mx) * (x - mx) * e * e * CASE kind WHEN 'HC0' THEN 1.0 ELSE 1 / (1 - h) / (1 - h) END)) / any_value(sxx) AS se, any_value(n) AS n FROM s, k GROUP BY kind)
SELECT kind, round(b / se, 4) AS t, round(b - """ + _TCRIT.replace("v", "(e2.n - 2.0)") + """ * se, 5) AS lower FROM e2, m"""
)
def hc_tests(spark, d):
    x = lineitem(spark, d)
    m = OLS([X1], Y).fit(x)
    out = []
    for kind in ("HC0", "HC3"):
        r = dg.hc_inference(m, x, kind)
        out.append((kind, round(float(r["t_statistics"][1]), 4), round(float(r["lower"][1]), 5)))
    return spark.createDataFrame(out, "kind string, t double, lower double")


@query(
    "WITH " + _S + """, c AS (SELECT *, e / sqrt(s2 * (1 - h)) AS r, e / sqrt((s2 * (n - 2) - e * e / (1 - h)) / (n - 3) * (1 - h)) AS t FROM s)
SELECT count(*) FILTER (h > 4.0 / n) AS leverage, count(*) FILTER (abs(r) > 2) AS outliers, count(*) FILTER (r * r * h / (1 - h) / 2 > 4.0 / n) AS cooks,
  count(*) FILTER (abs(t * sqrt(h / (1 - h))) > 2 * sqrt(2.0 / n)) AS dffits FROM c"""
)
def influential_rows(spark, d):
    x = lineitem(spark, d)
    m = OLS([X1], Y).fit(x)
    i = dg.influence(m, x).persist()
    kinds = {
        "leverage": dg.high_leverage_points(i, m), "outliers": dg.residual_outliers(i), "cooks": dg.influential_cooks(i, m.n), "dffits": dg.influential_dffits(i, m.n, 2),
    }
    out = spark.createDataFrame([tuple(f.count() for f in kinds.values())], ", ".join(f"{k} long" for k in kinds))
    i.unpersist()
    return out


@query(
    """WITH c AS (SELECT corr(l_quantity, l_discount) AS a, corr(l_quantity, l_tax) AS b, corr(l_discount, l_tax) AS c, corr(l_quantity, l_extendedprice) AS r FROM lineitem)
SELECT round(1 / (1 - (a * a + b * b - 2 * a * b * c) / (1 - c * c)), 8) AS alone, round(1 / (1 - greatest(a * a, b * b)), 8) AS pair, 1 / (1 - r * r) > 1.5 AS high FROM c"""
)
def group_inflation(spark, d):
    x = lineitem(spark, d)
    g = dg.generalized_vif(x, {"alone": [X1], "pair": [X2, "l_tax"]}, [X1, X2, "l_tax"])
    high = X1 in dg.high_vif_predictors(dg.vif(x, [X1, Y]), 1.5)
    return spark.createDataFrame([(round(g["alone"], 8), round(g["pair"], 8), high)], "alone double, pair double, high boolean")


@query(
    """WITH g AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS r, count(*) AS n, avg(CAST(l_linenumber AS DOUBLE)) AS m, var_pop(l_linenumber) * count(*) AS ss FROM lineitem GROUP BY 1),
d AS (SELECT greatest(sum(ss / m) / (sum(n) - 2), 1) AS phi FROM g)
SELECT CAST(r AS DOUBLE) AS r, round(m, 6) AS count, round(sqrt(phi * m / n), 7) AS se, round(ln(m), 6) AS eta, round(sqrt(phi / (n * m)), 8) AS eta_se, round(m * exp(-1.959963984540054 * sqrt(phi / (n * m))), 6) AS lower,
  round(2 * m, 6) AS with_offset FROM g, d"""
)
def poisson_predictions(spark, d):
    """Standard errors of a saturated fit: one over the group's total on the link's scale."""
    x = lineitem(spark, d).withColumn("k", F.col("l_linenumber").cast("double")).select("r", "k")
    m = Poisson(["r"], "k").fit(x)
    g = x.select("r").distinct().withColumn("o", F.lit(0.6931471805599453))
    y = m.predict_with_se(m.predict_with_se(g, output="count"), scale="link", output="eta")
    return y.select("r", F.round("count", 6).alias("count"), F.round("count_se", 7).alias("se"), F.round("eta", 6).alias("eta"), F.round("eta_se", 8).alias("eta_se"), F.round("count_lower", 6).alias("lower"), F.round(m.predict_with_offset("o"), 6).alias("with_offset"))


@query(
    """WITH g AS (SELECT l_returnflag = 'R' AS f, count(*) AS n, avg(CAST(l_linenumber AS DOUBLE)) AS m FROM lineitem GROUP BY 1),
x AS (SELECT CAST(l_linenumber AS DOUBLE) AS y, m, 1.0 / n AS h FROM lineitem JOIN g ON (l_returnflag = 'R') = f),
d AS (SELECT greatest(sum((y - m) * (y - m) / m) / (count(*) - 2), 1) AS phi FROM x)
SELECT round(sum(abs(y - m)), 3) AS response, round(sum(abs(y - m) / m), 4) AS working, round(sum(abs(y - m) / sqrt(m * phi * (1 - h))), 3) AS standardized_pearson,
  round(sum(sqrt(greatest(2 * (y * ln(y / m) - (y - m)), 0) / (phi * (1 - h)))), 3) AS standardized_deviance, round(sum(h), 6) AS leverage FROM x, d"""
)
def glm_residual_kinds(spark, d):
    x = lineitem(spark, d).withColumn("k", F.col("l_linenumber").cast("double"))
    a = Poisson(["r"], "k").fit(x).augment(x)
    s = lambda c, k: F.round(F.sum(F.abs(c)), k)
    return a.agg(
        s("response_residual", 3).alias("response"), s("working_residual", 4).alias("working"), s("standardized_pearson", 3).alias("standardized_pearson"),
        s("standardized_deviance", 3).alias("standardized_deviance"), s("leverage", 6).alias("leverage"),
    )


@query(
    """SELECT round(sum(l_quantity - m), 3) + 0.0 AS centred, round(any_value(m), 6) AS mean, true AS full_rank, false AS doubled_full_rank FROM lineitem, (SELECT avg(l_quantity) AS m FROM lineitem)"""
)
def centred_columns(spark, d):
    x = lineitem(spark, d)
    c, means = center_columns(x, [X1])
    twice = x.withColumn("twice", F.col(X1) * 2)
    return c.agg((F.round(F.sum(X1), 3) + F.lit(0.0)).alias("centred")).withColumns(
        {"mean": F.lit(round(means[X1], 6)), "full_rank": F.lit(is_full_rank(x, [X1, X2])), "doubled_full_rank": F.lit(is_full_rank(twice, [X1, "twice"]))}
    )


@query(
    "WITH x AS (SELECT " + _T + """ AS t, l_quantity AS q, l_quantity + 1000 * (""" + _T + """) AS c, CASE WHEN l_quantity <= 25 THEN 1.0 ELSE 0.0 END AS low, CASE WHEN l_quantity >= 25 THEN 1.0 ELSE 0.0 END AS high,
  CASE WHEN l_quantity = 50 THEN l_linenumber ELSE 0 END AS rare, CASE WHEN l_quantity <= 25 THEN 0 ELSE l_linenumber END AS common FROM lineitem),
y AS (SELECT max(c) FILTER (t = 0) < min(c) FILTER (t = 1) AS c, max(q) FILTER (t = 0) < min(q) FILTER (t = 1) AS q,
  avg(CASE WHEN rare = 0 THEN 1.0 ELSE 0.0 END) > 0.9 AS sparse, avg(CASE WHEN common = 0 THEN 1.0 ELSE 0.0 END) > 0.9 AS usual,
  count(DISTINCT trunc(1000 * low)) <= 3 AND count(*) FILTER (low <> 0) > 0 AND count(*) FILTER (low <> 0 AND rare > 0) = 0 AS low_rare,
  count(DISTINCT trunc(1000 * high)) <= 3 AND count(*) FILTER (high <> 0) > 0 AND count(*) FILTER (high <> 0 AND rare > 0) = 0 AS high_rare,
  count(DISTINCT trunc(1000 * q)) <= 3 AND count(*) FILTER (q <> 0) > 0 AND count(*) FILTER (q <> 0 AND rare > 0) = 0 AS q_rare,
  count(DISTINCT trunc(1000 * low)) <= 3 AND count(*) FILTER (low <> 0) > 0 AND count(*) FILTER (low <> 0 AND common > 0) = 0 AS low_common FROM x)
SELECT CASE WHEN c THEN 'complete' ELSE 'none' END AS shifted, CASE WHEN q THEN 'complete' ELSE 'none' END AS quantity,
  sparse AND low_rare AS low, sparse AND high_rare AS high, sparse AND q_rare AS dense, usual AND low_common AS common FROM y"""
)
def separation(spark, d):
    x = lineitem(spark, d).withColumn("t", (F.col("l_tax") > 0.04).cast("double"))
    low, number = F.col(X1) <= 25, F.col("l_linenumber").cast("double")
    x = x.withColumns({"c": F.col(X1) + 1000 * F.col("t"), "low": low.cast("double"), "high": (F.col(X1) >= 25).cast("double"), "rare": F.when(F.col(X1) == 50, number).otherwise(0.0), "common": F.when(low, 0.0).otherwise(number)})
    s, z = dg.check_binary_separation(x, ["c", X1], "t"), dg.check_count_sparsity(x, ["low", "high", X1], "rare")
    common = dg.check_count_sparsity(x, ["low"], "common")["low"]
    return spark.createDataFrame([(s["c"], s[X1], z["low"], z["high"], z[X1], common)], "shifted string, quantity string, low boolean, high boolean, dense boolean, common boolean")


@query(
    """WITH x AS (SELECT l_suppkey AS s, l_extendedprice / 1000 AS y FROM lineitem),
a AS (SELECT s, count(*) AS n, sum(y) AS sy, avg(y) AS mu, var_pop(y) AS v, sum(ln(y)) AS sl, sum(ln(y) * ln(y)) AS sl2 FROM x GROUP BY s),
b AS (SELECT *, mu * mu / v AS shape, (sl2 - sl * sl / n) / (n - 1) AS lv FROM a),
l AS (SELECT *, -n / 2.0 * ln(2 * pi() * v * n / (n - 1)) - (n - 1) / 2.0 AS normal, n * shape * ln(shape / mu) + (shape - 1) * sl - shape / mu * sy - n * lgamma(shape) AS gamma,
  -sl - n / 2.0 * ln(2 * pi() * lv) - (n - 1) / 2.0 AS log_normal FROM b)
SELECT s, CASE WHEN normal >= gamma AND normal >= log_normal THEN 'normal' WHEN gamma >= log_normal THEN 'gamma' ELSE 'log_normal' END AS distribution,
  round(2 * ln(n) - 2 * greatest(normal, gamma, log_normal), 4) AS ic, round(2 * ln(n) - 2 * gamma, 4) AS gamma_ic, round(2 * ln(n) - 2 * log_normal, 4) AS log_normal_ic FROM l"""
)
def aid_fractional(spark, d):
    x = lineitem(spark, d).select(F.col("l_suppkey").alias("s"), (F.col(Y) / 1000).alias("y"))
    out = aid.classify(x, ["s"], "y", ic="bic")
    return out.select("s", "distribution", F.round("ic", 4).alias("ic"), F.round(F.col("criteria")["gamma"], 4).alias("gamma_ic"), F.round(F.col("criteria")["log_normal"], 4).alias("log_normal_ic"))


@query(
    """WITH s AS (SELECT date_trunc('month', o_orderdate) AS month, avg(CASE WHEN o_custkey % 3 = 0 THEN 1.0 ELSE 0.0 END) AS v FROM orders GROUP BY 1),
t AS (SELECT v, row_number() OVER (ORDER BY month) - 1 AS i, count(*) OVER () AS n FROM s),
d AS (SELECT a.i, b.v, abs(a.i - b.i) AS d, row_number() OVER (PARTITION BY a.i ORDER BY abs(a.i - b.i)) AS place, least(greatest(ceil(a.n * 0.23), 2), a.n) AS k FROM t a, t b),
h AS (SELECT i, v, d, max(d) FILTER (place = k) OVER (PARTITION BY i) AS h FROM d),
w AS (SELECT i, v, CASE WHEN d < h THEN pow(1 - pow(d / h, 3), 3) ELSE 0 END AS w FROM h),
m AS (SELECT i, sum(w * v) / sum(w) AS a, sum(w * (1 - v)) / sum(w) AS b FROM w GROUP BY i)
SELECT CAST(i AS BIGINT) AS i, round(a / (a + b), 6) AS a, round(b / (a + b), 6) AS b FROM m"""
)
def lowess_shares(spark, d):
    from pyspark.sql.window import Window

    s = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(F.avg((F.col("o_custkey") % 3 == 0).cast("double")).alias("a"))
    out = lowess_weights(s.withColumn("b", 1 - F.col("a")), ["a", "b"], ["month"], 0.23)
    return out.select((F.row_number().over(Window.orderBy("month")) - 1).cast("long").alias("i"), F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query(
    """WITH x AS (SELECT l_quantity AS a, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END AS b FROM lineitem),
m AS (SELECT regr_slope(b, a) AS s, regr_intercept(b, a) AS i FROM x)
SELECT count(*) AS n, count(b) AS fitted, round(sum(CASE WHEN b IS NOT NULL THEN i + s * a END), 2) AS total FROM x, m"""
)
def expanded_fits(spark, d):
    x = lineitem(spark, d).select(F.col(X1).alias("a"), F.when(F.col("l_linenumber") != 3, F.col(Y)).alias("b"))
    m = OLS(["a"], "b", na_action="exclude").fit(x)
    y = na.expanded(x, ["a", "b"], {"fitted": m.predict()})
    return y.agg(F.count("*").alias("n"), F.count("fitted").alias("fitted"), F.round(F.sum("fitted"), 2).alias("total"))


@query(
    """WITH m AS (SELECT l_suppkey, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem GROUP BY 1) SELECT count(*) AS n, round(sum(b), 4) AS slopes FROM m"""
)
def many_fits(spark, d):
    out = OLS([X1], Y).fit_by(lineitem(spark, d), ["l_suppkey"])
    return out.agg(F.count("*").alias("n"), F.round(F.sum(F.col("coefficients")[0]), 4).alias("slopes"))


# ---- without a closed form in SQL: the tests hold these against brute force


def _coefficients(spark, m):
    names = ["intercept", *m.features]
    return rows(spark, "term string, value double", [(n, None if v is None else float(v)) for n, v in zip(names, [m.intercept, *m.coefficients], strict=True)])


@query()
def huber_price(spark, d):
    return _coefficients(spark, Huber([X1, X2], Y).fit(lineitem(spark, d)))


@query()
def quantile_price(spark, d):
    return _coefficients(spark, Quantile([X1], Y, 0.9).fit(lineitem(spark, d)))


@query()
def bayesian_models(spark, d):
    x = from_vectors(table(spark, d, "embeddings"), "embedding", 64)
    fs = [f"x{j}" for j in range(2, 65)]
    m = moments(x, fs, "x1")
    return rows(spark, "model string, term string, value double", [(n, f, v) for n, e in (("bayesian_ridge", BayesianRidge(fs, "x1")), ("ard", ARD(fs, "x1"))) for f, v in zip(fs, e.fit_moments(m).coefficients, strict=True)])


@query()
def theil_sen_price(spark, d):
    return _coefficients(spark, TheilSen([X1], Y, ["l_orderkey", "l_linenumber"]).fit(lineitem(spark, d)))


@query()
def ransac_price(spark, d):
    return _coefficients(spark, Ransac([X1], Y, ["l_orderkey", "l_linenumber"]).fit(lineitem(spark, d)))


@query()
def passive_aggressive_by_supplier(spark, d):
    x = lineitem(spark, d).withColumn("y", F.col(Y) / 1000)
    out = PassiveAggressive([X1], "y", ["l_orderkey", "l_linenumber"]).fit_by(x, ["l_suppkey"])
    return out.select("l_suppkey", F.round("intercept", 6).alias("intercept"), F.round(F.col("coefficients")[0], 6).alias("slope"), "epochs")


@query()
def pspline_price(spark, d):
    x = lineitem(spark, d)
    m = PSpline(X1, Y).fit(x)
    return m.transform(x.select(X1).distinct(), "fit", 0.95).select(X1, F.round("fit", 4).alias("fit"), F.round("fit_se", 4).alias("fit_se"))


@query()
def lm_dynamic_monthly(spark, d):
    s = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(F.sum("o_totalprice").alias("v"), F.count("*").cast("double").alias("n"), F.avg("o_custkey").alias("c"))
    m = LmDynamic(["n", "c"], "v", ["month"]).fit(s)
    return m.augment(s).select("month", F.round("fitted", 2).alias("fitted"), F.round("c1", 4).alias("c1"))


@query()
def negative_binomial_ml(spark, d):
    x = lineitem(spark, d).groupBy("l_suppkey").agg(F.count("*").cast("double").alias("k"), F.avg(X1).alias("q"))
    m = NegativeBinomial(["q"], "k").fit(x)
    return rows(spark, "term string, value double", [("intercept", m.intercept), ("q", m.coefficients[0]), ("theta", m.theta)])


@query()
def probit_tax(spark, d):
    m = Binomial(["l_quantity"], "t", "probit").fit(lineitem(spark, d).withColumn("t", (F.col("l_tax") > 0.04).cast("double")))
    return rows(spark, "term string, value double, se double", [("intercept", m.b[0], m.std_errors_all[0]), ("l_quantity", m.b[1], m.std_errors_all[1])])


@query()
def alm_likelihood_fits(spark, d):
    x = lineitem(spark, d).withColumn("z", F.col(Y) / 10000)
    out = []
    names = ("student_t", "logistic", "generalised_normal", "laplace")
    for name, m in zip(names, fit_together(x, [ALM([X1], "z", n, inference=False) for n in names]), strict=True):
        out.append((name, m.b[0], m.b[1], m.scale, m.log_likelihood, m.converged))
    return rows(spark, "distribution string, intercept double, slope double, scale double, loglik double, converged boolean", out)


@query(
    """WITH x AS (SELECT l_quantity AS q, l_linenumber AS e, s FROM lineitem, (SELECT unnest([1, -1]) AS s)),
y AS (SELECT q, e, 100 + 2 * q + s * e AS level, 1 + 0.02 * q + s * e / 10.0 AS logs, 0.5 + s * e / 20.0 AS share FROM x),
f AS (SELECT regr_intercept(level, q) AS a, regr_slope(level, q) AS b, sqrt(avg(e * e)) AS sd, regr_intercept(logs, q) AS la, regr_slope(logs, q) AS lb, sqrt(avg(e * e)) / 10 AS lsd,
  regr_intercept(ln(share / (1 - share)), q) AS sa, regr_slope(ln(share / (1 - share)), q) AS sb FROM y),
-- the errors come in pairs of either sign, so that a symmetric density has the middle line as its optimum
r AS (SELECT 'student_t' AS distribution, a, b, NULL AS scale FROM f UNION ALL SELECT 'logistic', a, b, NULL FROM f UNION ALL SELECT 'generalised_normal', a, b, sd * sqrt(2) FROM f
  UNION ALL SELECT 'box_cox_normal', a, b, sd FROM f UNION ALL SELECT 'rectified_normal', a, b, sd FROM f UNION ALL SELECT 'folded_normal', a, b, sd FROM f
  UNION ALL SELECT 'log_generalised_normal', la, lb, lsd * sqrt(2) FROM f UNION ALL SELECT 'beta', sa, sb, NULL FROM f)
SELECT distribution, round(a, 3) + 0.0 AS intercept, round(b, 4) + 0.0 AS slope, round(scale, 3) AS scale, true AS converged FROM r"""
)
def alm_symmetric_fits(spark, d):
    """Fits by climbing whose optimum is known: errors in pairs of either sign about a line."""
    x = lineitem(spark, d).select(F.col(X1).alias("q"), F.col("l_linenumber").cast("double").alias("e"), F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("s"))
    off = F.col("s") * F.col("e")
    x = x.select("q", (100 + 2 * F.col("q") + off).alias("level"), F.exp(1 + 0.02 * F.col("q") + off / 10).alias("logs"), (0.5 + off / 20).alias("share"))
    label = {"log_generalised_normal": "logs", "beta": "share"}
    names = ["student_t", "logistic", "generalised_normal", "box_cox_normal", "rectified_normal", "folded_normal", "log_generalised_normal", "beta"]
    fits = fit_together(x, [ALM(["q"], label.get(n, "level"), n, inference=False) for n in names])
    closed = {"generalised_normal", "box_cox_normal", "rectified_normal", "folded_normal", "log_generalised_normal"}
    out = [(n, round(float(m.b[0]), 3) + 0.0, round(float(m.b[1]), 4) + 0.0, round(m.scale, 3) if n in closed else None, m.converged) for n, m in zip(names, fits, strict=True)]
    return spark.createDataFrame(out, "distribution string, intercept double, slope double, scale double, converged boolean")


@query(
    """WITH g AS (SELECT l_suppkey AS s, avg(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS m1, avg(CASE WHEN l_returnflag <> 'R' THEN l_linenumber END) AS m0,
  count(*) AS n, sum(CASE WHEN l_returnflag <> 'R' THEN l_linenumber END) AS s0, sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS s1 FROM lineitem GROUP BY 1),
d AS (SELECT l_suppkey AS s, sum(pow(l_linenumber - m, 2) / m) AS chi, sum(2 * (l_linenumber * ln(l_linenumber / m) - (l_linenumber - m))) AS dev
  FROM (SELECT l_suppkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN m1 ELSE m0 END AS m FROM lineitem JOIN g ON g.s = l_suppkey) GROUP BY 1)
SELECT g.s, n, round(ln(m0), 6) AS intercept, round(ln(m1 / m0), 6) AS slope, round(dev, 4) AS deviance, round(sqrt(greatest(chi / (n - 2), 1) * (1.0 / s0 + 1.0 / s1)), 6) AS se
FROM g JOIN d ON d.s = g.s WHERE m0 IS NOT NULL AND m1 IS NOT NULL AND n > 2"""
)
def poisson_by_supplier(spark, d):
    """A model for each supplier, all taking their steps together."""
    m = Poisson(["r"], "k").fit_by(lineitem(spark, d).withColumn("k", F.col("l_linenumber").cast("double")), ["l_suppkey"])
    # without rows of both groups a slope is not determined
    both = lineitem(spark, d).groupBy("l_suppkey").agg(F.count_distinct("r").alias("c")).filter("c = 2").select("l_suppkey")
    m = m.filter("error is null and n > 2").join(both, "l_suppkey")
    return m.select(
        F.col("l_suppkey").alias("s"), "n", F.round("intercept", 6).alias("intercept"), F.round(F.col("coefficients")[0], 6).alias("slope"), F.round("deviance", 4).alias("deviance"),
        F.round(F.col("std_errors")[0], 6).alias("se"),
    )


@query(
    """SELECT l_returnflag, l_linestatus, CAST(GROUPING(l_returnflag, l_linestatus) AS BIGINT) AS grouping, count(*) AS n, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
  round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_r2(l_extendedprice, l_quantity), 8) AS r_squared
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())"""
)
def ols_levels(spark, d):
    """Fits at all levels of two keys from one scan."""
    m = OLS([X1], Y).fit_sets(table(spark, d, "lineitem"), [["l_returnflag", "l_linestatus"], ["l_returnflag"], ["l_linestatus"], []])
    return m.select(
        "l_returnflag", "l_linestatus", "grouping", F.col("n_observations").alias("n"), F.round("intercept", 4).alias("intercept"), F.round(F.col("coefficients")[0], 6).alias("slope"), F.round("r_squared", 8).alias("r_squared")
    )


@query(
    """WITH x AS (SELECT o_orderpriority AS g, row_number() OVER (ORDER BY o_orderkey) AS i, CAST(o_custkey % 10 + 1 AS DOUBLE) AS x, o_totalprice / 1000 AS y FROM orders),
s AS (SELECT *, coalesce(sum(x * y * pow(0.97, -i)) OVER w, 0) AS v, coalesce(sum(x * x * pow(0.97, -i)) OVER w, 0) AS a FROM x WINDOW w AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT g, count(*) AS n, round(sum(x * v / (a + 1e-6)), 3) AS predicted, round(sqrt(avg(pow(y - x * v / (a + 1e-6), 2))), 5) AS rmse FROM s GROUP BY g"""
)
def rls_path(spark, d):
    """One-step-ahead predictions of recursive least squares over a whole sequence."""
    x = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("g"), (F.col("o_custkey") % 10 + 1).cast("double").alias("x"), (F.col("o_totalprice") / 1000).alias("y"))
    p = RLS(["x"], "y", ["o_orderkey"], forgetting=0.97, intercept=False).path(x)
    out = p.groupBy("g").agg(F.count("*").alias("n"), F.round(F.sum("prediction"), 3).alias("predicted"), F.round(F.sqrt(F.avg(F.col("prediction_error") ** 2)), 5).alias("rmse"))
    out = spark.createDataFrame(out.collect(), out.schema)  # a row for each priority
    release(p)
    return out


@query(
    """WITH x AS (SELECT time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS start, event_type, value FROM events),
m AS (SELECT max(ts) - INTERVAL '10 days' AS mark FROM events)
SELECT epoch_ms(start) AS start_ms, event_type, count(*) AS n, round(sum(value), 4) AS sum, round(sum(value * value), 4) AS squares
FROM x, m WHERE start + INTERVAL '7 days' <= mark GROUP BY 1, 2"""
)
def event_windows(spark, d):
    """Weekly moments of a stream by event time: windows that the watermark has closed."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path + "*").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("one", F.lit(1.0))
    name = "stream_" + uuid.uuid4().hex
    q = window_moments(stream, "ts", "7 days", ["value"], "one", "10 days", keys=["event_type"]).writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    out = spark.table(name).select((F.unix_timestamp("start") * 1000).alias("start_ms"), "event_type", F.col("_n").alias("n"), F.round("_s0", 4).alias("sum"), F.round("_q0_0", 4).alias("squares"))
    found = spark.createDataFrame(out.collect(), out.schema)  # a row for each week and type
    spark.catalog.dropTempView(name)
    return found


@query(
    """WITH x AS (SELECT l_quantity AS u, l_quantity + 10 * l_linenumber AS v, l_extendedprice AS y FROM lineitem),
g AS (SELECT covar_pop(u, u) * count(*) AS a, covar_pop(u, v) * count(*) AS c, covar_pop(v, v) * count(*) AS b, covar_pop(u, y) * count(*) AS r, covar_pop(v, y) * count(*) AS s FROM x),
p AS (SELECT *, lam * alpha / 2 AS h, lam * (1 - alpha) AS k FROM g, (VALUES ('elastic_net', 2e7, 0.5), ('lasso', 2e6, 1.0), ('lasso_strong', 5e8, 1.0), ('lasso_all', 4e9, 1.0)) AS t(model, lam, alpha)),
-- every pattern of signs, of which the optimality conditions leave one
e AS (SELECT p.*, i.e1, j.e2 FROM p, (VALUES (-1), (0), (1)) AS i(e1), (VALUES (-1), (0), (1)) AS j(e2)),
f AS (SELECT *, CASE WHEN e1 = 0 THEN 0 WHEN e2 = 0 THEN (r - e1 * h) / (a + k) ELSE ((r - e1 * h) * (b + k) - (s - e2 * h) * c) / ((a + k) * (b + k) - c * c) END AS b1,
  CASE WHEN e2 = 0 THEN 0 WHEN e1 = 0 THEN (s - e2 * h) / (b + k) ELSE ((s - e2 * h) * (a + k) - (r - e1 * h) * c) / ((a + k) * (b + k) - c * c) END AS b2 FROM e)
SELECT model, round(b1, 4) + 0.0 AS b1, round(b2, 4) + 0.0 AS b2 FROM f
WHERE sign(b1) = e1 AND sign(b2) = e2 AND (e1 <> 0 OR abs(r - c * b2) <= h) AND (e2 <> 0 OR abs(s - c * b1) <= h)"""
)
def elastic_net_two(spark, d):
    """Two correlated features under penalties that keep both, one and none of them."""
    x = lineitem(spark, d).withColumn("v", F.col(X1) + 10 * F.col("l_linenumber"))
    m = moments(x, [X1, "v"], Y)
    models = {"elastic_net": ElasticNet([X1, "v"], Y, 2e7, 0.5), "lasso": Lasso([X1, "v"], Y, 2e6), "lasso_strong": Lasso([X1, "v"], Y, 5e8), "lasso_all": Lasso([X1, "v"], Y, 4e9)}
    fits = {k: e.fit_moments(m).coefficients for k, e in models.items()}
    return spark.createDataFrame([(k, round(float(b[0]), 4) + 0.0, round(float(b[1]), 4) + 0.0) for k, b in fits.items()], "model string, b1 double, b2 double")


@query(
    """WITH big AS (SELECT user_id, ts, max(value) AS latest FROM events WHERE value > 50 GROUP BY 1, 2)
SELECT event_type, count(*) AS n, count(latest) AS matched, round(sum(latest), 3) AS total FROM (
  SELECT e.event_type, (SELECT arg_max(b.latest, b.ts) FROM big b WHERE b.user_id = e.user_id AND b.ts <= e.ts) AS latest FROM events e)
GROUP BY event_type"""
)
def asof_events(spark, d):
    """Each event with its user's latest value over 50, itself included."""
    x = table(spark, d, "events").select("user_id", "ts", "event_type", "value")
    out = asof_join(x, x.filter("value > 50").withColumnRenamed("value", "latest"), "ts", ["latest"], by=["user_id"])
    found = out.groupBy("event_type").agg(F.count("*").alias("n"), F.count("latest").alias("matched"), F.round(F.sum("latest"), 3).alias("total"))
    found = spark.createDataFrame(found.collect(), found.schema)  # a row for each type
    release(out)
    return found
