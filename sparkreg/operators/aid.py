"""Demand classification of many series at once: one aggregation by series, a second over the
histogram of values for the one sum without a closed form, and windows for anomalies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidOptions
from ..functions.special import lgamma_col, norm_cdf_col

CRITERIA = ("aic", "aicc", "bic")
#: (intermittent, fractional) -> candidates in order; the first of equal criteria wins.
CANDIDATES = {
    (False, False): ("poisson", "negative_binomial", "normal"),
    (False, True): ("normal", "gamma", "log_normal"),
    (True, False): ("negative_binomial", "geometric", "poisson"),
    (True, True): ("rectified_normal", "gamma", "normal"),
}
PARAMETERS = {"poisson": 1, "geometric": 1}


def criterion(ll: Column, k: int, n: Column, kind: str) -> Column:
    aic = 2.0 * k - 2 * ll
    if kind == "bic":
        return k * F.ln(n) - 2 * ll
    if kind == "aic":
        return aic
    return F.when(n - k - 1 > 0, aic + 2.0 * k * (k + 1) / (n - k - 1)).otherwise(aic)


def statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    y = F.col(value).cast("double")
    x = df.select(*keys, y.alias("y")).filter("y is not null and not isnan(y)")
    y = F.col("y")
    pos = F.when(y > 0, F.ln(y))
    mean = F.avg("y").alias("mean")
    return x.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("y").alias("sum_y"), mean, F.var_pop("y").alias("variance"),
        F.avg((y == 0).cast("double")).alias("zero_share"), F.max((y != F.round(y)).cast("int")).alias("fractional"),
        F.max((y <= 0).cast("int")).alias("has_non_positive"), F.sum(pos).alias("sum_log"), F.sum(pos * pos).alias("sum_log2"), F.avg(pos).alias("mean_log"),
        F.sum(lgamma_col(F.greatest(F.round(y), F.lit(0.0)) + 1)).alias("sum_lgamma1"),
        F.sum((y > 0).cast("double")).alias("_m"), F.sum(F.when(y > 0, y).otherwise(0.0)).alias("_a"), F.sum(F.when(y > 0, y * y).otherwise(0.0)).alias("_b"),
    )


def rectified_normal(s: DataFrame, where: Column, steps: int = 40) -> DataFrame:
    """s (of statistics()) with rn_mu, rn_sigma, rn_ll, null but for rows where: a constant mean with
    mass at zero, by maximum likelihood. With z zeros and the positive part's n, sum and squares the
    likelihood has a closed form, so that each series needs only its row: EM steps of its two
    parameters run as one fold over an array."""
    x = s
    # EM: zeros are censored draws below zero, with mean mu - sigma h and second moment from h = pdf / cdf
    def step(acc, _):
        mu, sd = acc["mu"], F.greatest(acc["sd"], F.lit(1e-6))
        t = -mu / sd
        h = F.exp(-t * t / 2) / math.sqrt(2 * math.pi) / F.greatest(norm_cdf_col(t), F.lit(1e-300))
        z = F.col("n") - F.col("_m")
        e1 = mu - sd * h
        e2 = mu * mu + sd * sd - sd * h * (mu)  # E[v^2 | v < 0]
        new = (F.col("_a") + z * e1) / F.col("n")
        var = (F.col("_b") + z * e2) / F.col("n") - new * new
        return F.struct(new.alias("mu"), F.sqrt(F.greatest(var, F.lit(1e-12))).alias("sd"))

    start = F.struct(F.col("mean").alias("mu"), F.sqrt(F.greatest("variance", F.lit(1e-6))).alias("sd"))
    x = x.withColumn("_p", F.when(where, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)))
    x = x.withColumn("rn_mu", F.col("_p.mu")).withColumn("rn_sigma", F.col("_p.sd"))
    mu, sd = F.col("rn_mu"), F.col("rn_sigma")
    ll = -F.col("_m") * (0.5 * math.log(2 * math.pi) + F.ln(sd)) - (F.col("_b") - 2 * mu * F.col("_a") + F.col("_m") * mu * mu) / (2 * sd * sd)
    ll = ll + (F.col("n") - F.col("_m")) * F.ln(F.greatest(norm_cdf_col(-mu / sd), F.lit(1e-300)))
    return x.withColumn("rn_ll", ll).drop("_p")


def classify(df: DataFrame, keys: list[str], value: str, threshold: float = 0.3, ic: str = "aicc", rectified: bool = True) -> DataFrame:
    """One row a series: demand_type, fractional, distribution, ic, the candidates' criteria as a map,
    mean, variance, zero_share, shape and scale."""
    if ic not in CRITERIA:
        raise InvalidOptions(f"ic must be one of {CRITERIA}")
    threshold = min(max(threshold, 0.0), 1.0)
    s = statistics(df, keys, value)
    mu, var, n = F.col("mean"), F.col("variance"), F.col("n").cast("double")
    size = F.when((var > mu) & (mu > 0), mu * mu / (var - mu)).otherwise(F.lit(1.0))
    s = s.withColumn("nb_size", size)
    y = F.col(value).cast("double")
    # only whole series have the negative binomial for a candidate
    hist = df.select(*keys, F.greatest(F.round(y), F.lit(0.0)).alias("_k")).filter("_k is not null and not isnan(_k)").groupBy(*keys, "_k").agg(F.count("*").alias("_c"))
    nb = hist.join(s.filter("fractional = 0").select(*keys, "nb_size"), keys).groupBy(*keys).agg(F.sum(F.col("_c") * lgamma_col(F.col("_k") + F.col("nb_size"))).alias("sum_lgamma_size"))
    s = s.join(nb, keys, "left")
    if rectified:
        s = rectified_normal(s, (F.col("zero_share") > threshold) & (F.col("fractional") == 1))
    else:
        s = s.withColumns({"rn_mu": F.lit(None).cast("double"), "rn_sigma": F.lit(None).cast("double"), "rn_ll": F.lit(None).cast("double")})
    lam = F.greatest(mu, F.lit(1e-10))
    sq = var * n
    sd = F.sqrt(sq / (n - 1))
    shape = F.when(var > 0, mu * mu / var).otherwise(F.lit(1.0))
    p = F.col("nb_size") / (F.col("nb_size") + lam)
    log_rss = F.col("sum_log2") - n * F.col("mean_log") * F.col("mean_log")
    log_sd = F.sqrt(log_rss / (n - 1))
    good = F.col("has_non_positive") == 0
    ll = {
        "poisson": F.col("sum_y") * F.ln(lam) - n * lam - F.col("sum_lgamma1"),
        "negative_binomial": F.col("sum_lgamma_size") - n * lgamma_col(F.col("nb_size")) - F.col("sum_lgamma1") + n * F.col("nb_size") * F.ln(p) + F.col("sum_y") * F.ln(1 - p),
        "geometric": n * F.ln(1 / (1 + lam)) + F.col("sum_y") * F.ln(lam / (1 + lam)),
        "normal": F.when(sd > 0, -n / 2 * F.ln(2 * math.pi * sd * sd) - sq / (2 * sd * sd)),
        "gamma": F.when(good, n * shape * F.ln(shape / mu) + (shape - 1) * F.col("sum_log") - shape / mu * F.col("sum_y") - n * lgamma_col(shape)),
        "log_normal": F.when(good & (log_sd > 0), -F.col("sum_log") - n * F.ln(log_sd) - n / 2 * math.log(2 * math.pi) - log_rss / (2 * log_sd * log_sd)),
        "rectified_normal": F.col("rn_ll"),
    }
    ics = {d: criterion(v, PARAMETERS.get(d, 2), n, ic) for d, v in ll.items()}
    ics = {d: F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c) for d, c in ics.items()}
    x = s.withColumns({f"_ic_{d}": c for d, c in ics.items()}).withColumn("intermittent", F.col("zero_share") > threshold)
    options = [
        F.when(
            (F.col("intermittent") == F.lit(a)) & (F.col("fractional") == F.lit(int(b))),
            F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"_ic_{d}").alias("ic")) for d in names]),
        )
        for (a, b), names in CANDIDATES.items()
    ]
    x = x.withColumn("_options", F.filter(F.coalesce(*options), lambda v: v["ic"].isNotNull()))
    best = F.aggregate("_options", F.struct(F.lit(None).cast("string").alias("d"), F.lit(float("inf")).alias("ic")), lambda a, v: F.when(v["ic"] < a["ic"], v).otherwise(a))
    x = x.withColumn("_best", best)
    d = F.col("_best.d")
    return x.select(
        *keys, "n", F.when(F.col("intermittent"), F.lit("intermittent")).otherwise(F.lit("regular")).alias("demand_type"), (F.col("fractional") == 1).alias("fractional"),
        d.alias("distribution"), F.when(d.isNotNull(), F.col("_best.ic")).alias("ic"), F.map_from_entries("_options").alias("criteria"),
        F.when(d == "log_normal", F.exp("mean_log")).when(d == "rectified_normal", F.col("rn_mu")).otherwise(mu).alias("mean"), "variance", "zero_share",
        F.when(d == "negative_binomial", F.col("nb_size")).when(d == "gamma", shape).alias("shape"),
        F.when(d == "normal", sd).when(d == "log_normal", log_sd).when(d == "rectified_normal", F.col("rn_sigma")).otherwise(F.lit(1.0)).alias("scale"),
    )


def anomalies(df: DataFrame, keys: list[str], value: str, order_by: list[str], output: str = "anomaly") -> DataFrame:
    """df with one of none, new_product, obsolete_product, stockout, high_outlier, low_outlier."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    every = Window.partitionBy(*keys)
    y = F.col(value).cast("double")
    x = df.withColumns({"_y": y})
    y = F.col("_y")
    seen = F.sum((y != 0).cast("long"))
    x = x.withColumns(
        {
            "_led": seen.over(w.rowsBetween(Window.unboundedPreceding, 0)) == 0, "_trail": seen.over(w.rowsBetween(0, Window.unboundedFollowing)) == 0,
            "_pre": F.max((y > 0).cast("int")).over(w.rowsBetween(-3, -1)), "_post": F.max((y > 0).cast("int")).over(w.rowsBetween(1, 3)),
            "_n": F.count("*").over(every), "_mean": F.avg("_y").over(every), "_sd": F.stddev_pop("_y").over(every),
        }
    )
    x = x.withColumns({"_nl": F.sum(F.col("_led").cast("long")).over(every), "_nt": F.sum(F.col("_trail").cast("long")).over(every)})
    mean, sd = F.col("_mean"), F.col("_sd")
    inner = ~F.col("_led") & ~F.col("_trail")
    kind = (
        F.when(F.col("_led") & (F.col("_nl") / F.col("_n") > 0.1), F.lit("new_product"))
        .when(F.col("_trail") & (F.col("_nt") / F.col("_n") > 0.1), F.lit("obsolete_product"))
        .when((mean > 0) & inner & (y == 0) & (F.col("_pre") == 1) & (F.col("_post") == 1), F.lit("stockout"))
        .when((sd > 0) & (y > mean + 3 * sd), F.lit("high_outlier"))
        .when((sd > 0) & (y > 0) & (mean > 0) & (y < F.greatest(mean - 3 * sd, F.lit(0.0))), F.lit("low_outlier"))
        .otherwise(F.lit("none"))
    )
    return x.withColumn(output, kind).drop("_y", "_led", "_trail", "_pre", "_post", "_n", "_mean", "_sd", "_nl", "_nt")


def anomaly_counts(x: DataFrame, keys: list[str], column: str = "anomaly") -> DataFrame:
    kinds = ["new_product", "obsolete_product", "stockout", "high_outlier", "low_outlier"]
    counts = [F.sum((F.col(column) == k).cast("long")).alias(k) for k in kinds]
    return x.groupBy(*keys).agg(*counts).withColumns(
        {"has_stockouts": F.col("stockout") > 0, "is_new_product": F.col("new_product") > 0, "is_obsolete_product": F.col("obsolete_product") > 0}
    )


def profile(df: DataFrame, keys: list[str], value: str, order_by: list[str], detect_anomalies: bool = True, anomaly_alpha: float = 0.05, **options) -> DataFrame:
    """classify() with the series' anomaly counts beside it, unless detect_anomalies is off.
    anomaly_alpha is taken into 0.001 to 0.5 and put beside them; the limits of anomalies() are fixed
    numbers of deviations, which it does not move."""
    kinds = classify(df, keys, value, **options).withColumn("anomaly_alpha", F.lit(float(min(max(anomaly_alpha, 0.001), 0.5))))
    return kinds.join(anomaly_counts(anomalies(df, keys, value, order_by), keys), keys) if detect_anomalies else kinds


__all__ = ["CANDIDATES", "anomalies", "anomaly_counts", "classify", "criterion", "profile", "rectified_normal", "statistics"]
