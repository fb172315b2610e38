"""Diagnostics and robust inference: leverage, influence, VIF, condition, HC covariances, separation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import na
from ..errors import InsufficientObservations
from ..functions.special import t_ppf, t_sf2
from ..plans.moments import moments
from ..plans.qr import singular_values
from ..plans.solve import spd_inverse
from .base import Model, number


def influence(model: Model, df: DataFrame) -> DataFrame:
    """df with fitted, residual, leverage, standardized, studentized and externally studentized
    residuals, Cook's distance and DFFITS: a projection, as the hat matrix's diagonal is x'Ax with a
    literal A."""
    s2, k, n = F.lit(float(model.mse)), model.fit.n_parameters, model.n
    x = model.augment(df).withColumn("leverage", F.least(F.lit(1.0), F.greatest(F.lit(0.0), model.quadratic())))
    gap = F.greatest(1 - F.col("leverage"), F.lit(1e-14))
    e = F.col("residual")
    loo = (F.lit(float(model.rss)) - e * e / gap) / F.lit(float(n - k - 1)) if n - k - 1 > 0 else F.lit(None).cast("double")
    x = x.withColumn("standardized", e / F.sqrt(s2)).withColumn("studentized", e / F.sqrt(s2 * gap))
    x = x.withColumn("external", e / F.sqrt(F.greatest(loo, F.lit(0.0)) * gap))
    x = x.withColumn("cooks_distance", F.col("studentized") ** 2 * F.col("leverage") / gap / k)
    return x.withColumn("dffits", F.col("external") * F.sqrt(F.col("leverage") / gap))


def high_leverage_points(x: DataFrame, model: Model, threshold: float | None = None) -> DataFrame:
    return x.filter(F.col("leverage") > (2 * model.fit.n_parameters / model.n if threshold is None else threshold))


def residual_outliers(x: DataFrame, threshold: float = 2.0, column: str = "studentized") -> DataFrame:
    return x.filter(F.abs(column) > threshold)


def influential_cooks(x: DataFrame, n: int, threshold: float | None = None) -> DataFrame:
    return x.filter(F.col("cooks_distance") > (4 / n if threshold is None else threshold))


def influential_dffits(x: DataFrame, n: int, p: int, threshold: float | None = None) -> DataFrame:
    return x.filter(F.abs("dffits") > (2 * math.sqrt(p / n) if threshold is None else threshold))


def vif(df: DataFrame, features: list[str]) -> dict[str, float]:
    """Variance inflation: the diagonal of the inverse correlation matrix; infinite for a feature the
    others determine; 1 for fewer than two features or three rows."""
    x = na.process(df, features)
    m = moments(x, features, features[0])
    p = len(features)
    if p < 2 or m.n < 3:
        return dict.fromkeys(features, 1.0)
    sxx, _, _ = m.centred()
    out = {}
    for j, f in enumerate(features):
        rest = [i for i in range(p) if i != j and sxx[i, i] > 1e-300]
        if sxx[j, j] <= 1e-300 or not rest:
            out[f] = 1.0
            continue
        b = np.linalg.lstsq(sxx[np.ix_(rest, rest)], sxx[rest, j], rcond=None)[0]
        r2 = float(sxx[rest, j] @ b / sxx[j, j])
        out[f] = math.inf if r2 >= 1 - 1e-12 else max(1.0, 1 / (1 - r2))
    return out


def generalized_vif(df: DataFrame, groups: dict[str, list[str]], features: list[str]) -> dict[str, float]:
    """Of each group of columns, the largest VIF against the columns outside the group."""
    x = na.process(df, features)
    m = moments(x, features, features[0])
    sxx, _, _ = m.centred()
    at = {f: i for i, f in enumerate(features)}
    out = {}
    for name, cols in groups.items():
        rest = [at[f] for f in features if f not in cols]
        worst = 0.0
        for f in cols if rest else []:
            b = np.linalg.lstsq(sxx[np.ix_(rest, rest)], sxx[rest, at[f]], rcond=None)[0]
            worst = max(worst, float(sxx[rest, at[f]] @ b / sxx[at[f], at[f]]))
        out[name] = math.inf if worst >= 1 - 1e-12 else 1 / (1 - worst)
    return out


def high_vif_predictors(values: dict[str, float], threshold: float = 10.0) -> list[str]:
    return [f for f, v in values.items() if v > threshold]


def classify_condition(kappa: float) -> str:
    return "well conditioned" if kappa < 30 else "moderate" if kappa < 100 else "strong" if kappa < 1000 else "severe"


def condition_diagnostic(df: DataFrame, features: list[str], intercept: bool = True) -> dict:
    """Condition number of the raw design, its singular values, condition indices and variance
    decomposition proportions, from its triangular factor: nothing is squared."""
    sv, v = singular_values(na.process(df, features), [*([F.lit(1.0)] if intercept else []), *map(number, features)])
    low = sv[sv > 0].min() if (sv > 0).any() else 0.0
    kappa = float(sv[0] / low) if low > 0 else math.inf
    with np.errstate(divide="ignore", invalid="ignore"):
        phi = (v / sv) ** 2
        share = phi / phi.sum(axis=1, keepdims=True)
        indices = np.where(sv > 0, sv[0] / sv, np.inf)
    return {"condition_number": kappa, "singular_values": sv, "condition_indices": indices, "severity": classify_condition(kappa), "variance_proportions": share.T}


def condition_number(df: DataFrame, features: list[str], intercept: bool = True) -> float:
    return condition_diagnostic(df, features, intercept)["condition_number"]


def hc_covariance(model: Model, df: DataFrame, kind: str = "HC3") -> np.ndarray:
    """Sandwich covariance: one aggregation of w x x', w made of the residual and the leverage."""
    n, k = model.n, model.fit.n_parameters
    if n <= k:
        raise InsufficientObservations("HC covariances need more rows than parameters")
    x = na.process(df, [*model.features, model.label])
    e = number(model.label) - model.linear()
    h = F.least(F.lit(1.0), F.greatest(F.lit(0.0), model.quadratic()))
    gap = F.when((h >= 1) | F.isnan(h), F.lit(1.0)).otherwise(1 - h)
    omega = {"HC0": e * e, "HC1": e * e * (n / (n - k)), "HC2": e * e / gap, "HC3": e * e / gap / gap}[kind.upper()]
    v = [number(model.features[j]) for j in model.kept]
    v = [F.lit(1.0), *v] if model.intercept is not None else v
    p = len(v)
    row = x.select(omega.alias("_w"), *[c.alias(f"_v{i}") for i, c in enumerate(v)]).agg(
        *[F.sum(F.col("_w") * F.col(f"_v{i}") * F.col(f"_v{j}")) for i in range(p) for j in range(i, p)]
    ).first()
    meat = np.zeros((p, p))
    for value, (i, j) in zip(row, [(i, j) for i in range(p) for j in range(i, p)], strict=True):
        meat[i, j] = meat[j, i] = value
    return model.cov @ meat @ model.cov


def hc_inference(model: Model, df: DataFrame, kind: str = "HC3", level: float = 0.95) -> dict:
    cov = hc_covariance(model, df, kind)
    se = np.sqrt(np.diag(cov))
    has = model.intercept is not None
    b = np.r_[[model.intercept] if has else [], model.coefficients[model.kept]]
    t = b / se
    crit = t_ppf(0.5 + level / 2, model.df)
    return {"kind": kind, "std_errors": se, "t_statistics": t, "p_values": np.array([t_sf2(v, model.df) for v in t]), "lower": b - crit * se, "upper": b + crit * se, "covariance": cov}


def hc_standard_errors(model: Model, df: DataFrame, kind: str = "HC3") -> np.ndarray:
    return np.sqrt(np.diag(hc_covariance(model, df, kind)))


def standard_errors(df: DataFrame, features: list[str], mse: float, weight: str | None = None, intercept: bool = True) -> np.ndarray:
    """sqrt(mse * diag((X'X)^-1)), the intercept first."""
    m = moments(na.process(df, features), features, features[0], weight)
    return np.sqrt(mse * np.diag(spd_inverse(m.augmented() if intercept else m.raw()[0])))


def check_binary_separation(df: DataFrame, features: list[str], label: str) -> dict[str, str]:
    """For each feature 'complete', 'quasi', 'monotonic' or 'none'; increasing direction only."""
    out = {}
    x = na.process(df, [*features, label])
    y = number(label)
    for f in features:
        v = number(f)
        row = x.agg(
            F.max(F.when(y == 0, v)), F.min(F.when(y == 1, v)), F.sum((y == 1).cast("long")), F.sum((y == 0).cast("long"))
        ).first()
        top0, low1, ones, zeros = row
        if not ones or not zeros:
            out[f] = "none"
            continue
        if top0 < low1:
            out[f] = "complete"
            continue
        overlap = x.filter((y == 1) & (v <= F.lit(top0))).count()
        if overlap <= 2 and overlap < 0.1 * ones:
            out[f] = "quasi"
            continue
        groups = x.groupBy(v.alias("v")).agg(F.min(y).alias("lo"), F.max(y).alias("hi"), F.count("*").alias("n"))
        pure, repeated = groups.agg(F.min((F.col("lo") == F.col("hi")).cast("int")), F.max((F.col("n") > 1).cast("int"))).first()
        out[f] = "monotonic" if pure and repeated else "none"
    return out


def check_count_sparsity(df: DataFrame, features: list[str], label: str) -> dict[str, bool]:
    """Where over nine tenths of the responses are zero: features of at most three values (told apart
    to a thousandth) whose active rows all have a zero response. Other responses have none."""
    x = na.process(df, [*features, label])
    y = number(label)
    aggs = [F.avg((y < 1e-10).cast("double")).alias("zeros")]
    for i, f in enumerate(features):
        v = number(f)
        active = F.abs(v) > 1e-10
        value = F.greatest(F.least(v * 1000, F.lit(9e18)), F.lit(-9e18)).cast("long")
        aggs += [F.count_distinct(value).alias(f"d{i}"), F.count_if(active).alias(f"a{i}"), F.count_if(active & (y > 1e-10)).alias(f"y{i}")]
    r = x.agg(*aggs).first()
    sparse = r["zeros"] is not None and r["zeros"] > 0.9
    return {f: sparse and r[f"d{i}"] <= 3 and r[f"a{i}"] > 0 and r[f"y{i}"] == 0 for i, f in enumerate(features)}


def glm_dispersion(x: DataFrame, kind: str, k: int) -> float:
    """Pearson or deviance dispersion from an augmented GLM frame; 1 where n <= k."""
    col = {"pearson": "pearson_residual", "deviance": "deviance_residual"}[kind]
    n, s = x.agg(F.count(col), F.sum(F.col(col) ** 2)).first()
    return s / (n - k) if n > k else 1.0


def pearson_chi_squared(x: DataFrame) -> float:
    return x.agg(F.sum(F.col("pearson_residual") ** 2)).first()[0]

