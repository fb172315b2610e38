"""Fits and models that all linear estimators share.

A Fit is what the driver computes from moments; a Model is a Fit with column names: it scores
DataFrames by plain Column expressions, describes itself as one row, and can be saved as Parquet.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import na
from ..errors import DimensionMismatch, InsufficientObservations, RegressionError
from ..functions.special import f_sf, t_ppf, t_sf2
from ..options import RegressionOptions
from ..plans.moments import Moments, grouped_moments, moments

NAN = float("nan")


@dataclass
class Fit:
    """Coefficients and everything that moments give about them. cov: the unscaled covariance of
    (intercept, kept coefficients); None where a model has no intervals."""

    coefficients: np.ndarray
    intercept: float | None
    n: int
    n_parameters: int
    rss: float
    tss: float
    mse: float
    cov: np.ndarray | None = None
    kept: list[int] = field(default_factory=list)
    options: RegressionOptions = field(default_factory=RegressionOptions)
    extra: dict = field(default_factory=dict)
    stats: dict = field(default_factory=dict)

    @property
    def df(self) -> int:
        return self.n - self.n_parameters

    def describe(self) -> Fit:
        """Fit statistics. The likelihood is Gaussian with variance mse."""
        n, k, s = self.n, self.n_parameters, self.stats
        has = self.intercept is not None
        r2 = min(max(1 - self.rss / self.tss, 0.0), 1.0) if self.tss > 0 else (1.0 if self.rss <= 1e-12 else 0.0)
        s["r_squared"] = r2
        total = n - 1 if has else n
        s["adj_r_squared"] = 1 - (1 - r2) * total / self.df if self.df > 0 else NAN
        s["mse"], s["rmse"] = self.mse, math.sqrt(max(self.mse, 0)) if self.mse == self.mse else NAN
        model_df = k - 1 if has else k
        if model_df > 0 and self.df > 0 and self.mse > 0:
            s["f_statistic"] = (self.tss - self.rss) / model_df / self.mse
            s["f_pvalue"] = f_sf(s["f_statistic"], model_df, self.df)
        else:
            s["f_statistic"], s["f_pvalue"] = NAN, NAN
        if self.mse > 0:
            ll = -n / 2 * (1 + math.log(2 * math.pi) + math.log(self.mse))
            s["log_likelihood"], s["aic"], s["bic"] = ll, 2 * k - 2 * ll, k * math.log(n) - 2 * ll
            s["aicc"] = s["aic"] + 2 * k * (k + 1) / (n - k - 1) if n - k - 1 > 0 else NAN
        else:
            s["log_likelihood"] = s["aic"] = s["bic"] = s["aicc"] = NAN
        return self.infer()

    def infer(self) -> Fit:
        """Standard errors, t statistics, p values and confidence intervals, where cov is known."""
        s, p = self.stats, len(self.coefficients)
        if self.cov is None or not self.options.inference or self.df <= 0:
            return self
        se = np.sqrt(np.maximum(np.diag(self.cov), 0) * self.mse)
        at = 1 if self.intercept is not None else 0
        full = np.full(p, NAN)
        full[self.kept] = se[at:]
        if "std_errors" in self.extra:
            full = self.extra["std_errors"]
        s["std_errors"] = full
        b = self.coefficients
        with np.errstate(divide="ignore", invalid="ignore"):
            s["t_statistics"] = b / full
        s["p_values"] = np.array([t_sf2(t, self.df) for t in s["t_statistics"]])
        crit = t_ppf(0.5 + self.options.confidence / 2, self.df)
        s["conf_lower"], s["conf_upper"] = b - crit * full, b + crit * full
        if at:
            e = self.extra.get("intercept_std_error", float(se[0]))
            t = self.intercept / e if e else NAN
            s |= {"intercept_std_error": e, "intercept_t_statistic": t, "intercept_p_value": t_sf2(t, self.df)}
            s |= {"intercept_lower": self.intercept - crit * e, "intercept_upper": self.intercept + crit * e}
        return self


SCALARS = [
    "r_squared", "adj_r_squared", "rmse", "mse", "f_statistic", "f_pvalue", "aic", "aicc", "bic", "log_likelihood",
    "intercept_std_error", "intercept_t_statistic", "intercept_p_value", "intercept_lower", "intercept_upper",
]
ARRAYS = ["std_errors", "t_statistics", "p_values", "conf_lower", "conf_upper"]

RESULT = T.StructType(
    [
        T.StructField("coefficients", T.ArrayType(T.DoubleType())),
        T.StructField("intercept", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("n_parameters", T.IntegerType()),
        T.StructField("n_observations", T.LongType()),
        T.StructField("aliased", T.ArrayType(T.BooleanType())),
        *[T.StructField(c, T.DoubleType()) for c in SCALARS],
        *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ARRAYS],
        T.StructField("error", T.StringType()),
    ]
)


def plain(x):
    """A float for a row, NULL where it was not computed."""
    return None if x is None or x != x else float(x)


def result_row(fit: Fit | None, error: str | None = None) -> dict:
    if fit is None:
        return {f.name: None for f in RESULT} | {"error": error}
    out = {
        "coefficients": [float(b) for b in fit.coefficients], "intercept": plain(fit.intercept), "rank": len(fit.kept),
        "n_parameters": fit.n_parameters, "n_observations": fit.n,
        "aliased": [bool(b != b) for b in fit.coefficients], "error": error,
    }
    out |= {c: plain(fit.stats.get(c)) for c in SCALARS}
    return out | {c: None if fit.stats.get(c) is None else [float(v) for v in fit.stats[c]] for c in ARRAYS}


def number(name: str) -> Column:
    return F.col(name).cast("double")


def total(terms: list[Column]) -> Column:
    """Sum of terms as a balanced tree, so that hundreds of them do not nest deeply."""
    terms = list(terms)
    if not terms:
        return F.lit(0.0)
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2], strict=False)] + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0]


class Model:
    """A fitted linear predictor over named columns."""

    def __init__(self, fit: Fit, features: list[str], label: str, weight: str | None = None):
        self.fit, self.features, self.label, self.weight = fit, list(features), label, weight

    def __getattr__(self, name):
        fit = self.__dict__.get("fit")
        if fit is not None:
            if name in fit.stats:
                return fit.stats[name]
            if name in ("coefficients", "intercept", "n", "df", "mse", "rss", "tss", "kept", "extra", "stats", "cov"):
                return getattr(fit, name)
        raise AttributeError(name)

    def linear(self) -> Column:
        b = self.fit.coefficients
        terms = [number(f) * F.lit(float(v)) for f, v in zip(self.features, b, strict=True) if v == v and v != 0]
        start = F.lit(float(self.fit.intercept or 0.0))
        some_null = total([number(f) * 0 for f, v in zip(self.features, b, strict=True) if v == v and v == 0]) if any(v == 0 for v in b) else None
        out = reduce(lambda a, c: a + c, terms, start)
        return out if some_null is None else out + some_null

    def predict(self) -> Column:
        return self.linear()

    def quadratic(self, a: np.ndarray | None = None) -> Column:
        """v'Av with v = (1, kept features): the leverage for A = cov."""
        a = self.fit.cov if a is None else a
        if a is None:
            return F.lit(None).cast("double")
        v = [number(self.features[j]) for j in self.fit.kept]
        if self.fit.intercept is not None:
            v = [F.lit(1.0), *v]
        return total([v[i] * v[j] * F.lit(float(a[i, j] * (1 if i == j else 2))) for i in range(len(v)) for j in range(i, len(v))])

    def transform(self, df: DataFrame, interval: str | None = None, level: float = 0.95, output: str = "prediction") -> DataFrame:
        """df with the prediction, and with _lower, _upper and _se for interval 'confidence' or
        'prediction'; NULL where the model has no intervals."""
        df = df.withColumn(output, self.predict())
        if interval is None:
            return df
        ok = self.fit.cov is not None and self.fit.df > 0
        h = self.quadratic()
        var = (h + 1 if interval == "prediction" else h) * F.lit(float(self.fit.mse)) if ok else F.lit(None).cast("double")
        crit = t_ppf(0.5 + level / 2, self.fit.df) if ok else NAN
        se = F.sqrt(F.greatest(var, F.lit(0.0))) if ok else var
        df = df.withColumn(f"{output}_se", se)
        half = F.col(f"{output}_se") * F.lit(crit if ok else None)
        return df.withColumn(f"{output}_lower", F.col(output) - half).withColumn(f"{output}_upper", F.col(output) + half)

    def augment(self, df: DataFrame) -> DataFrame:
        """df with fitted and residual: NULL where a value is missing."""
        return df.withColumn("fitted", self.predict()).withColumn("residual", number(self.label) - F.col("fitted"))

    def score(self, df: DataFrame) -> float:
        """R squared over df; 1 or 0 where the response does not vary."""
        x = self.augment(na.process(df, [*self.features, self.label]))
        mean = x.agg(F.avg(number(self.label))).first()[0]
        r = x.agg(F.sum(F.col("residual") ** 2), F.sum((number(self.label) - F.lit(mean)) ** 2)).first()
        if not r[1]:
            return 1.0 if (r[0] or 0) < 1e-12 else 0.0
        return 1 - r[0] / r[1]

    def row(self) -> dict:
        return result_row(self.fit)

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([self.row()], RESULT)

    def save(self, spark: SparkSession, path: str) -> None:
        f = self.fit
        data = {
            "features": self.features, "label": self.label, "weight": self.weight, "coefficients": [float(v) for v in f.coefficients],
            "intercept": f.intercept, "n": f.n, "n_parameters": f.n_parameters, "rss": f.rss, "tss": f.tss, "mse": f.mse,
            "cov": None if f.cov is None else np.asarray(f.cov).tolist(), "kept": list(map(int, f.kept)), "options": f.options.__dict__,
        }
        spark.createDataFrame([(json.dumps(data),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        d = json.loads(spark.read.parquet(path).first()[0])
        fit = Fit(
            np.array(d["coefficients"], dtype=float), d["intercept"], d["n"], d["n_parameters"], d["rss"], d["tss"], d["mse"],
            None if d["cov"] is None else np.array(d["cov"]), d["kept"], RegressionOptions(**d["options"]),
        ).describe()
        return Model(fit, d["features"], d["label"], d["weight"])


class GramEstimator:
    """An estimator that needs moments only: fit() is two aggregations and a solve on the driver,
    fit_by() one aggregation by group and a solve of each group's row where it lies."""

    weighted = False
    model = Model

    def __init__(self, features: list[str], label: str, weight: str | None = None, **options):
        if not features:
            raise DimensionMismatch("no features")
        self.features, self.label, self.weight = list(features), label, weight
        self.options = RegressionOptions(**options)

    def columns(self) -> list[str]:
        return [*self.features, self.label, *([self.weight] if self.weight else [])]

    def prepared(self, df: DataFrame) -> DataFrame:
        return na.process(df, self.columns(), self.options.na_action)

    def solve(self, m: Moments) -> Fit:
        raise NotImplementedError

    def check(self, m: Moments) -> None:
        need = m.p + (1 if self.options.intercept else 0)
        if m.n < max(2, need):
            raise InsufficientObservations(f"{m.n} rows for {need} parameters")
        if not (np.isfinite(m.q).all() and np.isfinite(m.s).all()):
            raise RegressionError("values that are not finite")

    def fit_moments(self, m: Moments) -> Fit:
        self.check(m)
        return self.solve(m)

    def fit(self, df: DataFrame) -> Model:
        m = moments(self.prepared(df), self.features, self.label, self.weight)
        if m.n == 0 and not df.isEmpty():
            na.require_rows(0, 1)
        return self.model(self.fit_moments(m), self.features, self.label, self.weight)

    def fit_by(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """keys and a result row for each group; a group that fails has NULLs and an error."""
        rows, shift = grouped_moments(self.prepared(df), keys, self.features, self.label, self.weight)
        return self.solved(rows, keys, shift)

    def fit_sets(self, df: DataFrame, sets: list[list[str]]) -> DataFrame:
        """Fits at several levels of keys at once, as GROUPING SETS has them: the keys (NULL where a set
        lacks one), grouping (the bits of the missing keys, the last key lowest) and a result row. The rows
        are read for the finest level only; coarser moments are sums of finer ones."""
        keys = list(dict.fromkeys(k for s in sets for k in s))
        fine, shift = grouped_moments(self.prepared(df), keys, self.features, self.label, self.weight)
        sums = [c for c in fine.columns if c not in keys]
        if not keys:
            return self.solved(fine, [], shift)
        columns = [[F.col(k) for k in s] for s in sets]
        rows = fine.groupingSets(columns, *[F.col(k) for k in keys]).agg(F.grouping_id().cast("long").alias("grouping"), *[F.sum(c).alias(c) for c in sums])
        return self.solved(rows, [*keys, "grouping"], shift)

    def solved(self, rows: DataFrame, keys: list[str], shift: np.ndarray) -> DataFrame:
        """A row of sums -> its keys and result."""
        schema = T.StructType([*[rows.schema[k] for k in keys], *RESULT])
        k = len(self.features) + 1

        def solve_all(it):
            from ..plans.moments import from_row

            for pdf in it:
                out = []
                for r in pdf.to_dict("records"):
                    try:
                        found = result_row(self.fit_moments(from_row(r, k, shift)))
                    except (RegressionError, np.linalg.LinAlgError) as e:
                        found = result_row(None, f"{type(e).__name__}: {e}")
                    out.append({c: r[c] for c in keys} | found)
                yield pd.DataFrame(out, columns=schema.names)

        return rows.mapInPandas(solve_all, schema)


def score_by(df: DataFrame, models: DataFrame, keys: list[str], features: list[str], output: str = "prediction") -> DataFrame:
    """df with each row scored by its group's model: an equi-join on keys, whose strategy is left to
    the optimiser's knowledge of the models' size; groups without a model get NULL."""
    cut = models.select(*keys, F.col("coefficients").alias("_b"), F.col("intercept").alias("_a"))
    x = F.array(*[number(f) for f in features])
    dot = F.aggregate(F.zip_with(x, "_b", lambda u, v: F.when(F.isnan(v), F.lit(0.0)).otherwise(u * v)), F.lit(0.0), lambda a, v: a + v)
    return df.join(cut, keys, "left").withColumn(output, F.when(F.col("_b").isNotNull(), dot + F.coalesce("_a", F.lit(0.0)))).drop("_a", "_b")
