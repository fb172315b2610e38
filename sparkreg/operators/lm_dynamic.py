"""Time-varying linear model: all subsets of features (the first 64), weighted row by row."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import na
from ..errors import InsufficientObservations, InvalidOptions
from ..functions.special import t_ppf
from ..plans.many import fit_together
from ..plans.moments import Moments, moments
from ..plans.solve import spd_inverse
from .alm import ALM
from .base import number, total
from .linear import OLS
from .smoothing import lowess_weights

MOST = 64


class LmDynamicModel:
    def __init__(self, est: LmDynamic, specs: list[list[int]], betas: np.ndarray, scales: list[float], loglik: list[Column], n: int, params: list[int]):
        self.est, self.model_specs, self.betas, self.scales, self.loglik, self.n, self.params = est, specs, betas, scales, loglik, n, params
        self.average: np.ndarray | None = None

    def pointwise_ic(self) -> list[Column]:
        """Information criterion of each model at a row."""
        out = []
        for ll, k in zip(self.loglik, self.params, strict=True):
            ic = self.est.ic
            if ic == "bic":
                out.append(k * math.log(self.n) - 2 * ll)
                continue
            more = 2 * k * (k + 1) / (self.n - k - 1) if ic == "aicc" and self.n - k - 1 > 0 else 0.0
            out.append(2.0 * k - 2 * ll + more)
        return out

    def augment(self, df: DataFrame, keep_ic: bool = False) -> DataFrame:
        """df with model weights w0.., smoothed where a span is set, dynamic coefficients c0.. (the
        intercept first, where there is one) and the time-varying fit."""
        e = self.est
        x = na.process(df, [*e.features, e.label]).withColumns({f"ic{i}": c for i, c in enumerate(self.pointwise_ic())})
        names = [f"w{i}" for i in range(len(self.model_specs))]
        low = F.least(*[F.col(f"ic{i}") for i in range(len(names))]) if len(names) > 1 else F.col("ic0")
        x = x.withColumn("_low", low)
        raw = {w: F.exp(-0.5 * (F.col(f"ic{i}") - F.col("_low"))) for i, w in enumerate(names)}
        x = x.withColumns(raw)
        total = sum((F.col(w) for w in names), F.lit(0.0))
        x = x.withColumn("_sum", total).withColumns({w: F.col(w) / F.col("_sum") for w in names}).drop("_low", "_sum")
        if not keep_ic:
            x = x.drop(*[f"ic{i}" for i in range(len(names))])
        if e.span is not None:
            x = lowess_weights(x, names, e.order_by, e.span)
        coefs = {f"c{j}": sum((F.col(w) * F.lit(float(b)) for w, b in zip(names, self.betas[:, j], strict=True) if b), F.lit(0.0)) for j in range(self.betas.shape[1])}
        x = x.withColumns(coefs)
        v = [*([F.lit(1.0)] if e.intercept else []), *map(number, e.features)]
        return x.withColumn("fitted", sum((F.col(f"c{j}") * c for j, c in enumerate(v)), F.lit(0.0)))

    def average_coefficients(self, df: DataFrame) -> np.ndarray:
        """Means over rows of the dynamic coefficients: what predict() uses."""
        if self.average is None:
            self.average = np.array(list(self.augment(df).agg(*[F.avg(f"c{j}") for j in range(self.betas.shape[1])]).first()))
        return self.average

    def predict(self) -> Column:
        v = [*([F.lit(1.0)] if self.est.intercept else []), *map(number, self.est.features)]
        return sum((c * F.lit(float(b)) for c, b in zip(v, self.average, strict=True)), F.lit(0.0))

    def transform(self, df: DataFrame, interval: str | None = None, level: float = 0.95, output: str = "prediction") -> DataFrame:
        """df with the prediction by average coefficients, and with _lower, _upper and _se for interval
        'confidence' or 'prediction': t intervals from the full design and the dynamic fit's residuals."""
        df = df.withColumn(output, self.predict())
        if interval is None:
            return df
        if self.cov is None:
            return df.withColumns({f"{output}_{c}": F.lit(None).cast("double") for c in ("se", "lower", "upper")})
        v = [*([F.lit(1.0)] if self.est.intercept else []), *map(number, self.est.features)]
        h = total([v[i] * v[j] * F.lit(float(self.cov[i, j] * (1 if i == j else 2))) for i in range(len(v)) for j in range(i, len(v))])
        se = F.sqrt(F.greatest((h + 1 if interval == "prediction" else h) * F.lit(float(self.mse)), F.lit(0.0)))
        half = F.col(f"{output}_se") * F.lit(t_ppf(0.5 + level / 2, self.df))
        return df.withColumn(f"{output}_se", se).withColumns({f"{output}_lower": F.col(output) - half, f"{output}_upper": F.col(output) + half})

    def coefficient_at(self, x: DataFrame, position: Column) -> DataFrame:
        return x.filter(position).select(*[f"c{j}" for j in range(self.betas.shape[1])])


class LmDynamic:
    """With a normal response every subset is solved from one Gram matrix; other distributions fit an
    ALM each."""

    def __init__(self, features, label, order_by: list[str], ic: str = "aicc", distribution: str = "normal", span: float | None = 0.3, intercept: bool = True):
        if ic not in ("aic", "aicc", "bic"):
            raise InvalidOptions("ic must be aic, aicc or bic")
        self.features, self.label, self.order_by = list(features), label, list(order_by)
        self.ic, self.distribution, self.span, self.intercept = ic, distribution, span, intercept

    def specs(self) -> list[list[int]]:
        p = len(self.features)
        return [[j for j in range(p) if mask >> j & 1] for mask in range(1, min(2**p, MOST + 1))]

    def fit(self, df: DataFrame) -> LmDynamicModel:
        x = na.process(df, [*self.features, self.label])
        n = x.count()
        if n < 3:
            raise InsufficientObservations(f"{n} rows")
        specs = self.specs()
        at = 1 if self.intercept else 0
        betas = np.zeros((len(specs), len(self.features) + at))
        scales, lls, params = [], [], []
        m = moments(x, self.features, self.label) if self.distribution == "normal" else None
        names = [[self.features[j] for j in s] for s in specs]
        # all subsets advance by the same aggregations
        alms = [] if m is not None else fit_together(x, [ALM(c, self.label, self.distribution, intercept=self.intercept, inference=False) for c in names])
        for i, s in enumerate(specs):
            cols = [self.features[j] for j in s]
            if m is not None:
                keep = [*s, m.p]
                part = Moments(m.n, m.positive, m.sw, m.s[keep], m.q[np.ix_(keep, keep)], m.shift[keep])
                f = OLS(cols, self.label, intercept=self.intercept, inference=False).fit_moments(part)
                coef, a, sd = np.nan_to_num(f.coefficients), f.intercept, math.sqrt(max(f.mse, 1e-300))
                mu = F.lit(float(a or 0.0))
                for c, b in zip(cols, coef, strict=True):
                    mu = mu + number(c) * F.lit(float(b))
                ll = -0.5 * math.log(2 * math.pi * sd * sd) - (number(self.label) - mu) ** 2 / (2 * sd * sd)
            else:
                f = alms[i]
                coef, a, sd, ll = f.coefficients, f.intercept, f.scale, f.pointwise()
            if self.intercept:
                betas[i, 0] = a
            betas[i, [j + at for j in s]] = coef
            scales.append(sd)
            lls.append(ll)
            params.append(len(s) + at)
        model = LmDynamicModel(self, specs, betas, scales, lls, n, params)
        model.average_coefficients(x)
        k = len(self.features) + at
        model.df, model.cov = n - k, None
        rss = model.augment(x).agg(F.sum((number(self.label) - F.col("fitted")) ** 2)).first()[0]
        if model.df > 0 and rss == rss:
            whole = m or moments(x, self.features, self.label)
            gram = whole.augmented() if self.intercept else whole.raw()[0]
            if np.linalg.matrix_rank(gram / np.sqrt(np.outer(np.diag(gram), np.diag(gram)))) == k:
                model.cov, model.mse = spd_inverse(gram), rss / model.df
        return model
