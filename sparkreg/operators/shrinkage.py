"""Estimators that need cross products only: elastic net, bounded least squares, PLS, LARS, Bayes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidOptions, SingularMatrix
from ..plans.moments import Moments
from ..plans.solve import bounded, elastic_net, lars, simpls, spd_inverse
from .base import Fit, GramEstimator, Model, number, total
from .linear import Ridge, centred_tss, full_cov, gram_of, residual_ss, with_intercept


def finish(est: GramEstimator, m: Moments, beta: np.ndarray, k: int, cov=None, extra=None, kept=None) -> Fit:
    o = est.options
    sxx, sxy, syy = gram_of(m, o.intercept)
    rss = residual_ss(syy, sxx, sxy, beta)
    mse = rss / (m.n - k) if m.n > k else np.nan
    kept = list(range(m.p)) if kept is None else kept
    return Fit(beta, with_intercept(m, beta, o.intercept), m.n, k, rss, centred_tss(m), mse, cov, kept, o, extra or {}).describe()


class ElasticNet(GramEstimator):
    """Minimises |y - Xb|^2 + lam (1 - alpha) |b|^2 + lam alpha |b|_1 by coordinate descent on the
    Gram matrix; alpha = 0 is ridge. compat='one_shot' thresholds the smooth solution once instead."""

    def __init__(self, features, label, lam: float, alpha: float = 0.5, compat: str | None = None, **options):
        super().__init__(features, label, lam=lam, alpha=alpha, **options)
        if compat not in (None, "one_shot"):
            raise InvalidOptions("compat must be None or 'one_shot'")
        self.compat = compat

    def solve(self, m: Moments) -> Fit:
        o = self.options
        if o.alpha == 0:
            return Ridge.solve(self, m)
        lam = Ridge.penalty(self, m)
        sxx, sxy, _ = gram_of(m, o.intercept)
        l1, l2 = lam * o.alpha, lam * (1 - o.alpha)
        if self.compat:
            beta = np.linalg.lstsq(sxx + l2 * np.eye(m.p), sxy, rcond=None)[0]
            beta = np.sign(beta) * np.maximum(abs(beta) - l1, 0)
        else:
            beta = elastic_net(sxx, sxy, l1, l2, steps=max(o.max_iterations, 10_000))
        beta = np.where(abs(beta) < 1e-10, 0.0, beta)
        active = [j for j in range(m.p) if beta[j] != 0]
        k = len(active) + (1 if o.intercept else 0)
        inv = spd_inverse(sxx[np.ix_(active, active)] + l2 * np.eye(len(active)))
        fit = finish(self, m, beta, k, full_cov(m, active, inv, o.intercept), kept=active)
        return fit

    penalty = Ridge.penalty


class Lasso(ElasticNet):
    def __init__(self, features, label, lam: float, **options):
        super().__init__(features, label, lam, 1.0, **options)


class BLS(GramEstimator):
    """Least squares with box bounds on the slopes; the intercept is free. A single bound holds for
    all slopes. The true constrained optimum: both Karush-Kuhn-Tucker directions are tested."""

    def __init__(self, features, label, lower=None, upper=None, **options):
        super().__init__(features, label, **options)
        p = len(features)
        wide = lambda b, d: np.full(p, d) if b is None else np.broadcast_to(np.asarray(b, dtype=float), (p,)).copy()
        self.lower, self.upper = wide(lower, -np.inf), wide(upper, np.inf)
        if (self.lower > self.upper).any():
            raise InvalidOptions("a lower bound is above its upper bound")

    def solve(self, m: Moments) -> Fit:
        sxx, sxy, _ = gram_of(m, self.options.intercept)
        beta = bounded(sxx, sxy, self.lower, self.upper)
        return finish(self, m, beta, m.p + (1 if self.options.intercept else 0))


class NNLS(BLS):
    """Slopes of at least zero."""

    def __init__(self, features, label, **options):
        options.setdefault("intercept", False)
        super().__init__(features, label, lower=0.0, **options)


class PLSModel(Model):
    def transform_scores(self, df: DataFrame, prefix: str = "t") -> DataFrame:
        """df with the scores of each component."""
        e = self.fit.extra
        x = [(number(f) - F.lit(float(c))) / F.lit(float(s)) for f, c, s in zip(self.features, e["centre"], e["scale"], strict=True)]
        w = e["weights"]
        return df.withColumns({f"{prefix}{a}": total([x[j] * F.lit(float(w[j, a])) for j in range(len(x))]) for a in range(w.shape[1])})

    def explained_variance(self) -> list[float]:
        """Shares of the scores' variance: scores have unit norm, so that shares are equal."""
        k = self.fit.extra["weights"].shape[1]
        return [1 / k] * k if k else []


class PLS(GramEstimator):
    """Partial least squares (SIMPLS) with one response, always about the means."""

    model = PLSModel

    def __init__(self, features, label, n_components: int, scale: bool = False, **options):
        super().__init__(features, label, **options)
        if n_components < 1:
            raise InvalidOptions("n_components must be at least 1")
        self.n_components, self.scale = n_components, scale

    def solve(self, m: Moments) -> Fit:
        sxx, sxy, _ = m.centred()
        s = np.sqrt(np.diag(sxx) / max(m.n - 1, 1)) if self.scale else np.ones(m.p)
        s = np.where(s > 1e-14, s, 1.0)
        k = min(self.n_components, m.n, m.p)
        beta, w, pl, q = simpls(sxx / np.outer(s, s), sxy / s, k)
        beta = beta / s
        used = w.shape[1]
        mx, my = m.means()
        extra = {"weights": w, "loadings": pl, "y_loadings": q, "centre": mx, "scale": s, "n_components": used}
        fit = finish(self, m, beta, used + 1, extra=extra)
        fit.intercept = float(my - beta @ mx)
        return fit


class LARS(GramEstimator):
    """Least angle regression; penalties are largest absolute correlations, not divided by n."""

    lasso = False

    def __init__(self, features, label, n_nonzero_coefs: int | None = None, standardize: bool = False, alpha_stop: float = 0.0, **options):
        super().__init__(features, label, **options)
        self.limit, self.standardize, self.alpha_stop = n_nonzero_coefs, standardize, alpha_stop

    def solve(self, m: Moments) -> Fit:
        sxx, sxy, _ = gram_of(m, self.options.intercept)
        s = np.sqrt(np.maximum(np.diag(sxx), 1e-300)) if self.standardize else np.ones(m.p)
        beta, alphas, path = lars(sxx / np.outer(s, s), sxy / s, self.lasso, self.alpha_stop, self.limit)
        extra = {"alphas": alphas, "path": [b / s for b in path]}
        k = int((beta != 0).sum()) + (1 if self.options.intercept else 0)
        return finish(self, m, beta / s, k, extra=extra)


class LassoLars(LARS):
    lasso = True

    def __init__(self, features, label, alpha_stop: float = 0.0, standardize: bool = False, **options):
        super().__init__(features, label, None, standardize, alpha_stop, **options)


class BayesianRidge(GramEstimator):
    """Evidence maximisation over the noise precision alpha and one weight precision lambda."""

    def __init__(self, features, label, alpha_1=1e-6, alpha_2=1e-6, lambda_1=1e-6, lambda_2=1e-6, max_iter: int = 300, tol: float = 1e-3, **options):
        super().__init__(features, label, **options)
        self.prior = (alpha_1, alpha_2, lambda_1, lambda_2)
        self.max_iter, self.tol = max_iter, tol

    def solve(self, m: Moments) -> Fit:
        a1, a2, l1, l2 = self.prior
        sxx, sxy, syy = gram_of(m, self.options.intercept)
        eig, u = np.linalg.eigh(sxx)
        eig = np.maximum(eig, 0)
        r = u.T @ sxy
        tss = max(m.centred()[2], 0)
        if tss <= 0:
            raise SingularMatrix("the response does not vary")
        alpha, lam = m.n / tss, 1.0
        beta = np.zeros(m.p)
        for _ in range(self.max_iter):
            new = u @ (r / (eig + lam / alpha))
            rss = residual_ss(syy, sxx, sxy, new)
            gamma = float((alpha * eig / (lam + alpha * eig)).sum())
            lam = (gamma + 2 * l1) / (float(new @ new) + 2 * l2)
            alpha = (m.n - gamma + 2 * a1) / (rss + 2 * a2)
            moved = abs(new - beta).sum()
            beta = new
            if moved < self.tol:
                break
        beta = u @ (r / (eig + lam / alpha))
        sigma = (u / (lam + alpha * eig)) @ u.T
        extra = {"alpha": alpha, "lambda": lam, "sigma": sigma, "sigma_diag": np.diag(sigma)}
        return finish(self, m, beta, m.p + (1 if self.options.intercept else 0), extra=extra)


class ARD(GramEstimator):
    """Automatic relevance determination: a precision for each weight; weights whose precision
    reaches threshold_lambda are pruned."""

    def __init__(self, features, label, alpha_1=1e-6, alpha_2=1e-6, lambda_1=1e-6, lambda_2=1e-6, threshold_lambda: float = 1e4, max_iter: int = 300, tol: float = 1e-3, **options):
        super().__init__(features, label, **options)
        self.prior = (alpha_1, alpha_2, lambda_1, lambda_2)
        self.threshold, self.max_iter, self.tol = threshold_lambda, max_iter, tol

    def solve(self, m: Moments) -> Fit:
        a1, a2, l1, l2 = self.prior
        sxx, sxy, syy = gram_of(m, self.options.intercept)
        tss = max(m.centred()[2], 0)
        if tss <= 0:
            raise SingularMatrix("the response does not vary")
        alpha, lam = m.n / tss, np.ones(m.p)
        keep = np.ones(m.p, dtype=bool)
        beta = np.zeros(m.p)

        def posterior():
            at = np.flatnonzero(keep)
            sigma = spd_inverse(alpha * sxx[np.ix_(at, at)] + np.diag(lam[at]))
            out = np.zeros(m.p)
            out[at] = alpha * sigma @ sxy[at]
            return out, sigma, at

        for _ in range(self.max_iter):
            new, sigma, at = posterior()
            gamma = 1 - lam[at] * np.diag(sigma)
            lam[at] = (gamma + 2 * l1) / (new[at] ** 2 + 2 * l2)
            alpha = (m.n - gamma.sum() + 2 * a1) / (residual_ss(syy, sxx, sxy, new) + 2 * a2)
            keep = lam < self.threshold
            new[~keep] = 0
            moved = abs(new - beta).sum()
            beta = new
            if moved < self.tol or not keep.any():
                break
        if keep.any():
            beta, sigma, at = posterior()
            diag = np.zeros(m.p)
            diag[at] = np.diag(sigma)
        else:
            diag = np.zeros(m.p)
        extra = {"alpha": alpha, "lambda": lam, "sigma_diag": diag, "kept": keep}
        return finish(self, m, beta, int(keep.sum()) + (1 if self.options.intercept else 0), extra=extra)


# ---- P-spline


def knots(lo: float, hi: float, p: int, degree: int = 3) -> np.ndarray:
    inner = np.linspace(lo, hi, p - degree + 1)
    return np.r_[[lo] * degree, inner, [hi] * degree]


def basis_column(x: Column, t: np.ndarray, j: int, degree: int = 3) -> Column:
    """The j-th B-spline at x as an expression: a cubic in x on each of at most four intervals."""
    out = None
    for a in range(j, j + degree + 1):
        if t[a + 1] <= t[a]:
            continue
        poly = _piece(t, j, degree, a)
        width = t[a + 1] - t[a]
        u = (x - F.lit(float(t[a]))) / F.lit(float(width))
        value = F.lit(float(poly[-1]))
        for c in poly[-2::-1]:
            value = value * u + F.lit(float(c))
        last = t[a + 1] >= t[-1]
        inside = (x >= F.lit(float(t[a]))) & ((x <= F.lit(float(t[a + 1]))) if last else (x < F.lit(float(t[a + 1]))))
        out = F.when(inside, value) if out is None else out.when(inside, value)
    return F.lit(0.0) if out is None else out.otherwise(F.lit(0.0))


def _piece(t: np.ndarray, j: int, k: int, a: int) -> np.ndarray:
    """Coefficients in u = (x - t[a]) / (t[a+1] - t[a]) of B-spline j of degree k on interval a."""
    if k == 0:
        return np.array([1.0 if j == a else 0.0])
    h = t[a + 1] - t[a]
    out = np.zeros(k + 1)
    if t[j + k] > t[j]:
        d = t[j + k] - t[j]
        out += np.polynomial.polynomial.polymul(_piece(t, j, k - 1, a), [(t[a] - t[j]) / d, h / d])
    if t[j + k + 1] > t[j + 1]:
        d = t[j + k + 1] - t[j + 1]
        out += np.polynomial.polynomial.polymul(_piece(t, j + 1, k - 1, a), [(t[j + k + 1] - t[a]) / d, -h / d])
    return out


class PSplineModel:
    def __init__(self, feature, label, t, beta, cov, sigma2, edf, lam, n, gcv, lo, hi):
        self.feature, self.label, self.t, self.coefficients = feature, label, t, beta
        self.cov, self.sigma2, self.edf, self.lam, self.n, self.gcv = cov, sigma2, edf, lam, n, gcv
        self.lo, self.hi = lo, hi

    def basis(self) -> list[Column]:
        x = F.greatest(F.lit(float(self.lo)), F.least(F.lit(float(self.hi)), number(self.feature)))
        return [F.when(number(self.feature).isNotNull(), basis_column(x, self.t, j)) for j in range(len(self.coefficients))]

    def predict(self) -> Column:
        return total([b * F.lit(float(v)) for b, v in zip(self.basis(), self.coefficients, strict=True)])

    def transform(self, df: DataFrame, output: str = "prediction", level: float | None = None) -> DataFrame:
        """With a level, also a confidence band."""
        if level is None:
            return df.withColumn(output, self.predict())
        from ..functions.special import t_ppf

        p = len(self.coefficients)
        df = df.withColumn("_b", F.array(*self.basis()))
        b = F.col("_b")
        var = total([b[i] * b[j] * F.lit(float(self.cov[i, j] * (1 if i == j else 2))) for i in range(p) for j in range(i, p)])
        fit = total([b[j] * F.lit(float(self.coefficients[j])) for j in range(p)])
        crit = t_ppf(0.5 + level / 2, max(self.n - self.edf, 1e-9))
        df = df.withColumn(output, fit).withColumn(f"{output}_se", F.sqrt(F.greatest(var, F.lit(0.0)) * F.lit(float(self.sigma2))))
        return df.withColumn(f"{output}_lower", F.col(output) - crit * F.col(f"{output}_se")).withColumn(f"{output}_upper", F.col(output) + crit * F.col(f"{output}_se")).drop("_b")


class PSpline:
    """Penalised cubic B-spline of one feature: second differences penalised, the penalty chosen by
    generalised cross-validation on a grid; x is clamped to the fitted range."""

    def __init__(self, feature: str, label: str, n_basis: int | None = None, lam: float | None = None):
        self.feature, self.label, self.n_basis, self.lam = feature, label, n_basis, lam

    def fit(self, df: DataFrame) -> PSplineModel:
        from .. import na
        from ..plans.moments import moments

        df = na.process(df, [self.feature, self.label])
        lo, hi, n = df.agg(F.min(number(self.feature)), F.max(number(self.feature)), F.count("*")).first()
        if n < 5 or not hi > lo:
            raise SingularMatrix("a spline needs five rows and a feature that varies")
        p = min(max(n // 4 + 4, 6), 40, n - 1) if self.n_basis is None else self.n_basis
        t = knots(lo, hi, p)
        names = [f"b{j}" for j in range(p)]
        x = number(self.feature)
        m = moments(
            df.select(*[basis_column(x, t, j).alias(names[j]) for j in range(p)], number(self.label).alias("y")), names, "y",
            shift=np.zeros(p + 1),
        )
        btb, bty, yy = m.raw()
        d = np.diff(np.eye(p), 2, axis=0)
        pen = d.T @ d
        scale = np.trace(btb) / np.trace(pen)
        best = None
        for e in [math.log10(self.lam / scale)] if self.lam else np.arange(-8, 9):
            lam = 10.0**e * scale
            inv = np.linalg.pinv(btb + lam * pen)
            beta = inv @ bty
            edf = float(np.trace(inv @ btb))
            rss = max(float(yy - 2 * beta @ bty + beta @ btb @ beta), 0.0)
            gcv = n * rss / (n - edf) ** 2 if n > edf else math.inf
            if best is None or gcv < best[0]:
                best = (gcv, lam, beta, inv, edf, rss)
        gcv, lam, beta, inv, edf, rss = best
        return PSplineModel(self.feature, self.label, t, beta, inv @ btb @ inv, rss / max(n - edf, 1e-9), edf, lam, n, gcv, lo, hi)
