"""Estimator options, always validated."""

from __future__ import annotations

from dataclasses import dataclass, replace

from .errors import InvalidOptions

NA_ACTIONS = ("omit", "exclude", "fail", "pass")
SOLVERS = ("qr", "svd", "cholesky")
SCALINGS = ("raw", "glmnet")


@dataclass(frozen=True)
class RegressionOptions:
    intercept: bool = True
    inference: bool = True
    confidence: float = 0.95
    lam: float = 0.0
    alpha: float = 0.0
    scaling: str = "raw"
    forgetting: float = 1.0
    solver: str = "qr"
    max_iterations: int = 1000
    tolerance: float = 1e-6
    rank_tolerance: float = 1e-10
    na_action: str = "omit"

    def __post_init__(self):
        checks = [
            (self.lam >= 0, "lam must not be negative"),
            (0 <= self.alpha <= 1, "alpha must lie in [0, 1]"),
            (0 < self.confidence < 1, "confidence must lie in (0, 1)"),
            (0 < self.forgetting <= 1, "forgetting must lie in (0, 1]"),
            (self.tolerance > 0 and self.rank_tolerance > 0, "tolerances must be positive"),
            (self.max_iterations >= 1, "max_iterations must be at least 1"),
            (self.alpha == 0 or self.lam > 0, "alpha > 0 needs lam > 0"),
            (self.scaling in SCALINGS, f"scaling must be one of {SCALINGS}"),
            (self.solver in SOLVERS, f"solver must be one of {SOLVERS}"),
            (self.na_action in NA_ACTIONS, f"na_action must be one of {NA_ACTIONS}"),
        ]
        for fine, message in checks:
            if not fine:
                raise InvalidOptions(message)

    def with_(self, **changes) -> RegressionOptions:
        return replace(self, **changes)

    @classmethod
    def ols(cls, **kw) -> RegressionOptions:
        return cls(**kw)

    @classmethod
    def ridge(cls, lam: float, **kw) -> RegressionOptions:
        return cls(lam=lam, **kw)

    @classmethod
    def lasso(cls, lam: float, **kw) -> RegressionOptions:
        return cls(lam=lam, alpha=1.0, **kw)

    @classmethod
    def elastic_net(cls, lam: float, alpha: float, **kw) -> RegressionOptions:
        return cls(lam=lam, alpha=alpha, **kw)

    @classmethod
    def rls(cls, forgetting: float, **kw) -> RegressionOptions:
        return cls(forgetting=forgetting, **kw)
