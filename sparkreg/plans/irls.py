"""Normal equations of a reweighting step."""

from __future__ import annotations

import numpy as np

from .moments import Moments


def normal_equations(m: Moments, intercept: bool, ridge: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Weighted Gram matrix of (1, x) and right side; ridge on the slopes."""
    if intercept:
        a = m.augmented()
        r = np.r_[m.s[-1] + m.sw * m.shift[-1], m.raw()[1]]
    else:
        a, r, _ = m.raw()
    a = a.copy()
    at = 1 if intercept else 0
    a[range(at, len(a)), range(at, len(a))] += ridge
    return a, r


def solve(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.maximum(np.diag(a), 1e-300))
    s = a / np.outer(d, d)
    try:
        return np.linalg.solve(s, r / d) / d
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(s, r / d, rcond=None)[0] / d
