"""Dense kernels on Gram matrices: everything after the aggregation is p x p."""

from __future__ import annotations

import numpy as np

from ..errors import ConvergenceFailed, SingularMatrix


def pivoted(gram: np.ndarray, tol: float = 1e-10) -> list[int]:
    """Columns of full rank, greedily by largest remaining norm (ties: lowest index)."""
    a = np.array(gram, dtype=float)
    first = np.diag(a).copy()
    rest = set(range(len(a)))
    keep: list[int] = []
    while rest:
        d = {j: a[j, j] for j in rest}
        j = min(rest, key=lambda i: (-d[i], i))
        if not d[j] > 0:
            break
        if d[j] <= tol * first[j]:
            rest.discard(j)
            continue
        keep.append(j)
        rest.discard(j)
        col = a[:, j] / np.sqrt(a[j, j])
        a = a - np.outer(col, col)
    return sorted(keep)


def spd_inverse(a: np.ndarray) -> np.ndarray:
    """Inverse of a positive definite matrix, scaled to a unit diagonal first."""
    if not len(a):
        return np.zeros((0, 0))
    d = np.sqrt(np.maximum(np.diag(a), 1e-300))
    try:
        inv = np.linalg.inv(a / np.outer(d, d))
    except np.linalg.LinAlgError as e:
        raise SingularMatrix("the design is singular") from e
    return inv / np.outer(d, d)


def least_squares(gram: np.ndarray, rhs: np.ndarray, tol: float = 1e-10) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Coefficients (NaN where aliased), kept columns, inverse over the kept ones."""
    keep = pivoted(gram, tol)
    inv = spd_inverse(gram[np.ix_(keep, keep)])
    beta = np.full(len(rhs), np.nan)
    beta[keep] = inv @ rhs[keep]
    # a step of refinement regains digits on ill-conditioned designs
    beta[keep] += inv @ (rhs[keep] - gram[np.ix_(keep, keep)] @ beta[keep])
    return beta, keep, inv


def elastic_net(gram: np.ndarray, rhs: np.ndarray, l1: float, l2: float, tol: float = 1e-10, steps: int = 10_000) -> np.ndarray:
    """Minimises b'Gb - 2 b'r + l2 b'b + l1 |b|_1 by coordinate descent."""
    b = np.zeros(len(rhs))
    for _ in range(steps):
        move = 0.0
        for j in range(len(b)):
            if gram[j, j] + l2 <= 0:
                continue
            rho = rhs[j] - gram[j] @ b + gram[j, j] * b[j]
            new = np.sign(rho) * max(abs(rho) - l1 / 2, 0) / (gram[j, j] + l2)
            move = max(move, abs(new - b[j]) * np.sqrt(max(gram[j, j], 1e-300)))
            b[j] = new
        if move < tol * max(1.0, np.sqrt(abs(rhs).max(initial=0))):
            return b
    raise ConvergenceFailed("coordinate descent did not converge")


def bounded(gram: np.ndarray, rhs: np.ndarray, lower: np.ndarray, upper: np.ndarray, steps: int = 1000) -> np.ndarray:
    """Least squares within bounds: active set with two-sided Karush-Kuhn-Tucker tests."""
    p = len(rhs)
    b = np.where(np.isfinite(lower), lower, np.where(np.isfinite(upper), upper, 0.0))
    free = ~(np.isfinite(lower) | np.isfinite(upper))
    scale = max(abs(rhs).max(initial=0), abs(gram).max(initial=0), 1e-300)
    for _ in range(steps):
        while free.any():
            at = np.flatnonzero(free)
            fixed = ~free
            r = rhs[at] - gram[np.ix_(at, np.flatnonzero(fixed))] @ b[fixed]
            z = np.linalg.lstsq(gram[np.ix_(at, at)], r, rcond=None)[0]
            low, high = z < lower[at] - 1e-12, z > upper[at] + 1e-12
            if not (low | high).any():
                b[at] = z
                break
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(low, (lower[at] - b[at]) / (z - b[at]), np.where(high, (upper[at] - b[at]) / (z - b[at]), np.inf))
            k = int(np.argmin(step))
            b[at] += max(0.0, step[k]) * (z - b[at])
            b[at[k]] = lower[at[k]] if low[k] else upper[at[k]]
            free[at[k]] = False
        g = rhs - gram @ b
        up = ~free & (b <= lower) & (b < upper) & (g > 1e-10 * scale)
        down = ~free & (b >= upper) & (b > lower) & (g < -1e-10 * scale)
        if not (up | down).any():
            return np.clip(b, lower, upper)
        free[int(np.argmax(np.where(up | down, abs(g), -1)))] = True
    raise ConvergenceFailed("the active set did not settle")


def simpls(sxx: np.ndarray, sxy: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(beta, weights, loadings, y loadings) of SIMPLS with one response, from moments alone."""
    s = sxy.astype(float).copy()
    w, pl, q, v = [], [], [], []
    for _ in range(min(components, len(sxy))):
        r = s.copy()
        norm = np.sqrt(max(r @ sxx @ r, 0))
        if norm < 1e-14:
            break
        r /= norm
        p = sxx @ r
        base = p.copy()
        for u in v:
            base -= u * (u @ p)
        size = np.linalg.norm(base)
        w.append(r)
        pl.append(p)
        q.append(r @ sxy)
        if size < 1e-14:
            break
        base /= size
        v.append(base)
        s = s - base * (base @ s)
    w, pl, q = np.array(w).T.reshape(len(sxy), -1), np.array(pl).T.reshape(len(sxy), -1), np.array(q)
    return (w @ q if len(q) else np.zeros(len(sxy))), w, pl, q


def lars(gram: np.ndarray, rhs: np.ndarray, lasso: bool = False, alpha: float = 0.0, max_features: int | None = None) -> tuple[np.ndarray, list[float], list[np.ndarray]]:
    """Least angle regression on moments: coefficients, and the path as penalties (the largest
    absolute correlation) and coefficients. lasso: variables leave where they reach zero, the step
    after a departure admits none, and the path ends at alpha."""
    p = len(rhs)
    beta, active, dropped = np.zeros(p), [], None
    alphas, path = [], []
    limit = min(max_features or p, p)
    eps = 1e-12 * max(abs(rhs).max(initial=0), 1e-300)
    shut = {j for j in range(p) if gram[j, j] <= 0}
    for _ in range(16 * p + 16):
        c = rhs - gram @ beta
        big = abs(c).max(initial=0)
        alphas.append(float(big))
        path.append(beta.copy())
        if big <= max(alpha if lasso else 0.0, 0.0) + eps:
            break
        if dropped is None:
            if len(active) >= limit:
                break
            rest = [j for j in range(p) if j not in active and j not in shut]
            if not rest:
                break
            j = max(rest, key=lambda i: (abs(c[i]), -i))
            if len(pivoted(gram[np.ix_([*active, j], [*active, j])])) == len(active):
                shut.add(j)
                alphas.pop()
                path.pop()
                continue
            active.append(j)
        d = np.linalg.solve(gram[np.ix_(active, active)], np.sign(c[active]))
        a = gram[:, active] @ d
        step = big
        for j in range(p):
            if j in active or j in shut:
                continue
            for num, den in ((big - c[j], 1 - a[j]), (big + c[j], 1 + a[j])):
                if den > 1e-14 and eps < num / den < step:
                    step = num / den
        dropped = None
        if lasso:
            for k, j in enumerate(active):
                if d[k] and 1e-14 < -beta[j] / d[k] < step:
                    step, dropped = -beta[j] / d[k], j
            if big - step <= alpha:
                step, dropped = big - alpha, None
        beta[active] += step * d
        if dropped is not None:
            beta[dropped] = 0.0
            active.remove(dropped)
    return beta, alphas, path


def spatial_median(points: np.ndarray, tol: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Weiszfeld's iteration with Vardi and Zhang's step where it meets a point."""
    if points.shape[1] == 1:
        return np.median(points, axis=0)
    at = points.mean(axis=0)
    for _ in range(steps):
        d = points - at
        dist = np.sqrt((d * d).sum(axis=1))
        away = dist >= 1e-12
        if not away.any():
            break
        w = 1 / dist[away]
        new = (points[away] * w[:, None]).sum(axis=0) / w.sum()
        if not away.all():
            r = np.linalg.norm((d[away] * w[:, None]).sum(axis=0))
            share = min(1.0, (~away).sum() / r) if r > 0 else 1.0
            new = (1 - share) * new + share * at
        moved = np.linalg.norm(new - at)
        at = new
        if moved < tol * 1e-6:
            break
    return at


def pava(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted increasing fit by pooling adjacent violators, with a stack of blocks."""
    value, weight, size = [], [], []
    for v, u in zip(y.tolist(), w.tolist(), strict=True):
        n = 1
        while value and value[-1] > v:
            total = weight[-1] + u
            v = (value.pop() * weight[-1] + v * u) / total if total else v
            u, n = total, n + size.pop()
            weight.pop()
        value.append(v)
        weight.append(u)
        size.append(n)
    return np.repeat(value, size)


def least_check(x: np.ndarray, y: np.ndarray, c: np.ndarray, tau: float, g: np.ndarray, b: np.ndarray, most: int = 10_000) -> np.ndarray:
    """Coefficients v that minimise the check loss of y - xv with weights c plus gv, of few rows: from
    the vertex near b along edges, each as far as the loss falls. Ties are broken by a slight shift of y."""
    n, k = x.shape
    z = y + 1e-11 * np.abs(y).max(initial=0.0) * np.random.default_rng(42).uniform(-1, 1, n)
    basis: list[int] = []
    for i in np.argsort(np.abs(z - x @ b), kind="stable"):
        if np.linalg.matrix_rank(x[[*basis, i]]) > len(basis):
            basis.append(int(i))
            if len(basis) == k:
                break
    else:
        return b
    for _ in range(most):
        back = np.linalg.inv(x[basis])
        r = z - x @ (back @ z[basis])
        r[basis] = 0.0
        move = x @ back
        side = c * np.where(r > 0, tau, tau - 1)
        side[basis] = 0.0
        slope = g @ back - side @ move
        # either way along each edge: the row that is left pays by its side
        ways = np.r_[slope + c[basis] * (1 - tau), c[basis] * tau - slope]
        j = int(np.argmin(ways))
        u = (1 if j < k else -1) * move[:, j % k]
        if ways[j] >= -1e-12 * (c @ np.abs(u)):
            break
        met = np.flatnonzero(r * u > 0)
        if not len(met):
            break
        met = met[np.argsort(r[met] / u[met], kind="stable")]
        at = int(np.searchsorted(ways[j] + np.cumsum(c[met] * np.abs(u[met])), 0.0))
        basis[j % k] = int(met[min(at, len(met) - 1)])
        if at >= len(met):  # it falls beyond all rows
            break
    return np.linalg.solve(x[basis], y[basis])
