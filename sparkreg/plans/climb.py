"""Limited-memory BFGS from several starts, as a generator: all starts and all step lengths of a round
are one request for heights and gradients."""

from __future__ import annotations

import math
from collections.abc import Callable, Generator

import numpy as np

MEMORY = 7
STEPS = (1.0, 0.3, 0.03)
#: A start this far below the best one after so many rounds is given up.
ROUNDS, BEHIND = 4, 1e-3


class Climber:
    """One start: where it is, what it remembers, and the points it wants to know next."""

    def __init__(self, x: np.ndarray, first: np.ndarray):
        self.x, self.first, self.f, self.g = np.array(x, dtype=float), first, -math.inf, None
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.converged = self.ended = self.dropped = False
        self.still = self.short = 0

    def direction(self) -> np.ndarray:
        """Two-loop recursion on the gradient of minus the height."""
        q = -self.g.copy()
        kept = []
        for s, y in reversed(self.pairs):
            a = s @ q / (s @ y)
            q -= a * y
            kept.append(a)
        q *= self.first
        if self.pairs:
            s, y = self.pairs[-1]
            q *= s @ y / (y @ (self.first * y))
        for (s, y), a in zip(self.pairs, reversed(kept), strict=True):
            q += s * (a - y @ q / (s @ y))
        return -q

    def wants(self) -> list[np.ndarray]:
        if self.g is None:
            return [self.x]
        d = self.direction()
        if not np.isfinite(d).all() or d @ self.g <= 0:
            self.pairs.clear()
            d = self.direction()
        return [self.x + t * d for t in STEPS]

    def told(self, points: list[np.ndarray], heights: list[tuple[float, np.ndarray]], tol: float) -> None:
        at = int(np.argmax([f for f, _ in heights]))
        f, g = heights[at]
        if self.g is None:
            self.f, self.g = f, g
            self.ended = not math.isfinite(f)
            return
        slope = float(np.sqrt(self.g**2 @ self.first))
        if not f > self.f:  # nothing is higher: first without what it remembers, then with shorter steps
            if self.pairs:
                self.pairs.clear()
            else:
                self.first = self.first / 30
                self.short += 1
            self.converged = slope < 1e-5
            self.ended = self.converged or self.short > 3
            return
        s, y = points[at] - self.x, self.g - g
        gain, self.x, self.f, self.g = f - self.f, points[at], f, g
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            self.pairs = [*self.pairs, (s, y)][-MEMORY:]
        self.still = self.still + 1 if gain < tol * max(1.0, abs(f)) else 0
        if self.still >= 2:
            self.ended = self.converged = True


def climb(heights: Callable[[list[np.ndarray]], Generator], starts: list[np.ndarray], first: np.ndarray, rounds: int = 200, tol: float = 1e-10) -> Generator:
    """The highest of the climbers; heights is a generator function of many points, of the order of one;
    first is the diagonal of an inverse curvature to begin with."""
    climbers = [Climber(x, first) for x in starts]
    for k in range(rounds):
        live = [c for c in climbers if not c.ended]
        if not live:
            break
        points = [c.wants() for c in live]
        found = iter((yield from heights([p for ps in points for p in ps])))
        for c, ps in zip(live, points, strict=True):
            c.told(ps, [next(found) for _ in ps], tol)
        top = max(c.f for c in climbers)
        if k >= ROUNDS:
            for c in live:
                if c.f < top - BEHIND * max(1.0, abs(top)):
                    c.ended = c.dropped = True
            # of climbers that have met, one goes on
            for i, c in enumerate(live):
                if any(not o.ended and np.allclose(o.x, c.x, rtol=1e-6, atol=1e-9) for o in live[:i]):
                    c.ended = c.dropped = True
    return max((c for c in climbers if not c.dropped), key=lambda c: c.f)
