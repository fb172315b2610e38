"""Online fitting with Structured Streaming: moments as a streaming aggregation, and recursive least
squares and passive-aggressive regression as keyed state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..errors import InvalidOptions
from ..operators.base import number
from ..operators.robust import pa_step
from ..plans.moments import Moments, aggregates, from_row

RLS_START = 1e6


def streaming_moments(stream: DataFrame, keys: list, features: list[str], label: str, weight: str | None = None, shift: np.ndarray | None = None) -> DataFrame:
    """Running sums by key (columns or windows): an ordinary streaming aggregation, so that state is
    one short row a key, and watermarks, update and complete mode work as for any other."""
    shift = np.zeros(len(features) + 1) if shift is None else shift
    return stream.groupBy(*keys).agg(*aggregates([*features, label], weight, shift))


def window_moments(stream: DataFrame, time: str, width: str, features: list[str], label: str, late: str, slide: str | None = None, keys: list[str] | None = None, session: bool = False) -> DataFrame:
    """Moments by event-time window (tumbling, sliding by slide, or a session that ends after a gap of
    width) and keys, for append mode: a window comes out once, when no row within `late` of the newest
    one can fall into it, and its state goes. Rows that come later than that are not counted into any
    window; dropped_late() tells how many they were."""
    if session and slide:
        raise InvalidOptions("a session window has no slide")
    window = F.session_window(time, width) if session else F.window(time, width, slide) if slide else F.window(time, width)
    out = streaming_moments(stream.withWatermark(time, late), [window.alias("span"), *(keys or [])], features, label)
    return out.withColumns({"start": F.col("span.start"), "end": F.col("span.end")}).drop("span")


def dropped_late(query: StreamingQuery) -> int:
    """Rows that a query's stateful operators left out as later than its watermark, so far."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


def moments_of(row, p: int, shift: np.ndarray | None = None) -> Moments:
    """Moments of a collected row of streaming_moments()."""
    d = row.asDict() if hasattr(row, "asDict") else row
    return from_row(d, p + 1, np.zeros(p + 1) if shift is None else shift)


def merge_moments(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Stored sums of the same shift, added by key: moments as a materialised view."""
    names = [c for c in a.columns if c.startswith("_")]
    return a.unionByName(b).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])


class RlsState:
    """Coefficients (the intercept first) and P of one series."""

    def __init__(self, p: int, intercept: bool = True):
        k = p + (1 if intercept else 0)
        self.b, self.p, self.intercept = np.zeros(k), np.eye(k) * RLS_START, intercept

    def update(self, x: np.ndarray, y: float, forgetting: float = 1.0) -> float:
        """One step; returns the prediction before it."""
        v = np.r_[1.0, x] if self.intercept else np.asarray(x, dtype=float)
        before = float(v @ self.b)
        pv = self.p @ v
        gain = pv / (forgetting + v @ pv)
        self.b = self.b + gain * (y - before)
        self.p = (self.p - np.outer(gain, pv)) / forgetting
        return before

    def dump(self) -> str:
        return json.dumps([self.b.tolist(), self.p.tolist(), self.intercept])

    @classmethod
    def load(cls, text: str) -> RlsState:
        b, p, intercept = json.loads(text)
        out = cls(0, False)
        out.b, out.p, out.intercept = np.array(b), np.array(p), intercept
        return out


def _keyed(stream: DataFrame, keys: list[str], order: list[str], features: list[str], label: str, step: Callable) -> DataFrame:
    x = stream.select(*keys, *order, *[number(c).alias(f"_v{i}") for i, c in enumerate([*features, label])])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema if f.name in [*keys, *order])
    names = [f"_v{i}" for i in range(len(features) + 1)]

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        pdf = pd.concat(list(pdfs)).sort_values(order)
        z = pdf[names].to_numpy(dtype=float)
        fits, coefs = [], []
        for row in z:
            if np.isnan(row).any():
                fits.append(np.nan)
                coefs.append(coefs[-1] if coefs else [])
                continue
            now, before, b = step(now, row[:-1], row[-1])
            fits.append(before)
            coefs.append(b)
        if now is not None:
            state.update((now,))
        yield pdf[[*keys, *[c for c in order if c not in keys]]].assign(prediction=fits, coefficients=coefs)

    return x.groupBy(*keys).applyInPandasWithState(run, f"{kept}, prediction double, coefficients array<double>", "state string", "append", GroupStateTimeout.NoTimeout)


def streaming_rls(stream: DataFrame, keys: list[str], order_by: list[str], features: list[str], label: str, forgetting: float = 1.0, intercept: bool = True) -> DataFrame:
    """Each row with the prediction made before it was learnt and the coefficients after; rows of a
    micro-batch are taken in order."""

    def step(now, x, y):
        s = RlsState.load(now) if now else RlsState(len(x), intercept)
        before = s.update(x, y, forgetting)
        return s.dump(), before, s.b.tolist()

    return _keyed(stream, keys, order_by, features, label, step)


def streaming_pa(stream: DataFrame, keys: list[str], order_by: list[str], features: list[str], label: str, c: float = 1.0, epsilon: float = 0.1, variant: str = "pa1") -> DataFrame:
    """partial_fit of a passive-aggressive model, row by row."""

    def step(now, x, y):
        w, b = json.loads(now) if now else ([0.0] * len(x), 0.0)
        w = np.array(w)
        before = float(w @ x + b)
        w, b, _ = pa_step(w, b, x, y, c, epsilon, variant)
        return json.dumps([w.tolist(), b]), before, [b, *w.tolist()]

    return _keyed(stream, keys, order_by, features, label, step)
