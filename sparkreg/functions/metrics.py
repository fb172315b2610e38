"""Forecast and fit metrics, as aggregate Columns: use them in agg(), per group, in cube or rollup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def mae(y: str, fit: str) -> Column:
    return F.avg(F.abs(F.col(y) - F.col(fit)))


def mse(y: str, fit: str) -> Column:
    d = F.col(y) - F.col(fit)
    return F.avg(d * d)


def rmse(y: str, fit: str) -> Column:
    return F.sqrt(mse(y, fit))


def mape(y: str, fit: str) -> Column:
    """In percent; rows with y = 0 do not count."""
    return 100 * F.avg(F.when(F.col(y) != 0, F.abs((F.col(y) - F.col(fit)) / F.col(y))))


def smape(y: str, fit: str) -> Column:
    """In percent of the mean of both sizes; rows where both are 0 do not count."""
    size = F.abs(F.col(y)) + F.abs(F.col(fit))
    return 100 * F.avg(F.when(size > 0, 2 * F.abs(F.col(y) - F.col(fit)) / size))


def mase(y: str, fit: str, naive_step: str) -> Column:
    """Scaled by the mean absolute one-step change, a column made by naive_step()."""
    return mae(y, fit) / F.avg(F.abs(F.col(naive_step)))


def naive_step(y: str, order: list[str], keys: list[str] | None = None) -> Column:
    """y minus the value before it in its series. keys part the series; without keys all rows are one series."""
    w = Window.partitionBy(*(keys or [])).orderBy(*order)
    return F.col(y) - F.lag(y).over(w)


def pinball_loss(y: str, fit: str, tau: float) -> Column:
    d = F.col(y) - F.col(fit)
    return F.avg(F.when(d >= 0, tau * d).otherwise((tau - 1) * d))
