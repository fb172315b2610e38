"""Missing values: NULL and NaN alike, by row over all columns a fit reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import AllNa, InvalidOptions, NaValuesPresent


def is_na(name: str) -> Column:
    c = F.col(name).cast("double")
    return c.isNull() | F.isnan(c)


def na_row(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, map(is_na, columns))


def count_na(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: NA counts of each column, of rows, and rows in all."""
    return df.agg(
        *[F.coalesce(F.sum(is_na(c).cast("long")), F.lit(0)).alias(c) for c in columns],
        F.coalesce(F.sum(na_row(columns).cast("long")), F.lit(0)).alias("na_rows"),
        F.count("*").alias("n_rows"),
    )


def has_na(df: DataFrame, columns: list[str]) -> bool:
    return not df.filter(na_row(columns)).isEmpty()


def process(df: DataFrame, columns: list[str], action: str = "omit") -> DataFrame:
    """omit and exclude keep complete rows (exclude: predictions later cover all rows, NULL where
    incomplete); fail raises where any row is incomplete; pass keeps all rows."""
    if action == "pass":
        return df
    if action == "fail":
        if has_na(df, columns):
            raise NaValuesPresent("missing values in " + ", ".join(columns))
        return df
    if action not in ("omit", "exclude"):
        raise InvalidOptions(f"no such na_action: {action}")
    return df.filter(~na_row(columns))


def expanded(df: DataFrame, columns: list[str], values: dict[str, Column]) -> DataFrame:
    """df with values where all of columns are present and NULL elsewhere: what a fit that left rows out
    says of them (fitted values, residuals, standard errors), in the place of every row."""
    whole = ~na_row(columns)
    return df.withColumns({name: F.when(whole, v) for name, v in values.items()})


def require_rows(n: int, n_all: int | None = None) -> None:
    if n == 0 and n_all:
        raise AllNa("every row has a missing value")
