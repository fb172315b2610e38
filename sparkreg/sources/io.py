"""Sources and sinks: frames from files or memory, and results as tables."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DimensionMismatch


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read(spark: SparkSession, path: str, schema: str | None = None, kind: str | None = None, **options) -> DataFrame:
    """Parquet, ORC, CSV or JSON, by the path's ending or kind; text formats take a schema."""
    kind = kind or path.rstrip("/").rpartition(".")[2].lower()
    reader = spark.read.options(**options)
    if schema:
        reader = reader.schema(schema)
    if kind == "csv":
        return reader.option("header", options.get("header", "true")).csv(path)
    return reader.format({"pq": "parquet", "ndjson": "json", "jsonl": "json"}.get(kind, kind)).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", partition_by: Iterable[str] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).format(kind).save(path)


def from_matrix(spark: SparkSession, x, y=None, weight=None, names: list[str] | None = None) -> DataFrame:
    """A frame of a row-major matrix, a response and weights: x1.., y, w, and row_id for their order."""
    x = np.asarray(x, dtype=float)
    x = x.reshape(len(x), -1)
    names = names or [f"x{j + 1}" for j in range(x.shape[1])]
    cols, data = list(names), [x[:, j] for j in range(x.shape[1])]
    for v, c in ((y, "y"), (weight, "w")):
        if v is not None:
            if len(v) != len(x):
                raise DimensionMismatch(f"{c} has {len(v)} values for {len(x)} rows")
            cols.append(c)
            data.append(np.asarray(v, dtype=float))
    rows = [(i, *map(float, r)) for i, r in enumerate(zip(*data, strict=True))]
    return spark.createDataFrame(rows, "row_id long, " + ", ".join(f"{c} double" for c in cols))


def from_vectors(df: DataFrame, column: str, size: int, prefix: str = "x") -> DataFrame:
    """An array column spread over columns x1.., without a detour through Python."""
    return df.select("*", *[F.get(F.col(column), F.lit(j)).cast("double").alias(f"{prefix}{j + 1}") for j in range(size)])
