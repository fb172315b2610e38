"""Tables in the folder that executors share, which cut the lineage of iterations."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_LEFT: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only in local mode where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="sparkreg-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df, written and read back. It stays until dropped() or the driver's end."""
    spark = df.sparkSession
    path = f"{folder(spark)}/state-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    if not _LEFT:
        atexit.register(lambda: [_delete(s, p) for p, s in list(_LEFT.items())])
    _LEFT[path] = spark
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    path = getattr(df, "_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    _LEFT.pop(path, None)
    with contextlib.suppress(Py4JError, OSError, AttributeError):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
