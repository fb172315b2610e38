"""What the operators share: the shared folder, written intermediate tables, partition counts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import math
import shutil
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def released(run):
    """run (batches -> batches), giving what it freed back to the system when it ends: workers are kept
    for later tasks, and what an idle one holds counts against its executor."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim:
                trim(0)

    return wrapped


def slices(batch: pa.RecordBatch, rows: int = 256) -> list[pa.RecordBatch]:
    """A batch in parts, so that few of its texts are Python objects at once."""
    return [batch.slice(k, rows) for k in range(0, len(batch), rows)]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. Only where that is unset
    (tests in local mode) one of our own is made and set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="sparkreg-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sparkreg_path = path
    remember(spark, path)
    return out


_LEFT: dict[str, SparkSession] = {}


def remember(spark: SparkSession, path: str) -> None:
    """Has a folder that a lazy result still reads deleted when the driver ends, if not before."""
    if not _LEFT:
        atexit.register(lambda: [delete(s, p) for p, s in list(_LEFT.items())])
    _LEFT[path] = spark


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system; at the driver's end, if its JVM still answers."""
    _LEFT.pop(path, None)
    with contextlib.suppress(Py4JError, OSError, AttributeError):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of materialize() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_sparkreg_path", None)
        if path:
            delete(df.sparkSession, path)


def shuffles_go(spark: SparkSession) -> None:
    """Shuffle files of a finished job leave the executors' disks when the driver's JVM collects its
    garbage; this asks for it once what they were for is written."""
    gc.collect()
    spark._jvm.System.gc()


def parts(df: DataFrame, rows: int, rows_each: int) -> int:
    """Shuffle partitions for so many rows: at least what the session is set to, more as data grow."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / rows_each))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
