"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where that is unset (tests on one machine) a folder of our own."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        have = f"file://{tempfile.gettempdir()}/loomgraph-shared"
        spark.conf.set("spark.checkpoint.dir", have)
    return have


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back: its lineage ends there, and a lost executor loses nothing.

    The folder goes when the JVM of the driver ends (Hadoop's delete on exit), or earlier through `drop`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loomgraph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back


#: Rows that go to a Python worker at once: texts are long, and both sides hold a batch outside their heaps.
MOST_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to MOST_ROWS rows (Spark has no such setting for a single plan)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= MOST_ROWS:
        spark.conf.set(name, MOST_ROWS)


#: Characters of a plan's description, of which the driver keeps many.
MOST_DESCRIBED = 10_000


def short_plans(spark: SparkSession) -> None:
    """Lowers the session's spark.sql.maxPlanStringLength where it is unbounded (Spark has no such setting for one plan)."""
    if spark.conf.get("spark.sql.maxPlanStringLength").rstrip("b") == str(2**31 - 16):
        spark.conf.set("spark.sql.maxPlanStringLength", MOST_DESCRIBED)


def tidy(spark: SparkSession) -> None:
    """Lets the driver's JVM collect what no plan holds any more: Spark then deletes the shuffle files of finished steps,
    which otherwise stay on the executors' disks until the driver's heap happens to be full.  Python gives back what it
    has freed as well."""
    spark._jvm.System.gc()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def drop(df: DataFrame) -> None:
    """Deletes the table of a frame from `cut` that no later plan reads."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
