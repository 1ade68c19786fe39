"""Tables that end a lineage, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of our own only where it is unset (tests on one machine)."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/loomgraph-shared"


def _at(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in whatever store Spark reads."""
    fs, at = _at(spark, path)
    return bool(fs.exists(at))


def move(spark: SparkSession, path: str, to: str) -> None:
    fs, at = _at(spark, path)
    if not fs.rename(at, _at(spark, to)[1]):
        raise OSError(f"{path} could not be moved to {to}")


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def kept(df: DataFrame) -> DataFrame:
    """`df` as a table of its own: written once, read by every later plan, and gone when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loomgraph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _at(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def kept_blocks(spark: SparkSession, blocks: Iterable[pa.Table], schema: str) -> DataFrame:
    """Blocks of rows that the driver has read, as one table like that of `kept`: the driver holds one block at a time."""
    path = f"{shared_folder(spark)}/loomgraph-{uuid.uuid4().hex}"
    fs, at = _at(spark, path)
    fs.deleteOnExit(at)
    spark.createDataFrame([], schema).write.parquet(path)
    for b in blocks:
        spark.createDataFrame(b, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def written_lines(df: DataFrame) -> str:
    """A folder with the only column of `df` as lines of text, in the order of its rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loomgraph-{uuid.uuid4().hex}"
    df.write.option("compression", "none").text(path)
    fs, at = _at(spark, path)
    fs.deleteOnExit(at)
    return path


def append_lines(spark: SparkSession, path: str, to: Path) -> None:
    """Appends the lines of `written_lines` to a file of the driver's, but for the first character of all."""
    fs, at = _at(spark, path)
    out = spark._jvm.java.io.FileOutputStream(str(to.absolute()), True)
    try:
        first = True
        for f in sorted((f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda p: p.getName()):
            part = fs.open(f)
            try:
                if first:
                    part.read()
                first = False
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            finally:
                part.close()
    finally:
        out.close()


def for_tasks(spark: SparkSession, path: str | Path) -> str:
    """A file of the driver's as a path that tasks can read: its own where they see it, else that of a copy."""
    at = Path(path).resolve()
    shared = shared_folder(spark)
    if not spark.sparkContext.master.startswith("local[") and not at.is_relative_to(shared.removeprefix("file://").removeprefix("file:")):
        copy = f"{shared}/loomgraph-{uuid.uuid4().hex}"
        fs, to = _at(spark, copy)
        fs.copyFromLocalFile(False, True, _at(spark, f"file://{at}")[1], to)
        fs.deleteOnExit(to)
        return copy
    return "file://" + re.sub(r"([*?{}\[\]\\])", r"\\\1", str(at))
