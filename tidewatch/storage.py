"""The shared work folder, stored intermediate rows, range replacement and reports; :mod:`tidewatch.tables` keeps versioned tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_root(spark: SparkSession) -> str:
    """The library's folder under ``spark.checkpoint.dir``, which all executors share.

    Only in local mode, where neither the configuration nor the context names one (tests), a temporary folder of
    this machine becomes the checkpoint folder; on a cluster that is an error, since no executor could see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = kept.get() if kept.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tidewatch"


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder for one purpose."""
    return f"{work_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The Hadoop path of ``path`` and its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = file_system(spark, path)
    return files.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Hadoop's file system."""
    target, files = file_system(spark, path)
    files.delete(target, True)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replaced(old: DataFrame, new: DataFrame, column: str, low: str, high: str) -> DataFrame:
    """``old`` with its rows between ``low`` and ``high`` (both included) deleted and those of ``new`` in their place."""
    inside = F.col(column).between(F.lit(low), F.lit(high))
    return old.where(~inside | F.col(column).isNull()).unionByName(new.where(inside))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file, such as a report, to any file system that Spark knows."""
    target, files = file_system(spark, path)
    out = files.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def report(title: str, parts: dict[str, DataFrame]) -> str:
    """A Markdown report of small aggregates, one table each."""
    out = [f"# {title}", ""]
    for name, df in parts.items():
        out += [f"## {name}", "", f"| {' | '.join(df.columns)} |", f"|{' --- |' * len(df.columns)}"]
        out += [f"| {' | '.join('' if v is None else str(v) for v in row)} |" for row in df.collect()] + [""]
    return "\n".join(out)
