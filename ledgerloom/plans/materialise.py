"""Lineage cuts: tables written to the folder that all executors share.

A cut is a parquet table under ``spark.checkpoint.dir``, so it outlives any executor, is compressed, and is read back
with column pruning. Where the setting is unset, a local master gets a temporary folder of the driver; any other is
refused, since its executors could not read what another machine wrote there.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder for cuts of this application."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="ledgerloom-")
        _own.append(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


@atexit.register
def _drop_own() -> None:
    for path in _own:
        shutil.rmtree(path, ignore_errors=True)


class Cuts:
    """Names the cuts of one operator run and drops those that were superseded."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        """Write ``df`` and return it as a table that is read from the files, with its path."""
        self.count += 1
        path = f"{self.base}/{self.count:03d}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def observed(self, df: DataFrame, **facts: Column) -> tuple[DataFrame, dict]:
        """As ``cut``, with aggregates that the write itself computes."""
        seen = Observation()
        out = self.cut(df.observe(seen, *[v.alias(k) for k, v in facts.items()]))
        return out, seen.get

    def counted(self, df: DataFrame) -> tuple[tuple[DataFrame, str], int]:
        """As ``write``, with the number of rows, counted by the write."""
        seen = Observation()
        return self.write(df.observe(seen, F.count(F.lit(1)).alias("n"))), seen.get["n"]

    def cut(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def drop(self, path: str) -> None:
        """Delete a table that nothing will read again."""
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Delete all cuts of this application; results that still read them can't be used afterwards."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
