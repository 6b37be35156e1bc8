"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


MOST_PARTS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only in local mode, where one machine runs all (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="trustlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read back: later steps start from files, not from its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is shuffled and never sent through the driver: written tables take a tenth of the room in their files that they
    take in memory, and Spark would broadcast them by the size of the files."""
    return df.hint("merge")


def dealt(df: DataFrame, key: str, rows: int, each: int) -> DataFrame:
    """df, of so many rows that take long for their size, as a side of a join by key: in partitions of about `each` rows.

    Spark would join neighbouring partitions to some of 64 MB, which are few and end at different times. Where its own number of partitions makes
    them much smaller than `each`, it is left to join them."""
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(MOST_PARTS, max(rows // each, default)), key) if rows * 4 >= default * each else df


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """While a table of long rows is written: Arrow batches of at most so many rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
