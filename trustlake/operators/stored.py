"""Results of scans as one table, partitioned by scan and bucketed by page.

A scan is a partition, so reading, comparing and dropping scans touch their own files only. A page is in the same bucket of every scan, so scans are
joined by page bucket by bucket, without an exchange. The table is Spark's own kind; its files live in a folder that all executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def create(spark: SparkSession, name: str, path: str, like: DataFrame, buckets: int = BUCKETS) -> None:
    """Make the table known to the session, with the columns of `like` (scan_id and document_id among them); files that are there already are its rows."""
    columns = ", ".join(f"`{n}` {t}" for n, t in like.dtypes if n != "scan_id")
    spark.sql(f"""CREATE TABLE IF NOT EXISTS {name} ({columns}, scan_id BIGINT) USING parquet PARTITIONED BY (scan_id)
      CLUSTERED BY (document_id) SORTED BY (document_id) INTO {buckets} BUCKETS LOCATION '{path}'""")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")


def buckets_of(spark: SparkSession, name: str) -> int:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Num Buckets'").collect()  # one row
    return int(rows[0].data_type)


def append(results: DataFrame, name: str) -> None:
    """Add results: one file a scan and bucket, as each task has the pages of one bucket."""
    spark = results.sparkSession
    columns = [c for c in spark.table(name).columns]
    rows = results.withColumn("scan_id", F.col("scan_id").cast("long")).select(*columns)
    rows.repartition(buckets_of(spark, name), "document_id").sortWithinPartitions("scan_id", "document_id").write.insertInto(name)


def scan(spark: SparkSession, name: str, scan_id: int) -> DataFrame:
    return spark.table(name).where(F.col("scan_id") == scan_id)


def expire(spark: SparkSession, name: str, scans: list[int]) -> None:
    """Drop the given scans: their partitions go, no other file is read or written."""
    for scan_id in scans:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (scan_id = {int(scan_id)})")
