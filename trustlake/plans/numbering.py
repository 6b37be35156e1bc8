"""Exact numbers of rows in a given order, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustlake.plans.tables import written


def numbered(rows: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """rows with their place from 0 in the order (ascending; ties in any order), written.

    Rows are range-partitioned and sorted; a row's number is its place in its partition plus the rows of the partitions
    before. Those are counted in a table of one row a partition, so no task sees all rows."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id())
    placed = written(placed, "numbered")
    part = F.shiftright("at_", 33)
    counts = placed.groupBy(part.alias("part_")).agg(F.min("at_").alias("first_"), F.count("*").alias("n_"))
    before = F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")  # a row a partition
    starts = counts.select("part_", (before - F.col("first_")).alias("start_"))
    return placed.join(F.broadcast(starts), part == F.col("part_")).withColumn(name, F.col("at_") + F.col("start_")).drop("at_", "part_", "start_")
