"""Continuous scans: documents that arrive in a folder are audited batch by batch into a store."""

from __future__ import annotations

from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trustlake.plans.audit import Settings
from trustlake.schema import DOCUMENT
from trustlake.store import Store


def latest(docs: DataFrame) -> DataFrame:
    """Of each id the document that was modified last (without a date: fetched last)."""
    order = Window.partitionBy("id").orderBy(F.desc_nulls_last("last_modified"), F.desc("doc_ord"))
    return docs.withColumn("turn_", F.row_number().over(order)).where("turn_ = 1").drop("turn_")


def watch(spark: SparkSession, folder: str, store: Store, settings: Settings, checkpoint: str) -> StreamingQuery:
    """Audit each batch of new Parquet files in folder. A batch that is run again finds its pages unchanged, so its effects are
    had once; settings.as_of is replaced by the time of the batch."""

    def scan(batch: DataFrame, _: int) -> None:
        now = datetime.now(UTC)
        if (token := store.try_start(now)) is None:
            raise RuntimeError("another scan is running")
        try:
            store.run(latest(batch), replace(settings, as_of=now), token)
        finally:
            store.end(token)

    rows = spark.readStream.schema(DOCUMENT).parquet(folder)
    return rows.writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
