"""Streams: pages that land in a folder are read, labelled and checked as they come; review events fold as they come.

Progress is in the checkpoint, so a restart goes on where it stopped. Decisions never
expire: the fold has no watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dateloom.operators.ledger import STATUS_OF, mapped
from dateloom.plans.batch import process_pages


def ingest_pages(spark: SparkSession, landing: str, schema: str, out: str, checkpoint: str, today: str, once: bool = True) -> StreamingQuery:
    """Read Parquet pages that land in ``landing``; append dates and flags of each batch of whole documents under ``out``."""

    def batch(pages: DataFrame, number: int) -> None:
        pages.persist()
        dates, flags, _ = process_pages(pages, today)
        dates.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/dates/batch={number}")
        flags.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/flags/batch={number}")
        pages.unpersist()

    writer = spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def fold_reviews(events: DataFrame) -> DataFrame:
    """Current status of each date from a stream of review events, in the order of event ids."""
    last = events.groupBy("date_id").agg(
        F.max_by("action", "id").alias("last_action"),
        F.max_by("new_type", F.when(F.col("new_type").isNotNull(), F.col("id"))).alias("set_type"),
        F.max_by("new_value", F.when(F.col("new_value").isNotNull(), F.col("id"))).alias("set_value"),
        F.count(F.lit(1)).alias("n_events"),
    )
    return last.withColumn("status", F.coalesce(mapped(STATUS_OF, F.col("last_action")), F.lit("needs_review")))


def stream_reviews(events: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Give each batch of changed dates to ``write``."""
    return (
        fold_reviews(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
