"""Structured Streaming over event files: every batch is filled by the batch plan and added to the histograms so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventloom.operators import histogram as H
from eventloom.plans.compiler import Plan
from eventloom.spec.model import Spec


def stream_histograms(spark: SparkSession, spec: Spec, source: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that keeps the fills of each batch as rows under out/batch=N.

    A batch that is run again after a failure overwrites its own rows, so that every file counts once.
    """

    def add_batch(batch: DataFrame, n: int) -> None:
        H.fill(Plan(spec, batch).fills(), ["hist", "variation"]).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return source.writeStream.foreachBatch(add_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, spec: Spec, out: str) -> DataFrame:
    """The complete histograms over all batches so far."""
    parts = spark.read.schema(H.SCHEMA + ", batch long").parquet(out)
    whole = H.frame(spark, {h.name: h.bins for h in spec.histograms}, spec.variations())
    return H.complete(H.add(parts, []), whole)


def windowed_counts(events: DataFrame, minutes: int = 60, late: str = "1 hour") -> DataFrame:
    """Events by tumbling window and type, with a watermark for late ones; batch or streaming."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
