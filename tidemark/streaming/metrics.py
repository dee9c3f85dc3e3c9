"""Structured Streaming forms of the metric operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.steps import shared_root
from tidemark.streaming.baselines import compacted


def windowed_totals(events: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and total of ``value`` by event-time window and key; rows later than ``late`` are dropped from a stream."""
    w = F.window(ts, width)
    out = events.withWatermark(ts, late).groupBy(w, key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), key, "n", "total")


def first_seen(events: DataFrame, ts: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def totals_table(events: DataFrame, ts: str, key: str, value: str, folder: str, **how: str) -> DataFrame:
    """``windowed_totals`` of all that a stream has at hand, kept as a table below ``folder``.

    The folder holds the stream's cursor, so a later call reads new rows only. Each batch writes the windows that it
    changed as Parquet (a batch that is run again overwrites its own); a window counts as its last batch left it, and
    many batches become one.
    """
    totals = windowed_totals(events, ts, key, value, **how)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/parts/batch-{number:09d}")

    totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/cursor").trigger(availableNow=True).start().awaitTermination()
    return compacted(events.sparkSession, folder, totals.withColumn("batch", F.lit(0).cast("long")).schema, ["window_start", key])


def windowed_totals_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events at hand through the stream, into a folder of this run."""
    from tidemark.plans.tables import read

    schema = read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    totals = totals_table(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value", f"{shared_root(spark)}/windows-{uuid.uuid4().hex}")
    return totals.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))
