"""Daily bars from a live feed of priced events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import scratch_path

EVENT_SCHEMA = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")


def read_events(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """The event feed as a stream; event time becomes a zoned timestamp, as watermarks require."""
    return (spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", pattern).parquet(folder)
            .withColumn("ts", F.col("ts").cast("timestamp")))


def daily_bars(events: DataFrame, late: str = "1 day") -> DataFrame:
    """One bar per day and event type. The same plan runs on a batch or a stream.

    The watermark bounds the state: a day is emitted once no event that late can
    come any more, and later ones are dropped.
    """
    at = F.struct("ts", "event_id")
    return (events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", at).alias("close"), F.sum("value").alias("volume"), F.count(F.lit(1)).alias("trades"))
        .select(F.col("window.start").alias("day"), "event_type", "open", "high", "low", "close", "volume", "trades"))


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream over everything available into a Parquet table and read the table."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    run = (stream.writeStream.format("parquet").option("path", out)
           .option("checkpointLocation", scratch_path(spark, f"{name}-state"))
           .outputMode("append").trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
