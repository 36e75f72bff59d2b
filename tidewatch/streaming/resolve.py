"""Outcomes as their horizons close, from a stream of predictions and a stream of prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import settings as S
from tidewatch.session import scratch_path
from tidewatch.sources import commits


def outcome_stream(predictions: DataFrame, prices: DataFrame, horizon: int = S.HORIZON_DAYS,
                   threshold: float = S.DRAWDOWN_THRESHOLD, late: str = "1 day") -> DataFrame:
    """Interval join of (prediction_id, asset, pred_ts, severity_band) with (asset, ts, close).

    Both sides carry watermarks and the time bound is part of the join condition,
    so Spark can drop state once a horizon is over. A prediction that comes twice counts once:
    its copy meets the first one's state, or is late. The aggregate is keyed by the
    prediction's own day and emitted when that day can get no more prices, that is
    once the watermark has passed the end of the horizon.
    """
    p = predictions.withWatermark("pred_ts", late).dropDuplicatesWithinWatermark(["prediction_id"])
    q = prices.withColumnRenamed("asset", "p_asset").withWatermark("ts", late)
    near = F.expr(f"asset = p_asset AND ts >= pred_ts AND ts <= pred_ts + INTERVAL {horizon} DAYS")
    seen = (p.join(q, near).groupBy(F.window("pred_ts", "1 day"), "prediction_id", "asset", "severity_band").agg(
        F.count("close").alias("n"), F.min_by("close", "ts").alias("start_price"), F.min("close").alias("low"))
        .filter("n >= 2"))
    fall = (F.col("start_price") - F.col("low")) / F.col("start_price")
    warned, crashed = F.col("severity_band").isin(*S.ALERT_BANDS), fall >= threshold
    kind = (F.when(warned & crashed, "TRUE_POSITIVE").when(warned, "FALSE_POSITIVE")
            .when(crashed, "FALSE_NEGATIVE").otherwise("TRUE_NEGATIVE"))
    return seen.select("prediction_id", "asset", F.col("window.start").alias("pred_day"),
                       fall.alias("actual_max_drawdown"), kind.alias("classification"))


def append_once(path: str, app: str):
    """A batch writer that records each outcome once.

    A batch that is replayed after a restart is known by its number and reads nothing; a stream started anew is held
    against the recorded ids of the months that the batch writes to.
    """
    def write(batch: DataFrame, number: int) -> None:
        commits.append(batch, path, "pred_day", fmt="parquet", app=app, batch=number)
    return write


def resolve_stream(outcomes: DataFrame, path: str | None = None, state: str | None = None) -> DataFrame:
    """Drain the outcome stream into the outcome table and read it. ``state`` is the folder of a stream to go on with."""
    spark = outcomes.sparkSession
    path, state = path or scratch_path(spark, "outcomes"), state or scratch_path(spark, "outcomes-state")
    run = (outcomes.writeStream.foreachBatch(append_once(path, state)).outputMode("append")
           .option("checkpointLocation", state).trigger(availableNow=True).start())
    run.awaitTermination()
    return commits.read(spark, path, outcomes.schema, "parquet")
