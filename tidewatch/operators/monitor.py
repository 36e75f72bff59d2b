"""Dated monitoring cycles, computed set-wise instead of one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import settings as S


def cycle_dates(spark, end: str, n: int, every_days: int) -> DataFrame:
    """n dates ending at ``end``, oldest first."""
    if n > 1 and every_days <= 0:
        raise ValueError("several cycles need a positive step")
    return spark.range(n).select(
        F.date_sub(F.lit(end).cast("date"), ((F.lit(n - 1) - F.col("id")) * every_days).cast("int")).alias("as_of"))


def resolving_cycle(maturity: str, start: str, end: str, every_days: int):
    """First cycle on or after a date, NULL beyond the last one: cycles form a regular grid."""
    first, step = F.lit(start).cast("date"), F.lit(every_days)
    k = F.greatest(F.ceil(F.datediff(maturity, first) / step), F.lit(0))
    at = F.date_add(first, (k * step).cast("int"))
    return F.when(at <= F.lit(end).cast("date"), at)


def backfill(predictions: DataFrame, outcomes: DataFrame, start: str, end: str, every_days: int) -> DataFrame:
    """Predictions of all cycles with their outcome and the cycle that resolves it.

    A cycle resolves before it predicts, so an outcome belongs to the first cycle
    at or after its maturity and never to the one that issued the prediction.
    """
    known = outcomes.filter("resolved").select("prediction_id", "classification", "actual_max_drawdown")
    df = predictions.join(known, "prediction_id", "left").withColumn(
        "matures", F.date_add(F.to_date("as_of_date"), F.col("horizon_days")))
    at = F.when(F.col("classification").isNotNull(), resolving_cycle("matures", start, end, every_days))
    df = df.withColumn("resolved_at", at)
    open_ = F.col("resolved_at").isNull()
    return df.select("prediction_id", "asset", "as_of_date", "severity_band", "matures", "resolved_at",
                     F.when(open_, "PENDING").otherwise(F.col("classification")).alias("classification"),
                     F.when(~open_, F.col("actual_max_drawdown")).alias("actual_max_drawdown"))


def cycle_summary(filled: DataFrame) -> DataFrame:
    """Per cycle: predictions, alerts with their assets, and outcomes resolved there."""
    alert = F.col("severity_band").isin(*S.ALERT_BANDS)
    issued = filled.groupBy(F.to_date("as_of_date").alias("cycle")).agg(
        F.count(F.lit(1)).alias("predictions"), F.sum(alert.cast("long")).alias("alerts"),
        F.array_join(F.array_sort(F.collect_list(F.when(alert, F.col("asset")))), ",").alias("alert_assets"))
    closed = filled.filter("resolved_at IS NOT NULL").groupBy(F.col("resolved_at").alias("cycle")).agg(F.count(F.lit(1)).alias("resolved"))
    return (issued.join(closed, "cycle", "full_outer")
            .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("predictions", "alerts", "resolved")})
            .withColumn("alert_assets", F.coalesce("alert_assets", F.lit(""))))
