"""What happened after a prediction or any other date, and the track record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import settings as S
from tidewatch.operators import metrics as M


def ahead(starts: DataFrame, prices: DataFrame, keys: list[str], day: str, days: Column | int) -> DataFrame:
    """First, lowest and last price in [day, day + days], per row of ``starts``.

    Each start is spread over its few calendar days and meets the prices by
    equality, so the interval join is a hash or merge join.
    """
    n = days if isinstance(days, Column) else F.lit(days)
    span = starts.select(*keys, F.explode(F.sequence(F.col(day), F.date_add(F.col(day), n))).alias("date"))
    return (span.join(prices.select("asset", "date", "close"), ["asset", "date"])
            .groupBy(*keys).agg(
                F.count("close").alias("days_observed"), F.min_by("close", "date").alias("start_price"),
                F.min("close").alias("min_price"), F.max_by("close", "date").alias("end_price")))


def resolve(predictions: DataFrame, prices: DataFrame, threshold: float = S.DRAWDOWN_THRESHOLD,
            alert_bands=S.ALERT_BANDS) -> DataFrame:
    """Outcome of each prediction; fewer than two prices in the horizon leave it unresolved."""
    day = F.to_date("as_of_date")
    seen = ahead(predictions.withColumn("_day", day), prices, ["prediction_id", "asset"], "_day", F.col("horizon_days"))
    out = predictions.join(seen.drop("asset"), "prediction_id", "left")
    resolved = F.coalesce(F.col("days_observed") >= 2, F.lit(False))
    fall = F.when(resolved, (F.col("start_price") - F.col("min_price")) / F.col("start_price"))
    warned, crashed = F.col("severity_band").isin(*alert_bands), F.col("actual_max_drawdown") >= threshold
    kind = (F.when(~F.col("resolved"), "UNRESOLVED").when(warned & crashed, "TRUE_POSITIVE")
            .when(warned, "FALSE_POSITIVE").when(crashed, "FALSE_NEGATIVE").otherwise("TRUE_NEGATIVE"))
    return (out.withColumns({"resolved": resolved, "actual_max_drawdown": fall})
            .select("prediction_id", "asset", "as_of_date", "horizon_days",
                    F.col("severity_band").alias("predicted_band"), F.col("probability").alias("predicted_probability"),
                    "actual_max_drawdown", F.coalesce(crashed, F.lit(False)).alias("crash_occurred"),
                    kind.alias("classification"), "resolved"))


def matured(predictions: DataFrame, as_of: Column | str) -> DataFrame:
    """Predictions whose horizon has closed."""
    closes = F.date_add(F.to_date("as_of_date"), F.col("horizon_days"))
    return predictions.filter(closes <= F.lit(as_of).cast("date"))


def unresolved(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    return predictions.join(outcomes.select("prediction_id"), "prediction_id", "left_anti")


def track_record(predictions: DataFrame, outcomes: DataFrame, boundary: str) -> DataFrame:
    """Counts, precision and recall: all, and split at the last date the models were fitted on."""
    period = F.when(F.col("as_of_date") > boundary, "out_of_sample").otherwise("in_sample")
    known = outcomes.filter("resolved").select("prediction_id", "classification")
    df = (predictions.select("prediction_id", "as_of_date").join(known, "prediction_id", "left")
          .withColumn("period", period))
    n = lambda k: F.sum((F.coalesce("classification", F.lit("")) == k).cast("long"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (df.groupingSets([["period"], []], "period").agg(
        F.count(F.lit(1)).alias("predictions"), F.count("classification").alias("n_resolved"),
        n("TRUE_POSITIVE").alias("tp"), n("FALSE_POSITIVE").alias("fp"),
        n("FALSE_NEGATIVE").alias("fn"), n("TRUE_NEGATIVE").alias("tn"))
        .withColumns({
            "period": F.coalesce("period", F.lit("all")), "pending": F.col("predictions") - F.col("n_resolved"),
            "alerts": tp + fp, "precision": tp / F.nullif(tp + fp, F.lit(0)), "recall": tp / F.nullif(tp + fn, F.lit(0))}))


def report(outcomes: DataFrame) -> DataFrame:
    """Metric suite over resolved outcomes; a missing probability keeps its count but is not ranked."""
    known = outcomes.filter("resolved").withColumn("y_true", F.col("crash_occurred").cast("int"))
    kinds = ["TRUE_POSITIVE", "FALSE_POSITIVE", "FALSE_NEGATIVE", "TRUE_NEGATIVE"]
    wide = known.agg(*[F.count(F.when(F.col("classification") == k, 1)).alias(k) for k in kinds], F.count(F.lit(1)).alias("_n"))
    ranked = M.metric_suite(known.filter("predicted_probability IS NOT NULL"), [], 0.5, "y_true", "predicted_probability")
    both = wide.filter("_n > 0").crossJoin(F.broadcast(ranked))       # two aggregates of one row each
    return both.select(F.lit("all").alias("scope"), *kinds, "pr_auc", "roc_auc", "brier", "positive_rate", "n_samples")


def ledger_view(predictions: DataFrame, outcomes: DataFrame, n: int = 200) -> DataFrame:
    """Latest predictions with their outcome, PENDING where there is none."""
    newest = predictions.orderBy(F.desc("as_of_date"), "asset", "prediction_id").limit(n)
    known = outcomes.filter("resolved").select("prediction_id", "classification", "actual_max_drawdown")
    return (newest.join(known, "prediction_id", "left")
            .withColumn("classification", F.coalesce("classification", F.lit("PENDING"))))


def hindsight(prices: DataFrame, horizon: int = S.HORIZON_DAYS, threshold: float = S.DRAWDOWN_THRESHOLD) -> DataFrame:
    """For every (asset, date): what followed within the calendar horizon, NULL with fewer than two rows."""
    w = (Window.partitionBy("asset").orderBy(F.datediff("date", F.lit("1970-01-01").cast("date")))
         .rangeBetween(0, horizon))
    df = prices.select("asset", "date", F.col("close").alias("start_price"), F.count("close").over(w).alias("n"),
                       F.min("close").over(w).alias("min_price"), F.last("close").over(w).alias("end_price"))
    known = F.col("n") >= 2
    df = df.select("asset", "date", *[F.when(known, F.col(c)).alias(c) for c in ("start_price", "min_price", "end_price")])
    return (df.withColumn("max_drawdown", (F.col("start_price") - F.col("min_price")) / F.col("start_price"))
            .withColumn("crashed", F.col("max_drawdown") >= threshold))
