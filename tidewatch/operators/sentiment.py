"""Headline and index sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import settings as S
from tidewatch.functions.frames import full_window, rolling_z, trailing
from tidewatch.functions.text import Scorer, lexicon_scorer
from tidewatch.operators.panel import align_series


def score_headlines(headlines: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Attach ``polarity``; the scorer is any Column -> Column, a pandas UDF included."""
    return headlines.withColumn("polarity", (scorer or lexicon_scorer())(F.col("title")))


def daily_rollup(scored: DataFrame, lag_days: int = 0) -> DataFrame:
    """Mean polarity, count and share of negative headlines per publication day.

    ``lag_days=1`` makes a headline count from the next day on.
    """
    day = F.date_add(F.to_date("published_at"), lag_days)
    return scored.groupBy(day.alias("date")).agg(
        F.avg("polarity").alias("polarity"), F.count(F.lit(1)).alias("n_headlines"),
        F.avg((F.col("polarity") < 0).cast("double")).alias("negative_share"))


def on_panel_dates(panel: DataFrame, daily: DataFrame) -> DataFrame:
    """The rollup on each asset's dates; a day without headlines counts zero, its polarity is missing."""
    return (panel.select("asset", "date").join(daily, "date", "left")
            .withColumn("n_headlines", F.coalesce("n_headlines", F.lit(0)).cast("double")))


def headline_features(panel: DataFrame, headlines: DataFrame, scorer: Scorer | None = None,
                      long: int = S.SENTIMENT_LONG, count_window: int = S.SENTIMENT_COUNT_WINDOW,
                      lag_days: int = 0) -> DataFrame:
    """Sentiment columns from headlines."""
    df = on_panel_dates(panel, daily_rollup(score_headlines(headlines, scorer), lag_days))
    return df.select(
        "asset", "date", F.avg("polarity").over(trailing(1)).alias("headline_polarity_1d"),
        full_window(F.avg, "polarity", long, trailing(long)).alias("headline_polarity_7d"),
        rolling_z("n_headlines", count_window).alias("headline_count_z"),
        full_window(F.avg, "negative_share", long, trailing(long)).alias("negative_ratio_7d"))


def with_index_sentiment(df: DataFrame, long: int = S.SENTIMENT_LONG, index: str = "index") -> DataFrame:
    """Sentiment columns from an aligned 0..100 index column, used when there are no headlines.

    A day without an index value counts as not negative, so the ratio covers more
    days than the polarity. ``headline_count_z`` stays missing.
    """
    df = df.withColumn("_pol", (F.col(index) - 50.0) / 50.0)
    df = df.withColumn("_neg", F.coalesce(F.col("_pol") < 0, F.lit(False)).cast("double"))
    return df.withColumns({
        "headline_polarity_1d": F.col("_pol"),
        "headline_polarity_7d": full_window(F.avg, "_pol", long, trailing(long)),
        "headline_count_z": F.lit(None).cast("double"),
        "negative_ratio_7d": full_window(F.avg, "_neg", long, trailing(long)),
    }).drop(index, "_pol", "_neg")


def index_sentiment(panel: DataFrame, index: DataFrame, long: int = S.SENTIMENT_LONG) -> DataFrame:
    return with_index_sentiment(align_series(panel, index, "index"), long)
