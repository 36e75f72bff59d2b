"""Forward drawdown labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import settings as S
from tidewatch.functions.frames import ordered
from tidewatch.operators.panel import episode_days, require_empty


def _check(threshold: float, horizon: int) -> None:
    if not 0.0 < threshold < 1.0:
        raise ValueError(f"threshold must be in (0, 1), got {threshold}")
    if horizon < 1:
        raise ValueError(f"horizon must be at least 1, got {horizon}")


def forward_decline(horizon: int, price: str = "close") -> Column:
    """Deepest fall below today's price over the next rows; NULL unless all of them exist."""
    ahead = ordered().rowsBetween(1, horizon)
    lowest = F.when(F.count(price).over(ahead) == horizon, F.min(price).over(ahead))
    return (F.col(price) - lowest) / F.col(price)


def with_label(panel: DataFrame, threshold: float = S.DRAWDOWN_THRESHOLD,
               horizon: int = S.HORIZON_DAYS, out: str = "label") -> DataFrame:
    """1 where the price falls by the threshold within the horizon."""
    _check(threshold, horizon)
    return panel.withColumn(out, (forward_decline(horizon) >= threshold).cast("int"))


def label_rate(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("asset").agg(
        F.count("label").alias("n_labelled"), F.sum("label").alias("n_positive"),
        F.avg("label").alias("positive_rate"))


def episode_coverage(labelled: DataFrame, episodes: DataFrame,
                     lookback: int = S.EPISODE_LOOKBACK_DAYS, by: list[str] | None = None) -> DataFrame:
    """Whether any positive label falls between ``lookback`` days before an episode and its end."""
    by = by or []
    hits = (labelled.filter(F.col("label").isNotNull())
            .groupBy(*by, "date").agg(F.max("label").alias("label"))
            .join(episode_days(episodes, lookback), "date")
            .groupBy(*by, "episode").agg(F.max("label").alias("hit")))
    if by:
        return hits.filter("hit = 1").select(*by, "episode")
    return (episodes.select("episode").join(hits, "episode", "left")
            .select("episode", (F.coalesce("hit", F.lit(0)) == 1).alias("covered")))


def assert_covered(labelled: DataFrame, episodes: DataFrame, lookback: int = S.EPISODE_LOOKBACK_DAYS) -> None:
    """Raise with the names of the episodes that no positive label reaches."""
    require_empty(episode_coverage(labelled, episodes, lookback).filter("NOT covered"),
                  "labels miss known episodes")


def sensitivity(panel: DataFrame, thresholds: list[float], horizons: list[int], episodes: DataFrame,
                lookback: int = S.EPISODE_LOOKBACK_DAYS) -> DataFrame:
    """Positive rate and episode coverage for every threshold and horizon.

    The forward minimum is taken once per horizon; thresholds fan out from it.
    """
    for t in thresholds:
        for h in horizons:
            _check(t, h)
    wide = panel.select("asset", "date", *[forward_decline(h).alias(f"d{h}") for h in horizons])
    cells = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(h).alias("horizon_days"),
                               (F.col(f"d{h}") >= t).cast("int").alias("label"))
                      for t in thresholds for h in horizons])
    by = ["threshold", "horizon_days"]
    long = wide.select("date", F.explode(cells).alias("c")).select("date", "c.*")
    daily = long.groupBy(*by, "date").agg(F.sum("label").alias("pos"), F.count("label").alias("n"))
    rates = daily.groupBy(*by).agg(
        F.sum("n").alias("n_labelled"), F.coalesce(F.sum("pos"), F.lit(0)).alias("n_positive"))
    hit_days = daily.filter("pos > 0").select(*by, "date", F.lit(1).alias("label"))
    names = episodes.agg(F.array_sort(F.collect_list("episode"))).scalar()
    covered = (episode_coverage(hit_days, episodes, lookback, by)
               .groupBy(*by).agg(F.collect_set("episode").alias("hit")))
    missed = F.array_join(F.array_except("names", "hit"), ", ")
    return (rates.join(covered, by, "left").withColumn("names", names)
            .withColumn("hit", F.coalesce("hit", F.array().cast("array<string>")))
            .select(*by, (F.col("n_positive") / F.nullif("n_labelled", F.lit(0))).alias("positive_rate"),
                    "n_positive", "n_labelled", F.size("hit").alias("episodes_covered"),
                    F.size("names").alias("episodes_total"),
                    F.when(missed == "", "-").otherwise(missed).alias("uncovered")))
