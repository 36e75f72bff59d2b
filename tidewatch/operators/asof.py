"""Latest panel row at or before a date, for many dates at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_dates(panel: DataFrame, points: DataFrame) -> DataFrame:
    """Per decision point (asset, as_of): ``date`` of the latest row not after it.

    Rows and points are merged by time and the last row date is carried forward:
    one sort per asset instead of a range join. Points before the first row drop out.
    """
    merged = (panel.select("asset", F.col("date").alias("_t"), F.col("date"), F.lit(None).cast("date").alias("as_of"))
              .unionByName(points.select("asset", F.col("as_of").alias("_t"), F.lit(None).cast("date").alias("date"), "as_of")))
    upto = (Window.partitionBy("asset").orderBy("_t", F.col("as_of").isNotNull())
            .rowsBetween(Window.unboundedPreceding, 0))
    return (merged.withColumn("date", F.last("date", ignorenulls=True).over(upto))
            .filter("as_of IS NOT NULL AND date IS NOT NULL").select("asset", "as_of", "date"))


def decision_points(cycles: DataFrame, assets: DataFrame) -> DataFrame:
    """Every target asset at every monitoring date."""
    targets = assets.filter(F.col("role") == "target").agg(F.array_sort(F.collect_list("asset"))).scalar()
    return cycles.select("as_of", F.explode(targets).alias("asset"))
