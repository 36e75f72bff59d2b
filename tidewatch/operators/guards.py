"""Coverage and leakage checks. Each returns the offending rows or the measured values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import settings as S
from tidewatch.functions.frames import ordered, pair_corr
from tidewatch.operators.panel import require_empty, unpivot


def coverage(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Missing share per column and year, and overall (``year`` NULL), in one scan."""
    counts = panel.groupBy(F.year("date").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in columns])
    long = counts.unpivot(["year", "n"], columns, "feature", "known")
    return (long.groupingSets([["feature", "year"], ["feature"]], "feature", "year")
            .agg((1.0 - F.sum("known") / F.sum("n")).alias("missing")))


def coverage_wide(report: DataFrame, years: list[int]) -> DataFrame:
    """One row per column: overall and one column per year."""
    return report.groupBy("feature").agg(
        F.max(F.when(F.col("year").isNull(), F.col("missing"))).alias("overall"),
        *[F.max(F.when(F.col("year") == y, F.col("missing"))).alias(f"y{y}") for y in years])


def thin_columns(report: DataFrame, minimum: float = S.MIN_COVERAGE) -> DataFrame:
    """Columns whose overall coverage is below the minimum."""
    return report.filter(F.col("year").isNull() & (1.0 - F.col("missing") < minimum)).select("feature", "missing")


def enforce_coverage(report: DataFrame, minimum: float = S.MIN_COVERAGE) -> None:
    require_empty(thin_columns(report, minimum), f"coverage below {minimum}")


def null_profile(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Leading and trailing NULL runs of every (asset, column)."""
    rows = panel.withColumn("_row", F.row_number().over(ordered())).select("asset", "_row", *columns)
    long = unpivot(rows, columns, ["asset", "_row"])
    known = F.when(F.col("value").isNotNull(), F.col("_row"))
    return (long.groupBy("asset", "feature").agg(
        F.count("value").alias("known"), (F.min(known) - 1).alias("head_nulls"),
        (F.max("_row") - F.max(known)).alias("tail_nulls")))


def forward_looking(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that miss values at the end and none at the start: the mark of a forward window."""
    p = null_profile(panel, columns)
    return p.filter((F.col("known") >= 2) & (F.col("tail_nulls") > F.col("head_nulls"))
                    & (F.col("head_nulls") == 0) & (F.col("tail_nulls") > 1))


def next_step_copies(features: DataFrame, source: DataFrame, columns: list[str],
                     tolerance: float = 1e-9) -> DataFrame:
    """Columns equal to their source's next row wherever both are known (more than 10 rows)."""
    ahead = unpivot(source, columns).withColumn(
        "next_value", F.lead("value").over(Window.partitionBy("asset", "feature").orderBy("date"))).drop("value")
    both = (unpivot(features, columns).join(ahead, ["asset", "date", "feature"])
            .filter("value IS NOT NULL AND next_value IS NOT NULL"))
    return (both.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("value") - F.col("next_value"))).alias("worst"))
        .filter((F.col("n") > 10) & (F.col("worst") < tolerance)))


def future_rows(frame: DataFrame, stamp: str, as_of: Column | str) -> DataFrame:
    """Number of rows stamped after ``as_of``; the moment itself is allowed."""
    return frame.agg(F.sum((F.col(stamp) > as_of).cast("long")).alias("future_rows"),
                     F.count(F.lit(1)).alias("all_rows"))


def assert_no_future(frame: DataFrame, stamp: str, as_of: Column | str) -> None:
    require_empty(frame.filter(F.col(stamp) > as_of).select(stamp), "rows stamped after the as-of moment")


def compare_features(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: compared rows, largest difference and NULL mismatches."""
    left, right = unpivot(a, columns), unpivot(b, columns).withColumnRenamed("value", "other")
    return (left.join(right, ["asset", "date", "feature"]).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("value") - F.col("other"))).alias("max_abs_diff"),
        F.sum((F.col("value").isNull() != F.col("other").isNull()).cast("long")).alias("null_mismatches")))


def shift_invariance(bars: DataFrame, compute: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """Features of values moved one row later must be the features moved one row later.

    Every value column of row t goes to the date of row t+1. A trailing window
    does not notice; one that reads the current calendar or the future does.
    """
    w = ordered()
    values = [c for c in bars.columns if c not in ("asset", "date")]
    moved = (bars.select("asset", F.lead("date").over(w).alias("date"), *values)
             .filter(F.col("date").isNotNull()))
    base = compute(bars)
    shifted = base.select("asset", F.lead("date").over(w).alias("date"), *columns).filter(F.col("date").isNotNull())
    return compare_features(shifted, compute(moved), columns)


def truncation(bars: DataFrame, compute: Callable[[DataFrame], DataFrame], columns: list[str], cut: str) -> DataFrame:
    """Features from rows up to the cut must equal the full-history features there."""
    upto = F.col("date") <= F.lit(cut).cast("date")
    return compare_features(compute(bars).filter(upto), compute(bars.filter(upto)), columns)


def label_disguise(labelled: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """|corr(feature, label)| per feature; near 1 means the feature is the label."""
    long = unpivot(labelled, [*columns], ["asset", "date", label])
    return long.groupBy("feature").agg(F.abs(pair_corr("value", F.col(label).cast("double"))).alias("abs_corr"))
