"""Feature drift, metric trend, component reliability and the advice drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.ranks import exact_quantiles

MINOR, MAJOR = 0.10, 0.25


def psi(reference: DataFrame, current: DataFrame, keys: list[str], value: str = "value",
        weight: str | None = None, bins: int = 10) -> DataFrame:
    """Population stability index over reference quantile bins, per key.

    NULL with fewer than 5 reference values per bin, fewer current values than
    bins, or fewer than three distinct edges. Outer bins are open.
    """
    w = F.col(weight) if weight else F.lit(1)
    edges = (exact_quantiles(reference, keys, value, [i / bins for i in range(bins + 1)], weight)
             .groupBy(*keys).agg(F.array_sort(F.collect_set("quantile")).alias("_e")))
    both = (reference.select(*keys, value, w.alias("_r"), F.lit(0).alias("_c"))
            .unionByName(current.select(*keys, value, F.lit(0).alias("_r"), w.alias("_c")))
            .filter(F.col(value).isNotNull()))
    inner = F.when(F.size("_e") >= 3, F.slice("_e", F.lit(2), F.size("_e") - 2)).otherwise(F.array().cast("array<double>"))
    binned = (both.join(F.broadcast(edges.withColumn("_inner", inner)), keys)     # one row of a few edges per feature
              .withColumn("_bin", F.size(F.filter("_inner", lambda e: e <= F.col(value))))
              .groupBy(*keys, "_bin").agg(F.sum("_r").alias("_r"), F.sum("_c").alias("_c"),
                                          F.max(F.size("_e")).alias("_edges")))
    every = Window.partitionBy(*keys)
    n_r, n_c = F.sum("_r").over(every), F.sum("_c").over(every)
    shares = binned.withColumns({"_nr": n_r, "_nc": n_c}).withColumns({
        "_rs": F.greatest(F.col("_r") / F.nullif("_nr", F.lit(0)), F.lit(1e-6)),
        "_cs": F.greatest(F.col("_c") / F.nullif("_nc", F.lit(0)), F.lit(1e-6))})
    total = F.sum((F.col("_cs") - F.col("_rs")) * F.ln(F.col("_cs") / F.col("_rs")))
    usable = (F.max("_nr") >= bins * 5) & (F.max("_nc") >= bins) & (F.max("_edges") >= 3)
    return shares.groupBy(*keys).agg(F.when(usable, total).alias("psi"), F.max("_nr").alias("n_reference"),
                                     F.max("_nc").alias("n_current"))


def severity(df: DataFrame) -> DataFrame:
    p = F.col("psi")
    return df.withColumn("severity", F.when(p.isNull(), "unknown").when(p >= MAJOR, "major")
                         .when(p >= MINOR, "minor").otherwise("stable"))


def trend(per_fold: DataFrame, metric: str = "pr_auc", order: str = "fold", limit: float = -0.01) -> DataFrame:
    """Least-squares slope over a model's ordered folds; needs three folds, all of them known. ``metric`` is one that grows
    with quality, such as PR-AUC: a slope below ``limit`` is a decline."""
    w = Window.partitionBy("model").orderBy(order)
    df = per_fold.withColumn("_i", (F.row_number().over(w) - 1).cast("double"))
    return (df.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_folds"), F.count(metric).alias("_known"),
        F.regr_slope(F.col(metric), F.col("_i")).alias("slope"),
        F.min_by(metric, "_i").alias("first"), F.max_by(metric, "_i").alias("last"))
        .filter((F.col("n_folds") >= 3) & (F.col("n_folds") == F.col("_known"))).drop("_known")
        .withColumn("declining", F.col("slope") < limit))


def reliability(reports: DataFrame) -> DataFrame:
    """Share of usable reports per component."""
    return reports.groupBy("component").agg(
        F.avg(F.col("status").isin("OK", "DEGRADED").cast("double")).alias("usable_share"), F.count(F.lit(1)).alias("n_reports"))


def recommend(drift: DataFrame, trends: DataFrame, usable: DataFrame, floor: float = 0.80) -> DataFrame:
    """concerns = 2 major + minor + declining models + unreliable components; 4 retrain, 2 monitor."""
    def count(cond):
        return F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    parts = (drift.agg(count(F.col("severity") == "major").alias("n")).withColumn("what", F.lit("major"))
             .unionByName(drift.agg(count(F.col("severity") == "minor").alias("n")).withColumn("what", F.lit("minor")))
             .unionByName(trends.agg(count(F.col("declining")).alias("n")).withColumn("what", F.lit("declining")))
             .unionByName(usable.agg(count(F.col("usable_share") < floor).alias("n")).withColumn("what", F.lit("unreliable"))))
    one = parts.agg(*[F.sum(F.when(F.col("what") == k, F.col("n"))).alias(k)
                      for k in ("major", "minor", "declining", "unreliable")])
    concerns = 2 * F.col("major") + F.col("minor") + F.col("declining") + F.col("unreliable")
    return one.withColumn("concerns", concerns).withColumns({
        "recommendation": F.when(F.col("concerns") >= 4, "RETRAIN").when(F.col("concerns") >= 2, "MONITOR").otherwise("HEALTHY"),
        "score": F.least(F.lit(100.0), 12.5 * F.col("concerns"))})
