"""The (date, asset) panel: stacking, checking, trimming, slicing and describing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.frames import expanding, ordered

KEYS = ["date", "asset"]


def build_panel(frames: list[DataFrame]) -> DataFrame:
    """Stack long per-source frames; timestamps become UTC days. Empty frames add nothing."""
    if not frames:
        raise ValueError("build_panel: no frames")
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.withColumn("date", F.to_date("date"))


def duplicate_keys(panel: DataFrame) -> DataFrame:
    """Keys present more than once; must be empty."""
    return (panel.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("copies"))
            .filter(F.col("copies") > 1))


def require_empty(df: DataFrame, message: str) -> None:
    """Raise when a check returned rows: their number, and ten of them as examples."""
    rows = df.take(10)
    if rows:
        raise ValueError(f"{message}: {df.count()} in total, among them {[r.asDict() for r in rows]}")


def trim_inception(panel: DataFrame, assets: DataFrame) -> DataFrame:
    """Drop rows dated before the asset existed."""
    return (panel.join(assets.select("asset", "inception"), "asset")
            .filter(F.col("date") >= F.col("inception")).drop("inception"))


def align_series(panel: DataFrame, series: DataFrame, out: str) -> DataFrame:
    """A market-wide daily series on each asset's own dates: exact match or NULL."""
    return panel.join(series.select("date", F.col("value").alias(out)), "date", "left")


def only_targets(panel: DataFrame, assets: DataFrame) -> DataFrame:
    return panel.join(assets.filter(F.col("role") == "target").select("asset"), "asset", "left_semi")


def blank_context(panel: DataFrame, assets: DataFrame, label: str = "label") -> DataFrame:
    """Context assets keep their features and lose their labels."""
    return (panel.join(assets.select("asset", "role"), "asset", "left")
            .withColumn(label, F.when(F.col("role") == "target", F.col(label))).drop("role"))


def date_grid(panel: DataFrame) -> DataFrame:
    """Every date of any asset with its position; one row per calendar day at most."""
    return (panel.select("date").distinct()
            .withColumn("g", F.row_number().over(Window.orderBy("date"))))


def returns_long(panel: DataFrame, price: str = "close") -> DataFrame:
    """Log returns over the union date grid: a gap in one asset makes two returns missing.

    Rows exist where the asset has a price; ``g`` is the grid position, so frames
    over ``g`` count grid rows without materialising the missing ones.
    """
    w = ordered("asset", order="g")
    previous = F.when(F.lag("g").over(w) == F.col("g") - 1, F.lag(price).over(w))
    return (panel.select("asset", "date", price).join(date_grid(panel), "date")
            .withColumn("ret", F.ln(F.col(price) / previous)).drop(price))


def returns_wide(panel: DataFrame, assets: list[str], price: str = "close") -> DataFrame:
    """One row per grid date, one return column per asset."""
    return (returns_long(panel, price).groupBy("date").pivot("asset", assets).agg(F.max("ret")))


def asof_slice(panel: DataFrame, as_of: str, lookback: int, features: list[str]) -> DataFrame:
    """The latest row at or before ``as_of`` per asset, and the size of its trailing window."""
    history = panel.filter(F.col("date") <= F.lit(as_of).cast("date"))
    recent = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("date")))
    window = history.withColumn("_r", recent).filter(F.col("_r") <= lookback)
    return window.groupBy("asset").agg(
        F.max("date").alias("as_of"), F.min("date").alias("window_start"),
        F.count(F.lit(1)).alias("window_rows"),
        *[F.max_by(f, "date").alias(f) for f in features])


def timeline_tail(panel: DataFrame, asset: str, n: int, episodes: DataFrame) -> DataFrame:
    """Last n rows of one asset, with the episode a day belongs to."""
    tail = panel.filter(F.col("asset") == asset).orderBy(F.desc("date")).limit(n)
    return tail.join(episode_days(episodes, 0), "date", "left")


def episode_days(episodes: DataFrame, lookback: int) -> DataFrame:
    """One row per episode and day of [start - lookback, end]: turns range joins into equi-joins."""
    first = F.date_sub("start", lookback)
    return episodes.select("episode", F.explode(F.sequence(first, F.col("end"))).alias("date"))


def unpivot(panel: DataFrame, columns: list[str], ids: list[str] | None = None) -> DataFrame:
    """Long form (ids..., feature, value)."""
    ids = ids or ["asset", "date"]
    return (panel.select(*ids, *[F.col(c).cast("double") for c in columns])
            .unpivot(ids, columns, "feature", "value"))


def feature_percentiles(panel: DataFrame, features: list[str], families: dict[str, list[str]],
                        registry: DataFrame) -> DataFrame:
    """Latest value of every feature, its share of own history at or below it, family and provenance."""
    latest = panel.groupBy("asset").agg(
        F.max("date").alias("as_of"), *[F.max_by(f, "date").alias(f) for f in features])
    now = unpivot(latest, features, ["asset", "as_of"]).withColumnRenamed("value", "latest")
    family = F.coalesce(*[F.when(F.col("feature").isin(v), F.lit(k)) for k, v in families.items()])
    return (unpivot(panel, features).join(now, ["asset", "feature"])
            .groupBy("asset", "as_of", "feature")
            .agg(F.max("latest").alias("value"),
                 F.avg(F.when(F.col("value").isNotNull(),
                              (F.col("value") <= F.col("latest")).cast("double"))).alias("percentile"))
            .withColumn("family", family)
            .join(registry.select(F.col("column").alias("feature"), "kind"), "feature", "left")
            .withColumn("provenance", F.coalesce("kind", F.lit("DERIVED"))).drop("kind"))


def universe_summary(panel: DataFrame, assets: DataFrame) -> DataFrame:
    """Rows, dates, positives and last close per asset; assets without rows stay."""
    stats = panel.groupBy("asset").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"),
        F.max("date").alias("last_date"), F.sum("label").alias("positives"),
        F.max_by("close", "date").alias("last_close"))
    return (assets.select("asset", "role", "inception").join(stats, "asset", "left")
            .withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_rows", "positives")}))
