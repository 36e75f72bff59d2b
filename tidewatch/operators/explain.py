"""Attributions of window scores and how stable they are across episodes."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import settings as S
from tidewatch.functions.frames import pair_corr, ratio
from tidewatch.operators.panel import episode_days, require_empty

KEY = ["asset", "window_end"]
#: Profile values are ranked in steps of one part in so many of their episode's largest.
RANK_STEPS = 1e10


def linear(tensor: DataFrame, coef: Column, background: Column) -> DataFrame:
    """coef * (x - background) per cell; ``coef`` is lookback x features, ``background`` one mean per feature."""
    cell = lambda row, c: F.zip_with(F.zip_with(row, "_mean", lambda x, b: x - b), c, lambda d, k: d * k)
    df = tensor.withColumns({"_coef": coef, "_mean": background})
    return df.select(*KEY, "label", F.zip_with("feats", "_coef", cell).alias("contrib"))


def linear_model(rows: DataFrame, model: Model, background: Column, width: int) -> DataFrame:
    """Contributions of a fitted linear classifier, per cell of the window: coefficient * (x - background).

    ``rows`` holds flat feature vectors, ``background`` a flat array of their means over the training rows, ``width`` the
    features per time step. ``base`` is the score of the background; base plus all contributions is ``logit``, the raw
    score of the model.
    """
    from pyspark.ml.functions import vector_to_array

    coef = F.lit([float(c) for c in model.coefficients])
    x = vector_to_array("features")
    cells = F.zip_with(F.zip_with(x, "_background", lambda a, b: a - b), coef, lambda d, k: d * k)
    base = F.aggregate(F.zip_with("_background", coef, lambda b, k: b * k), F.lit(float(model.intercept)), lambda a, v: a + v)
    steps = F.transform(F.sequence(F.lit(0), F.floor(F.size("_cells") / width).cast("int") - 1), lambda t: F.slice("_cells", t * width + 1, width))
    return (model.transform(rows).withColumn("_background", background).withColumn("_cells", cells)
            .select(*KEY, "label", base.alias("base"), vector_to_array("rawPrediction")[1].alias("logit"), steps.alias("contrib")))


def gradient_input(tensor: DataFrame, gradient: Column) -> DataFrame:
    """gradient * x per cell; for a linear score the gradient is its coefficients."""
    cell = lambda row, g: F.zip_with(row, g, lambda x, k: x * k)
    df = tensor.withColumn("_grad", gradient)
    return df.select(*KEY, "label", F.zip_with("feats", "_grad", cell).alias("contrib"))


def per_feature(attr: DataFrame, features: list[str]) -> DataFrame:
    """Contributions summed over the window: one double column per feature."""
    totals = F.aggregate(F.slice("contrib", F.lit(2), F.size("contrib") - 1), F.element_at("contrib", 1),
                         lambda acc, row: F.zip_with(acc, row, lambda a, b: a + b))
    df = attr.select(*KEY, "label", totals.alias("_t"))
    return df.select(*KEY, "label", *[F.col("_t")[i].alias(f) for i, f in enumerate(features)])


def long_features(wide: DataFrame, features: list[str]) -> DataFrame:
    return wide.unpivot(KEY, features, "feature", "contribution")


def _ranked(df: DataFrame, by: list[str]) -> DataFrame:
    over = Window.partitionBy(*by)
    size = F.abs("contribution")
    share = F.coalesce(ratio(size, F.sum(size).over(over)), F.lit(0.0))
    return df.withColumns({"abs_contribution": size, "share_of_total": share,
                           "rank": F.row_number().over(over.orderBy(F.desc(size), "feature"))})


def ranked_mean(wide: DataFrame, features: list[str]) -> DataFrame:
    """Mean contribution per feature with its share, largest first. One row per feature."""
    means = wide.agg(*[F.avg(f).alias(f) for f in features]).withColumn("scope", F.lit("mean"))
    return _ranked(means.unpivot(["scope"], features, "feature", "contribution"), ["scope"])


def ranked_samples(wide: DataFrame, features: list[str]) -> DataFrame:
    """The same per window."""
    return _ranked(long_features(wide, features), KEY)


def mean_absolute(wide: DataFrame, features: list[str]) -> DataFrame:
    means = wide.agg(*[F.avg(F.abs(f)).alias(f) for f in features]).withColumn("_s", F.lit(0))
    return means.unpivot(["_s"], features, "feature", "mean_abs").drop("_s")


def timestep_profile(attr: DataFrame, lookback: int = S.LOOKBACK) -> DataFrame:
    """Mean |contribution| by position in the window."""
    size = F.transform("contrib", lambda row: F.aggregate(row, F.lit(0.0), lambda a, x: a + F.abs(x)) / F.size(row))
    return (attr.select(F.posexplode(size).alias("t", "v")).groupBy("t").agg(F.avg("v").alias("mean_abs"))
            .withColumn("position", F.concat(F.lit("t-"), (lookback - 1 - F.col("t")).cast("string"))))


def episode_profiles(wide: DataFrame, features: list[str], episodes: DataFrame,
                     lookback: int = S.EPISODE_LOOKBACK_DAYS, min_windows: int = 5) -> DataFrame:
    """Mean |contribution| per feature over windows ending in an episode's run-up or the episode."""
    days = episode_days(episodes, lookback).withColumnRenamed("date", "window_end")
    means = (wide.join(days, "window_end").groupBy("episode")
             .agg(F.count(F.lit(1)).alias("n_windows"), *[F.avg(F.abs(f)).alias(f) for f in features])
             .filter(F.col("n_windows") >= min_windows))
    return means.unpivot(["episode", "n_windows"], features, "feature", "value").withColumn("value", F.coalesce("value", F.lit(0.0)))


def assert_comparable(profiles: DataFrame) -> None:
    n = profiles.agg(F.countDistinct("episode").alias("n"))
    require_empty(n.filter("n < 2"), "fewer than two episodes have enough windows")


def spearman(profiles: DataFrame) -> DataFrame:
    """Rank correlation of the feature profiles for each pair of episodes; ties share their mean rank.

    A value is a mean over many windows, whose rounding noise depends on the order of its sums. Values tie if they fall
    into the same step, a share of the episode's largest value far above that noise.
    """
    by = Window.partitionBy("episode")
    step = F.floor(F.coalesce(ratio("value", F.max("value").over(by)), F.lit(0.0)) * RANK_STEPS + 0.5)
    steps = profiles.select("episode", "feature", step.alias("step"))
    ties = F.count(F.lit(1)).over(Window.partitionBy("episode", "step"))
    r = steps.select("episode", "feature", (F.rank().over(by.orderBy("step")) + (ties - 1) / 2.0).alias("r"))
    a = r.select(F.col("episode").alias("a"), "feature", F.col("r").alias("ra"))
    b = r.select(F.col("episode").alias("b"), "feature", F.col("r").alias("rb"))
    return (a.join(b, "feature").filter("a < b").groupBy("a", "b")
            .agg(F.coalesce(pair_corr("ra", "rb"), F.lit(0.0)).alias("spearman")))


def top_features(profiles: DataFrame, k: int = 5) -> DataFrame:
    """Each episode's k strongest features with their share of the episode's total."""
    by = Window.partitionBy("episode")
    return (profiles.withColumn("share_of_total", F.col("value") / F.coalesce(F.nullif(F.sum("value").over(by), F.lit(0.0)), F.lit(1.0)))
            .withColumn("rank", F.row_number().over(by.orderBy(F.desc("value"), "feature"))).filter(F.col("rank") <= k)
            .select("episode", "rank", "feature", F.col("value").alias("mean_abs_attribution"), "share_of_total"))


def topk_jaccard(profiles: DataFrame, k: int = 5) -> DataFrame:
    """Overlap of the top-k feature sets for each pair of episodes; one row per episode goes into the join."""
    sets = top_features(profiles, k).groupBy("episode").agg(F.collect_set("feature").alias("s"))
    a = sets.select(F.col("episode").alias("a"), F.col("s").alias("sa"))
    b = F.broadcast(sets.select(F.col("episode").alias("b"), F.col("s").alias("sb")))     # one row per listed episode
    both, either = F.size(F.array_intersect("sa", "sb")), F.size(F.array_union("sa", "sb"))
    return (a.join(b, F.col("a") < F.col("b"))
            .select("a", "b", F.coalesce(both / F.nullif(either, F.lit(0)), F.lit(0.0)).alias("jaccard")))


def stability(pairs: DataFrame) -> DataFrame:
    """Mean pairwise rank correlation and its reading; the cut points are fixed beforehand.

    The mean is taken to 12 places, so that one which is a cut point reads alike in whatever order the pairs are added.
    """
    s = F.col("stability_index")
    mean = F.floor(F.avg("spearman") * 1e12 + 0.5) / 1e12
    return (pairs.agg(mean.alias("stability_index"), F.count(F.lit(1)).alias("n_pairs"))
            .withColumn("reading", F.when(s.isNull(), "UNDETERMINED").when(s >= 0.7, "HIGH").when(s >= 0.4, "MODERATE")
                        .when(s >= 0.0, "LOW").otherwise("NEGATIVE")))
