"""Rare-event metrics per group, thresholds, lead times and their summaries.

Accuracy is not offered: with one positive in nine it rewards silence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import settings as S
from tidewatch.functions.canon import fixed
from tidewatch.functions.ranks import attach, exact_quantiles, running_totals
from tidewatch.session import staged

BANNED = {"accuracy", "accuracy_score", "acc", "balanced_accuracy"}
# --- fixed values: 60 quantile positions of the threshold search ---------------
CANDIDATE_PROBS = [0.50 + i * (0.999 - 0.50) / 59 for i in range(60)]


def guard_names(names: list[str]) -> None:
    bad = BANNED & {n.lower() for n in names}
    if bad:
        raise ValueError(f"{sorted(bad)} is not reported for rare events")


def _share(a: Column, b: Column) -> Column:
    """a / b, 0 when nothing is to divide by."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def confusion(df: DataFrame, keys: list[str], threshold: Column | float = 0.5,
              y: str = "y_true", score: str = "y_score") -> DataFrame:
    """TP, FP, FN, TN with precision, recall and F1 (0 when undefined)."""
    return _rates(df.groupBy(*keys).agg(*_cells(threshold, y, score)))


def _cells(threshold: Column | float, y: str, score: str) -> list[Column]:
    fired = F.col(score) >= threshold
    def n(cond):
        return F.sum(cond.cast("long"))
    return [n(fired & (F.col(y) == 1)).alias("tp"), n(fired & (F.col(y) == 0)).alias("fp"),
            n(~fired & (F.col(y) == 1)).alias("fn"), n(~fired & (F.col(y) == 0)).alias("tn")]


def _rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns({
        "precision": _share(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": _share(F.col("tp"), F.col("tp") + F.col("fn")),
        "f1": _share(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def false_alarm_rate(df: DataFrame, keys: list[str], threshold: Column | float = 0.5,
                     y: str = "y_true", score: str = "y_score") -> DataFrame:
    """FP / (FP + TN), NULL without negatives."""
    return df.groupBy(*keys).agg(_false_alarms(threshold, y, score))


def _false_alarms(threshold: Column | float, y: str, score: str) -> Column:
    return F.avg(F.when(F.col(y) == 0, (F.col(score) >= threshold).cast("double"))).alias("false_alarm_rate")


def _by_score(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    return df.groupBy(*keys, score).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))


def ranking(df: DataFrame, keys: list[str], y: str = "y_true", score: str = "y_score") -> DataFrame:
    """Average precision and ROC AUC with ties, NULL where only one class is present.

    Rows are counted per distinct score first; both measures are sums over the
    distinct scores of terms in the running counts.
    """
    counted = _by_score(df, keys, y, score)
    totals = counted.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("n").alias("_n"))
    r = attach(running_totals(counted, keys, score, ["pos", "n"], descending=True), totals, keys)
    negatives = F.col("_n") - F.col("_p")
    ap = F.sum(F.col("pos") / F.nullif("_p", F.lit(0)) * F.col("run_pos") / F.col("run_n"))
    below = negatives - (F.col("run_n") - F.col("run_pos"))          # negatives with a lower score
    tied = F.col("n") - F.col("pos")
    auc = F.sum(F.col("pos") * (below + 0.5 * tied)) / F.nullif(F.max(F.col("_p") * negatives), F.lit(0))
    both = F.max((F.col("_p") > 0) & (negatives > 0))
    return r.groupBy(*keys).agg(F.when(both, ap).alias("pr_auc"), F.when(both, auc).alias("roc_auc"))


def brier(df: DataFrame, keys: list[str], y: str = "y_true", score: str = "y_score") -> DataFrame:
    return df.groupBy(*keys).agg(*_squares(y, score))


def _squares(y: str, score: str) -> list[Column]:
    return [F.avg((F.col(score) - F.col(y)) ** 2).alias("brier"), F.avg(y).alias("positive_rate"),
            F.sum(y).alias("n_positive"), F.count(F.lit(1)).alias("n_samples")]


def metric_suite(df: DataFrame, keys: list[str], threshold: Column | float = 0.5,
                 y: str = "y_true", score: str = "y_score") -> DataFrame:
    """All metrics per group, with the positive rate as PR-AUC baseline and the lift over it. All but the ranking are one
    aggregation."""
    plain = _rates(df.groupBy(*keys).agg(*_cells(threshold, y, score), _false_alarms(threshold, y, score), *_squares(y, score)))
    out = attach(ranking(df, keys, y, score), plain, keys)
    out = (out.withColumn("pr_auc_baseline", F.col("positive_rate"))
           .withColumn("pr_auc_lift", F.col("pr_auc") - F.col("pr_auc_baseline")))
    guard_names(out.columns)
    return out


def best_threshold(df: DataFrame, keys: list[str], y: str = "y_true", score: str = "y_score") -> DataFrame:
    """First of the 60 candidate quantiles with the largest F1; 0.5 for a single class.

    Calibration rows only. Counts above each candidate come from the running
    counts per distinct score, not from comparing every row with every candidate.
    The distinct scores are read several times, so they are written once.
    """
    counted = staged(_by_score(df, keys, y, score), "scores")
    candidates = (exact_quantiles(counted, keys, score, CANDIDATE_PROBS, weight="n")
                  .select(*keys, F.col("quantile").alias("threshold")).distinct())
    merged = (counted.select(*keys, F.col(score).alias("_at"), "pos", "n", F.lit(0).alias("cand"))
              .unionByName(candidates.select(*keys, F.col("threshold").alias("_at"), F.lit(0).alias("pos"),
                                             F.lit(0).alias("n"), F.lit(1).alias("cand")))
              .groupBy(*keys, "_at").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.max("cand").alias("cand")))
    totals = counted.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("n").alias("_n"))
    r = running_totals(merged, keys, "_at", ["pos", "n"], descending=True).filter("cand = 1").join(totals, keys)
    f1 = _share(2.0 * F.col("run_pos"), F.col("run_n") + F.col("_p"))
    best = (r.withColumn("_f1", f1).groupBy(*keys)
            .agg(F.max(F.struct("_f1", (-F.col("_at")).alias("neg"))).alias("b"),
                 F.max("_p").alias("_p"), F.max("_n").alias("_n")))
    single = (F.col("_p") == 0) | (F.col("_p") == F.col("_n"))
    return best.select(*keys, F.when(single, 0.5).otherwise(-F.col("b.neg")).alias("threshold"),
                       F.when(~single, F.col("b._f1")).alias("f1"))


def lead_time(df: DataFrame, keys: list[str], episodes: DataFrame, sustained: int = S.SUSTAINED_DAYS,
              lookback: int = S.LEAD_TIME_LOOKBACK_DAYS, score: str = "y_score", threshold: str = "threshold") -> DataFrame:
    """Days of warning before each episode.

    The first row of a run of ``sustained`` rows at or above the threshold in the
    look-back counts; failing that the first one inside the episode, negative.
    Episodes without either stay, unwarned. ``df`` has one row per key and date.
    """
    run = Window.partitionBy(*keys).orderBy("date").rowsBetween(0, sustained - 1)
    above = (F.col(score) >= F.col(threshold)).cast("int")
    starts = (df.withColumn("_run", F.sum(above).over(run)).filter(F.col("_run") == sustained)
              .select(*keys, "date"))
    days = episodes.select("episode", "start", F.explode(
        F.sequence(F.date_sub("start", lookback), F.col("end"))).alias("date"))
    early = F.min(F.when(F.col("date") < F.col("start"), F.col("date")))
    late = F.min(F.when(F.col("date") >= F.col("start"), F.col("date")))
    hits = (starts.join(days, "date").groupBy(*keys, "episode")
            .agg(F.coalesce(early, late).alias("first_warning")))
    names = F.array_agg(F.struct("episode", "start"))
    grid = (df.select(*keys).distinct().withColumn("_e", F.explode(episodes.agg(names).scalar()))
            .select(*keys, "_e.episode", "_e.start"))
    return (grid.join(hits, [*keys, "episode"], "left")
            .withColumn("lead_time_days", F.datediff("start", "first_warning"))
            .withColumn("warned", F.col("first_warning").isNotNull()).drop("first_warning"))


def aggregate_folds(per_fold: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and population deviation of each metric over a model's folds; counts are summed."""
    guard_names(metrics)
    return per_fold.groupBy("model").agg(
        *[F.avg(m).alias(f"{m}_mean") for m in metrics], *[F.stddev_pop(m).alias(f"{m}_std") for m in metrics],
        F.sum("n_positive").alias("n_positive"), F.sum("n_samples").alias("n_samples"))


def model_comparison(aggregate: DataFrame, metrics: list[str]) -> DataFrame:
    """One line per model with ``mean +/- std`` text, ranked by the PR-AUC number."""
    def text(m):
        return F.concat(fixed(f"{m}_mean", 3), F.lit(" +/- "), fixed(f"{m}_std", 3))
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("pr_auc_mean"), "model"))  # one row per model
    return aggregate.select(
        "model", rank.alias("rank"), *[text(m).alias(m) for m in metrics],
        F.round("pr_auc_baseline_mean", 4).alias("pr_auc_baseline"),
        F.round("pr_auc_lift_mean", 4).alias("pr_auc_lift"), F.col("n_samples").alias("n_test_samples"))


def per_fold_pivot(per_fold: DataFrame, folds: list[str], metric: str = "pr_auc") -> DataFrame:
    return per_fold.groupBy("model").pivot("fold", folds).agg(F.max(metric))
