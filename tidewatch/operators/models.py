"""Scoring rules and classifiers over windows, walk-forward."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import settings as S
from tidewatch.functions.ranks import empirical_cdf, exact_quantiles
from tidewatch.operators import metrics as M
from tidewatch.operators import splits as SP
from tidewatch.operators import windows as W
from tidewatch.session import staged

KEY = ["asset", "window_end"]


def rule_scores(marked: DataFrame, folds: list[dict], signal: str = "realized_vol_7",
                quantile: float = 0.90, embargo: int = S.EMBARGO_DAYS) -> DataFrame:
    """Volatility rule: a test window's share of training readings at or below its own.

    Labels are not used; ``vol_threshold`` is the training quantile at which the rule fires.
    """
    roles = SP.walk_forward(marked.filter("emit").select(
        "asset", "window_start", "window_end", "label_end", "label", F.col(signal).alias("signal")), folds, embargo)
    train, test = roles.filter("role = 'train'"), roles.filter("role = 'test'")
    limits = exact_quantiles(train, ["fold"], "signal", [quantile]).select("fold", F.col("quantile").alias("vol_threshold"))
    scored = empirical_cdf(train, test, ["fold"], "signal", "y_score")
    return scored.join(limits, "fold").select("fold", *KEY, "label", "y_score", "vol_threshold")


def logreg(max_iter: int = 100) -> Estimator:
    """L2 logistic regression on balanced weights; ``fit`` sets the penalty from the number of rows."""
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                              maxIter=max_iter, standardization=False)


def _penalised(estimator: Estimator, rows: DataFrame, inverse: float = 1.0) -> Estimator:
    """The penalty is half the squared weights against the summed loss times ``inverse``; Spark divides the loss by the
    weights' sum, which balanced weights make the number of rows."""
    if not isinstance(estimator, LogisticRegression):
        return estimator
    return estimator.copy({estimator.regParam: 1.0 / (inverse * max(1, rows.count()))})


def forest(trees: int = 400, depth: int = 8, seed: int = 42) -> Estimator:
    return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight",
                                  numTrees=trees, maxDepth=depth, seed=seed)


def gbt(rounds: int = 400, depth: int = 4, step: float = 0.05, seed: int = 42) -> Estimator:
    return GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight",
                         maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)


def mlp(width: int, hidden: tuple[int, ...] = (64, 32), max_iter: int = 500, seed: int = 42) -> Estimator:
    """Feed-forward network. It takes no weights; resample the rows instead."""
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol="label",
                                          layers=[width, *hidden, 2], maxIter=max_iter, seed=seed)


def probability() -> Column:
    """Of the positive class; 0 from a forest that saw no positive row, which knows one class alone."""
    return F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))


def training_rows(tensor: DataFrame, folds: list[dict], features: list[str], marked: DataFrame,
                  embargo: int = S.EMBARGO_DAYS) -> DataFrame:
    """(fold, role, asset, window_end, label, features): windows of every fold, scaled on its training part.

    Windows are spread evenly over the shuffle's partitions: they are far larger than
    the panel rows they come from, and every training iteration scans them.
    """
    arrays = SP.scale_arrays(SP.fit_scaler(marked, folds, features, embargo), features)
    roles = SP.walk_forward(tensor, folds, embargo).filter("role IN ('train', 'test')")
    return (SP.scale_windows(roles, arrays)
            .withColumn("features", W.flat_vector()).withColumn("label", F.col("label").cast("double"))
            .select("fold", "role", "asset", "window_start", "window_end", "label_end", "label", "features")
            .repartition("asset", "window_end"))


def fit(estimator: Estimator, rows: DataFrame, resample: bool = False) -> Model:
    """Fit on balanced class weights, or on rows resampled by them."""
    weighted = SP.with_class_weight(rows, [])
    if resample:
        weighted = SP.weighted_resample(weighted, [], KEY)
    return _penalised(estimator, rows).fit(weighted)


def at_once(jobs: list, fn: Callable, parallelism: int = 4) -> list:
    """``fn`` of every job, a few at a time: fits are many short Spark jobs, which leave cores idle one after the other."""
    with ThreadPool(min(parallelism, len(jobs))) as pool:
        return pool.map(inheritable_thread_target(fn), jobs)


def rule_parts(parts: DataFrame, signals: DataFrame) -> DataFrame:
    """The volatility rule over ``parts``: share of a fold's ``fit`` readings at or below each other window's own.

    ``signals`` is (asset, window_end, signal).
    """
    known = parts.select("fold", "part", *KEY, "label").join(signals, KEY)
    return empirical_cdf(known.filter("part = 'fit'"), known.filter("part <> 'fit'"), ["fold"], "signal", "y_score")


def walk_forward(rows: DataFrame, models: dict[str, Callable[[], Estimator]], folds: list[dict],
                 embargo: int = S.EMBARGO_DAYS, scorers: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Fit every model on every fold, calibrate its threshold on later training windows, score the test windows.

    ``rows`` comes from ``training_rows``. The split of all folds is written once,
    by fold, so each fit reads only its own files. The few (model, fold) pairs are
    fitted a few at a time, each as distributed jobs, and all thresholds come from
    one pass over the calibration scores. ``scorers`` are models that take all folds
    at once: (fold, part, asset, window_end, label, ..) in, the windows outside ``fit``
    with their ``y_score`` out.
    """
    columns = ["fold", "part", *KEY, "label", "features"]
    parts = staged(SP.calibration(rows, embargo).select(columns).unionByName(
        rows.filter("role = 'test'").withColumn("part", F.lit("test")).select(columns)), "parts", ["fold"])
    def one(pair: tuple[str, str]) -> DataFrame:
        mine = parts.filter(F.col("fold") == pair[0])
        model = fit(models[pair[1]](), mine.filter("part = 'fit'"))
        return model.transform(mine.filter("part <> 'fit'")).select(
            "fold", F.lit(pair[1]).alias("model"), "part", F.col("window_end").alias("date"), "asset",
            F.col("label").cast("long").alias("y_true"), probability().alias("y_score"))

    outs = at_once([(f["fold"], name) for f in folds for name in models], one)
    outs += [score(parts).select("fold", F.lit(name).alias("model"), "part", F.col("window_end").alias("date"), "asset",
                                 F.col("label").cast("long").alias("y_true"), "y_score") for name, score in (scorers or {}).items()]
    scored = staged(reduce(DataFrame.unionByName, outs), "scored")
    limits = M.best_threshold(scored.filter("part = 'calibrate'"), ["fold", "model"]).select("fold", "model", "threshold")
    return (scored.filter("part = 'test'").drop("part").join(limits, ["fold", "model"], "left")
            .withColumn("threshold", F.coalesce("threshold", F.lit(0.5))))


def deploy(estimator: Estimator, rows: DataFrame, path: str) -> PipelineModel:
    """Fit on the resolvable windows, save, and reload what a scoring job would read."""
    weighted = SP.with_class_weight(rows, [])
    Pipeline(stages=[_penalised(estimator, rows)]).fit(weighted).write().overwrite().save(path)
    return PipelineModel.load(path)
