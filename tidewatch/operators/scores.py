"""Out-of-fold scores with their validity, and the scores a decision date may see.

A score table has one row per (model, asset, date): the probability for the window ending on that date, from the fit in
use then. ``trained_until`` is the last label end of that fit's training windows and ``valid_from`` the day the fit goes
into use, the start of its fold's test period; it stays in use until the next fold's. Only windows that end while a fit
is in use are scored by it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import settings as S
from tidewatch.functions.ranks import empirical_cdf
from tidewatch.operators import models as MO
from tidewatch.operators import splits as SP
from tidewatch.operators import windows as W
from tidewatch.session import staged

COLUMNS = ["model", "fold", "trained_until", "valid_from", "asset", "date", "probability"]
#: Logits beyond this are no further from certainty.
MOST = 30.0


def in_use(date: Column | str, folds: list[dict]) -> Column:
    """``(fold, valid_from)`` of the fit in use on a date, NULL before the first one. Folds are in order of time."""
    day = F.col(date) if isinstance(date, str) else date
    starts = [F.lit(f["test_start"]).cast("date") for f in folds]
    ends = [*starts[1:], None]
    return F.coalesce(*[F.when((day >= a) if b is None else (day >= a) & (day < b), F.struct(F.lit(f["fold"]).alias("fold"), a.alias("valid_from")))
                        for f, a, b in zip(folds, starts, ends, strict=True)])


def complete_windows(panel: DataFrame, features: list[str]) -> DataFrame:
    """Panel rows on which a complete window ends, labelled or not, with its start and label end."""
    return W.mark_windows(panel.withColumn("_any", F.lit(0)), features, label="_any").filter("emit").drop("_any", "emit")


def training(windows: DataFrame, folds: list[dict], embargo: int = S.EMBARGO_DAYS) -> DataFrame:
    """Labelled windows that each fold's fit may see."""
    return SP.walk_forward(windows.filter("label IS NOT NULL"), folds, embargo).filter("role = 'train'").drop("role")


def serving(windows: DataFrame, folds: list[dict]) -> DataFrame:
    """Windows with the fit in use on their last day."""
    return (windows.withColumn("_use", in_use("window_end", folds)).filter("_use IS NOT NULL")
            .withColumns({"fold": F.col("_use.fold"), "valid_from": F.col("_use.valid_from")}).drop("_use"))


def _table(model: str, scored: DataFrame, train: DataFrame) -> DataFrame:
    until = train.groupBy("fold").agg(F.max("label_end").alias("trained_until"))          # one row per fold
    return (scored.join(F.broadcast(until), "fold").filter("probability IS NOT NULL")
            .select(F.lit(model).alias("model"), "fold", "trained_until", "valid_from", "asset", F.col("window_end").alias("date"), "probability"))


def rule(windows: DataFrame, folds: list[dict], signal: str = "realized_vol_7", embargo: int = S.EMBARGO_DAYS) -> DataFrame:
    """The volatility rule: share of a fold's training readings at or below the window's own."""
    train = training(windows, folds, embargo).withColumn("_signal", F.col(signal))
    scored = empirical_cdf(train, serving(windows, folds).withColumn("_signal", F.col(signal)), ["fold"], "_signal", "probability")
    return _table("rule", scored, train)


def discriminant(windows: DataFrame, folds: list[dict], features: list[str], embargo: int = S.EMBARGO_DAYS) -> DataFrame:
    """Linear discriminant on the window's last row, classes balanced, features independent within a class.

    The fit is one aggregate: class means and the pooled variance per feature. A fold whose training windows hold one class
    only has no fit; a constant feature has no say.
    """
    train = training(windows, folds, embargo)
    of = lambda f, c: F.when(F.col("label") == c, F.col(f).cast("double"))
    n1, n0 = F.sum(F.col("label").cast("double")), F.sum(1.0 - F.col("label"))
    fits = train.groupBy("fold").agg(*[
        F.struct(F.avg(of(f, 1)).alias("m1"), F.avg(of(f, 0)).alias("m0"),
                 ((n1 * F.var_pop(of(f, 1)) + n0 * F.var_pop(of(f, 0))) / (n1 + n0)).alias("v")).alias(f"_{f}") for f in features])
    term = lambda f: F.when(F.col(f"_{f}.v") > 1e-12, (F.col(f"_{f}.m1") - F.col(f"_{f}.m0")) / F.col(f"_{f}.v")
                            * (F.col(f).cast("double") - (F.col(f"_{f}.m1") + F.col(f"_{f}.m0")) / 2)).when(F.col(f"_{f}.v").isNotNull(), 0.0)
    logit = sum((term(f) for f in features[1:]), term(features[0]))
    bounded = F.when(logit.isNotNull(), F.greatest(F.least(logit, F.lit(MOST)), F.lit(-MOST)))
    scored = serving(windows, folds).join(F.broadcast(fits), "fold")                       # one row per fold
    return _table("discriminant", scored.withColumn("probability", 1.0 / (1.0 + F.exp(-bounded))), train)


def fitted(model: str, estimator: Estimator, panel: DataFrame, folds: list[dict], features: list[str], embargo: int = S.EMBARGO_DAYS) -> DataFrame:
    """A classifier over whole scaled windows: one fit per fold, scaler and classifier both from its training windows."""
    arrays = staged(SP.scale_arrays(SP.fit_scaler(W.mark_windows(panel, features), folds, features, embargo), features), "scales")
    ready = lambda df: SP.scale_windows(df, arrays).withColumn("features", W.flat_vector())
    # Every complete window is scored, labelled or not, so completeness alone decides and the label rides along.
    marked = W.mark_windows(panel.withColumn("_any", F.lit(0)), features, label="_any")
    tensor = staged(W.window_tensor(marked, features, label="label"), "tensor")
    known = staged(ready(training(tensor, folds, embargo)).select("fold", "asset", "window_end", "label_end", F.col("label").cast("double").alias("label"), "features"), "training")
    present = [r.fold for r in known.groupBy("fold").agg(F.countDistinct("label").alias("n")).filter("n > 1").select("fold").collect()]      # at most one per fold
    fitting = [f for f in folds if f["fold"] in present]
    asked = serving(tensor, folds).filter(F.col("fold").isin(present))
    asked = staged(ready(asked).select("fold", "valid_from", "asset", "window_end", "features"), "serving")

    def one(fold: dict) -> DataFrame:
        fit = MO.fit(estimator.copy(), known.filter(F.col("fold") == fold["fold"]))
        return fit.transform(asked.filter(F.col("fold") == fold["fold"])).select("fold", "valid_from", "asset", "window_end", MO.probability().alias("probability"))

    none = asked.select("fold", "valid_from", "asset", "window_end", F.lit(None).cast("double").alias("probability")).limit(0)
    return _table(model, reduce(DataFrame.unionByName, MO.at_once(fitting, one) if fitting else [], none), known)


def as_of(scores: DataFrame, keys: DataFrame) -> DataFrame:
    """Per (asset, date) of ``keys`` and model: the probability of the latest fit that the date may see.

    A row counts only if its fit was in use by the date and trained on labels that had all ended before it, whatever else
    the table holds; of several such fits the one that went into use last.
    """
    seen = (scores.join(keys.select("asset", "date").distinct(), ["asset", "date"])
            .filter((F.col("valid_from") <= F.col("date")) & (F.col("trained_until") < F.col("date"))))
    latest = Window.partitionBy("asset", "date", "model").orderBy(F.desc("valid_from"), F.desc("trained_until"))
    return (seen.withColumn("_k", F.row_number().over(latest)).filter("_k = 1")
            .select("asset", "date", "model", "probability", "fold", "trained_until", "valid_from"))
