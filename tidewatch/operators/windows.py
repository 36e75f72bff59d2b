"""Sliding look-back windows over complete feature rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.ml.functions import array_to_vector

from tidewatch import settings as S
from tidewatch.functions.frames import finite, ordered, trailing


def mark_windows(panel: DataFrame, features: list[str], lookback: int = S.LOOKBACK,
                 horizon: int = S.HORIZON_DAYS, stride: int = 1, label: str = "label") -> DataFrame:
    """Every panel row with ``emit``: the window ending there is complete and its label is known."""
    absent = [c for c in [*features, label] if c not in panel.columns]
    if absent:
        raise ValueError(f"panel lacks {absent}")
    if stride < 1 or lookback < 1:
        raise ValueError("lookback and stride must be positive")
    complete = None
    for f in features:
        ok = finite(F.col(f).cast("double")).isNotNull()
        complete = ok if complete is None else complete & ok
    w = trailing(lookback)
    row = F.row_number().over(ordered())
    return panel.withColumns({
        "window_start": F.min("date").over(w), "window_end": F.col("date"),
        "label_end": F.date_add("date", horizon), "_row": row,
        "_ok": F.sum(complete.cast("int")).over(w),
    }).withColumn("emit", (F.col("_ok") == lookback) & (F.col("_row") >= lookback)
                  & F.col(label).isNotNull() & (F.pmod(F.col("_row") - lookback, F.lit(stride)) == 0)
                  ).drop("_row", "_ok")


def window_meta(marked: DataFrame, label: str = "label") -> DataFrame:
    return marked.filter("emit").select("asset", "window_start", "window_end", "label_end", label)


def window_tensor(marked: DataFrame, features: list[str], lookback: int = S.LOOKBACK,
                  label: str = "label") -> DataFrame:
    """Meta plus ``feats``: lookback x features values, oldest row first.

    This multiplies the data by the lookback, so join to the folds first where possible.
    """
    row = F.array(*[F.col(f).cast("double") for f in features])
    return (marked.withColumn("feats", F.collect_list(row).over(trailing(lookback)))
            .filter("emit").select("asset", "window_start", "window_end", "label_end", label, "feats"))


def flat(feats: Column | str = "feats") -> Column:
    """Timestep-major flattening."""
    return F.flatten(feats)


def flat_vector(feats: Column | str = "feats") -> Column:
    return array_to_vector(F.flatten(feats))


def flat_names(features: list[str], lookback: int = S.LOOKBACK) -> list[str]:
    return [f"{f}[t-{lookback - 1 - t}]" for t in range(lookback) for f in features]


def named_cells(tensor: DataFrame, features: list[str], lookback: int = S.LOOKBACK) -> DataFrame:
    """Long form of the flattened window: position, name and value."""
    names = F.array(*[F.lit(f) for f in features])
    width = len(features)
    name = F.concat(F.element_at(names, (F.pmod("pos", F.lit(width)) + 1).cast("int")), F.lit("[t-"),
                    (lookback - 1 - F.floor(F.col("pos") / width)).cast("string"), F.lit("]"))
    return (tensor.select("asset", "window_end", F.posexplode(flat()).alias("pos", "value"))
            .withColumn("name", name))


def multiplicity(marked: DataFrame, chosen: Column, lookback: int = S.LOOKBACK) -> Column:
    """In how many chosen windows a row lies: those ending on it or in the next lookback-1 rows."""
    ahead = ordered().rowsBetween(0, lookback - 1)
    return F.sum((F.col("emit") & F.coalesce(chosen, F.lit(False))).cast("int")).over(ahead)
