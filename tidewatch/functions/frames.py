"""Window frames and null-safe arithmetic.

The panel holds one row per (asset, day), so a window partitioned by asset is
bounded by the number of calendar days however large the raw feed is; the raw
feed itself is only ever reduced with partially aggregated ``groupBy``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ordered(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*(keys or ("asset",))).orderBy(order)


def trailing(n: int, *keys: str, order: str = "date") -> WindowSpec:
    """The current row and the n-1 rows before it."""
    return ordered(*keys, order=order).rowsBetween(-(n - 1), 0)


def expanding(*keys: str, order: str = "date") -> WindowSpec:
    return ordered(*keys, order=order).rowsBetween(Window.unboundedPreceding, 0)


def full_window(agg: Callable[[Column], Column], x: Column | str, n: int,
                over: WindowSpec) -> Column:
    """``agg`` over the frame, NULL unless all n values are present."""
    x = col(x)
    return F.when(F.count(x).over(over) == n, agg(x).over(over))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL when b is zero or missing."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def rolling_z(x: Column | str, n: int, *keys: str, order: str = "date") -> Column:
    """(x - mean) / sample std over the last n rows, NULL for a constant window."""
    w = trailing(n, *keys, order=order)
    return ratio(col(x) - full_window(F.avg, x, n, w), full_window(F.stddev_samp, x, n, w))


def pair_corr(x: Column | str, y: Column | str, over: WindowSpec | None = None) -> Column:
    """Pearson correlation over pair-complete rows, NULL when a side is constant.

    A group's rows come from several tasks, and merging their moments leaves a constant a spread of rounding noise;
    there a side is constant if its least value is its greatest. A window takes its rows one by one, without noise.
    """
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    parts = [F.covar_pop(xs, ys), F.stddev_pop(xs), F.stddev_pop(ys)]
    if over is not None:
        parts = [p.over(over) for p in parts]
        return ratio(parts[0], parts[1] * parts[2])
    return F.when((F.min(xs) < F.max(xs)) & (F.min(ys) < F.max(ys)), ratio(parts[0], parts[1] * parts[2]))


def clip(x: Column, low: float, high: float) -> Column:
    """x limited to [low, high]; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def finite(x: Column | str) -> Column:
    """NULL instead of NaN or an infinity."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def ewm_means(df, values: dict[str, str], alpha: float, min_rows: int, *keys: str,
              order: str = "date", block: int = 256):
    """Exponentially weighted means without a recursion: ``{out: value}``, NULLs shared by all values.

    Unrolled, the mean seeded by the first value is a weighted sum with weights
    (1-alpha)^age. Rows are cut into blocks; inside a block it is a running sum of
    re-scaled values. Every block leaves one total, and the totals of all blocks
    before a row's own, decayed in their order, are added: the full recursion, down
    to values that only a long-past row keeps from zero. Work is linear in the rows;
    the totals of a key are one short list of days / block entries.
    """
    keys = keys or ("asset",)
    decay = 1.0 - alpha
    known = col(next(iter(values.values()))).isNotNull()
    df = df.withColumn("_n", F.when(known, F.count(F.when(known, 1)).over(expanding(*keys, order=order))))
    pos = F.col("_n") - 1
    own = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    weights = {f"_w_{out}": F.when(pos == 0, col(v) / alpha).otherwise(col(v))
               * F.pow(F.lit(1.0 / decay), pos % block) for out, v in values.items()}
    df = df.withColumns({"_blk": F.floor(pos / block), **weights})
    totals = (df.filter(F.col("_blk").isNotNull()).groupBy(*keys, "_blk").agg(*[F.sum(w).alias(w) for w in weights])
              .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_blk", *weights))).alias("_blocks")))
    df = df.join(totals, list(keys), "left")
    def carried(weight: str) -> Column:
        before = F.filter("_blocks", lambda b: b["_blk"] < F.col("_blk"))
        return F.aggregate(before, F.lit(0.0), lambda acc, b: (acc + b[weight]) * decay ** block)

    means = {}
    for out in values:
        total = F.sum(f"_w_{out}").over(own) + F.coalesce(carried(f"_w_{out}"), F.lit(0.0))
        means[out] = F.when(F.col("_n") >= min_rows, F.lit(alpha) * total * F.pow(F.lit(decay), pos % block))
    return df.withColumns(means).drop("_n", "_blk", "_blocks", *weights)
