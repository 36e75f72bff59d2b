"""Order statistics that never put a whole group into one task.

Rows are first counted per distinct value (partial aggregation), the values are
cut into ranges at approximate quantiles, running sums are taken inside each
range, and the range totals - a bounded number per group - supply the offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A group is cut into so many ranges at least; more where the session shuffles into more partitions.
RANGES = 64


def attach(df: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of its group. Without keys ``groups`` is one row (an aggregate over everything), which is
    broadcast; with keys Spark picks the join by size."""
    return df.join(groups, keys) if keys else df.crossJoin(F.broadcast(groups))


def running_totals(df: DataFrame, keys: list[str], order: str, sums: list[str],
                   descending: bool = False, ranges: int | None = None) -> DataFrame:
    """Inclusive running sums ``run_<c>`` per key in the order of a column unique per key."""
    ranges = ranges or max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.groupBy(*keys).agg(
        F.percentile_approx(order, [i / ranges for i in range(1, ranges)], F.lit(10000)).alias("_cuts"))
    cut = (attach(df, cuts, keys)
           .withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(order))))
           .drop("_cuts"))
    value_order = F.desc(order) if descending else F.asc(order)
    range_order = F.desc("_range") if descending else F.asc("_range")
    inside = (Window.partitionBy(*keys, "_range").orderBy(value_order)
              .rowsBetween(Window.unboundedPreceding, 0))
    before = (Window.partitionBy(*keys).orderBy(range_order)
              .rowsBetween(Window.unboundedPreceding, -1))
    totals = cut.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_tot_{c}") for c in sums])
    offsets = totals.select(*keys, "_range", *[
        F.coalesce(F.sum(f"_tot_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sums])
    out = cut.join(offsets, [*keys, "_range"])
    for c in sums:
        out = out.withColumn(f"run_{c}", F.sum(c).over(inside) + F.col(f"_off_{c}"))
    return out.drop("_range", *[f"_off_{c}" for c in sums])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float],
                    weight: str | None = None) -> DataFrame:
    """Linear-interpolated quantiles: one row (keys, prob, quantile, n) per key and probability.

    ``weight`` is a whole number of copies of the row.
    """
    copies = F.sum(weight) if weight else F.count(F.lit(1))
    counted = (df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
               .agg(copies.cast("long").alias("_w")).filter("_w > 0"))
    sizes = counted.groupBy(*keys).agg(F.sum("_w").alias("n"))
    ranked = running_totals(counted, keys, value, ["_w"])
    ranked = attach(ranked, sizes, keys)

    def target(p):
        h = p * (F.col("n") - 1)
        lo = F.floor(h)
        return F.struct(p.alias("prob"), lo.alias("lo"),
                        F.least(lo + 1, F.col("n") - 1).alias("hi"), (h - lo).alias("frac"))

    def here(rank):
        return (rank >= F.col("run__w") - F.col("_w")) & (rank < F.col("run__w"))

    hits = ranked.withColumn("_q", F.explode(F.filter(
        F.transform(F.lit(probs), target), lambda q: here(q["lo"]) | here(q["hi"]))))
    hits = hits.select(*keys, "n", "_q.prob", "_q.frac",
                       F.when(here(F.col("_q.lo")), F.col(value)).alias("_lo"),
                       F.when(here(F.col("_q.hi")), F.col(value)).alias("_hi"))
    return (hits.groupBy(*keys, "prob")
            .agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"),
                 F.max("frac").alias("_f"), F.max("n").alias("n"))
            .select(*keys, "prob",
                    (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("quantile"), "n"))


def empirical_cdf(reference: DataFrame, query: DataFrame, keys: list[str], value: str,
                  out: str = "cdf") -> DataFrame:
    """Share of reference values <= each query value, per key: a merge of two sorted sides."""
    both = (reference.select(*keys, value, F.lit(1).alias("_ref"))
            .unionByName(query.select(*keys, value, F.lit(0).alias("_ref")))
            .filter(F.col(value).isNotNull())
            .groupBy(*keys, value).agg(F.sum("_ref").alias("_ref")))
    sizes = both.groupBy(*keys).agg(F.sum("_ref").alias("_n"))
    position = (attach(running_totals(both, keys, value, ["_ref"]), sizes, keys)
                .select(*keys, value, (F.col("run__ref") / F.nullif("_n", F.lit(0))).alias(out)))
    return query.join(position, [*keys, value], "left")


def expanding_rank(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """For every row, how many rows up to it (in ``order``) are <= and < its value.

    Adds ``rank_le``, ``rank_lt`` and ``rank_n``; NULL values are dropped. The
    history before row i splits into the dyadic blocks given by the set bits of i.
    Each row visits one node per bit; a node counts its left half by value with a
    single window, so the cost is n log n instead of one comparison per pair.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    base = (df.filter(F.col(value).isNotNull())
            .withColumn("_i", F.row_number().over(w) - 1)
            .withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
            .withColumn("rank_eq", F.row_number().over(Window.partitionBy(*keys, value).orderBy(order))))
    last_bit = F.floor(F.log2(F.col("_size").cast("double"))).cast("int")
    nodes = (base.select(*keys, order, value, "_i",
                         F.explode(F.sequence(F.lit(0), last_bit)).alias("_bit"))
             .withColumn("_right", F.expr("shiftright(_i, _bit) & 1"))
             .withColumn("_node", F.expr("shiftright(_i, _bit + 1)")))
    by_value = (Window.partitionBy(*keys, "_bit", "_node").orderBy(value)
                .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    counted = (nodes.withColumn("_le", F.sum(1 - F.col("_right")).over(by_value))
               .filter("_right = 1")
               .groupBy(*keys, order).agg(F.sum("_le").alias("_before")))
    return (base.join(counted, [*keys, order], "left")
            .withColumn("rank_le", F.coalesce(F.col("_before"), F.lit(0)) + 1)
            .withColumn("rank_lt", F.col("rank_le") - F.col("rank_eq"))
            .withColumn("rank_n", F.col("_i") + 1)
            .drop("_i", "_size", "_before", "rank_eq"))
