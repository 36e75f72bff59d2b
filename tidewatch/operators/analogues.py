"""Nearest earlier windows of a decision point, and what followed them."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import settings as S
from tidewatch.functions.canon import fixed, percent
from tidewatch.operators.outcomes import ahead


def latest_queries(vectors: DataFrame) -> DataFrame:
    """One query per asset: its latest vector."""
    return vectors.groupBy("asset").agg(F.max("date").alias("as_of"), F.max_by("vec", "date").alias("query"))


def queries_at(vectors: DataFrame, points: DataFrame) -> DataFrame:
    """One query per point (asset, as_of, date): the vector of its row."""
    return points.join(vectors.withColumnRenamed("vec", "query"), ["asset", "date"]).drop("date")


def _history(vectors: DataFrame, queries: DataFrame, past_only: bool) -> DataFrame:
    """Each query meets its own asset's history; queries are few, history stays partitioned."""
    df = vectors.join(queries, "asset")
    return df.filter(F.col("date") <= F.col("as_of")) if past_only else df


def _scaled(history: DataFrame) -> DataFrame:
    """History and query as z-scores of the query's history; a constant dimension is only centred."""
    stats = history.groupBy("asset", "as_of").agg(
        Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("vec")).alias("s"))
    n = F.col("s.count")
    spread = F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(F.greatest(v * (n - 1) / n, F.lit(0.0))))
    stats = stats.select("asset", "as_of", vector_to_array("s.mean").alias("_m"),
                         F.transform(spread, lambda x: F.when(x > 1e-12, x).otherwise(F.lit(1.0))).alias("_s"))
    def z(c):
        centred = F.zip_with(c, "_m", lambda x, m: x - m)
        return F.zip_with(centred, "_s", lambda d, s: d / s)
    return (history.join(stats, ["asset", "as_of"])
            .withColumns({"vec": z("vec"), "query": z("query")}).drop("_m", "_s"))


def _dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _top(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("asset", "as_of").orderBy(F.desc("similarity"), "date")
    return (scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("asset", "as_of", "date", "similarity", "rank"))


def _eligible(df: DataFrame, exclude_days: int, past_only: bool) -> DataFrame:
    gap = F.datediff("as_of", "date")
    return df.filter((gap if past_only else F.abs(gap)) >= exclude_days)


def nearest_cosine(vectors: DataFrame, queries: DataFrame, k: int = S.ANALOGUE_K,
                   exclude_days: int = S.ANALOGUE_EXCLUDE_DAYS, past_only: bool = True) -> DataFrame:
    """The k most similar windows of the same asset, at least ``exclude_days`` away.

    With ``past_only`` neither candidates nor scaling look beyond the query date.
    """
    df = _eligible(_scaled(_history(vectors, queries, past_only)), exclude_days, past_only)
    norm = F.sqrt(_dot("vec", "vec")) * F.sqrt(_dot("query", "query"))
    similarity = _dot("vec", "query") / F.when(norm > 1e-12, norm).otherwise(F.lit(1.0))
    return _top(df.withColumn("similarity", similarity), k)


def outcomes(matches: DataFrame, prices: DataFrame, days: int = S.ANALOGUE_OUTCOME_DAYS) -> DataFrame:
    """Drawdown and return in the days after each match; unavailable with fewer than two prices."""
    seen = ahead(matches.select("asset", F.col("date").alias("match")).distinct(), prices, ["asset", "match"], "match", days)
    df = matches.join(seen.withColumnRenamed("match", "date"), ["asset", "date"], "left")
    ok = F.coalesce(F.col("days_observed") >= 2, F.lit(False))
    start = F.col("start_price")
    return df.select("asset", "as_of", "date", "rank", "similarity", ok.alias("available"),
                     F.when(ok, (start - F.col("min_price")) / start).alias("max_drawdown"),
                     F.when(ok, (F.col("end_price") - start) / start).alias("return"),
                     F.when(ok, F.col("days_observed")).alias("days_observed"))


def summary(found: DataFrame) -> DataFrame:
    """One line per query."""
    head = F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(" ("), "asset", F.lit(", similarity "), fixed("similarity", 2), F.lit(")"))
    line = F.when(F.col("available"), F.concat(head, F.lit(" was followed by a "), percent("max_drawdown", 1), F.lit(" drawdown"))
                  ).otherwise(F.concat(head, F.lit("; outcome unavailable")))
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return found.groupBy("asset", "as_of").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "; ").alias("summary"))
