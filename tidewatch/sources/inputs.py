"""Demo inputs: projections of the TPC-H-like tables onto the panel's source shapes.

Regions stand for assets, ship dates for days, orders for the market-wide index
and supply, documents for headlines.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRIMARY = "AMERICA"
# --- fixed values: the demo universe, episodes and folds ----------------------
ASSETS = [
    ("AFRICA", "target", "1995-01-01"), ("AMERICA", "target", "1995-01-01"),
    ("ASIA", "target", "1996-06-01"), ("EUROPE", "target", "1995-09-17"),
    ("MIDDLE EAST", "context", "1995-01-01"),
]
EPISODES = [
    ("E1", "1996-05-10", "1996-05-25"), ("E2", "1997-05-07", "1997-05-16"),
    ("E3", "1998-11-06", "1998-11-14"), ("E4", "2000-03-10", "2000-03-14"),
]
FOLDS = [
    {"fold": "fold1_1997", "train_end": "1996-12-31", "test_start": "1997-01-01", "test_end": "1997-12-31"},
    {"fold": "fold2_1998", "train_end": "1997-12-31", "test_start": "1998-01-01", "test_end": "1998-12-31"},
    {"fold": "fold3_1999", "train_end": "1998-12-31", "test_start": "1999-01-01", "test_end": "1999-12-31"},
    {"fold": "fold4_2000", "train_end": "1999-12-31", "test_start": "2000-01-01", "test_end": "2000-12-31"},
]
CYCLES = {"start": "1997-01-01", "end": "2000-12-31", "every_days": 45}
NEGATIVE = ["the", "of", "de", "to"]
POSITIVE = ["and", "in", "a", "is", "la"]


def _values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A literal table: its size is part of the plan, so Spark broadcasts it by itself."""
    text = ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({columns})")


def _cents(name: str):
    """Money as whole cents: integer sums are exact in any order, and much faster than decimals."""
    return F.floor(F.col(name) * 100.0 + 0.5)


class Inputs:
    """The tables below one directory, and the projections every operator starts from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def assets(self) -> DataFrame:
        return (_values(self.spark, ASSETS, "asset, role, inception")
                .withColumn("inception", F.to_date("inception")))

    @cached_property
    def episodes(self) -> DataFrame:
        return (_values(self.spark, EPISODES, "episode, start, end")
                .withColumns({c: F.to_date(c) for c in ("start", "end")}))

    @cached_property
    def bars(self) -> DataFrame:
        """Daily bars per region, from line items."""
        trades = (self.table("lineitem")
                  .select("l_suppkey", F.to_date("l_shipdate").alias("date"), "l_linestatus",
                          _cents("l_quantity").alias("qty"), _cents("l_extendedprice").alias("amount"),
                          (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"),
                          F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("k"))
                  .join(self.table("supplier").select("s_suppkey", "s_nationkey"),
                        F.col("l_suppkey") == F.col("s_suppkey"))
                  .join(self.table("nation").select("n_nationkey", "n_regionkey"),
                        F.col("s_nationkey") == F.col("n_nationkey"))
                  .join(self.table("region").select("r_regionkey", F.col("r_name").alias("asset")),
                        F.col("n_regionkey") == F.col("r_regionkey")))
        qty, amount = F.sum("qty") / 100.0, F.sum("amount") / 100.0
        filled = F.when(F.col("l_linestatus") == "F", F.col("qty")).otherwise(F.lit(0))
        return trades.groupBy("asset", "date").agg(
            F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"),
            (amount / qty).alias("close"), F.max_by("p", "k").alias("last_price"),
            qty.alias("volume"), amount.alias("quote_volume"),
            F.count(F.lit(1)).cast("double").alias("trades"),
            (F.sum(filled) / 100.0).alias("taker_buy_base"))

    @cached_property
    def fg_index(self) -> DataFrame:
        """A market-wide daily index in 0..100."""
        return (self.table("orders").groupBy(F.to_date("o_orderdate").alias("date"))
                .agg((F.lit(100.0) * F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).cast("double")
                      / F.count(F.lit(1))).alias("value")))

    @cached_property
    def supply(self) -> DataFrame:
        """A market-wide daily level; the running sum is over one row per calendar day."""
        daily = (self.table("orders").groupBy(F.to_date("o_orderdate").alias("date"))
                 .agg(F.sum(_cents("o_totalprice")).alias("flow")))
        upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        return daily.select("date", (F.sum("flow").over(upto) / 100.0).alias("value"))

    @cached_property
    def headlines(self) -> DataFrame:
        """Documents as headlines, whole texts."""
        day = F.date_add(F.lit("1995-01-02").cast("date"), ((F.col("doc_id") * 37) % 2499).cast("int"))
        return self.table("documents").select(
            "doc_id", "source", "lang", F.col("text").alias("title"),
            (day.cast("timestamp") + F.make_dt_interval(hours=(F.col("doc_id") % 24).cast("int"))).alias("published_at"))

    @cached_property
    def scores(self) -> DataFrame:
        """Scored labels: fold = language, model = source."""
        return (self.table("documents").select("doc_id", F.col("lang").alias("fold"), F.col("source").alias("model"))
                .join(self.table("labels").select("doc_id", (1 - F.col("quality")).alias("y_true")), "doc_id")
                .withColumn("y_score", ((F.col("doc_id") * 7919) % 997).cast("double") / 997))

    @cached_property
    def vectors(self) -> DataFrame:
        """Embedding vectors; the label stands for the asset, the id for the day."""
        return self.table("embeddings").select(
            F.col("label").cast("string").alias("asset"),
            F.date_add(F.lit("1995-01-02").cast("date"), F.col("vec_id").cast("int")).alias("date"),
            F.transform("embedding", lambda x: x.cast("double")).alias("vec"))

    @cached_property
    def cycles(self) -> DataFrame:
        """Monitoring dates."""
        return self.spark.sql(
            f"SELECT explode(sequence(date'{CYCLES['start']}', date'{CYCLES['end']}', "
            f"interval {CYCLES['every_days']} day)) AS as_of")
