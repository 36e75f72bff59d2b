"""Files: the frozen panel, result tables, window tensors and JSON-lines ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def freeze_panel(panel: DataFrame, path: str) -> None:
    """Parquet by asset, sorted by date: an asset filter prunes folders, a date filter prunes row groups."""
    (panel.repartition("asset", F.year("date")).sortWithinPartitions("asset", "date")
     .write.mode("overwrite").option("compression", "snappy").partitionBy("asset").parquet(path))


def load_panel(spark: SparkSession, path: str, targets: DataFrame | None = None) -> DataFrame:
    panel = spark.read.parquet(path)
    return panel if targets is None else panel.join(targets.select("asset"), "asset", "left_semi")


def write_table(df: DataFrame, path: str) -> None:
    """A result table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_windows(tensor: DataFrame, path: str) -> None:
    tensor.write.mode("overwrite").partitionBy("asset").parquet(path)


def read_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; blank and corrupt lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
