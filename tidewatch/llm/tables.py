"""Reading the corpus tables, sizing, and small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import scratch_path

#: Separators of words, as a character class of Java and of Python: space and the ASCII controls 9 to 13.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the given data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` only, a missing text being empty: other columns cannot clash with those an operator adds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct ``_whole``, out of the way of columns that an operator adds."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_whole")


def partitions(spark: SparkSession) -> int:
    """Partitions for shuffles of whole texts: the session's setting, which the cluster sizes to its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def staged_small(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder with zstd, read back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it.

    The optimiser may copy a named expression into every place that refers to it, even into a function that runs per
    array element. A lambda variable is never copied.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def part_offsets(parts: DataFrame, part: str, amount: str, name: str) -> DataFrame:
    """``part, name``: sum of ``amount`` over all smaller parts. ``parts`` has one row per partition of a written table,
    so the unpartitioned window sees as many rows as that table has partitions."""
    from pyspark.sql import Window

    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(part, F.coalesce(F.sum(amount).over(before), F.lit(0)).cast("long").alias(name))


def batches(stream: Iterator, columns: list[str], size: int) -> Iterator[list[tuple]]:
    """Rows of Arrow batches, in lists of about ``size`` characters of the last column."""
    held: list[tuple] = []
    amount = 0
    for batch in stream:
        for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns), strict=True):
            held.append(row)
            amount += len(row[-1])
            if amount >= size:
                yield held
                held, amount = [], 0
    if held:
        yield held
