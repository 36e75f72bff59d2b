"""Append-only records: each append is a folder of files that a numbered manifest makes visible, whole or not at all.

``path/commit=<name>/as_of_month=<division>/`` holds the rows, ``path/_manifests/<number>.json`` names the folder, its
divisions and, for streams, the batch. Readers open only what manifests name, so a killed append leaves nothing to be
seen. A manifest is written aside and renamed to its number only if that number is free, which HDFS does in one step (a
local disk checks, then renames); who comes second checks its ids against the winner's and takes the next number. There
is one small manifest per append, and an append opens only the divisions that it writes.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidewatch.session import staged

MONTH = "as_of_month"
PARTS = 64
MANIFEST = "number long, commit string, divisions array<string>, app string, batch long"


def division(df: DataFrame, date: str = "as_of_date", key: str = "prediction_id") -> Column:
    """The month of the record's date, or one of ``PARTS`` hash parts of its id; an id always meets the same division."""
    part = F.format_string("part-%02d", F.pmod(F.xxhash64(key), F.lit(PARTS)))
    return F.coalesce(F.date_format(F.to_date(F.col(date)), "yyyy-MM"), part) if date in df.columns else part


def manifests(spark: SparkSession, path: str) -> list[Row]:
    """What is visible, oldest first: one row per append."""
    fs, hadoop = _files(spark, path)
    if not fs.exists(hadoop.Path(f"{path}/_manifests")):
        return []
    return sorted(spark.read.schema(MANIFEST).json(f"{path}/_manifests/*.json").collect(), key=lambda r: r.number)


def append(new: DataFrame, path: str, date: str = "as_of_date", key: str = "prediction_id", fmt: str = "json",
           app: str | None = None, batch: int | None = None) -> None:
    """Rows whose ``key`` is not recorded yet; of rows with one key, one. A batch of ``app`` that is in already is left out."""
    spark = new.sparkSession
    fresh = staged(new.withColumn(MONTH, division(new, date, key)).dropDuplicates([key]), "append")
    divisions = sorted(r[0] for r in fresh.select(MONTH).distinct().collect())      # as many as the append touches
    while True:
        made = manifests(spark, path)
        if app is not None and any(m.app == app and m.batch == batch for m in made):
            return
        names = [m.commit for m in made if set(m.divisions) & set(divisions)]
        rows = fresh
        if names:
            known = _open(spark, path, names, fresh.schema, fmt).filter(F.col(MONTH).isin(divisions)).select(key).distinct()
            rows = fresh.join(known, key, "left_anti")
        name = f"c{uuid.uuid4().hex}"
        folder = f"{path}/commit={name}"
        rows.write.option("ignoreNullFields", False).partitionBy(MONTH).format(fmt).save(folder)
        number = made[-1].number + 1 if made else 1
        if publish(spark, path, {"number": number, "commit": name, "divisions": divisions, "app": app, "batch": batch}):
            return
        fs, hadoop = _files(spark, path)
        fs.delete(hadoop.Path(folder), True)        # never visible; written anew against the winner's ids


def publish(spark: SparkSession, path: str, manifest: dict) -> bool:
    """Give a manifest its number; False if another append holds it."""
    fs, hadoop = _files(spark, path)
    target = fs.makeQualified(hadoop.Path(f"{path}/_manifests/{manifest['number']:012d}.json"))
    draft = fs.makeQualified(hadoop.Path(f"{path}/_drafts/{manifest['commit']}.json"))
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(manifest).encode() + b"\n"))
    out.close()
    fs.mkdirs(target.getParent())
    keep = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, keep)
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        fs.delete(draft, False)
        return False


def read(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "json") -> DataFrame:
    """All visible records."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = [m.commit for m in manifests(spark, path)]
    if not names:
        return spark.createDataFrame([], fields)
    whole = StructType([*fields.fields, StructField(MONTH, StringType())])
    return _open(spark, path, names, whole, fmt).select(fields.names)


def _open(spark: SparkSession, path: str, names: list[str], schema: StructType, fmt: str) -> DataFrame:
    reader = spark.read.schema(schema).option("basePath", path).format(fmt)
    reader = reader.option("mode", "DROPMALFORMED") if fmt == "json" else reader
    return reader.load([f"{path}/commit={n}" for n in names])


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop
