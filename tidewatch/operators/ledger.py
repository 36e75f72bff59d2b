"""Prediction ids, canonical payloads, digests and the append-only ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.functions.canon import canonical_json, digest
from tidewatch.functions.frames import col
from tidewatch.sources import commits

# --- fixed values: fields every payload carries -----------------------------------
PAYLOAD = {
    "prediction_id": "string", "asset": "string", "as_of_date": "string", "horizon_days": "integer",
    "risk_score": "number", "probability": "number", "severity_band": "string", "top_drivers": "raw",
    "model_name": "string", "model_version": "string", "feature_hash": "string", "code_version": "string",
}


def prediction_id(asset: Column | str, as_of: Column | str, model: Column | str, code: Column | str) -> Column:
    """Derived from what the prediction is, so it cannot be issued twice under two ids."""
    return digest(F.concat_ws("|", col(asset), col(as_of), col(model), col(code)))


def feature_hash(features: list[str]) -> Column:
    return digest(canonical_json({f: (F.col(f), "number") for f in features}))


def drivers_json(drivers: Column | str = "top_drivers") -> Column:
    """An array of (feature, contribution, direction) as canonical JSON."""
    one = lambda d: canonical_json({
        "feature": (d["feature"], "string"), "contribution": (d["contribution"], "number"),
        "direction": (d["direction"], "integer")})
    return F.concat(F.lit("["), F.array_join(F.transform(drivers, one), ","), F.lit("]"))


def canonical_payload(df: DataFrame) -> Column:
    """Canonical JSON of a payload row; a missing field is an error, a NULL value is not."""
    absent = [f for f in PAYLOAD if f not in df.columns]
    if absent:
        raise ValueError(f"payload lacks {absent}")
    fields = {f: (F.col(f), kind) for f, kind in PAYLOAD.items()}
    fields["top_drivers"] = (drivers_json(), "raw")
    return canonical_json(fields)


def with_digest(df: DataFrame) -> DataFrame:
    return df.withColumn("digest", digest(canonical_payload(df)))


def append_predictions(new: DataFrame, path: str, schema: StructType | str) -> None:
    """Append predictions whose id the ledger does not hold yet; existing records are never touched.

    The ledger is divided by the month of the as-of date, which the id is made of, so an append reads only the months
    it writes to. The append is one commit: seen whole or not at all, also beside others.
    """
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    commits.append(new.select(fields.names), path)


def read_predictions(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The ledger's records."""
    return commits.read(spark, path, schema)


def append_outcomes(outcomes: DataFrame, path: str) -> None:
    """Outcomes are records of their own; one that is there already is not written again, so a replay is harmless.

    They are divided like the predictions they belong to, so a replay is found in the months it writes to.
    """
    commits.append(outcomes, path)


def read_outcomes(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return commits.read(spark, path, schema)


def verify(published: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recompute each published payload's digest and compare it with the recorded one."""
    r = recorded.select("prediction_id", F.lower("digest").alias("recorded_digest"), "committed_at")
    out = with_digest(published).join(r, "prediction_id", "left")
    verdict = (F.when(F.col("recorded_digest").isNull(), "NEVER_RECORDED")
               .when(F.lower("digest") == F.col("recorded_digest"), "MATCH").otherwise("MISMATCH"))
    return out.select("prediction_id", "asset", "as_of_date", F.col("digest").alias("computed_digest"),
                      "recorded_digest", verdict.alias("verdict"),
                      F.datediff(F.to_date("committed_at"), F.to_date("as_of_date")).alias("days_to_commit"))


def significant(x: Column, digits: int = 10) -> Column:
    """A double as integer mantissa and exponent with a fixed number of significant digits."""
    e = F.floor(F.log10(F.abs(x)))
    mantissa = F.floor(x / F.pow(F.lit(10.0), e.cast("double")) * 10.0 ** (digits - 1) + 0.5)
    return (F.when(x.isNull(), "null").when(x == 0, "0")
            .otherwise(F.concat(mantissa.cast("string"), F.lit("e"), e.cast("string"))))


def dataset_digest(panel: DataFrame, keys: tuple[str, ...] = ("asset", "date"), digits: int = 10) -> DataFrame:
    """A digest of the content that does not depend on row order, column order or storage.

    Each row is hashed over its columns in name order; row hashes are added up in
    60-bit pieces, which any number of tasks can do in any order.
    """
    values = sorted(c for c in panel.columns if c not in keys)
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys],
                       *[F.concat(F.lit(f"{c}="), significant(F.col(c).cast("double"), digits)) for c in values])
    pieces = [F.sum(F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"piece_{i}")
              for i in range(4)]
    sums = panel.select(F.sha2(text, 256).alias("_h")).agg(F.count(F.lit(1)).alias("n_rows"), *pieces)
    return sums.select("n_rows", digest(F.concat_ws("|", F.lit(",".join(values)), F.col("n_rows").cast("string"),
                                                    *[F.col(f"piece_{i}") for i in range(4)])).alias("digest"))
