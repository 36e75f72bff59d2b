"""Registration of queries and of the SQL they are checked with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.sources.inputs import Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}
PLACES = 6


def present(df: DataFrame) -> DataFrame:
    """Output form shared with the check SQL: rounded doubles, long integers, dates as text.

    Rounding is plain double arithmetic, so both engines treat exact halves alike.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.floor(c.cast("double") * 10.0 ** PLACES + 0.5) / 10.0 ** PLACES
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(key: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``key`` with optional check SQL."""
    def add(fn: Callable[[Inputs], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"{key} registered twice")
        QUERIES[key] = lambda spark, sf_dir: present(fn(Inputs(spark, sf_dir)))
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return add


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def _expand(sql: str) -> str:
    """``R6(x)`` -> the output rounding, ``DAY(x)`` -> the date as text."""
    for mark, head, tail in (("R6(", "(floor(CAST((", f") AS DOUBLE) * 1e{PLACES} + 0.5) / 1e{PLACES})"),
                             ("DAY(", "strftime(CAST((", ") AS DATE), '%Y-%m-%d')"),
                             ("INT8(", "CAST((", ") AS BIGINT)")):
        at = sql.find(mark)
        while at >= 0:
            depth, end = 1, at + len(mark)
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[end], 0)
                end += 1
            sql = sql[:at] + head + sql[at + len(mark):end - 1] + tail + sql[end:]
            at = sql.find(mark)
    return sql


def compose(sql: str) -> str:
    """Prefix the named subqueries that the statement mentions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bc_\w+", text):
            if name in CTES and name not in needed:
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in needed)
    return _expand((f"WITH {head}\n" if head else "") + sql)


def oracles() -> dict[str, str]:
    return {k: compose(v) for k, v in ORACLES.items()}
