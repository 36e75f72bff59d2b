"""Decoders for API-style payload text, one payload page per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import settings as S
from tidewatch.functions.frames import ordered

# --- fixed values: positions of a bar inside its array, and the default news source
KLINE_FIELDS = {"open": 1, "high": 2, "low": 3, "close": 4, "volume": 5,
                "quote_volume": 7, "trades": 8, "taker_buy_base": 9}
DEFAULT_NEWS_SOURCE = "cryptopanic"


def utc_day(epoch, per_day: int = 86400):
    """The UTC day of an epoch, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(epoch / per_day).cast("int"))


MILLIS = 86400000


def klines(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """Arrays of 12 positional fields, the first one the opening time in epoch milliseconds."""
    rows = pages.select("asset", F.explode(F.from_json(payload, "array<array<string>>")).alias("k"))
    return rows.select("asset", utc_day(F.col("k")[0].cast("long"), MILLIS).alias("date"),
                       *[F.col("k")[i].cast("double").alias(n) for n, i in KLINE_FIELDS.items()])


def with_synthetic_range(closes: DataFrame) -> DataFrame:
    """Open from the previous close, high and low from both: the intraday range is not known."""
    return (closes.withColumn("open", F.coalesce(F.lag("close").over(ordered()), "close"))
            .withColumns({"high": F.greatest("open", "close"), "low": F.least("open", "close")}))


def price_points(pages: DataFrame, start: str, end: str, payload: str = "payload") -> DataFrame:
    """Close-only points: the last of each UTC day within [start, end]; volumes stay missing."""
    points = pages.select("asset", F.explode(F.from_json(
        payload, "array<struct<timestamp:bigint,price:double>>")).alias("p"))
    daily = (points.groupBy("asset", utc_day(F.col("p.timestamp")).alias("date"))
             .agg(F.max_by("p.price", "p.timestamp").alias("close"))
             .filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    missing = F.lit(None).cast("double")
    return with_synthetic_range(daily).withColumns({c: missing for c in ("volume", "quote_volume", "trades")})


def market_chart(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """Two [ms, value] series: last known value of each per UTC day, days without a price dropped."""
    parsed = pages.select("asset", F.from_json(
        payload, "prices array<array<double>>, total_volumes array<array<double>>").alias("j"))
    def series(name):
        return (parsed.select("asset", F.explode(f"j.{name}").alias("p"))
                .select("asset", F.col("p")[0].cast("long").alias("ts"), F.col("p")[1].alias(name)))
    joined = series("prices").join(series("total_volumes"), ["asset", "ts"], "full_outer")
    def last(name):
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("ts")))
    daily = (joined.groupBy("asset", utc_day(F.col("ts"), MILLIS).alias("date"))
             .agg(last("prices").alias("close"), last("total_volumes").alias("volume"))
             .filter(F.col("close").isNotNull()))
    return with_synthetic_range(daily).withColumns({
        "quote_volume": F.col("volume") * F.col("close"), "trades": F.lit(None).cast("double")})


def daily_index(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """Epoch-second index values; the last entry of a repeated moment counts. No entry at all is an error."""
    rows = pages.select("page", F.posexplode(F.from_json(
        payload, "data array<struct<timestamp:string,value:string>>")["data"]).alias("pos", "r"))
    out = (rows.groupBy(F.col("r.timestamp").cast("long").alias("ts"))
           .agg(F.max_by(F.col("r.value").cast("double"), F.struct("page", "pos")).alias("value"))
           .select(utc_day(F.col("ts")).alias("date"), "value"))
    if rows.isEmpty():
        raise ValueError("index payload holds no data")
    return out


def nested_supply(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """The nested total of each entry; entries without one are skipped, the last per day counts."""
    rows = pages.select(F.explode(F.from_json(
        payload, "array<struct<date:string,totalCirculatingUSD:struct<peggedUSD:double>>>")).alias("r"))
    epoch = F.col("r.date").cast("long")
    return (rows.filter(F.col("r.totalCirculatingUSD.peggedUSD").isNotNull())
            .groupBy(utc_day(epoch).alias("date"))
            .agg(F.max_by("r.totalCirculatingUSD.peggedUSD", epoch).alias("value")))


def headlines(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """News entries with a usable time; source and asset codes filled and joined."""
    entry = ("results array<struct<id:bigint,published_at:string,created_at:string,title:string,"
             "source:struct<domain:string>,currencies:array<struct<code:string>>>>")
    rows = pages.select(F.explode(F.from_json(payload, entry)["results"]).alias("r"))
    def filled(c):
        return F.when(F.col(c) != "", F.col(c))
    stamp = F.try_to_timestamp(F.coalesce(filled("r.published_at"), filled("r.created_at")))
    return rows.select(
        F.col("r.id").alias("id"), stamp.alias("published_at"), F.coalesce("r.title", F.lit("")).alias("title"),
        F.coalesce("r.source.domain", F.lit(DEFAULT_NEWS_SOURCE)).alias("source"),
        F.array_join(F.transform(F.coalesce("r.currencies", F.array()),
                                 lambda c: F.coalesce(c["code"], F.lit(""))), ",").alias("asset"),
    ).filter(F.col("published_at").isNotNull())


def first_usable(sources: list[tuple[str, DataFrame]], min_days: int = S.MIN_SOURCE_DAYS) -> DataFrame:
    """Per asset, the rows of the first source (in list order) with enough days."""
    tagged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                    [df.withColumns({"source": F.lit(name), "_rank": F.lit(i)}) for i, (name, df) in enumerate(sources)])
    chosen = (tagged.groupBy("asset", "_rank").agg(F.count(F.lit(1)).alias("_days"))
              .filter(F.col("_days") >= min_days).groupBy("asset").agg(F.min("_rank").alias("_rank")))
    return tagged.join(chosen, ["asset", "_rank"]).drop("_rank")


def uncovered(universe: DataFrame, covered: DataFrame) -> DataFrame:
    """Assets no source covers; reported, never filled."""
    return universe.join(covered.select("asset").distinct(), "asset", "left_anti")
