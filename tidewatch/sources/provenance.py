"""Where each panel column comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COLUMNS = "column string, source string, kind string, definition string, proxy_for string, limitation string"
# --- fixed values: kind of every registered column ------------------------------
_ROWS = [
    ("open", "venue bars", "PRIMARY", "first trade price of the UTC day", None, None),
    ("high", "venue bars", "PRIMARY", "highest trade price of the UTC day", None, None),
    ("low", "venue bars", "PRIMARY", "lowest trade price of the UTC day", None, None),
    ("close", "venue bars", "PRIMARY", "closing price of the UTC day", None, None),
    ("volume", "venue bars", "PRIMARY", "base volume traded", None, None),
    ("quote_volume", "venue bars", "PRIMARY", "quote volume traded", None, None),
    ("trades", "venue bars", "PRIMARY", "number of trades", None, None),
    ("taker_buy_base", "venue bars", "PRIMARY", "base volume bought by takers", None, None),
    ("stablecoin_supply", "supply series", "PRIMARY", "circulating value of all pegged coins", None, None),
    ("fear_greed", "index series", "PRIMARY", "daily index, 0 fear to 100 greed", None, None),
    ("exchange_netflow_7", "venue bars", "PROXY", "7-row mean of net taker selling over volume",
     "net transfers into exchange wallets", "sees orders on the venue, not deposits made before they are sold"),
    ("whale_tx_count", "venue bars", "PROXY", "30-row z-score of mean trade size",
     "number of large transfers", "cannot tell one large actor from many middling ones"),
    ("active_addresses", "venue bars", "PROXY", "log of one plus the trade count",
     "distinct active addresses", "dominated by frequent traders, blind to settlement off the venue"),
    ("stablecoin_netflow", "supply series", "DERIVED", "7-row fractional change of the supply", None, None),
    ("nvt_ratio", "venue bars", "PROXY", "log of close over 7-row mean turnover",
     "network value to transfer volume", "comparable over time within one asset only"),
]


def registry_table(spark: SparkSession) -> DataFrame:
    """The registry as a literal table."""
    def lit(v):
        return "CAST(NULL AS STRING)" if v is None else "'" + v.replace("'", "\\'") + "'"
    names = ", ".join(c.split()[0] for c in _COLUMNS.split(", "))
    rows = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in _ROWS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})")


def column_provenance(columns: DataFrame, registry: DataFrame) -> DataFrame:
    """Source, kind and definition per ``column``; unregistered columns are DERIVED."""
    return (columns.join(registry, "column", "left")
            .withColumn("kind", F.coalesce("kind", F.lit("DERIVED"))))


def invalid_proxies(registry: DataFrame) -> DataFrame:
    """Stand-ins that do not say what they stand for or where they fall short; must be empty."""
    return registry.filter((F.col("kind") == "PROXY")
                           & (F.col("proxy_for").isNull() | F.col("limitation").isNull()))
