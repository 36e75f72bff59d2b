"""Trading-flow features, per asset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import settings as S
from tidewatch.functions.frames import full_window, ordered, ratio, rolling_z, trailing
from tidewatch.operators.panel import align_series


def with_flow_raw(bars: DataFrame) -> DataFrame:
    """Taker imbalance, mean trade size and trade count; zero volume or trades give NULL."""
    volume = F.nullif("volume", F.lit(0.0))
    sold = volume - F.col("taker_buy_base")
    count = F.nullif("trades", F.lit(0.0))
    return bars.withColumns({
        "taker_net_ratio": (F.col("taker_buy_base") - sold) / volume,
        "mean_trade_size": F.col("quote_volume") / count,
        "trade_count": count})


def exchange_netflow(n: int = S.FLOW_WINDOW) -> Column:
    """Trailing mean of selling pressure; positive means net selling."""
    return full_window(F.avg, -F.col("taker_net_ratio"), n, trailing(n))


def whale_z(n: int = S.CORR_WINDOW) -> Column:
    return rolling_z("mean_trade_size", n)


def activity() -> Column:
    return F.log1p("trade_count")


def supply_change(column: str = "supply", n: int = S.FLOW_WINDOW) -> Column:
    """Fractional change over n of the asset's own rows, no filling."""
    return ratio(column, F.lag(column, n).over(ordered())) - 1.0


def nvt(n: int = S.NVT_WINDOW) -> Column:
    """Log of price over trailing mean turnover."""
    return F.ln(ratio("close", full_window(F.avg, "quote_volume", n, trailing(n))))


def with_flow(df: DataFrame) -> DataFrame:
    """The five flow columns on bars that already carry the aligned ``supply``."""
    return with_flow_raw(df).withColumns({
        "exchange_netflow_7": exchange_netflow(), "whale_tx_count": whale_z(),
        "active_addresses": activity(), "stablecoin_netflow": supply_change(), "nvt_ratio": nvt(),
    }).drop("taker_net_ratio", "mean_trade_size", "trade_count", "supply")


def flow(bars: DataFrame, supply: DataFrame) -> DataFrame:
    """The input with all five flow columns."""
    return with_flow(align_series(bars, supply, "supply"))
