"""Trailing price and volume features, per asset."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import settings as S
from tidewatch.functions.frames import (col, ewm_means, expanding, full_window, ordered, ratio,
                                        rolling_z, trailing)


def log_return(price: str = "close") -> Column:
    return F.ln(col(price) / F.lag(price).over(ordered()))


def with_realized_vol(df: DataFrame, windows=S.VOL_WINDOWS) -> DataFrame:
    """Annualised sample deviation of log returns."""
    df = df.withColumn("_r", log_return())
    scale = math.sqrt(S.ANNUALISATION_DAYS)
    return df.withColumns({
        f"realized_vol_{n}": full_window(F.stddev_samp, "_r", n, trailing(n)) * scale for n in windows
    }).drop("_r")


def volume_z(n: int = S.VOLUME_Z_WINDOW) -> Column:
    return rolling_z("volume", n)


def drawdown_depth() -> Column:
    """Fall from the running maximum as a share of it."""
    peak = F.max("close").over(expanding())
    return (peak - F.col("close")) / peak


def with_drawdown_duration(df: DataFrame) -> DataFrame:
    """Rows since the price last stood at its running maximum."""
    row = F.row_number().over(ordered())
    df = df.withColumn("_row", row).withColumn(
        "_peak", F.when(F.col("close") >= F.max("close").over(expanding()), F.col("_row")))
    return (df.withColumn("drawdown_duration",
                          (F.col("_row") - F.max("_peak").over(expanding())).cast("double"))
            .drop("_row", "_peak"))


def with_rsi(df: DataFrame, period: int = S.RSI_PERIOD) -> DataFrame:
    """Wilder's index; NULL while warming up and where there is no loss at all."""
    step = F.col("close") - F.lag("close").over(ordered())
    df = df.withColumn("_d", step).withColumns({
        "_gain": F.when(F.col("_d").isNotNull(), F.greatest("_d", F.lit(0.0))),
        "_loss": F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), F.lit(0.0)))})
    df = ewm_means(df, {"_up": "_gain", "_down": "_loss"}, 1.0 / period, period)
    return (df.withColumn("rsi_14", 100.0 - 100.0 / (1.0 + ratio("_up", "_down")))
            .drop("_d", "_gain", "_loss", "_up", "_down"))


def momentum(n: int = S.MOMENTUM_PERIOD) -> Column:
    return F.col("close") / F.lag("close", n).over(ordered()) - 1.0


def with_atr(df: DataFrame, n: int = S.ATR_PERIOD) -> DataFrame:
    """Mean true range over close; a missing leg of the range is ignored."""
    previous = F.lag("close").over(ordered())
    true_range = F.greatest(F.col("high") - F.col("low"),
                            F.abs(F.col("high") - previous), F.abs(F.col("low") - previous))
    return (df.withColumn("_tr", true_range)
            .withColumn("atr_14", full_window(F.avg, "_tr", n, trailing(n)) / F.col("close"))
            .drop("_tr"))


def technical(df: DataFrame) -> DataFrame:
    """The input with all nine columns; every frame shares the (asset, date) sort."""
    df = with_realized_vol(df).withColumns({
        "volume_z_20": volume_z(), "drawdown_depth": drawdown_depth(), "momentum_10": momentum()})
    df = with_rsi(with_atr(with_drawdown_duration(df)))
    rest = [c for c in df.columns if c not in S.TECHNICAL]
    return df.select(*rest, *S.TECHNICAL)
