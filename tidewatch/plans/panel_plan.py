"""The assembled panel: all feature families and the label on one (date, asset) table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewatch import settings as S
from tidewatch.operators.contagion import with_contagion
from tidewatch.operators.flow import with_flow
from tidewatch.operators.labels import with_label
from tidewatch.operators.panel import align_series, blank_context, trim_inception
from tidewatch.operators.sentiment import with_index_sentiment
from tidewatch.operators.technical import technical


def own_features(bars: DataFrame, supply: DataFrame, index: DataFrame, assets: DataFrame) -> DataFrame:
    """Technical, flow and sentiment columns: everything computed from one asset and the market series.

    The market series are aligned first, so one shuffle by asset serves all windows.
    """
    df = align_series(align_series(trim_inception(bars, assets), supply, "supply"), index, "index")
    df = with_index_sentiment(with_flow(technical(df)))
    return df.select("asset", "date", "close", "volume", *S.OWN_FEATURES, "headline_count_z")


def assemble(bars: DataFrame, supply: DataFrame, index: DataFrame, assets: DataFrame, primary: str,
             threshold: float = S.DRAWDOWN_THRESHOLD, horizon: int = S.HORIZON_DAYS,
             cross_asset: bool = True) -> DataFrame:
    df = own_features(bars, supply, index, assets)
    if cross_asset:
        df = with_contagion(df, trim_inception(bars, assets), primary)
    return blank_context(with_label(df, threshold, horizon), assets)
