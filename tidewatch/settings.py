"""Default parameters.

Every number is an argument default somewhere in ``operators``; this module only
keeps the ones that several operators share.
"""

from __future__ import annotations

# --- fixed values: window lengths and thresholds of the published method -----
VOL_WINDOWS = (7, 14, 30)
VOLUME_Z_WINDOW = 20
RSI_PERIOD = 14
MOMENTUM_PERIOD = 10
ATR_PERIOD = 14
FLOW_WINDOW = 7
NVT_WINDOW = 7
SENTIMENT_LONG = 7
SENTIMENT_COUNT_WINDOW = 30
CORR_WINDOW = 30
LEAD_LAG_MAX = 5
MIN_EDGE_WEIGHT = 0.30
MIN_ASSETS = 3
LOOKBACK = 30
HORIZON_DAYS = 14
DRAWDOWN_THRESHOLD = 0.20
EMBARGO_DAYS = 45
EPISODE_LOOKBACK_DAYS = 45
LEAD_TIME_LOOKBACK_DAYS = 90
SUSTAINED_DAYS = 2
MIN_COVERAGE = 0.80
MIN_SOURCE_DAYS = 90
ANALOGUE_K = 3
ANALOGUE_EXCLUDE_DAYS = 90
ANALOGUE_OUTCOME_DAYS = 30
ANNUALISATION_DAYS = 365.0

# --- fixed values: feature order of the panel --------------------------------
TECHNICAL = [
    "realized_vol_7", "realized_vol_14", "realized_vol_30", "volume_z_20",
    "drawdown_depth", "drawdown_duration", "rsi_14", "momentum_10", "atr_14",
]
FLOW = [
    "exchange_netflow_7", "whale_tx_count", "active_addresses",
    "stablecoin_netflow", "nvt_ratio",
]
SENTIMENT = ["headline_polarity_1d", "headline_polarity_7d", "negative_ratio_7d"]
CONTAGION = [
    "mean_pairwise_corr_30", "corr_dispersion_30", "btc_lead_lag_5",
    "eigen_centrality_30",
]
FEATURES = TECHNICAL + FLOW + SENTIMENT + CONTAGION
OWN_FEATURES = TECHNICAL + FLOW + SENTIMENT

# --- fixed values: risk bands, weights and signal tables ----------------------
BANDS = {"moderate": 40.0, "high": 65.0, "critical": 80.0}
ALERT_BANDS = ("HIGH", "CRITICAL")
COMPONENT_WEIGHTS = {"models": 0.40, "market": 0.25, "flow": 0.25, "sentiment": 0.10}
DEFAULT_COMPONENT_WEIGHT = 0.1
MARKET_SIGNALS = [
    ("realized_vol_7", 1, "short-horizon volatility"),
    ("realized_vol_30", 1, "30-day volatility"),
    ("volume_z_20", 1, "volume anomaly"),
    ("atr_14", 1, "average true range"),
    ("drawdown_depth", 1, "drawdown from the running peak"),
    ("momentum_10", -1, "10-day momentum"),
    ("rsi_14", -1, "relative strength"),
]
FLOW_SIGNALS = [
    ("exchange_netflow_7", 1, "net selling pressure toward exchanges"),
    ("whale_tx_count", 1, "large-holder activity"),
    ("active_addresses", 1, "network activity"),
    ("stablecoin_netflow", -1, "stablecoin supply growth"),
    ("nvt_ratio", 1, "valuation relative to turnover"),
]
SENTIMENT_SIGNALS = [
    ("headline_polarity_1d", -1, "same-day sentiment polarity"),
    ("headline_polarity_7d", -1, "7-day sentiment polarity"),
    ("negative_ratio_7d", 1, "share of negative days over 7 days"),
]
PROXY_FEATURES = ("exchange_netflow_7", "whale_tx_count", "active_addresses", "nvt_ratio")


def check_invariants(lookback: int, horizon: int, embargo: int, folds: list[dict],
                     bands: dict[str, float], exclude_days: int) -> None:
    """Cross-parameter rules that must hold before any split or decision is made."""
    if embargo < lookback + horizon:
        raise ValueError(f"embargo {embargo} must be at least lookback + horizon = {lookback + horizon}")
    if not 0 < bands["moderate"] < bands["high"] < bands["critical"] <= 100:
        raise ValueError("risk bands must increase within (0, 100]")
    if exclude_days < lookback:
        raise ValueError("analogue exclusion must be at least the lookback")
    previous = None
    for fold in folds:
        if not fold["train_end"] < fold["test_start"] <= fold["test_end"]:
            raise ValueError(f"fold {fold} is not chronological")
        if previous is not None and fold["test_start"] <= previous:
            raise ValueError("test periods must not overlap and must be in order")
        previous = fold["test_end"]
