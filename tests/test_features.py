import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch import settings as S
from tidewatch.operators import contagion as C
from tidewatch.operators import flow as FL
from tidewatch.operators import guards as G
from tidewatch.operators import labels as L
from tidewatch.operators import panel as P
from tidewatch.operators import sentiment as SE
from tidewatch.operators import technical as TE
from tidewatch.operators import windows as W


def one(df, asset="A"):
    return df.filter(F.col("asset") == asset).orderBy("date").toPandas().reset_index(drop=True)


def test_technical_against_pandas(prices):
    got = one(TE.technical(prices))
    c, v = got["close"], got["volume"]
    r = np.log(c / c.shift(1))
    for n in S.VOL_WINDOWS:
        np.testing.assert_allclose(got[f"realized_vol_{n}"], r.rolling(n).std() * math.sqrt(365), rtol=1e-9)
    np.testing.assert_allclose(got["volume_z_20"], (v - v.rolling(20).mean()) / v.rolling(20).std(), rtol=1e-8)
    peak = c.cummax()
    np.testing.assert_allclose(got["drawdown_depth"], (peak - c) / peak, atol=1e-12)
    at = c >= peak
    np.testing.assert_array_equal(got["drawdown_duration"], at.groupby(at.cumsum()).cumcount())
    d = c.diff()
    up = d.clip(lower=0).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    down = (-d).clip(lower=0).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    np.testing.assert_allclose(got["rsi_14"], 100 - 100 / (1 + up / down), rtol=1e-9)
    np.testing.assert_allclose(got["momentum_10"], c / c.shift(10) - 1, rtol=1e-9, atol=1e-12)


def test_ewm_over_several_blocks(spark):
    n = 1300
    x = [(i * 7919 % 1009) / 100.0 for i in range(n)]
    df = spark.createDataFrame(pd.DataFrame({"asset": "A", "date": pd.date_range("2000-01-01", periods=n).date, "x": x}))
    from tidewatch.functions.frames import ewm_means
    got = ewm_means(df, {"m": "x"}, 1 / 14, 14).orderBy("date").toPandas()["m"]
    np.testing.assert_allclose(got, pd.Series(x).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean(), rtol=1e-11)


def test_edge_rows(spark):
    df = spark.sql("""SELECT 'A' AS asset, date_add(date'2020-01-01', CAST(id AS INT)) AS date, 5.0D AS close, 5.0D AS high, 5.0D AS low,
      0.0D AS volume, 0.0D AS quote_volume, 0.0D AS trades, 0.0D AS taker_buy_base FROM range(40)""")
    got = one(TE.technical(df))
    assert got["volume_z_20"].isna().all() and got["rsi_14"].isna().all()
    assert (got["realized_vol_7"].dropna() == 0).all() and len(got["realized_vol_7"].dropna()) == 33
    raw = one(FL.with_flow_raw(df))
    assert raw[["taker_net_ratio", "mean_trade_size", "trade_count"]].isna().all().all()
    single = one(TE.technical(df.limit(1)))
    assert len(single) == 1 and single["momentum_10"].isna().all()


def test_label_and_arguments(spark, prices):
    got = one(L.with_label(prices, 0.2, 14))
    c = got["close"]
    ahead = c[::-1].shift(1).rolling(14, min_periods=14).min()[::-1]
    want = ((c - ahead) / c >= 0.2).astype(float).where(ahead.notna())
    np.testing.assert_array_equal(got["label"].astype(float), want)
    for bad in ((0.0, 14), (1.0, 14), (0.2, 0)):
        with pytest.raises(ValueError):
            L.with_label(prices, *bad)
    far = spark.sql("SELECT 'X' AS episode, date'2035-01-01' AS start, date'2035-01-09' AS end")
    with pytest.raises(ValueError, match="X"):
        L.assert_covered(L.with_label(prices, 0.2, 14), far)


def test_gap_makes_two_returns_missing(spark):
    df = spark.sql("""SELECT asset, date_add(date'2020-01-01', CAST(id AS INT)) AS date, 10.0D + id AS close
      FROM range(6) CROSS JOIN (SELECT explode(array('A', 'B')) AS asset) WHERE NOT (asset = 'B' AND id = 3)""")
    r = P.returns_long(df).filter("asset = 'B'").orderBy("date").toPandas()
    assert r["ret"].isna().tolist() == [True, False, False, True, False]


def _pairs_by_hand(frame, window=30):
    wide = frame.pivot(index="date", columns="asset", values="close").sort_index()
    r = np.log(wide / wide.shift(1))
    out = {}
    for i in range(window, len(r)):
        block = r.iloc[i - window + 1:i + 1].dropna(axis=1, thresh=window // 2)
        out[r.index[i]] = block.corr()
    return out


def _three(spark):
    return spark.sql("""SELECT asset, date_add(date'2020-01-01', CAST(id AS INT)) AS date, CAST(50 + (id * k % 23) + k / 10.0D AS DOUBLE) AS close
      FROM range(60) CROSS JOIN (SELECT * FROM VALUES ('A', 7), ('B', 11), ('C', 17) AS v(asset, k))
      WHERE NOT (asset = 'C' AND id BETWEEN 20 AND 24)""")


def test_pair_correlation_by_hand(spark):
    df = _three(spark)
    want = _pairs_by_hand(df.toPandas())
    rows = C.pairwise_corr(C.grid_returns(df)).collect()
    assert len(rows) == sum(len(m) * (len(m) - 1) // 2 for m in want.values())
    for r in rows:
        assert r["corr"] == pytest.approx(want[r["date"]].loc[r["a"], r["b"]], abs=1e-9)


def test_lead_lag_by_hand(spark):
    df = _three(spark)
    wide = df.toPandas().pivot(index="date", columns="asset", values="close").sort_index()
    r = np.log(wide / wide.shift(1))
    got = {x["date"]: x["btc_lead_lag_5"] for x in C.lead_lag(C.grid_returns(df), "A").collect()}
    for i in range(30, len(r)):
        block = r.iloc[i - 29:i + 1]
        led = []
        for other in ("B", "C"):
            best = (0, 0.0)
            for lag in range(1, 6):
                pair = pd.concat([block["A"].shift(lag), block[other]], axis=1).dropna()
                corr = pair.iloc[:, 0].corr(pair.iloc[:, 1]) if len(pair) >= 7 else np.nan
                if np.isfinite(corr) and abs(corr) > abs(best[1]):
                    best = (lag, corr)
            led.append(best[0] * best[1])
        assert got[r.index[i]] == pytest.approx(np.mean(led), abs=1e-9)


def test_eigen_centrality(spark):
    """A connected graph gets its leading eigenvector, a split one degree shares, none at all zeros."""
    rows = [("2020-01-01", "A", "B", 0.9), ("2020-01-01", "A", "C", 0.5), ("2020-01-01", "B", "C", -0.4),
            ("2020-01-02", "A", "B", 0.8), ("2020-01-02", "A", "C", 0.1), ("2020-01-02", "B", "C", 0.1),
            ("2020-01-03", "A", "B", 0.1), ("2020-01-03", "A", "C", 0.1), ("2020-01-03", "B", "C", None)]
    df = spark.createDataFrame(rows, "d string, a string, b string, corr double").withColumn("date", F.to_date("d"))
    got = {(str(r["date"]), r["asset"]): r["eigen_centrality_30"] for r in C.eigen_centrality(df).collect()}
    m = np.array([[0, .9, .5], [.9, 0, .4], [.5, .4, 0]])
    lead = np.abs(np.linalg.eigh(m)[1][:, -1])
    assert [got[("2020-01-01", a)] for a in "ABC"] == pytest.approx(lead.tolist(), abs=1e-11)
    assert [got[("2020-01-02", a)] for a in "ABC"] == [0.5, 0.5, 0.0]
    assert [got[("2020-01-03", a)] for a in "ABC"] == [0.0, 0.0, 0.0]


def test_guards_catch_leaks(prices):
    leaky = prices.withColumn("peek", L.forward_decline(7))
    assert G.forward_looking(leaky, ["peek", "close"]).count() == 2          # one per asset
    copied = prices.withColumn("close", F.lead("close").over(G.ordered()))
    assert [r["feature"] for r in G.next_step_copies(copied, prices, ["close", "volume"]).collect()] == ["close"]
    centred = lambda df: df.withColumn("m", F.avg("close").over(G.ordered().rowsBetween(-2, 2)))
    assert G.truncation(prices, centred, ["m"], "2021-06-30").first()["max_abs_diff"] > 0
    clean = G.shift_invariance(prices, TE.technical, S.TECHNICAL).toPandas()
    assert clean["max_abs_diff"].max() < 1e-6
    with pytest.raises(ValueError):
        G.assert_no_future(prices, "date", F.lit("2021-02-01").cast("date"))


def test_windows_need_complete_rows(prices):
    df = TE.technical(L.with_label(prices, 0.2, 14))
    marked = W.mark_windows(df, ["realized_vol_30", "close"])
    meta = W.window_meta(marked).filter("asset = 'A'").orderBy("window_end").collect()
    assert len(meta) == 400 - 30 - 29 - 14                                   # warm-up, look-back, horizon
    assert (meta[0]["window_end"] - meta[0]["window_start"]).days == 29
    tensor = W.window_tensor(marked, ["realized_vol_30", "close"])
    row = tensor.filter("asset = 'A'").orderBy("window_end").first()
    want = [r["close"] for r in df.filter(F.col("asset") == "A").filter(F.col("date") <= row["window_end"]).orderBy("date").collect()][-30:]
    assert [x[1] for x in row["feats"]] == want
    assert W.flat_names(["a", "b"], 2) == ["a[t-1]", "b[t-1]", "a[t-0]", "b[t-0]"]
    with pytest.raises(ValueError):
        W.mark_windows(df, ["no_such_column"])


def test_partition_count_does_not_matter(prices):
    cols = ["asset", "date", *[F.round(c, 6).alias(c) for c in S.TECHNICAL]]
    a = TE.technical(prices.repartition(1)).select(cols)
    b = TE.technical(prices.repartition(16, "volume")).select(cols)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_lexicon(spark):
    from tidewatch.functions.text import lexicon_scorer
    df = spark.createDataFrame([(1, "Crash! and (panic) then RALLY."), (2, "nothing here"), (3, None), (4, "gain gain loss")], "id int, title string")
    got = {r["id"]: r["polarity"] for r in SE.score_headlines(df, lexicon_scorer()).collect()}
    assert got[1] == pytest.approx(-1 / 3) and got[2] == 0 and got[3] == 0 and got[4] == pytest.approx(1 / 3)
