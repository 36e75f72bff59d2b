"""Registered queries: panel, features, labels and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import settings as S
from tidewatch.functions.frames import rolling_z
from tidewatch.functions.text import lexicon_scorer
from tidewatch.operators import contagion as C
from tidewatch.operators import flow as FL
from tidewatch.operators import labels as L
from tidewatch.operators import panel as P
from tidewatch.operators import sentiment as SE
from tidewatch.operators import technical as TE
from tidewatch.operators import windows as W
from tidewatch.plans import oracle_panel as O
from tidewatch.plans.panel_plan import assemble, own_features
from tidewatch.plans.registry import cte, query
from tidewatch.sources import inputs as I
from tidewatch.sources.provenance import column_provenance, invalid_proxies, registry_table

THRESHOLD = 0.8      # the demo prices are noise, so only deep falls are rare
GRID = ([0.6, 0.7, 0.8], [7, 14, 30])
BAR_COLUMNS = ["open", "high", "low", "close", "last_price", "volume", "quote_volume", "trades", "taker_buy_base"]


def demo_panel(t: I.Inputs, cross_asset: bool = False):
    return assemble(t.bars, t.supply, t.fg_index, t.assets, I.PRIMARY, THRESHOLD, cross_asset=cross_asset)


def _r6(columns) -> str:
    return ", ".join(f"R6({c}) AS {c}" for c in columns)


# --- panel ---------------------------------------------------------------------
@query("panel_build", f"SELECT asset, DAY(date) AS date, {_r6(BAR_COLUMNS)} FROM c_bars")
def _(t):
    west = t.bars.filter(F.col("asset").isin("AMERICA", "EUROPE"))
    rest = t.bars.filter(~F.col("asset").isin("AMERICA", "EUROPE"))
    stamped = rest.withColumn("date", F.col("date").cast("timestamp"))
    return P.build_panel([west, stamped])


@query("panel_duplicates", """
SELECT DAY(date) AS date, asset, INT8(count(*)) AS copies FROM (
 SELECT CAST(l_shipdate AS DATE) AS date, r_name AS asset FROM lineitem
 JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
) GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t):
    raw = (t.table("lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date"))
           .join(t.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
           .join(t.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
           .join(t.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
           .select("date", F.col("r_name").alias("asset")))
    return P.duplicate_keys(raw)


@query("panel_trim_inception", "SELECT asset, DAY(date) AS date, R6(close) AS close FROM c_trim")
def _(t):
    return P.trim_inception(t.bars, t.assets).select("asset", "date", "close")


_OWN = S.OWN_FEATURES
_CROSS = ["mean_pairwise_corr_30", "corr_dispersion_30", "btc_lead_lag_5"]


@query("panel_assemble", f"""
SELECT p.asset, DAY(p.date) AS date, R6(close) AS close, {_r6(_OWN)}, R6(mean_pairwise_corr_30) AS mean_pairwise_corr_30, R6(corr_dispersion_30) AS corr_dispersion_30,
 CASE WHEN mean_pairwise_corr_30 IS NOT NULL THEN R6(btc_lead_lag_5) END AS btc_lead_lag_5, R6(v) AS eigen_centrality_30, INT8(label) AS label
FROM c_panel p LEFT JOIN c_market_t USING (date) LEFT JOIN c_lead_t USING (date) LEFT JOIN c_eigen_t e ON e.date = p.date AND e.asset = p.asset""")
def _(t):
    return demo_panel(t, cross_asset=True).select("asset", "date", "close", *S.FEATURES, "label")


@query("panel_align_series", """
SELECT asset, DAY(b.date) AS date, R6(close) AS close, R6(i.value) AS idx FROM c_bars b LEFT JOIN c_index i USING (date)""")
def _(t):
    return P.align_series(t.bars.select("asset", "date", "close"), t.fg_index, "idx")


@query("panel_blank_context", """
SELECT asset, DAY(date) AS date, INT8(CASE WHEN role = 'target' THEN label END) AS label
FROM c_label JOIN c_assets USING (asset)""")
def _(t):
    return P.blank_context(L.with_label(t.bars, THRESHOLD), t.assets).select("asset", "date", "label")


_COLS = [f"ret_{a.lower().replace(' ', '_')}" for a, _, _ in I.ASSETS]


@query("returns_wide", "SELECT DAY(date) AS date, " + ", ".join(
    f"R6(max(CASE WHEN asset = '{a}' THEN ret END)) AS {c}" for (a, _, _), c in zip(I.ASSETS, _COLS))
    + " FROM c_spine GROUP BY date")
def _(t):
    wide = P.returns_wide(t.bars, [a for a, _, _ in I.ASSETS])
    return wide.select("date", *[F.col(f"`{a}`").alias(c) for (a, _, _), c in zip(I.ASSETS, _COLS)])


@query("asof_slice", """
SELECT asset, DAY(max(date)) AS as_of, DAY(min(date)) AS window_start, INT8(count(*)) AS window_rows,
 R6(max_by(close, date)) AS close, R6(max_by(realized_vol_30, date)) AS realized_vol_30
FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS recent FROM c_tech WHERE date <= DATE '1999-06-30')
WHERE recent <= 30 GROUP BY asset""")
def _(t):
    return P.asof_slice(TE.with_realized_vol(t.bars), "1999-06-30", S.LOOKBACK, ["close", "realized_vol_30"])


@query("timeline_tail", """
SELECT t.asset, DAY(t.date) AS date, R6(close) AS close, INT8(label) AS label, R6(realized_vol_30) AS realized_vol_30,
 R6(drawdown_depth) AS drawdown_depth, episode FROM (
 SELECT f.asset, f.date, f.close, l.label, realized_vol_30, drawdown_depth FROM c_tech f JOIN c_label l USING (asset, date)
 WHERE f.asset = 'AMERICA' ORDER BY f.date DESC LIMIT 2200) t
LEFT JOIN c_episodes e ON t.date BETWEEN e.s AND e.e""")
def _(t):
    df = TE.with_realized_vol(L.with_label(t.bars, THRESHOLD)).withColumn("drawdown_depth", TE.drawdown_depth())
    df = df.select("asset", "date", "close", "label", "realized_vol_30", "drawdown_depth")
    return P.timeline_tail(df, I.PRIMARY, 2200, t.episodes)


_FAMILIES = {"technical": S.TECHNICAL, "flow": S.FLOW, "sentiment": S.SENTIMENT, "contagion": S.CONTAGION}
cte("c_long", "SELECT asset, date, feature, value FROM (SELECT asset, date, "
    + ", ".join(_OWN) + " FROM c_own) UNPIVOT INCLUDE NULLS (value FOR feature IN (" + ", ".join(_OWN) + "))")
_family_sql = "CASE " + " ".join(
    f"WHEN feature IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in _FAMILIES.items()) + " END"
_proxies = ", ".join(repr(p) for p in S.PROXY_FEATURES)


@query("feature_percentiles", f"""
SELECT l.asset, DAY(n.as_of) AS as_of, l.feature, R6(max(n.latest)) AS value,
 R6(avg(CASE WHEN l.value IS NULL OR n.latest IS NULL THEN NULL WHEN l.value <= n.latest THEN 1.0 ELSE 0.0 END)) AS percentile,
 {_family_sql.replace('feature', 'l.feature')} AS family,
 CASE WHEN l.feature IN ({_proxies}) THEN 'PROXY' ELSE 'DERIVED' END AS provenance
FROM c_long l JOIN (SELECT asset, feature, max(date) AS as_of, arg_max_null(value, date) AS latest FROM c_long GROUP BY 1, 2) n
 ON l.asset = n.asset AND l.feature = n.feature GROUP BY l.asset, n.as_of, l.feature""")
def _(t):
    panel = own_features(t.bars, t.supply, t.fg_index, t.assets)
    return P.feature_percentiles(panel, _OWN, _FAMILIES, registry_table(t.spark))


@query("universe_summary", """
SELECT a.asset, a.role, DAY(a.inception) AS inception, INT8(count(p.date)) AS n_rows, DAY(min(p.date)) AS first_date,
 DAY(max(p.date)) AS last_date, INT8(coalesce(sum(p.label), 0)) AS positives, R6(max_by(p.close, p.date)) AS last_close
FROM (SELECT * FROM c_assets UNION ALL SELECT 'ANTARCTICA', 'target', DATE '1995-01-01') a
LEFT JOIN c_label p USING (asset) GROUP BY 1, 2, 3""")
def _(t):
    universe = t.assets.unionByName(t.spark.sql(
        "SELECT 'ANTARCTICA' AS asset, 'target' AS role, date'1995-01-01' AS inception"))
    return P.universe_summary(L.with_label(t.bars, THRESHOLD), universe)


@query("column_provenance", f"""
SELECT feature AS "column", CASE WHEN feature IN ({_proxies}) THEN 'PROXY'
  WHEN feature IN ('close', 'volume') THEN 'PRIMARY' ELSE 'DERIVED' END AS kind, INT8(count(value)) AS n_values
FROM (SELECT asset, date, close, volume, {', '.join(_OWN)} FROM c_own)
 UNPIVOT INCLUDE NULLS (value FOR feature IN (close, volume, {', '.join(_OWN)})) GROUP BY 1""")
def _(t):
    panel = own_features(t.bars, t.supply, t.fg_index, t.assets)
    P.require_empty(invalid_proxies(registry_table(t.spark)), "proxy without target or limitation")
    counts = (P.unpivot(panel, ["close", "volume", *_OWN]).groupBy(F.col("feature").alias("column"))
              .agg(F.count("value").alias("n_values")))
    return column_provenance(counts, registry_table(t.spark)).select("column", "kind", "n_values")


# --- technical -----------------------------------------------------------------
def _feature_query(key, build, columns, source):
    query(key, f"SELECT asset, DAY(date) AS date, {_r6(columns)} FROM {source}")(
        lambda t: build(t).select("asset", "date", *columns))


_vols = [f"realized_vol_{n}" for n in S.VOL_WINDOWS]
_feature_query("f_realized_vol", lambda t: TE.with_realized_vol(t.bars), _vols, "c_tech")
_feature_query("f_volume_z", lambda t: t.bars.withColumn("volume_z_20", TE.volume_z()), ["volume_z_20"], "c_tech")
_feature_query("f_drawdown_depth", lambda t: t.bars.withColumn("drawdown_depth", TE.drawdown_depth()),
               ["drawdown_depth"], "c_tech")
_feature_query("f_drawdown_duration", lambda t: TE.with_drawdown_duration(t.bars), ["drawdown_duration"], "c_tech")
_feature_query("f_rsi", lambda t: TE.with_rsi(t.bars), ["rsi_14"], "c_tech")
_feature_query("f_momentum", lambda t: t.bars.withColumn("momentum_10", TE.momentum()), ["momentum_10"], "c_tech")
_feature_query("f_atr", lambda t: TE.with_atr(t.bars), ["atr_14"], "c_tech")
_feature_query("f_technical_all", lambda t: TE.technical(t.bars), S.TECHNICAL, "c_tech")

# --- flow ----------------------------------------------------------------------
_feature_query("f_flow_raw", lambda t: FL.with_flow_raw(t.bars),
               ["taker_net_ratio", "mean_trade_size", "trade_count"], "c_flow")
query("f_rolling_z", f"SELECT asset, DAY(date) AS date, R6({O.z('close', 30)}) AS close_z_30 FROM c_bars")(
    lambda t: t.bars.select("asset", "date", rolling_z("close", 30).alias("close_z_30")))
_raw = lambda t: FL.with_flow_raw(t.bars)
_feature_query("f_exchange_netflow", lambda t: _raw(t).withColumn("exchange_netflow_7", FL.exchange_netflow()),
               ["exchange_netflow_7"], "c_flow")
_feature_query("f_whale_z", lambda t: _raw(t).withColumn("whale_tx_count", FL.whale_z()), ["whale_tx_count"], "c_flow")
_feature_query("f_activity", lambda t: _raw(t).withColumn("active_addresses", FL.activity()),
               ["active_addresses"], "c_flow")
_feature_query("f_supply_change", lambda t: P.align_series(t.bars, t.supply, "supply").withColumn(
    "stablecoin_netflow", FL.supply_change()), ["stablecoin_netflow"], "c_flow")
_feature_query("f_nvt", lambda t: t.bars.withColumn("nvt_ratio", FL.nvt()), ["nvt_ratio"], "c_flow")
_feature_query("f_flow_all", lambda t: FL.flow(t.bars, t.supply), S.FLOW, "c_flow")

# --- sentiment -----------------------------------------------------------------
_sql_list = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
cte("c_polarity", f"""
SELECT doc_id, published_at, CASE WHEN p + n = 0 THEN 0 ELSE CAST(p - n AS DOUBLE) / (p + n) END AS polarity FROM (
 SELECT doc_id, published_at, len(list_filter(ws, lambda w: w IN {_sql_list(I.POSITIVE)})) AS p,
  len(list_filter(ws, lambda w: w IN {_sql_list(I.NEGATIVE)})) AS n FROM (
  SELECT doc_id, published_at, list_transform(regexp_split_to_array(trim(title), '[ \\t\\n\\r]+'),
    lambda x: lower(trim(x, '.,!?:;"''()[]'))) AS ws FROM c_headlines))""")
_scorer = lexicon_scorer(I.NEGATIVE, I.POSITIVE)


@query("s_lexicon_score", "SELECT doc_id, R6(polarity) AS polarity FROM c_polarity")
def _(t):
    return t.headlines.select("doc_id", _scorer(F.col("title")).alias("polarity"))


@query("s_score_headlines", """
SELECT doc_id, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, R6(polarity) AS polarity FROM c_polarity""")
def _(t):
    return SE.score_headlines(t.headlines, _scorer).select("doc_id", "published_at", "polarity")


cte("c_daily", """
SELECT CAST(published_at AS DATE) AS date, avg(polarity) AS polarity, count(*) AS n,
 avg(CASE WHEN polarity < 0 THEN 1.0 ELSE 0.0 END) AS negative_share FROM c_polarity GROUP BY 1""")
cte("c_ondates", """
SELECT asset, b.date, polarity, CAST(coalesce(n, 0) AS DOUBLE) AS n_headlines, negative_share
FROM c_bars b LEFT JOIN c_daily d USING (date)""")


@query("s_daily_rollup", """
SELECT asset, DAY(date) AS date, R6(polarity) AS polarity, R6(n_headlines) AS n_headlines,
 R6(negative_share) AS negative_share FROM c_ondates""")
def _(t):
    return SE.on_panel_dates(t.bars, SE.daily_rollup(SE.score_headlines(t.headlines, _scorer)))


_headline_sql = {
    "headline_polarity_1d": "polarity", "headline_polarity_7d": O.roll("avg", "polarity", 7),
    "negative_ratio_7d": O.roll("avg", "negative_share", 7), "headline_count_z": O.z("n_headlines", 30)}
for _key, _columns in {"s_polarity_1d_7d": ["headline_polarity_1d", "headline_polarity_7d"],
                       "s_negative_ratio": ["negative_ratio_7d"], "s_count_z": ["headline_count_z"]}.items():
    query(_key, "SELECT asset, DAY(date) AS date, " + ", ".join(f"R6({_headline_sql[c]}) AS {c}" for c in _columns)
          + " FROM c_ondates")(
        lambda t, cols=tuple(_columns): SE.headline_features(t.bars, t.headlines, _scorer).select("asset", "date", *cols))


@query("s_index_fallback", f"""
SELECT asset, DAY(date) AS date, {_r6(S.SENTIMENT)}, CAST(NULL AS DOUBLE) AS headline_count_z FROM c_senti""")
def _(t):
    return SE.index_sentiment(t.bars, t.fg_index).select("asset", "date", *S.SENTIMENT, "headline_count_z")


# --- cross-asset ---------------------------------------------------------------
@query("x_pairwise_corr", "SELECT DAY(date) AS date, a, b, R6(corr) AS corr FROM c_pairs")
def _(t):
    return C.pairwise_corr(C.grid_returns(t.bars)).drop("g")


@query("x_mean_corr", "SELECT DAY(date) AS date, R6(mean_pairwise_corr_30) AS mean_pairwise_corr_30 FROM c_market")
def _(t):
    return C.market_corr(C.pairwise_corr(C.grid_returns(t.bars))).select("date", "mean_pairwise_corr_30")


@query("x_corr_dispersion", "SELECT DAY(date) AS date, R6(corr_dispersion_30) AS corr_dispersion_30 FROM c_market")
def _(t):
    return C.market_corr(C.pairwise_corr(C.grid_returns(t.bars))).select("date", "corr_dispersion_30")


@query("x_lead_lag", "SELECT DAY(date) AS date, R6(btc_lead_lag_5) AS btc_lead_lag_5 FROM c_lead")
def _(t):
    return C.lead_lag(C.grid_returns(t.bars), I.PRIMARY)


@query("x_corr_graph", "SELECT DAY(date) AS date, a, b, R6(abs(corr)) AS weight FROM c_pairs WHERE abs(corr) >= 0.3")
def _(t):
    return C.corr_graph(C.pairwise_corr(C.grid_returns(t.bars)))


@query("x_eigen_centrality", "SELECT DAY(date) AS date, asset, R6(v) AS eigen_centrality_30 FROM c_eigen")
def _(t):
    return C.eigen_centrality(C.pairwise_corr(C.grid_returns(t.bars)))


@query("x_degree_centrality", """
SELECT DAY(date) AS date, asset, R6(coalesce(d / nullif(sum(d) OVER (PARTITION BY date), 0), 0)) AS degree_share FROM (
 SELECT date, asset, sum(CASE WHEN abs(corr) >= 0.3 THEN abs(corr) ELSE 0 END) AS d FROM (
  SELECT date, a AS asset, corr FROM c_pairs UNION ALL SELECT date, b, corr FROM c_pairs) GROUP BY 1, 2)""")
def _(t):
    return C.degree_centrality(C.pairwise_corr(C.grid_returns(t.bars)))


@query("x_contagion_all", f"""
SELECT b.asset, DAY(b.date) AS date, R6(close) AS close, R6(mean_pairwise_corr_30) AS mean_pairwise_corr_30, R6(corr_dispersion_30) AS corr_dispersion_30,
 CASE WHEN mean_pairwise_corr_30 IS NOT NULL THEN R6(btc_lead_lag_5) END AS btc_lead_lag_5, R6(v) AS eigen_centrality_30
FROM c_bars b LEFT JOIN c_market USING (date) LEFT JOIN c_lead USING (date) LEFT JOIN c_eigen e ON e.date = b.date AND e.asset = b.asset""")
def _(t):
    return C.with_contagion(t.bars.select("asset", "date", "close"), t.bars, I.PRIMARY)


# --- labels --------------------------------------------------------------------
@query("lbl_crash", "SELECT asset, DAY(date) AS date, R6(close) AS close, INT8(label) AS label FROM c_label")
def _(t):
    return L.with_label(t.bars, THRESHOLD).select("asset", "date", "close", "label")


@query("lbl_panel", """
SELECT asset, INT8(count(label)) AS n_labelled, INT8(sum(label)) AS n_positive, R6(avg(label)) AS positive_rate
FROM c_label GROUP BY asset""")
def _(t):
    return L.label_rate(L.with_label(t.bars, THRESHOLD))


cte("c_cells", " UNION ALL ".join(
    f"SELECT date, {th} AS threshold, {h} AS horizon_days, CASE WHEN {O.forward(h)} IS NULL THEN NULL "
    f"WHEN {O.forward(h)} >= {th} THEN 1 ELSE 0 END AS label FROM c_bars" for th in GRID[0] for h in GRID[1]))


@query("lbl_sensitivity", """
SELECT R6(threshold) AS threshold, INT8(horizon_days) AS horizon_days, R6(positive_rate) AS positive_rate,
 INT8(n_positive) AS n_positive, INT8(n_labelled) AS n_labelled, INT8(episodes_covered) AS episodes_covered,
 INT8(4) AS episodes_total, uncovered FROM (
 SELECT threshold, horizon_days, avg(label) AS positive_rate, sum(label) AS n_positive, count(label) AS n_labelled FROM c_cells GROUP BY 1, 2)
JOIN (SELECT threshold, horizon_days, count(*) FILTER (WHERE hit = 1) AS episodes_covered,
  coalesce(string_agg(episode, ', ' ORDER BY episode) FILTER (WHERE hit = 0), '-') AS uncovered FROM (
  SELECT threshold, horizon_days, episode, max(CASE WHEN label = 1 AND date BETWEEN s - 45 AND e THEN 1 ELSE 0 END) AS hit
  FROM c_cells CROSS JOIN c_episodes GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (threshold, horizon_days)""")
def _(t):
    return L.sensitivity(t.bars, *GRID, t.episodes)


cte("c_covered", """
SELECT episode, coalesce(max(label), 0) = 1 AS covered FROM c_episodes
LEFT JOIN c_label ON date BETWEEN s - 45 AND e GROUP BY episode""")


@query("lbl_episode_coverage", "SELECT episode, covered FROM c_covered")
def _(t):
    return L.episode_coverage(L.with_label(t.bars, THRESHOLD), t.episodes)


@query("lbl_assert_coverage", "SELECT episode, covered FROM c_covered WHERE NOT covered")
def _(t):
    return L.episode_coverage(L.with_label(t.bars, THRESHOLD), t.episodes).filter("NOT covered")


# --- windows -------------------------------------------------------------------
_complete = " AND ".join(f"{f} IS NOT NULL" for f in _OWN)
cte("c_marked", f"""
SELECT *, rn >= 30 AND ok = 30 AND label IS NOT NULL AS emit, date AS window_end, CAST(date + 14 AS DATE) AS label_end FROM (
 SELECT *, row_number() OVER w AS rn, sum(CASE WHEN {_complete} THEN 1 ELSE 0 END) OVER f AS ok, min(date) OVER f AS window_start
 FROM c_panel WINDOW w AS (PARTITION BY asset ORDER BY date),
  f AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))""")
cte("c_meta", "SELECT asset, window_start, window_end, label_end, label, rn FROM c_marked WHERE emit")
cte("c_tensor", f"""
SELECT m.asset, m.window_end, m.label, p.rn - m.rn + 29 AS t, {', '.join('p.' + f for f in _OWN)}
FROM c_meta m JOIN c_marked p ON p.asset = m.asset AND p.rn BETWEEN m.rn - 29 AND m.rn""")


def demo_marked(t, **kw):
    return W.mark_windows(demo_panel(t), _OWN, **kw)


@query("win_meta", """
SELECT asset, DAY(window_start) AS window_start, DAY(window_end) AS window_end, DAY(label_end) AS label_end,
 INT8(label) AS label FROM c_meta""")
def _(t):
    return W.window_meta(demo_marked(t))


@query("win_tensor", f"""
SELECT asset, DAY(window_end) AS window_end, INT8(max(label)) AS label, INT8(count(*)) AS n_rows,
 {', '.join(f'R6(sum(t * {f})) AS w_{f}' for f in ('realized_vol_7', 'rsi_14', 'nvt_ratio'))}
FROM c_tensor GROUP BY 1, 2""")
def _(t):
    def weighted(name):
        i = _OWN.index(name)
        steps = F.transform("feats", lambda row, k: row[i] * k)
        return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x).alias(f"w_{name}")
    return W.window_tensor(demo_marked(t), _OWN).select(
        "asset", "window_end", "label", F.size("feats").alias("n_rows"),
        *[weighted(f) for f in ("realized_vol_7", "rsi_14", "nvt_ratio")])


_pos = " + ".join(f"(t * {len(_OWN)} + {i}) * {f}" for i, f in enumerate(_OWN))


@query("win_flatten", f"""
SELECT asset, DAY(window_end) AS window_end, INT8(count(*) * {len(_OWN)}) AS width, R6(sum({_pos}) / 1000) AS position_sum
FROM c_tensor GROUP BY 1, 2""")
def _(t):
    flat = W.window_tensor(demo_marked(t), _OWN).withColumn("flat", W.flat())
    weighted = F.transform("flat", lambda x, k: x * k)
    return flat.select("asset", "window_end", F.size("flat").alias("width"),
                       (F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x) / 1000).alias("position_sum"))


@query("win_flat_names", "SELECT name, INT8(pos) AS pos, INT8(count(*)) AS n_windows, R6(avg(value)) AS mean_value FROM ("
       + " UNION ALL ".join(f"SELECT t * {len(_OWN)} + {i} AS pos, '{f}[t-' || (29 - t) || ']' AS name, {f} AS value FROM c_tensor"
                            for i, f in enumerate(_OWN)) + ") GROUP BY 1, 2")
def _(t):
    cells = W.named_cells(W.window_tensor(demo_marked(t), _OWN), _OWN)
    return cells.groupBy("name", "pos").agg(F.count("value").alias("n_windows"), F.avg("value").alias("mean_value"))
