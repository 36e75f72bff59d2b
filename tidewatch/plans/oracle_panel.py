"""Named subqueries of the check SQL: inputs and panel columns."""

from __future__ import annotations

import re

from tidewatch.operators.contagion import CENTRALITY_MOST, CENTRALITY_ROUNDS, CENTRALITY_TOLERANCE
from tidewatch.plans.registry import CTES, cte
from tidewatch.sources import inputs as I


def values(rows, columns: str) -> str:
    return ("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows)
            + f") t({columns})")


cte("c_bars", """
SELECT r.r_name AS asset, CAST(l.l_shipdate AS DATE) AS date,
  min_by(p, k) AS open, max(p) AS high, min(p) AS low,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)
    / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close,
  max_by(p, k) AS last_price,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS quote_volume,
  CAST(count(*) AS DOUBLE) AS trades,
  CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS taker_buy_base
FROM (SELECT *, l_extendedprice / l_quantity AS p,
        {'o': l_orderkey, 'n': l_linenumber, 'p': l_partkey, 's': l_suppkey} AS k FROM lineitem) l
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY r.r_name, CAST(l.l_shipdate AS DATE)""")
cte("c_index", """
SELECT CAST(o_orderdate AS DATE) AS date,
  100.0 * CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS value
FROM orders GROUP BY 1""")
cte("c_supply", """
SELECT date, CAST(sum(flow) OVER (ORDER BY date) AS DOUBLE) AS value FROM
 (SELECT CAST(o_orderdate AS DATE) AS date, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS flow FROM orders GROUP BY 1)""")
cte("c_assets", "SELECT asset, role, CAST(inception AS DATE) AS inception FROM ("
    + values(I.ASSETS, "asset, role, inception") + ")")
cte("c_episodes", "SELECT episode, CAST(s AS DATE) AS s, CAST(e AS DATE) AS e FROM ("
    + values(I.EPISODES, "episode, s, e") + ")")
cte("c_folds", "SELECT fold, CAST(train_end AS DATE) AS train_end, CAST(test_start AS DATE) AS test_start, "
    "CAST(test_end AS DATE) AS test_end FROM ("
    + values([tuple(f.values()) for f in I.FOLDS], "fold, train_end, test_start, test_end") + ")")
cte("c_cycles", f"SELECT CAST(unnest(generate_series(DATE '{I.CYCLES['start']}', DATE '{I.CYCLES['end']}', "
    f"INTERVAL {I.CYCLES['every_days']} DAY)) AS DATE) AS as_of")
cte("c_headlines", """
SELECT doc_id, source, lang, text AS title,
  CAST(CAST(DATE '1995-01-02' + CAST((doc_id * 37) % 2499 AS INT) AS DATE) AS TIMESTAMP)
   + to_hours(CAST(doc_id % 24 AS INT)) AS published_at FROM documents""")
cte("c_scores", """
SELECT d.doc_id, d.lang AS fold, d.source AS model, 1 - l.quality AS y_true,
  CAST((d.doc_id * 7919) % 997 AS DOUBLE) / 997 AS y_score FROM documents d JOIN labels l USING (doc_id)""")
cte("c_vectors", """
SELECT CAST(label AS VARCHAR) AS asset, CAST(DATE '1995-01-02' + CAST(vec_id AS INT) AS DATE) AS date,
  CAST(embedding AS DOUBLE[]) AS vec FROM embeddings""")


def roll(agg: str, x: str, n: int) -> str:
    """A trailing aggregate over n complete rows of one asset."""
    w = f"(PARTITION BY asset ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) OVER {w} = {n} THEN {agg}({x}) OVER {w} END)"


def z(x: str, n: int) -> str:
    return f"(({x} - {roll('avg', x, n)}) / nullif({roll('stddev_samp', x, n)}, 0))"


def technical_sql(source: str) -> str:
    """All technical columns computed from a bars-like relation."""
    upto = "(PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING)"
    ewm = ("CASE WHEN count({0}) OVER " + upto + " >= 14 THEN list_reduce(list({0}) FILTER (WHERE {0} IS NOT NULL) OVER "
           + upto + ", lambda a, x: a * 13.0::DOUBLE / 14 + x / 14.0::DOUBLE) END")
    return f"""
SELECT *, CASE WHEN down IS NULL OR down = 0 THEN NULL ELSE 100.0 - 100.0 / (1.0 + up / down) END AS rsi_14 FROM (
SELECT *, {ewm.format('gain')} AS up, {ewm.format('loss')} AS down,
  {roll('stddev_samp', 'r', 7)} * sqrt(365.0) AS realized_vol_7,
  {roll('stddev_samp', 'r', 14)} * sqrt(365.0) AS realized_vol_14,
  {roll('stddev_samp', 'r', 30)} * sqrt(365.0) AS realized_vol_30,
  {z('volume', 20)} AS volume_z_20,
  (peak - close) / peak AS drawdown_depth,
  CAST(rn - max(CASE WHEN close >= peak THEN rn END) OVER {upto} AS DOUBLE) AS drawdown_duration,
  close / prev10 - 1 AS momentum_10,
  {roll('avg', 'tr', 14)} / close AS atr_14
FROM (SELECT *, ln(close / prev) AS r, CASE WHEN prev IS NULL THEN NULL ELSE greatest(close - prev, 0) END AS gain,
   CASE WHEN prev IS NULL THEN NULL ELSE greatest(prev - close, 0) END AS loss,
   greatest(high - low, abs(high - prev), abs(low - prev)) AS tr
 FROM (SELECT *, lag(close) OVER w AS prev, lag(close, 10) OVER w AS prev10, row_number() OVER w AS rn,
   max(close) OVER {upto} AS peak FROM {source} WINDOW w AS (PARTITION BY asset ORDER BY date)))
)"""


cte("c_trim", "SELECT b.* FROM c_bars b JOIN c_assets a USING (asset) WHERE b.date >= a.inception")
cte("c_tech", technical_sql("c_bars"))
cte("c_techtrim", technical_sql("c_trim"))


def flow_sql(source: str) -> str:
    return f"""
SELECT *, {roll('avg', 'sell', 7)} AS exchange_netflow_7, {z('mean_trade_size', 30)} AS whale_tx_count,
  ln(1 + trade_count) AS active_addresses, sup / nullif(sup7, 0) - 1 AS stablecoin_netflow,
  ln(close / nullif({roll('avg', 'quote_volume', 7)}, 0)) AS nvt_ratio
FROM (SELECT b.*, -((taker_buy_base - (nullif(volume, 0) - taker_buy_base)) / nullif(volume, 0)) AS sell,
   (taker_buy_base - (nullif(volume, 0) - taker_buy_base)) / nullif(volume, 0) AS taker_net_ratio,
   quote_volume / nullif(trades, 0) AS mean_trade_size, nullif(trades, 0) AS trade_count,
   s.value AS sup, lag(s.value, 7) OVER (PARTITION BY asset ORDER BY date) AS sup7
 FROM {source} b LEFT JOIN c_supply s USING (date))"""


cte("c_flow", flow_sql("c_bars"))
cte("c_flowtrim", flow_sql("c_techtrim"))


def index_sql(source: str) -> str:
    return f"""
SELECT *, pol AS headline_polarity_1d, {roll('avg', 'pol', 7)} AS headline_polarity_7d, {roll('avg', 'neg', 7)} AS negative_ratio_7d
FROM (SELECT b.*, (i.value - 50) / 50 AS pol, CASE WHEN (i.value - 50) / 50 < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS neg
 FROM {source} b LEFT JOIN c_index i USING (date))"""


cte("c_senti", index_sql("c_bars"))
cte("c_own", index_sql("c_flowtrim"))


def forward(h: int) -> str:
    w = f"(PARTITION BY asset ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"((close - CASE WHEN count(close) OVER {w} = {h} THEN min(close) OVER {w} END) / close)"


cte("c_label", f"SELECT *, CASE WHEN d IS NULL THEN NULL WHEN d >= 0.8 THEN 1 ELSE 0 END AS label "
    f"FROM (SELECT asset, date, close, {forward(14)} AS d FROM c_bars)")
cte("c_panel", f"""SELECT * EXCLUDE (label0, role), CASE WHEN role = 'target' THEN label0 END AS label FROM (
 SELECT p.* EXCLUDE (d), a.role, CASE WHEN d IS NULL THEN NULL WHEN d >= 0.8 THEN 1 ELSE 0 END AS label0
 FROM (SELECT *, {forward(14)} AS d FROM c_own) p JOIN c_assets a USING (asset))""")

# --- cross-asset ---------------------------------------------------------------
cte("c_grid", "SELECT date, row_number() OVER (ORDER BY date) AS g FROM (SELECT DISTINCT date FROM c_bars)")
cte("c_spine", """
SELECT s.asset, s.date, s.g, ln(b.close / lag(b.close) OVER w) AS ret
FROM (SELECT a.asset, g.date, g.g FROM (SELECT DISTINCT asset FROM c_bars) a CROSS JOIN c_grid g) s
LEFT JOIN c_bars b ON b.asset = s.asset AND b.date = s.date
WINDOW w AS (PARTITION BY s.asset ORDER BY s.g)""")
cte("c_usable", """
SELECT *, g > 30 AND count(ret) OVER (PARTITION BY asset ORDER BY g ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) >= 15 AS usable
FROM c_spine""")


def corr_sql(x: str, y: str, w: str) -> str:
    cx, cy = (f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {v} END" for v in (x, y))
    return (f"(covar_pop({cx}, {cy}) OVER {w} / nullif(stddev_pop({cx}) OVER {w} * stddev_pop({cy}) OVER {w}, 0))")


_pw = "(PARTITION BY a, b ORDER BY g ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
cte("c_pairs", f"""
SELECT date, g, a, b, corr FROM (SELECT *, {corr_sql('ra', 'rb', _pw)} AS corr FROM
 (SELECT x.g, x.date, x.asset AS a, y.asset AS b, x.ret AS ra, y.ret AS rb, x.usable AND y.usable AS ok
  FROM c_usable x JOIN c_usable y ON x.g = y.g AND x.asset < y.asset)) WHERE ok""")
cte("c_market", """
SELECT date, avg(corr) AS mean_pairwise_corr_30, stddev_pop(corr) AS corr_dispersion_30
FROM c_pairs GROUP BY date HAVING count(*) >= 3 AND avg(corr) IS NOT NULL""")
_lags = []
for _k in range(1, 6):
    _w = f"(PARTITION BY asset ORDER BY g ROWS BETWEEN {29 - _k} PRECEDING AND CURRENT ROW)"
    _lags.append(f"CASE WHEN count(CASE WHEN l{_k} IS NOT NULL AND ret IS NOT NULL THEN 1 END) OVER {_w} >= 7 "
                 f"THEN {corr_sql(f'l{_k}', 'ret', _w)} END AS k{_k}")
_best = "CASE " + " ".join(
    f"WHEN abs(k{k}) = greatest(abs(k1), abs(k2), abs(k3), abs(k4), abs(k5)) THEN {k} * k{k}" for k in range(1, 6)) + " ELSE 0 END"
cte("c_lead", f"""
SELECT date, CASE WHEN bool_or(lu) THEN avg(CASE WHEN usable THEN led END) ELSE 0 END AS btc_lead_lag_5 FROM (
 SELECT date, usable, lu, {_best} AS led FROM (
  SELECT *, {', '.join(_lags)} FROM (
   SELECT f.*, l.usable AS lu, l1, l2, l3, l4, l5 FROM c_usable f LEFT JOIN (
     SELECT g, usable, {', '.join(f'lag(ret, {k}) OVER (ORDER BY g) AS l{k}' for k in range(1, 6))}
     FROM c_usable WHERE asset = '{I.PRIMARY}') l USING (g)
   WHERE f.asset <> '{I.PRIMARY}')))
GROUP BY date HAVING sum(CASE WHEN usable THEN 1 ELSE 0 END) + max(CASE WHEN lu THEN 1 ELSE 0 END) >= 3""")

# Leading vectors of the correlation graphs: the same rounds with the same end, one date's values a row each.
cte("c_gdates", "SELECT date, max(abs(corr)) >= 0.3 AS linked FROM c_pairs GROUP BY date HAVING count(*) >= 3 AND count(corr) > 0")
cte("c_ends", """
SELECT date, node, dest, CASE WHEN abs(corr) >= 0.3 THEN abs(corr) ELSE 0 END AS w, linked FROM
 (SELECT date, a AS node, b AS dest, corr FROM c_pairs UNION ALL SELECT date, b, a, corr FROM c_pairs) JOIN c_gdates USING (date)""")
cte("c_gnodes", "SELECT date, node, sum(w) AS degree, any_value(linked) AS linked FROM c_ends GROUP BY 1, 2")
cte("c_gedges", "SELECT date, node, dest, w FROM c_ends WHERE w > 0 UNION ALL SELECT date, node, node, 1.0 FROM c_gnodes WHERE linked")
cte("c_whole", """
SELECT date FROM (WITH RECURSIVE reach AS (SELECT date, min(node) AS node FROM c_gnodes WHERE linked GROUP BY date UNION SELECT e.date, e.dest FROM reach r JOIN c_gedges e ON e.date = r.date AND e.node = r.node)
 SELECT date, count(*) AS n FROM reach GROUP BY date) JOIN (SELECT date, count(*) AS n FROM c_gnodes GROUP BY date) USING (date, n)""")
cte("c_power", f"""
SELECT date, node, x FROM (WITH RECURSIVE p AS (
 SELECT 0 AS k, date, node, 1 / sqrt(count(*) OVER (PARTITION BY date)) AS x, 1 / sqrt(count(*) OVER (PARTITION BY date)) AS was, 1.0::DOUBLE AS moved FROM c_gnodes JOIN c_whole USING (date)
 UNION ALL
 SELECT k, date, node, x, CASE WHEN k % {CENTRALITY_ROUNDS} = 0 THEN x ELSE was END, CASE WHEN k % {CENTRALITY_ROUNDS} = 0 THEN max(abs(x - was)) OVER (PARTITION BY date) ELSE 1.0 END FROM (
  SELECT k, date, node, was, y / sqrt(sum(y * y) OVER (PARTITION BY date)) AS x FROM (
   SELECT p.k + 1 AS k, e.date, e.dest AS node, sum(e.w * p.x) AS y, max(CASE WHEN e.dest = e.node THEN p.was END) AS was FROM p JOIN c_gedges e ON e.date = p.date AND e.node = p.node
   WHERE p.moved > {CENTRALITY_TOLERANCE} AND p.k < {CENTRALITY_MOST} GROUP BY ALL)))
 SELECT date, node, x, k, max(k) OVER (PARTITION BY date) AS top FROM p) WHERE k = top""")
cte("c_eigen", """
SELECT date, node AS asset, coalesce(x, degree / nullif(sum(degree) OVER (PARTITION BY date), 0), 0) AS v FROM c_gnodes LEFT JOIN c_power USING (date, node)""")

# The same over the bars from each asset's inception on, as the assembled panel takes them.
_CROSS = ["c_grid", "c_spine", "c_usable", "c_pairs", "c_market", "c_lead", "c_gdates", "c_ends", "c_gnodes", "c_gedges", "c_whole", "c_power", "c_eigen"]
for _name in _CROSS:
    cte(f"{_name}_t", re.sub(r"\b(" + "|".join(_CROSS) + r")\b", r"\1_t", re.sub(r"\bc_bars\b", "c_trim", CTES[_name])))
