"""Registered queries: guards, splits, scaling, sampling and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import settings as S
from tidewatch.functions.ranks import empirical_cdf, exact_quantiles
from tidewatch.operators import guards as G
from tidewatch.operators import labels as L
from tidewatch.operators import metrics as M
from tidewatch.operators import models as MO
from tidewatch.operators import panel as P
from tidewatch.operators import splits as SP
from tidewatch.operators import technical as TE
from tidewatch.operators import windows as W
from tidewatch.plans import oracle_panel as O
from tidewatch.plans.catalog_panel import THRESHOLD, demo_marked, demo_panel
from tidewatch.plans.panel_plan import own_features
from tidewatch.plans.registry import cte, query
from tidewatch.session import staged
from tidewatch.sources import inputs as I

_OWN = S.OWN_FEATURES
YEARS = list(range(1995, 2002))


def fx(expr: str, places: int) -> str:
    return f"CAST(CAST(floor(({expr}) * 1e{places} + 0.5) / 1e{places} AS DECIMAL(38,{places})) AS VARCHAR)"


def _own(t):
    return own_features(t.bars, t.supply, t.fg_index, t.assets)


# --- guards --------------------------------------------------------------------
@query("g_coverage", "SELECT feature, R6(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END)) AS overall, " + ", ".join(
    f"R6(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) FILTER (WHERE year(date) = {y})) AS y{y}" for y in YEARS)
    + " FROM c_long GROUP BY feature")
def _(t):
    return G.coverage_wide(G.coverage(_own(t), _OWN), YEARS)


@query("g_coverage_enforce", """
SELECT feature, R6(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END)) AS missing
FROM c_long JOIN c_assets USING (asset) WHERE role = 'target' GROUP BY feature
HAVING 1 - avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) < 0.985""")
def _(t):
    return G.thin_columns(G.coverage(P.only_targets(_own(t), t.assets), _OWN), 0.985)


cte("c_peek", f"SELECT *, {O.forward(7)} AS peek FROM c_techtrim")
cte("c_profile", "SELECT asset, feature, count(value) AS known, min(rn) FILTER (WHERE value IS NOT NULL) - 1 AS head_nulls, "
    "max(rn) - max(rn) FILTER (WHERE value IS NOT NULL) AS tail_nulls FROM (SELECT asset, rn, "
    + ", ".join(S.TECHNICAL) + ", peek FROM c_peek) UNPIVOT INCLUDE NULLS (value FOR feature IN ("
    + ", ".join(S.TECHNICAL) + ", peek)) GROUP BY 1, 2")


@query("g_point_in_time", """
SELECT asset, feature, INT8(known) AS known, INT8(head_nulls) AS head_nulls, INT8(tail_nulls) AS tail_nulls
FROM c_profile WHERE known >= 2 AND tail_nulls > head_nulls AND head_nulls = 0 AND tail_nulls > 1""")
def _(t):
    panel = TE.technical(P.trim_inception(t.bars, t.assets)).withColumn("peek", L.forward_decline(7))
    return G.forward_looking(panel, [*S.TECHNICAL, "peek"])


@query("g_next_step_copy", """
SELECT 'close' AS feature, INT8(count(*)) AS n, R6(0.0) AS worst FROM (
 SELECT lead(close) OVER (PARTITION BY asset ORDER BY date) AS nxt FROM c_bars) WHERE nxt IS NOT NULL""")
def _(t):
    leaky = t.bars.withColumn("close", F.lead("close").over(G.ordered()))
    return G.next_step_copies(leaky, t.bars, ["close", "volume", "trades"])


@query("g_future_text", """
SELECT INT8(count(*) FILTER (WHERE published_at > TIMESTAMP '1999-12-31 00:00:00')) AS future_rows, INT8(count(*)) AS all_rows
FROM c_headlines""")
def _(t):
    return G.future_rows(t.headlines, "published_at", F.lit("1999-12-31").cast("timestamp"))


def _compare(a: str, b: str, where: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS feature, INT8(count(*)) AS n, R6(max(abs(a.{f} - b.{f}))) AS max_abs_diff, "
        f"INT8(sum(CASE WHEN (a.{f} IS NULL) <> (b.{f} IS NULL) THEN 1 ELSE 0 END)) AS null_mismatches "
        f"FROM {a} a JOIN {b} b ON a.asset = b.asset AND a.date = b.date{where}" for f in S.TECHNICAL)


_next = "lead(date) OVER (PARTITION BY asset ORDER BY date)"
cte("c_moved", f"SELECT * REPLACE (nd AS date) FROM (SELECT *, {_next} AS nd FROM c_bars) WHERE nd IS NOT NULL")
cte("c_techmoved", O.technical_sql("(SELECT * EXCLUDE (nd) FROM c_moved)"))
cte("c_shifted", f"SELECT asset, {_next} AS date, {', '.join(S.TECHNICAL)} FROM c_tech")
cte("c_cut", "SELECT * FROM c_bars WHERE date <= DATE '1999-06-30'")
cte("c_techcut", O.technical_sql("c_cut"))


@query("g_shift_invariance", _compare("c_shifted", "c_techmoved"))
def _(t):
    return G.shift_invariance(t.bars, TE.technical, S.TECHNICAL)


@query("g_truncation", _compare("c_tech", "c_techcut"))
def _(t):
    return G.truncation(t.bars, TE.technical, S.TECHNICAL, "1999-06-30")


@query("g_label_disguise", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, R6(abs(covar_pop({f}, CAST(label AS DOUBLE)) / nullif(stddev_pop({f}) * stddev_pop(label), 0))) AS abs_corr "
    f"FROM c_panel WHERE {f} IS NOT NULL AND label IS NOT NULL" for f in _OWN))
def _(t):
    return G.label_disguise(demo_panel(t), _OWN)


# --- splits --------------------------------------------------------------------
cte("c_roles", """
SELECT m.*, f.fold, CASE WHEN window_start BETWEEN test_start AND test_end THEN 'test'
 WHEN window_start <= train_end AND label_end < test_start - 45 THEN 'train'
 WHEN window_start <= train_end THEN 'embargoed' END AS role FROM c_meta m CROSS JOIN c_folds f""")


def demo_roles(t):
    return SP.walk_forward(W.window_meta(demo_marked(t)), I.FOLDS)


@query("g_split_overlap", """
SELECT fold, DAY(max(label_end) FILTER (WHERE role = 'train')) AS last_train_label,
 DAY(min(window_start) FILTER (WHERE role = 'test')) AS first_test_window, INT8(0) AS shared,
 max(label_end) FILTER (WHERE role = 'train') < min(window_start) FILTER (WHERE role = 'test') AS apart
FROM c_roles WHERE role IS NOT NULL GROUP BY fold""")
def _(t):
    return SP.split_overlap(demo_roles(t))


@query("sp_walk_forward", """
SELECT fold, asset, DAY(window_start) AS window_start, DAY(window_end) AS window_end, DAY(label_end) AS label_end,
 INT8(label) AS label, role FROM c_roles WHERE role IS NOT NULL""")
def _(t):
    return demo_roles(t)


cte("c_cal", """
SELECT *, CASE WHEN n_fit < 50 THEN 'fit' WHEN pos >= cut THEN 'calibrate' WHEN fits THEN 'fit' END AS part FROM (
 SELECT *, sum(CASE WHEN fits THEN 1 ELSE 0 END) OVER (PARTITION BY fold) AS n_fit FROM (
  SELECT *, label_end < boundary - 45 AS fits FROM (
   SELECT *, max(CASE WHEN pos = cut THEN window_start END) OVER (PARTITION BY fold) AS boundary FROM (
    SELECT *, row_number() OVER (PARTITION BY fold ORDER BY window_start, asset) - 1 AS pos,
     floor(count(*) OVER (PARTITION BY fold) * (1.0::DOUBLE - 0.2::DOUBLE)) AS cut FROM c_roles WHERE role = 'train'))))""")


@query("sp_calibration", """
SELECT fold, asset, DAY(window_start) AS window_start, DAY(window_end) AS window_end, DAY(label_end) AS label_end,
 INT8(label) AS label, DAY(boundary) AS boundary, part FROM c_cal WHERE part IS NOT NULL""")
def _(t):
    return SP.calibration(demo_roles(t))


@query("sp_deploy_fit_mask", """
SELECT asset, DAY(window_start) AS window_start, DAY(window_end) AS window_end, DAY(label_end) AS label_end,
 INT8(label) AS label FROM c_meta WHERE label_end < DATE '2000-01-01' - 45""")
def _(t):
    return SP.deploy_mask(W.window_meta(demo_marked(t)), I.FOLDS[-1]["test_start"])


cte("c_traintensor", "SELECT r.fold, t.* FROM c_roles r JOIN c_tensor t ON r.asset = t.asset AND r.window_end = t.window_end WHERE r.role = 'train'")
cte("c_scalew", "SELECT fold, count(*) // 30 AS n_windows, " + ", ".join(
    f"avg({f}) AS m_{f}, CASE WHEN stddev_pop({f}) > 1e-12 THEN stddev_pop({f}) ELSE 1 END AS s_{f}" for f in _OWN)
    + " FROM c_traintensor GROUP BY fold")


@query("sc_fit", " UNION ALL ".join(
    f"SELECT fold, '{f}' AS feature, INT8(n_windows) AS n_windows, R6(m_{f}) AS mean, R6(s_{f}) AS scale FROM c_scalew" for f in _OWN))
def _(t):
    return SP.fit_scaler(demo_marked(t), I.FOLDS, _OWN)


_scaled = " + ".join(f"({f} - m_{f}) / s_{f}" for f in _OWN)


@query("sc_transform", f"""
SELECT r.fold, t.asset, DAY(t.window_end) AS window_end, R6(sum({_scaled})) AS scaled_sum,
 R6(sum(CASE WHEN t.t = 29 THEN (rsi_14 - m_rsi_14) / s_rsi_14 END)) AS last_rsi
FROM c_roles r JOIN c_tensor t ON r.asset = t.asset AND r.window_end = t.window_end JOIN c_scalew s ON r.fold = s.fold
WHERE r.role = 'test' GROUP BY 1, 2, 3""")
def _(t):
    marked = demo_marked(t)
    arrays = SP.scale_arrays(SP.fit_scaler(marked, I.FOLDS, _OWN), _OWN)
    test = SP.walk_forward(W.window_tensor(marked, _OWN), I.FOLDS).filter("role = 'test'")
    scaled = SP.scale_windows(test, arrays)
    rsi = _OWN.index("rsi_14")
    return scaled.select("fold", "asset", "window_end",
                         F.aggregate(F.flatten("feats"), F.lit(0.0), lambda a, x: a + x).alias("scaled_sum"),
                         F.element_at("feats", -1)[rsi].alias("last_rsi"))


cte("c_weights", """
SELECT *, CASE WHEN p = 0 OR p = n THEN 1.0::DOUBLE ELSE n / (2.0::DOUBLE * (n - p)) END AS w0,
 CASE WHEN p = 0 OR p = n THEN 1.0::DOUBLE ELSE n / (2.0::DOUBLE * p) END AS w1 FROM (
 SELECT fold, model, count(y_true) AS n, sum(y_true) AS p FROM c_scores GROUP BY 1, 2)""")


@query("sm_class_weights", """
SELECT fold, model, R6(w0) AS weight_0, R6(w1) AS weight_1 FROM c_weights""")
def _(t):
    return SP.class_weights(t.scores, ["fold", "model"], "y_true")


@query("sm_weighted_resample")
def _(t):
    weighted = SP.with_class_weight(t.scores, ["fold"], "y_true")
    return SP.weighted_resample(weighted, ["fold"], ["doc_id"]).select("fold", "doc_id", "copy", "y_true")


_q = "least(greatest(y_score, 1e-12), 1.0 - 1e-12)"


@query("sm_weighted_bce", f"""
SELECT fold, model, R6(sum(w * -(y_true * ln({_q}) + (1 - y_true) * ln(1.0 - {_q}))) / sum(w)) AS log_loss FROM (
 SELECT s.*, CASE WHEN y_true = 1 THEN w1 ELSE w0 END AS w FROM c_scores s JOIN c_weights USING (fold, model)) GROUP BY 1, 2""")
def _(t):
    keys = ["fold", "model"]
    return SP.weighted_log_loss(SP.with_class_weight(t.scores, keys, "y_true"), keys, "y_true", "y_score", "weight")


# --- rule model ------------------------------------------------------------------
cte("c_signal", "SELECT r.fold, r.role, r.asset, r.window_end, r.label, k.realized_vol_7 AS signal FROM c_roles r "
    "JOIN c_marked k ON k.asset = r.asset AND k.date = r.window_end WHERE r.role IN ('train', 'test')")
cte("c_rulethr", "SELECT fold, quantile_cont(signal, 0.9) AS threshold FROM c_signal WHERE role = 'train' GROUP BY fold")


@query("m_rule", """
SELECT e.fold, e.asset, DAY(e.window_end) AS window_end, INT8(e.label) AS label,
 R6(count(*) FILTER (WHERE t.signal <= e.signal) / CAST(count(*) AS DOUBLE)) AS y_score, R6(max(h.threshold)) AS vol_threshold
FROM c_signal e JOIN c_signal t ON t.fold = e.fold AND t.role = 'train' JOIN c_rulethr h ON h.fold = e.fold
WHERE e.role = 'test' GROUP BY 1, 2, e.window_end, e.label""")
def _(t):
    return MO.rule_scores(staged(demo_marked(t), "marked"), I.FOLDS)


# --- metrics ---------------------------------------------------------------------
KEYS = ["fold", "model"]
cte("c_conf", """
SELECT *, coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS precision, coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) AS recall,
 coalesce(2.0 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0) AS f1 FROM (
 SELECT fold, model, count(*) FILTER (WHERE y_score >= 0.5 AND y_true = 1) AS tp, count(*) FILTER (WHERE y_score >= 0.5 AND y_true = 0) AS fp,
  count(*) FILTER (WHERE y_score < 0.5 AND y_true = 1) AS fn, count(*) FILTER (WHERE y_score < 0.5 AND y_true = 0) AS tn
 FROM c_scores GROUP BY 1, 2)""")
cte("c_steps", """
SELECT *, sum(pos) OVER w AS rp, sum(n) OVER w AS rn, sum(pos) OVER g AS p, sum(n) OVER g AS t FROM (
 SELECT fold, model, y_score, sum(y_true) AS pos, count(*) AS n FROM c_scores GROUP BY 1, 2, 3)
WINDOW w AS (PARTITION BY fold, model ORDER BY y_score DESC), g AS (PARTITION BY fold, model)""")
cte("c_rank", """
SELECT fold, model, CASE WHEN max(p) > 0 AND max(p) < max(t) THEN sum(CAST(pos AS DOUBLE) / nullif(p, 0) * rp / rn) END AS pr_auc FROM c_steps GROUP BY 1, 2""")
cte("c_auc", """
SELECT a.fold, a.model, sum(CASE WHEN a.y_score > b.y_score THEN 1.0 WHEN a.y_score = b.y_score THEN 0.5 ELSE 0.0 END) / count(*) AS roc_auc
FROM c_scores a JOIN c_scores b ON a.fold = b.fold AND a.model = b.model AND a.y_true = 1 AND b.y_true = 0 GROUP BY 1, 2""")
cte("c_brier", """
SELECT fold, model, avg((y_score - y_true) * (y_score - y_true)) AS brier, avg(y_true) AS positive_rate, sum(y_true) AS n_positive,
 count(*) AS n_samples, avg(CASE WHEN y_true = 0 THEN CASE WHEN y_score >= 0.5 THEN 1.0 ELSE 0.0 END END) AS false_alarm_rate
FROM c_scores GROUP BY 1, 2""")
cte("c_fold", """
SELECT c.fold, c.model, r.pr_auc, c.f1, c.precision, c.recall, b.false_alarm_rate, b.brier, b.positive_rate AS pr_auc_baseline,
 r.pr_auc - b.positive_rate AS pr_auc_lift, b.n_positive, b.n_samples
FROM c_conf c JOIN c_rank r USING (fold, model) JOIN c_brier b USING (fold, model)""")


@query("ev_confusion", """
SELECT fold, model, INT8(tp) AS tp, INT8(fp) AS fp, INT8(fn) AS fn, INT8(tn) AS tn, R6(precision) AS precision,
 R6(recall) AS recall, R6(f1) AS f1 FROM c_conf""")
def _(t):
    return M.confusion(t.scores, KEYS)


@query("ev_false_alarm", "SELECT fold, model, R6(false_alarm_rate) AS false_alarm_rate FROM c_brier")
def _(t):
    return M.false_alarm_rate(t.scores, KEYS)


@query("ev_pr_auc", "SELECT fold, model, R6(pr_auc) AS pr_auc FROM c_rank")
def _(t):
    return M.ranking(t.scores, KEYS).select(*KEYS, "pr_auc")


@query("ev_roc_auc", "SELECT r.fold, r.model, R6(roc_auc) AS roc_auc FROM c_rank r LEFT JOIN c_auc a USING (fold, model)")
def _(t):
    return M.ranking(t.scores, KEYS).select(*KEYS, "roc_auc")


@query("ev_brier", """
SELECT fold, model, R6(brier) AS brier, R6(positive_rate) AS pr_auc_baseline, R6(pr_auc - positive_rate) AS pr_auc_lift,
 INT8(n_positive) AS n_positive, INT8(n_samples) AS n_samples FROM c_brier JOIN c_rank USING (fold, model)""")
def _(t):
    return M.metric_suite(t.scores, KEYS).select(*KEYS, "brier", "pr_auc_baseline", "pr_auc_lift", "n_positive", "n_samples")


_probs = ", ".join(f"CAST('{p!r}' AS DOUBLE)" for p in M.CANDIDATE_PROBS)
cte("c_cand", f"""
SELECT DISTINCT fold, model, s[lo + 1] + (s[least(lo + 2, n)] - s[lo + 1]) * (h - lo) AS threshold FROM (
 SELECT *, CAST(floor(h) AS BIGINT) AS lo FROM (
  SELECT *, pr * (n - 1) AS h FROM (SELECT fold, model, list_sort(list(y_score)) AS s, count(*) AS n FROM c_scores GROUP BY 1, 2)
  CROSS JOIN (SELECT unnest([{_probs}]) AS pr)))""")
cte("c_f1", """
SELECT c.fold, c.model, c.threshold, sum(y_true) AS p, count(*) AS t,
 coalesce(2.0 * count(*) FILTER (WHERE y_score >= threshold AND y_true = 1)
  / CAST(nullif(count(*) FILTER (WHERE y_score >= threshold) + sum(y_true), 0) AS DOUBLE), 0) AS f1
FROM c_cand c JOIN c_scores s USING (fold, model) GROUP BY 1, 2, 3""")


@query("ev_best_threshold", """
SELECT fold, model, R6(CASE WHEN max(p) = 0 OR max(p) = max(t) THEN 0.5 ELSE min(threshold) FILTER (WHERE f1 = best) END) AS threshold,
 R6(CASE WHEN max(p) > 0 AND max(p) < max(t) THEN max(f1) END) AS f1
FROM (SELECT *, max(f1) OVER (PARTITION BY fold, model) AS best FROM c_f1) GROUP BY 1, 2""")
def _(t):
    return M.best_threshold(t.scores, KEYS)


cte("c_warn", """
SELECT 'vol' AS model, asset, date, realized_vol_30 AS y_score, 20.0 AS threshold FROM c_tech WHERE realized_vol_30 IS NOT NULL
UNION ALL SELECT 'drawdown', asset, date, drawdown_depth, 0.9 FROM c_tech WHERE drawdown_depth IS NOT NULL""")
cte("c_runs", """
SELECT model, asset, date FROM (SELECT *, count(*) FILTER (WHERE y_score >= threshold) OVER (PARTITION BY model, asset ORDER BY date
 ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS k FROM c_warn) WHERE k = 2""")
cte("c_lt", """
SELECT model, asset, episode, s, coalesce(early, late) AS first FROM (
 SELECT k.model, k.asset, e.episode, e.s, min(r.date) FILTER (WHERE r.date >= e.s - 90 AND r.date < e.s) AS early,
  min(r.date) FILTER (WHERE r.date BETWEEN e.s AND e.e) AS late
 FROM (SELECT DISTINCT model, asset FROM c_warn) k CROSS JOIN c_episodes e
 LEFT JOIN c_runs r ON r.model = k.model AND r.asset = k.asset GROUP BY 1, 2, 3, 4)""")


def _warnings(t):
    df = TE.with_realized_vol(t.bars).withColumn("drawdown_depth", TE.drawdown_depth())
    signals = F.array(
        F.struct(F.lit("vol").alias("model"), F.col("realized_vol_30").alias("y_score"), F.lit(20.0).alias("threshold")),
        F.struct(F.lit("drawdown").alias("model"), F.col("drawdown_depth").alias("y_score"), F.lit(0.9).alias("threshold")))
    return (df.select("asset", "date", F.explode(signals).alias("s")).select("asset", "date", "s.*")
            .filter(F.col("y_score").isNotNull()))


_LT = "episode, DAY(s) AS start, INT8(s - first) AS lead_time_days, first IS NOT NULL AS warned FROM c_lt"


@query("ev_lead_time", f"SELECT asset, {_LT} WHERE model = 'vol'")
def _(t):
    return M.lead_time(_warnings(t).filter("model = 'vol'"), ["asset"], t.episodes)


@query("ev_lead_time_table", f"SELECT model, {_LT} WHERE asset = 'AMERICA'")
def _(t):
    return M.lead_time(_warnings(t).filter(F.col("asset") == I.PRIMARY), ["model"], t.episodes)


METRICS = ["pr_auc", "f1", "precision", "recall", "false_alarm_rate", "brier"]
_ALL = [*METRICS, "pr_auc_baseline", "pr_auc_lift"]
cte("c_agg", "SELECT model, " + ", ".join(f"avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std" for m in _ALL)
    + ", sum(n_positive) AS n_positive, sum(n_samples) AS n_samples FROM c_fold GROUP BY model")


def _aggregate(t):
    return M.aggregate_folds(M.metric_suite(t.scores, KEYS), _ALL)


@query("ev_fold_aggregate", "SELECT model, " + ", ".join(
    f"R6({m}_mean) AS {m}_mean, R6({m}_std) AS {m}_std" for m in _ALL)
    + ", INT8(n_positive) AS n_positive, INT8(n_samples) AS n_samples FROM c_agg")
def _(t):
    return _aggregate(t)


@query("ev_model_comparison", "SELECT model, INT8(row_number() OVER (ORDER BY pr_auc_mean DESC NULLS LAST, model)) AS rank, " + ", ".join(
    f"{fx(m + '_mean', 3)} || ' +/- ' || {fx(m + '_std', 3)} AS {m}" for m in METRICS)
    + ", R6(round(pr_auc_baseline_mean, 4)) AS pr_auc_baseline, R6(round(pr_auc_lift_mean, 4)) AS pr_auc_lift, "
      "INT8(n_samples) AS n_test_samples FROM c_agg")
def _(t):
    return M.model_comparison(_aggregate(t), METRICS)


_LANGS = ["de", "en", "es", "fr"]


@query("ev_per_fold_pivot", "SELECT model, " + ", ".join(
    f"R6(max(CASE WHEN fold = '{f}' THEN pr_auc END)) AS {f}" for f in _LANGS) + " FROM c_fold GROUP BY model")
def _(t):
    return M.per_fold_pivot(M.metric_suite(t.scores, KEYS), _LANGS)


# --- flagship --------------------------------------------------------------------
cte("c_vq", "SELECT asset, " + ", ".join(
    f"list_sort(list(realized_vol_30))[CAST(floor({p} * (count(*) - 1)) AS BIGINT) + 1] AS lo{i}, "
    f"list_sort(list(realized_vol_30))[CAST(least(floor({p} * (count(*) - 1)) + 1, count(*) - 1) AS BIGINT) + 1] AS hi{i}, "
    f"{p} * (count(*) - 1) - floor({p} * (count(*) - 1)) AS fr{i}" for i, p in enumerate((0.25, 0.5, 0.75)))
    + " FROM (SELECT * FROM c_tech WHERE realized_vol_30 IS NOT NULL) GROUP BY asset")


@query("flagship", """
SELECT asset, INT8(quartile) AS quartile, INT8(count(*)) AS n_days, INT8(sum(label)) AS n_crash, R6(avg(label)) AS crash_rate,
 R6(avg(drawdown_depth)) AS mean_drawdown FROM (
 SELECT f.asset, f.drawdown_depth, l.label, 1
  + CASE WHEN realized_vol_30 > lo0 + (hi0 - lo0) * fr0 THEN 1 ELSE 0 END + CASE WHEN realized_vol_30 > lo1 + (hi1 - lo1) * fr1 THEN 1 ELSE 0 END
  + CASE WHEN realized_vol_30 > lo2 + (hi2 - lo2) * fr2 THEN 1 ELSE 0 END AS quartile
 FROM c_tech f JOIN c_label l USING (asset, date) JOIN c_vq v ON v.asset = f.asset
 WHERE realized_vol_30 IS NOT NULL AND label IS NOT NULL) GROUP BY 1, 2""")
def _(t):
    """Crash rate per asset and volatility quartile."""
    df = TE.with_realized_vol(t.bars).withColumn("drawdown_depth", TE.drawdown_depth())
    df = L.with_label(df, THRESHOLD).select("asset", "realized_vol_30", "drawdown_depth", "label")
    cuts = (exact_quantiles(df, ["asset"], "realized_vol_30", [0.25, 0.5, 0.75])
            .groupBy("asset").agg(F.collect_list("quantile").alias("cuts")))
    quartile = F.size(F.filter("cuts", lambda c: c < F.col("realized_vol_30"))) + 1
    return (df.filter("realized_vol_30 IS NOT NULL AND label IS NOT NULL").join(cuts, "asset")
            .groupBy("asset", quartile.alias("quartile")).agg(
                F.count(F.lit(1)).alias("n_days"), F.sum("label").alias("n_crash"),
                F.avg("label").alias("crash_rate"), F.avg("drawdown_depth").alias("mean_drawdown")))
