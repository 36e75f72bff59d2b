"""Registered queries: explanation, analogues and the risk chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import settings as S
from tidewatch.operators import analogues as A
from tidewatch.operators import explain as E
from tidewatch.operators import health as H
from tidewatch.operators import models as MO
from tidewatch.operators import precedents as PR
from tidewatch.operators import risk as R
from tidewatch.operators import scores as SC
from tidewatch.operators import windows as W
from tidewatch.operators.asof import decision_points, latest_dates
from tidewatch.operators.panel import trim_inception, unpivot
from tidewatch.functions.frames import pair_corr
from tidewatch.plans import oracle_panel as O
from tidewatch.plans.catalog_eval import fx
from tidewatch.plans.catalog_ledger import demo_drift, demo_trend
from tidewatch.plans.catalog_panel import demo_marked, demo_panel
from tidewatch.plans.decisions import SIGNALS, Chain
from tidewatch.plans.panel_plan import own_features
from tidewatch.plans.registry import cte, query
from tidewatch.session import staged
from tidewatch.sources import inputs as I

_OWN = S.OWN_FEATURES
L = S.LOOKBACK


def pc(expr: str, places: int = 0) -> str:
    return fx(f"({expr}) * 100", places) + " || '%'"


# --- attribution: a linear score whose weight is corr(feature, label), growing towards the last row ---
def _weights(t):
    panel = demo_panel(t)
    long = unpivot(panel, _OWN, ["asset", "date", "label"])
    one = long.groupBy("feature").agg(pair_corr("value", F.col("label").cast("double")).alias("c"), F.avg("value").alias("m"))
    packed = one.agg(F.map_from_entries(F.collect_list(F.struct("feature", "c"))).alias("c"),
                     F.map_from_entries(F.collect_list(F.struct("feature", "m"))).alias("m"))
    names = F.array(*[F.lit(f) for f in _OWN])
    base = F.transform(names, lambda f: F.element_at("c", f))
    coef = F.transform(F.sequence(F.lit(1), F.lit(L)), lambda k: F.transform(base, lambda c: c * k / float(L)))
    return packed.select(coef.alias("coef"), F.transform(names, lambda f: F.element_at("m", f)).alias("mean"))


def _attribution(t, kind="linear"):
    weights = staged(_weights(t), "weights")
    coef, mean = weights.select("coef").scalar(), weights.select("mean").scalar()
    tensor = W.window_tensor(demo_marked(t), _OWN)
    return E.linear(tensor, coef, mean) if kind == "linear" else E.gradient_input(tensor, coef)


def _wide(t, kind="linear"):
    return staged(E.per_feature(_attribution(t, kind), _OWN), "attribution")


cte("c_coef", "SELECT " + ", ".join(
    f"covar_pop({f}, CAST(label AS DOUBLE)) FILTER (WHERE {f} IS NOT NULL AND label IS NOT NULL) / (stddev_pop({f}) FILTER (WHERE {f} IS NOT NULL AND label IS NOT NULL)"
    f" * stddev_pop(label) FILTER (WHERE {f} IS NOT NULL AND label IS NOT NULL)) AS c_{f}, avg({f}) AS m_{f}" for f in _OWN) + " FROM c_panel")
cte("c_attr", "SELECT asset, window_end, " + ", ".join(f"sum(c_{f} * (t + 1) / 30.0::DOUBLE * ({f} - m_{f})) AS {f}" for f in _OWN)
    + " FROM c_tensor CROSS JOIN c_coef GROUP BY 1, 2")
cte("c_grad", "SELECT asset, window_end, " + ", ".join(f"sum(c_{f} * (t + 1) / 30.0::DOUBLE * {f}) AS {f}" for f in _OWN)
    + " FROM c_tensor CROSS JOIN c_coef GROUP BY 1, 2")
for _key, _kind, _src in (("at_linear", "linear", "c_attr"), ("at_grad_input", "gradient", "c_grad")):
    query(_key, "SELECT asset, DAY(window_end) AS window_end, " + ", ".join(f"R6({f}) AS {f}" for f in _OWN) + f" FROM {_src}")(
        lambda t, kind=_kind: E.per_feature(_attribution(t, kind), _OWN).drop("label"))
_un = lambda agg: " UNION ALL ".join(f"SELECT '{f}' AS feature, {agg.format(f)} AS v FROM c_attr" for f in _OWN)


# The same with the query's rule for what cannot be divided: a weight is NULL where a side of the correlation is constant.
cte("c_coef0", "SELECT " + ", ".join(
    f"covar_pop({f}, CAST(label AS DOUBLE)) FILTER (WHERE {f} IS NOT NULL AND label IS NOT NULL) / nullif(stddev_pop({f}) FILTER (WHERE {f} IS NOT NULL AND label IS NOT NULL)"
    f" * stddev_pop(label) FILTER (WHERE {f} IS NOT NULL AND label IS NOT NULL), 0) AS c_{f}, avg({f}) AS m_{f}" for f in _OWN) + " FROM c_panel")
cte("c_attr0", "SELECT asset, window_end, " + ", ".join(f"sum(c_{f} * (t + 1) / 30.0::DOUBLE * ({f} - m_{f})) AS {f}" for f in _OWN)
    + " FROM c_tensor CROSS JOIN c_coef0 GROUP BY 1, 2")


@query("at_ranked", f"""
SELECT 'mean' AS scope, feature, R6(v) AS contribution, R6(abs(v)) AS abs_contribution, R6(coalesce(abs(v) / nullif(sum(abs(v)) OVER (), 0), 0)) AS share_of_total,
 INT8(row_number() OVER (ORDER BY abs(v) DESC NULLS LAST, feature)) AS rank FROM ({_un('avg({0})').replace('c_attr', 'c_attr0')})""")
def _(t):
    return E.ranked_mean(E.per_feature(_attribution(t), _OWN), _OWN)


@query("at_mean_abs", f"SELECT feature, R6(v) AS mean_abs FROM ({_un('avg(abs({0}))')})")
def _(t):
    return E.mean_absolute(E.per_feature(_attribution(t), _OWN), _OWN)


@query("at_timestep", "SELECT INT8(t) AS t, R6(avg((" + " + ".join(f"abs(c_{f} * (t + 1) / 30.0::DOUBLE * ({f} - m_{f}))" for f in _OWN)
       + f") / {len(_OWN)})) AS mean_abs, 't-' || (29 - t) AS position FROM c_tensor CROSS JOIN c_coef GROUP BY t")
def _(t):
    return E.timestep_profile(_attribution(t))


cte("c_prof", "SELECT episode, n, feature, v FROM (SELECT episode, count(*) AS n, " + ", ".join(f"avg(abs({f})) AS {f}" for f in _OWN)
    + " FROM c_attr JOIN c_episodes ON window_end BETWEEN s - 45 AND e GROUP BY 1 HAVING count(*) >= 5) UNPIVOT (v FOR feature IN (" + ", ".join(_OWN) + "))")


# Profiles by the query's rule: a feature without a contribution counts 0, a total of 0 gives shares of 0.
cte("c_prof0", "SELECT episode, n, feature, v FROM (SELECT episode, count(*) AS n, " + ", ".join(f"coalesce(avg(abs({f})), 0) AS {f}" for f in _OWN)
    + " FROM c_attr0 JOIN c_episodes ON window_end BETWEEN s - 45 AND e GROUP BY 1 HAVING count(*) >= 5) UNPIVOT (v FOR feature IN (" + ", ".join(_OWN) + "))")


def _profiles(t):
    return staged(E.episode_profiles(E.per_feature(_attribution(t), _OWN), _OWN, t.episodes), "profiles")


@query("at_episode_profiles", "SELECT episode, INT8(n) AS n_windows, feature, R6(v) AS value FROM c_prof0")
def _(t):
    return _profiles(t)


cte("c_ranks", "SELECT *, rank() OVER (PARTITION BY episode ORDER BY v) + (count(*) OVER (PARTITION BY episode, v) - 1) / 2.0 AS r, "
    "row_number() OVER (PARTITION BY episode ORDER BY v DESC, feature) AS top, v / sum(v) OVER (PARTITION BY episode) AS share FROM c_prof")
cte("c_spear", "SELECT x.episode AS a, y.episode AS b, corr(x.r, y.r) AS rho, "
    "count(*) FILTER (WHERE x.top <= 5 AND y.top <= 5) / (10.0 - count(*) FILTER (WHERE x.top <= 5 AND y.top <= 5)) AS jac "
    "FROM c_ranks x JOIN c_ranks y ON x.feature = y.feature AND x.episode < y.episode GROUP BY 1, 2")


cte("c_ranks0", "SELECT *, rank() OVER (PARTITION BY episode ORDER BY v) + (count(*) OVER (PARTITION BY episode, v) - 1) / 2.0 AS r, "
    "row_number() OVER (PARTITION BY episode ORDER BY v DESC, feature) AS top, v / coalesce(nullif(sum(v) OVER (PARTITION BY episode), 0), 1) AS share FROM c_prof0")
# Rank correlations by the query's rule: values tie within a step, and a side without a ranking has correlation 0.
cte("c_steps0", f"SELECT episode, feature, floor(coalesce(v / nullif(max(v) OVER (PARTITION BY episode), 0), 0) * {E.RANK_STEPS}::DOUBLE + 0.5) AS step FROM c_prof0")
cte("c_stepranks0", "SELECT episode, feature, rank() OVER (PARTITION BY episode ORDER BY step) + (count(*) OVER (PARTITION BY episode, step) - 1) / 2.0 AS r FROM c_steps0")
cte("c_spear0", "SELECT x.episode AS a, y.episode AS b, CASE WHEN min(x.r) < max(x.r) AND min(y.r) < max(y.r) THEN covar_pop(x.r, y.r) / (stddev_pop(x.r) * stddev_pop(y.r)) ELSE 0 END AS rho "
    "FROM c_stepranks0 x JOIN c_stepranks0 y ON x.feature = y.feature AND x.episode < y.episode GROUP BY 1, 2")


@query("at_spearman", "SELECT a, b, R6(rho) AS spearman FROM c_spear0")
def _(t):
    return E.spearman(_profiles(t))


@query("at_topk_jaccard", "SELECT a, b, R6(jac) AS jaccard FROM c_spear")
def _(t):
    return E.topk_jaccard(_profiles(t))


@query("at_stability", """
SELECT R6(s) AS stability_index, INT8(n) AS n_pairs, CASE WHEN s IS NULL THEN 'UNDETERMINED' WHEN s >= 0.7 THEN 'HIGH' WHEN s >= 0.4 THEN 'MODERATE'
 WHEN s >= 0 THEN 'LOW' ELSE 'NEGATIVE' END AS reading FROM (SELECT floor(avg(rho) * 1e12 + 0.5) / 1e12 AS s, count(*) AS n FROM c_spear0)""")
def _(t):
    profiles = _profiles(t)
    E.assert_comparable(profiles)
    return E.stability(E.spearman(profiles))


@query("at_top_features", """
SELECT episode, INT8(top) AS rank, feature, R6(v) AS mean_abs_attribution, R6(share) AS share_of_total FROM c_ranks0 WHERE top <= 5""")
def _(t):
    return E.top_features(_profiles(t))


# --- analogues -----------------------------------------------------------------------------
cte("c_query", "SELECT asset, max(date) AS as_of, max_by(vec, date) AS query FROM c_vectors GROUP BY asset")
cte("c_dims", "SELECT v.asset, v.date, q.as_of, unnest(v.vec) AS x, unnest(q.query) AS y, generate_subscripts(v.vec, 1) AS i FROM c_vectors v JOIN c_query q USING (asset)")
_zz = "CASE WHEN s > 1e-12 THEN s ELSE 1 END"
cte("c_cos", f"""
SELECT asset, as_of, date, sum(zx * zy) / (sqrt(sum(zx * zx)) * sqrt(sum(zy * zy))) AS similarity FROM (
 SELECT d.asset, d.as_of, d.date, (x - m) / {_zz} AS zx, (y - m) / {_zz} AS zy FROM c_dims d
 JOIN (SELECT asset, i, avg(x) AS m, stddev_pop(x) AS s FROM c_dims GROUP BY 1, 2) USING (asset, i))
WHERE as_of - date >= 90 GROUP BY 1, 2, 3""")
cte("c_near", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY similarity DESC, date) AS k FROM c_cos) WHERE k <= 3")


@query("an_cosine", "SELECT asset, DAY(as_of) AS as_of, DAY(date) AS date, R6(similarity) AS similarity, INT8(k) AS rank FROM c_near")
def _(t):
    return A.nearest_cosine(t.vectors, A.latest_queries(t.vectors))


@query("an_mahalanobis")
def _(t):
    """Whole windows of all 21 features, the latest one of each asset as its query."""
    panel = staged(demo_panel(t, cross_asset=True), "panel")
    return PR.nearest_mahalanobis(panel, S.FEATURES, panel.groupBy("asset").agg(F.max("date").alias("as_of")))


# matches at monitoring dates, by whole windows of the asset's own features
cte("c_complete", "SELECT * FROM (SELECT *, row_number() OVER w AS rn2, sum(CASE WHEN " + " AND ".join(f"{f} IS NOT NULL" for f in _OWN)
    + " THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS ok FROM c_own WINDOW w AS (PARTITION BY asset ORDER BY date)) WHERE ok = 30")
cte("c_ap", """
SELECT a.asset, c.as_of, (SELECT max(date) FROM c_trim b WHERE b.asset = a.asset AND b.date <= c.as_of) AS date
FROM c_assets a CROSS JOIN c_cycles c WHERE a.role = 'target'""")
cte("c_wcells", "SELECT e.asset, e.date, r.rn - e.rn2 + 29 AS t, " + ", ".join(f"r.{f}" for f in _OWN)
    + " FROM c_complete e JOIN (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) AS rn FROM c_own) r ON r.asset = e.asset AND r.rn BETWEEN e.rn2 - 29 AND e.rn2")
cte("c_wask", "SELECT p.asset, p.as_of, max(e.date) AS qdate FROM c_ap p JOIN c_complete e ON e.asset = p.asset AND e.date <= p.as_of GROUP BY 1, 2")
_mom = ", ".join(f"avg(h.{f}) AS m_{f}, CASE WHEN stddev_pop(h.{f}) > 1e-12 THEN stddev_pop(h.{f}) ELSE 1 END AS s_{f}" for f in _OWN)
cte("c_wscale", f"SELECT a.asset, a.as_of, h.t, {_mom} FROM c_wask a JOIN c_wcells h ON h.asset = a.asset AND h.date <= a.as_of GROUP BY 1, 2, 3")
_zx = {f: f"((h.{f} - m_{f}) / s_{f})" for f in _OWN}
_zq = {f: f"((q.{f} - m_{f}) / s_{f})" for f in _OWN}
cte("c_match", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset, as_of ORDER BY similarity DESC, date) AS k FROM (
 SELECT a.asset, a.as_of, a.qdate, h.date, sum({' + '.join(f'{_zx[f]} * {_zq[f]}' for f in _OWN)}) / (sqrt(sum({' + '.join(f'{_zx[f]} * {_zx[f]}' for f in _OWN)}))
  * sqrt(sum({' + '.join(f'{_zq[f]} * {_zq[f]}' for f in _OWN)}))) AS similarity
 FROM c_wask a JOIN c_wcells q ON q.asset = a.asset AND q.date = a.qdate JOIN c_wscale s ON s.asset = a.asset AND s.as_of = a.as_of AND s.t = q.t
 JOIN c_wcells h ON h.asset = a.asset AND h.t = q.t AND a.as_of - h.date >= 90 GROUP BY 1, 2, 3, 4)) WHERE k <= 3""")
cte("c_after", """
SELECT m.asset, m.as_of, m.date, m.k, m.similarity, count(b.close) >= 2 AS available, count(b.close) AS n,
 min_by(b.close, b.date) AS s, min(b.close) AS lo, max_by(b.close, b.date) AS e
FROM c_match m LEFT JOIN c_trim b ON b.asset = m.asset AND b.date BETWEEN m.date AND m.date + 30 GROUP BY 1, 2, 3, 4, 5""")


def demo_matches(t):
    panel = staged(demo_panel(t), "panel")
    return PR.nearest_cosine(panel, _OWN, decision_points(t.cycles, t.assets))


@query("an_outcome", """
SELECT asset, DAY(as_of) AS as_of, DAY(date) AS date, INT8(k) AS rank, R6(similarity) AS similarity, available,
 CASE WHEN available THEN R6((s - lo) / s) END AS max_drawdown, CASE WHEN available THEN R6((e - s) / s) END AS "return",
 CASE WHEN available THEN INT8(n) END AS days_observed FROM c_after""")
def _(t):
    return A.outcomes(demo_matches(t), t.bars)


@query("an_summary", f"""
SELECT asset, DAY(as_of) AS as_of, string_agg(strftime(date, '%Y-%m-%d') || ' (' || asset || ', similarity ' || {fx('similarity', 2)} || ')'
 || CASE WHEN available THEN ' was followed by a ' || {pc('(s - lo) / s', 1)} || ' drawdown' ELSE '; outcome unavailable' END, '; ' ORDER BY k) AS summary
FROM c_after GROUP BY asset, as_of""")
def _(t):
    return A.summary(A.outcomes(demo_matches(t), t.bars))


# --- risk --------------------------------------------------------------------------------------
cte("c_siglong", "SELECT * FROM c_long WHERE value IS NOT NULL AND feature IN (" + ", ".join(f"'{f}'" for f in SIGNALS) + ")")
cte("c_pct", """
SELECT c.asset, c.date, c.feature, c.value, count(*) AS n, count(*) FILTER (WHERE h.value <= c.value) / CAST(count(*) AS DOUBLE) AS pct,
 count(*) FILTER (WHERE h.value < c.value) AS lt
FROM c_siglong c JOIN c_siglong h ON h.asset = c.asset AND h.feature = c.feature AND h.date <= c.date GROUP BY 1, 2, 3, 4""")


def _panel(t):
    return own_features(t.bars, t.supply, t.fg_index, t.assets)


def _pct(t):
    panel = staged(_panel(t), "panel")
    return panel, R.percentiles(panel, SIGNALS)


@query("rk_percentile", "SELECT asset, DAY(date) AS date, feature, R6(value) AS value, R6(pct) AS percentile, INT8(n) AS n_history FROM c_pct")
def _(t):
    return _pct(t)[1].select("asset", "date", "feature", "value", "percentile", F.col("rank_n").alias("n_history"))


_band = lambda s: (f"CASE WHEN {s} IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN {s} >= 80 THEN 'CRITICAL' WHEN {s} >= 65 THEN 'HIGH' "  # noqa: E731
                   f"WHEN {s} >= 40 THEN 'MODERATE' ELSE 'LOW' END")


def _component_cte(name: str, signals, confidence: str, status: str, words) -> None:
    flips = ", ".join(f"'{f}'" for f, d, _ in signals if d < 0)
    label = "CASE feature " + " ".join(f"WHEN '{f}' THEN '{w}'" for f, _, w in signals) + " END"
    proxy = (" || CASE WHEN feature IN (" + ", ".join(f"'{p}'" for p in S.PROXY_FEATURES) + ") THEN ' (proxy)' ELSE '' END") if name == "flow" else ""
    tail = f" || {fx('value', 4)} || ', ' || {pc('risk')} || ' of its trailing history'"
    cte(f"c_rk_{name}", f"""
SELECT '{name}' AS component, asset, date, score, CASE WHEN n > 0 THEN {confidence} ELSE 0 END AS confidence,
 CASE WHEN n > 0 THEN {status} ELSE 'UNAVAILABLE' END AS status, {_band('score')} AS risk, n AS n_used, raised, evidence FROM (
 SELECT o.asset, o.date, 100 * avg(risk) AS score, stddev_pop(risk) AS sd, count(risk) AS n, count(risk) / {float(len(signals))}::DOUBLE AS cov,
  string_agg(feature || '=' || risk, '|' ORDER BY feature) FILTER (WHERE risk >= 0.8) AS raised,
  string_agg({label} || CASE WHEN risk >= 0.8 THEN '' {proxy} || ' is ' || CASE WHEN risk >= 0.95 THEN '{words[0]}' ELSE '{words[1]}' END || ': '{tail}
    WHEN risk <= 0.2 THEN ' is {words[2]}: '{tail} END, '; ' ORDER BY feature) FILTER (WHERE risk >= 0.8 OR risk <= 0.2) AS evidence
 FROM c_own o LEFT JOIN (SELECT *, CASE WHEN feature IN ({flips}) THEN 1 - pct ELSE pct END AS risk FROM c_pct
   WHERE feature IN ({', '.join(f"'{f}'" for f, _, _ in signals)})) p ON p.asset = o.asset AND p.date = o.date GROUP BY 1, 2)""")


_agree = "CASE WHEN n < 2 THEN 0.5 ELSE greatest(least(1 - 2 * sd, 1), 0) END"
_component_cte("market", S.MARKET_SIGNALS, f"cov * {_agree}", "CASE WHEN cov >= 0.8 THEN 'OK' ELSE 'DEGRADED' END", ("extreme", "elevated", "calm"))
_component_cte("flow", S.FLOW_SIGNALS, "cov * 0.75", "'DEGRADED'", ("sharply elevated", "elevated", "benign"))
_component_cte("sentiment", S.SENTIMENT_SIGNALS, "least(0.55, cov)", "'DEGRADED'", ("stressed", "stressed", "constructive"))
for _name, _fn in (("market", R.market), ("flow", R.flow), ("sentiment", R.sentiment)):
    def _run(t, fn=_fn):
        panel, pct = _pct(t)
        details = F.array_join(F.transform("evidence", lambda e: e["detail"]), "; ")
        return (fn(panel.select("asset", "date"), pct)
                .withColumn("evidence", F.when(F.size("evidence") > 0, details)))
    query(f"rk_{_name}", f"""
SELECT component, asset, DAY(date) AS date, R6(score) AS score, R6(confidence) AS confidence, status, risk, INT8(n_used) AS n_used, evidence
FROM c_rk_{_name}""")(_run)

# Out-of-fold scores of two fitted models: the volatility rule and a linear discriminant on the window's last row.
cte("c_win", "SELECT * FROM (SELECT *, min(date) OVER w AS ws, date + 14 AS label_end, sum(CASE WHEN " + " AND ".join(f"{f} IS NOT NULL" for f in _OWN)
    + " THEN 1 ELSE 0 END) OVER w AS ok FROM c_panel WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) WHERE ok = 30")
cte("c_learn", "SELECT f.fold, w.* FROM c_win w JOIN c_folds f ON w.ws <= f.train_end AND w.label_end < f.test_start - 45 WHERE w.label IS NOT NULL")
cte("c_serve", "SELECT f.fold, f.test_start AS valid_from, w.* FROM c_win w JOIN (SELECT *, lead(test_start) OVER (ORDER BY test_start) AS until FROM c_folds) f "
    "ON w.date >= f.test_start AND (f.until IS NULL OR w.date < f.until)")
cte("c_fits", "SELECT fold, max(label_end) AS trained_until, " + ", ".join(
    f"avg({f}) FILTER (WHERE label = 1) AS m1_{f}, avg({f}) FILTER (WHERE label = 0) AS m0_{f}, (count(*) FILTER (WHERE label = 1) * var_pop({f}) FILTER (WHERE label = 1) "
    f"+ count(*) FILTER (WHERE label = 0) * var_pop({f}) FILTER (WHERE label = 0)) / count(*) AS v_{f}" for f in _OWN) + " FROM c_learn GROUP BY fold")
_logit = " + ".join(f"CASE WHEN v_{f} > 1e-12 THEN (m1_{f} - m0_{f}) / v_{f} * ({f} - (m1_{f} + m0_{f}) / 2) WHEN v_{f} IS NOT NULL THEN 0 END" for f in _OWN)
cte("c_oof", f"""
SELECT 'discriminant' AS model, fold, trained_until, valid_from, asset, date, 1 / (1 + exp(-greatest(least(l, {SC.MOST}::DOUBLE), -{SC.MOST}::DOUBLE))) AS probability
FROM (SELECT s.fold, trained_until, valid_from, asset, date, {_logit} AS l FROM c_serve s JOIN c_fits USING (fold)) WHERE l IS NOT NULL
UNION ALL SELECT 'rule', s.fold, max(t.label_end), s.valid_from, s.asset, s.date, count(*) FILTER (WHERE t.realized_vol_7 <= s.realized_vol_7) / CAST(count(*) AS DOUBLE)
FROM c_serve s JOIN c_learn t ON t.fold = s.fold GROUP BY ALL""")
cte("c_mp", "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY asset, date, model ORDER BY valid_from DESC, trained_until DESC) AS k FROM c_oof "
    "WHERE valid_from <= date AND trained_until < date) WHERE k = 1")


def demo_scores(panel):
    """Both models' out-of-fold scores from one labelled panel."""
    windows = staged(SC.complete_windows(panel, _OWN), "complete")
    return SC.rule(windows, I.FOLDS).unionByName(SC.discriminant(windows, I.FOLDS, _OWN))


cte("c_rk_models", f"""
SELECT 'models' AS component, asset, date, score, CASE WHEN n > 0 THEN greatest(least(1 - spread, 1), 0) ELSE 0 END AS confidence,
 CASE WHEN n = 0 THEN 'UNAVAILABLE' WHEN spread >= 0.2 THEN 'DEGRADED' ELSE 'OK' END AS status, {_band('score')} AS risk, n AS n_used, spread, raised, lowest, highest FROM (
 SELECT o.asset, o.date, 100 * avg(probability) AS score, count(probability) AS n, max(probability) - min(probability) AS spread,
  string_agg('model:' || model || '=' || probability, '|' ORDER BY model) AS raised,
  min_by(model, {{'p': probability, 'm': model}}) AS lowest, max_by(model, {{'p': probability, 'm': model}}) AS highest
 FROM c_own o LEFT JOIN c_mp m ON m.asset = o.asset AND m.date = o.date GROUP BY 1, 2)""")


@query("rk_models", """
SELECT component, asset, DAY(date) AS date, R6(score) AS score, R6(confidence) AS confidence, status, risk, INT8(n_used) AS n_used, R6(spread) AS spread,
 lowest, highest FROM c_rk_models""")
def _(t):
    panel = staged(demo_panel(t), "panel")
    keys = panel.select("asset", "date")
    return R.models(keys, SC.as_of(demo_scores(panel), keys)).drop("evidence")


@query("rk_severity", """
SELECT asset, INT8(count(d)) AS n_declines, R6(CASE WHEN count(*) >= 60 THEN quantile_cont(d, 0.5) END) AS decline_low,
 R6(CASE WHEN count(*) >= 60 THEN quantile_cont(d, 0.9) END) AS decline_high FROM (
 SELECT asset, CASE WHEN c < 0 THEN -c END AS d FROM (SELECT asset, close / lag(close, 14) OVER (PARTITION BY asset ORDER BY date) - 1 AS c FROM c_trim)) GROUP BY asset""")
def _(t):
    return R.severity(trim_inception(t.bars, t.assets))


# decisions at the monitoring dates
cte("c_rep", "SELECT component, asset, date, score, confidence, status, risk, raised, NULL AS spread FROM c_rk_market UNION ALL SELECT component, asset, date, score, confidence, status, risk, raised, NULL FROM c_rk_flow "
    "UNION ALL SELECT component, asset, date, score, confidence, status, risk, raised, NULL FROM c_rk_sentiment UNION ALL SELECT component, asset, date, score, confidence, status, risk, raised, spread FROM c_rk_models")
cte("c_atrep", "SELECT p.as_of, r.* FROM c_ap p JOIN c_rep r ON r.asset = p.asset AND r.date = p.date")
cte("c_prelim", f"""
SELECT *, CASE WHEN n >= 2 THEN (0.5 + 0.5 * consensus) * conf ELSE 0 END AS confidence, {_band('score')} AS risk FROM (
 SELECT *, greatest(least(1 - dispersion / 50, 1), 0) AS consensus FROM (
  SELECT asset, as_of, date, CASE WHEN count(*) >= 2 THEN max(m) END AS score, CASE WHEN count(*) >= 2 THEN max(score) - min(score) END AS spread,
   CASE WHEN count(*) >= 2 THEN sqrt(sum(w * (score - m) * (score - m)) / sum(w)) END AS dispersion, sum(w * confidence) / sum(w) AS conf, count(*) AS n,
   CASE WHEN count(*) < 2 THEN 'UNAVAILABLE' WHEN count(*) >= 3 THEN 'OK' ELSE 'DEGRADED' END AS status FROM (
   SELECT *, sum(w * score) OVER g / sum(w) OVER g AS m FROM (
    SELECT *, CASE component WHEN 'models' THEN 0.4 WHEN 'sentiment' THEN 0.1 ELSE 0.25 END * greatest(confidence, 0.05) AS w
    FROM c_atrep WHERE status <> 'UNAVAILABLE' AND score IS NOT NULL) WINDOW g AS (PARTITION BY asset, as_of)) GROUP BY 1, 2, 3))""")


def demo_chain(t, analogues=True, more_scores=None):
    """The chain at the monitoring dates. ``more_scores`` gives further score tables from the labelled panel."""
    panel = staged(demo_panel(t), "panel")
    points = staged(latest_dates(panel, decision_points(t.cycles, t.assets)), "points")
    pct = staged(R.percentiles_at(panel, SIGNALS, points), "percentiles")
    best = told = None
    if analogues:
        near = staged(PR.nearest_cosine(panel, _OWN, points), "precedents")
        best = staged(near.groupBy("asset", "as_of").agg(F.max("similarity").alias("best_similarity")).join(points, ["asset", "as_of"]), "best")
        told = staged(A.summary(A.outcomes(near.filter("rank = 1"), t.bars)).join(points, ["asset", "as_of"]).groupBy("asset", "date").agg(F.max("summary").alias("summary")), "told")
    scores = demo_scores(panel) if more_scores is None else demo_scores(panel).unionByName(more_scores(panel))
    return Chain(panel, pct, SC.as_of(scores, points), points, best, told)


@query("rk_orchestrate", """
SELECT asset, DAY(as_of) AS as_of, DAY(date) AS date, R6(score) AS score, R6(confidence) AS confidence, status, risk, R6(spread) AS spread,
 R6(dispersion) AS dispersion, R6(consensus) AS consensus, INT8(n) AS n_usable FROM c_prelim""")
def _(t):
    chain = demo_chain(t, analogues=False)
    return chain.at_points(chain.preliminary()).drop("evidence", "n_components")


cte("c_ctx", """
SELECT o.asset, o.date, close, CASE WHEN count(*) OVER w = 120 THEN avg(close) OVER w END AS long_mean, exchange_netflow_7 AS netflow, stablecoin_netflow AS supply_change
FROM c_own o WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)""")
cte("c_blind", "SELECT asset, as_of, count(*) FILTER (WHERE status = 'UNAVAILABLE') AS blind, max(spread) AS ms FROM c_atrep GROUP BY 1, 2")
cte("c_best", "SELECT asset, as_of, max(similarity) AS best FROM c_match GROUP BY 1, 2")
cte("c_checks", """
SELECT p.asset, p.as_of, p.date, p.score, p.confidence, p.status, unnest([
 CASE WHEN p.score >= 60 AND c.close > c.long_mean * 1.1 THEN {'n': 'long_term_trend', 'w': 0.15::DOUBLE} END,
 CASE WHEN p.score >= 60 AND netflow > 0 AND supply_change > 0.01 THEN {'n': 'conflicting_flow', 'w': 0.12::DOUBLE} END,
 CASE WHEN ms >= 0.2 THEN {'n': 'model_disagreement', 'w': least(0.05 + ms * 0.5, 0.2)} END,
 CASE WHEN blind > 0 THEN {'n': 'data_quality', 'w': least(0.1 * blind, 0.25)::DOUBLE} END,
 CASE WHEN p.spread >= 40 THEN {'n': 'agent_divergence', 'w': least(p.spread / 400, 0.15)} END,
 CASE WHEN v.n >= 100 AND v.lt > floor(0.99::DOUBLE * (v.n - 1)) THEN {'n': 'regime_novelty', 'w': 0.12::DOUBLE} END,
 CASE WHEN best < 0.6 THEN {'n': 'weak_analogue', 'w': 0.1::DOUBLE} END,
 {'n': 'none', 'w': 0.0::DOUBLE}]) AS ch
FROM c_prelim p LEFT JOIN c_ctx c ON c.asset = p.asset AND c.date = p.date LEFT JOIN c_blind b ON b.asset = p.asset AND b.as_of = p.as_of
LEFT JOIN c_pct v ON v.asset = p.asset AND v.date = p.date AND v.feature = 'realized_vol_30' LEFT JOIN c_best s ON s.asset = p.asset AND s.as_of = p.as_of""")
cte("c_doubt", """
SELECT asset, as_of, date, score, confidence, status, least(sum(ch.w), 0.6) AS penalty, count(*) FILTER (WHERE ch.n <> 'none') AS challenges,
 coalesce(string_agg(ch.n, ',' ORDER BY ch.n) FILTER (WHERE ch.n <> 'none'), '') AS names
FROM c_checks WHERE ch IS NOT NULL GROUP BY ALL""")


@query("rk_skeptic", """
SELECT asset, DAY(as_of) AS as_of, DAY(date) AS date, R6(penalty) AS penalty, INT8(challenges) AS challenges, names FROM c_doubt""")
def _(t):
    chain = demo_chain(t)
    names = F.array_join(F.array_sort("evidence.name"), ",")
    return chain.at_points(chain.doubt()).withColumn("names", names).drop("evidence")


cte("c_decide", f"""
SELECT *, CASE WHEN fc >= 0.25 AND status <> 'UNAVAILABLE' THEN {_band('fs')} ELSE 'INSUFFICIENT_EVIDENCE' END AS risk FROM (
 SELECT *, greatest(least(confidence * (1 - penalty), 1), 0) AS fc, score * (1 - 0.5 * penalty) AS fs FROM c_doubt)""")


@query("rk_decide", """
SELECT asset, DAY(as_of) AS as_of, DAY(date) AS date, R6(score) AS raw_score, R6(fs) AS final_score, R6(fc) AS final_confidence, R6(penalty) AS penalty,
 INT8(challenges) AS challenges, risk, CASE WHEN risk = 'INSUFFICIENT_EVIDENCE' THEN 'ABSTAIN' WHEN risk IN ('HIGH', 'CRITICAL') THEN 'ALERT' ELSE 'NO_ALERT' END AS decision,
 CASE WHEN risk = 'INSUFFICIENT_EVIDENCE' THEN CASE WHEN status = 'UNAVAILABLE' THEN 'no usable evidence' ELSE 'confidence below floor' END END AS reason FROM c_decide""")
def _(t):
    chain = demo_chain(t)
    return chain.at_points(chain.decisions())


cte("c_items", """
SELECT asset, as_of, date, split_part(x, '=', 1) AS driver, CAST(split_part(x, '=', 2) AS DOUBLE) AS w
FROM (SELECT asset, as_of, date, unnest(string_split(raised, '|')) AS x FROM c_atrep WHERE raised IS NOT NULL)""")
cte("c_drivers", """
SELECT *, c / sum(c) OVER (PARTITION BY asset, as_of) AS share, row_number() OVER (PARTITION BY asset, as_of ORDER BY c DESC, driver) AS k FROM (
 SELECT asset, as_of, date, driver, sum(w) AS c FROM c_items GROUP BY 1, 2, 3, 4)""")


@query("rk_drivers", """
SELECT asset, DAY(as_of) AS as_of, DAY(date) AS date, driver, R6(c) AS contribution, R6(share) AS share, INT8(k) AS rank FROM c_drivers""")
def _(t):
    chain = demo_chain(t, analogues=False)
    return chain.at_points(chain.drivers())


cte("c_listed", f"SELECT asset, as_of, string_agg(driver || ' (' || {pc('share')} || ')', ', ' ORDER BY k) AS listed FROM c_drivers WHERE k <= 5 GROUP BY 1, 2")


# The sceptic's sentences, the two heaviest of a decision.
cte("c_said", f"""
SELECT asset, as_of, string_agg(d, '; ' ORDER BY k) AS said FROM (SELECT asset, as_of, d, row_number() OVER (PARTITION BY asset, as_of ORDER BY w DESC, n) AS k FROM (
 SELECT p.asset, p.as_of, unnest([
  CASE WHEN p.score >= 60 AND c.close > c.long_mean * 1.1 THEN {{'n': 'long_term_trend', 'w': 0.15::DOUBLE, 'd': 'price is ' || {pc('c.close / c.long_mean - 1', 1)} || ' above its long mean; the trend contradicts the warning'}} END,
  CASE WHEN p.score >= 60 AND netflow > 0 AND supply_change > 0.01 THEN {{'n': 'conflicting_flow', 'w': 0.12::DOUBLE, 'd': 'supply grows by ' || {pc('supply_change', 2)} || ' while the warning rests on selling'}} END,
  CASE WHEN ms >= 0.2 THEN {{'n': 'model_disagreement', 'w': least(0.05 + ms * 0.5, 0.2), 'd': 'the models disagree by ' || {pc('ms')}}} END,
  CASE WHEN blind > 0 THEN {{'n': 'data_quality', 'w': least(0.1 * blind, 0.25)::DOUBLE, 'd': {fx('blind', 0)} || ' component(s) saw no data'}} END,
  CASE WHEN p.spread >= 40 THEN {{'n': 'agent_divergence', 'w': least(p.spread / 400, 0.15), 'd': 'the components span ' || {fx('p.spread', 0)} || ' points'}} END,
  CASE WHEN v.n >= 100 AND v.lt > floor(0.99::DOUBLE * (v.n - 1)) THEN {{'n': 'regime_novelty', 'w': 0.12::DOUBLE, 'd': 'volatility ' || {fx('v.value', 3)} || ' exceeds the 99th percentile of its history'}} END,
  CASE WHEN best < 0.6 THEN {{'n': 'weak_analogue', 'w': 0.1::DOUBLE, 'd': 'the closest precedent has similarity ' || {fx('best', 2)}}} END], max_depth := 2)
 FROM c_prelim p LEFT JOIN c_ctx c ON c.asset = p.asset AND c.date = p.date LEFT JOIN c_blind b ON b.asset = p.asset AND b.as_of = p.as_of
 LEFT JOIN c_pct v ON v.asset = p.asset AND v.date = p.date AND v.feature = 'realized_vol_30' LEFT JOIN c_best s ON s.asset = p.asset AND s.as_of = p.as_of) WHERE n IS NOT NULL) WHERE k <= 2 GROUP BY 1, 2""")
cte("c_nearest", f"""
SELECT asset, as_of, strftime(date, '%Y-%m-%d') || ' (' || asset || ', similarity ' || {fx('similarity', 2)} || ')'
 || CASE WHEN available THEN ' was followed by a ' || {pc('(s - lo) / s', 1)} || ' drawdown' ELSE '; outcome unavailable' END AS told FROM c_after WHERE k = 1""")
cte("c_eachmodel", f"SELECT p.asset, p.as_of, string_agg(m.model || ' ' || {pc('m.probability')}, ', ' ORDER BY m.model) AS each_ FROM c_ap p JOIN c_mp m ON m.asset = p.asset AND m.date = p.date GROUP BY 1, 2")


@query("rk_narrative", f"""
SELECT d.asset, DAY(d.as_of) AS as_of, d.risk, CASE WHEN d.risk = 'INSUFFICIENT_EVIDENCE'
 THEN 'The system declines to state a risk level for ' || d.asset || ' as of ' || strftime(d.date, '%Y-%m-%d') || '. ' || CASE WHEN d.status = 'UNAVAILABLE' THEN 'no usable evidence' ELSE 'confidence below floor' END || '.'
 ELSE d.asset || ' is assessed at ' || d.risk || ' risk (' || {fx('fs', 0)} || '/100) as of ' || strftime(d.date, '%Y-%m-%d') || '.'
  || coalesce(' The primary drivers are ' || listed || '.', '')
  || coalesce(' The models estimate a ' || {pc('m.score / 100')} || ' probability of a severe decline (' || each_ || ').', '')
  || coalesce(' Counter-evidence: ' || said || '.', '') || coalesce(' Nearest historical analogue: ' || told || '.', '')
  || ' Confidence: ' || {pc('fc')} || '.' END AS text,
 CASE WHEN challenges = 0 THEN 'No material counter-evidence found; the assessment stands as issued.'
  WHEN penalty >= 0.4 THEN 'Reduce confidence substantially: ' || challenges || ' independent challenges totalling a ' || {pc('penalty')} || ' reduction.'
  WHEN penalty >= 0.2 THEN 'Reduce confidence: ' || challenges || ' challenge(s), ' || {pc('penalty')} || ' reduction.'
  ELSE 'Minor caveats only: ' || challenges || ' challenge(s), ' || {pc('penalty')} || ' reduction.' END AS recommendation
FROM c_decide d LEFT JOIN c_listed l ON l.asset = d.asset AND l.as_of = d.as_of
LEFT JOIN c_atrep m ON m.asset = d.asset AND m.as_of = d.as_of AND m.component = 'models'
LEFT JOIN c_eachmodel e ON e.asset = d.asset AND e.as_of = d.as_of LEFT JOIN c_said q ON q.asset = d.asset AND q.as_of = d.as_of
LEFT JOIN c_nearest w ON w.asset = d.asset AND w.as_of = d.as_of""")
def _(t):
    chain = demo_chain(t)
    return chain.at_points(chain.narratives()).select("asset", "as_of", "risk", "text", "recommendation")


@query("rk_pipeline")
def _(t):
    """The whole chain with a third model: a logistic regression per fold over whole windows of the asset's own features."""
    chain = demo_chain(t, more_scores=lambda panel: SC.fitted("logreg", MO.logreg(), panel, I.FOLDS, _OWN))
    told = chain.narratives().select("asset", "date", "text", "recommendation")
    return chain.at_points(chain.decisions().join(told, ["asset", "date"]))


# --- health over the chain ---------------------------------------------------------------------
cte("c_rel", "SELECT component, avg(CASE WHEN status IN ('OK', 'DEGRADED') THEN 1.0 ELSE 0.0 END) AS usable_share, count(*) AS n_reports FROM c_atrep GROUP BY 1")


@query("hl_reliability", "SELECT component, R6(usable_share) AS usable_share, INT8(n_reports) AS n_reports FROM c_rel")
def _(t):
    chain = demo_chain(t, analogues=False)
    return H.reliability(chain.at_points(chain.reports))


@query("hl_recommend", """
SELECT INT8(major) AS major, INT8(minor) AS minor, INT8(declining) AS declining, INT8(unreliable) AS unreliable, INT8(concerns) AS concerns,
 CASE WHEN concerns >= 4 THEN 'RETRAIN' WHEN concerns >= 2 THEN 'MONITOR' ELSE 'HEALTHY' END AS recommendation, R6(least(100.0, 12.5 * concerns)) AS score FROM (
 SELECT *, 2 * major + minor + declining + unreliable AS concerns FROM (SELECT (SELECT count(*) FROM c_drift WHERE severity = 'major') AS major,
  (SELECT count(*) FROM c_drift WHERE severity = 'minor') AS minor, (SELECT count(*) FROM c_trend WHERE declining) AS declining,
  (SELECT count(*) FROM c_rel WHERE usable_share < 0.8) AS unreliable))""")
def _(t):
    chain = demo_chain(t, analogues=False)
    return H.recommend(staged(demo_drift(t), "drift"), demo_trend(t), H.reliability(chain.at_points(chain.reports)))
