"""Registered queries: classifiers, walk-forward evaluation, monitoring and streams.

Logistic regression, forest and network run at their full sizes on all folds, the forest also under the tree contributions; the
walk-forward evaluation takes five models, its forests of 100 trees. Boosting runs on all folds with fewer rounds than the builder's default (20 at
step 0.3): at full size it takes over ten minutes on eight cores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import settings as S
from tidewatch.operators import explain as E
from tidewatch.operators import ledger as LG
from tidewatch.operators import models as MO
from tidewatch.operators import monitor as MN
from tidewatch.operators import networks as N
from tidewatch.operators import outcomes as OC
from tidewatch.operators import splits as SP
from tidewatch.operators import trees as TR
from tidewatch.operators import windows as W
from tidewatch.plans.catalog_ledger import CODE, demo_preds
from tidewatch.plans.catalog_panel import THRESHOLD, demo_panel
from tidewatch.plans.catalog_risk import demo_chain
from tidewatch.plans.registry import cte, query
from tidewatch.session import scratch_path, staged
from tidewatch.sources import inputs as I
from tidewatch.streaming import bars as SB
from tidewatch.streaming import resolve as SR

FEATURES = S.FEATURES
LAST = I.FOLDS[-1:]


def _rows(t, folds):
    """Scaled window vectors of the whole panel for the folds, written once."""
    panel = staged(demo_panel(t, cross_asset=True), "panel")
    marked = W.mark_windows(panel, FEATURES)
    return staged(MO.training_rows(W.window_tensor(marked, FEATURES), folds, FEATURES, marked), "rows")


def _fit_all(t, build, resample=False):
    """Every fold: fit on its training windows, score its test windows."""
    rows = _rows(t, I.FOLDS)

    def one(fold):
        mine = rows.filter(F.col("fold") == fold["fold"])
        model = MO.fit(build(), mine.filter("role = 'train'"), resample)
        return model.transform(mine.filter("role = 'test'")).select(
            "fold", "asset", "window_end", F.col("label").cast("long").alias("label"), MO.probability().alias("y_score"))

    return reduce(DataFrame.unionByName, MO.at_once(I.FOLDS, one))


@query("m_logreg")
def _(t):
    return _fit_all(t, MO.logreg)


@query("m_forest")
def _(t):
    return _fit_all(t, MO.forest)


@query("m_gbt")
def _(t):
    return _fit_all(t, lambda: MO.gbt(20, 4, 0.3))


@query("m_mlp")
def _(t):
    panel = staged(demo_panel(t, cross_asset=True), "panel")
    marked = W.mark_windows(panel, FEATURES)
    arrays = SP.scale_arrays(SP.fit_scaler(marked, I.FOLDS, FEATURES), FEATURES)
    return N.walk_forward(W.window_tensor(marked, FEATURES), arrays, I.FOLDS)


@query("m_walk_forward")
def _(t):
    panel = staged(demo_panel(t, cross_asset=True), "panel")
    marked = W.mark_windows(panel, FEATURES)
    tensor = staged(W.window_tensor(marked, FEATURES), "tensor")
    arrays = SP.scale_arrays(SP.fit_scaler(marked, I.FOLDS, FEATURES), FEATURES)
    signals = marked.filter("emit").select(*MO.KEY, F.col("realized_vol_7").alias("signal"))
    models = {"logreg": MO.logreg, "forest": lambda: MO.forest(100, 8), "gbt": lambda: MO.gbt(20, 4, 0.3)}
    scorers = {"rule": lambda parts: MO.rule_parts(parts, signals),
               "mlp": lambda parts: N.score_parts(tensor, arrays, parts, [f["fold"] for f in I.FOLDS])}
    rows = staged(MO.training_rows(tensor, I.FOLDS, FEATURES, marked), "rows")
    return MO.walk_forward(rows, models, I.FOLDS, scorers=scorers)


@query("m_deploy_score")
def _(t):
    """Fit on every window that resolves before the last test period, save, reload, score all windows."""
    panel = staged(demo_panel(t, cross_asset=True), "panel")
    marked = W.mark_windows(panel, FEATURES)
    tensor = staged(W.window_tensor(marked, FEATURES).withColumn("fold", F.lit(LAST[0]["fold"])), "tensor")
    arrays = SP.scale_arrays(SP.fit_scaler(marked, LAST, FEATURES), FEATURES)
    rows = staged(SP.scale_windows(tensor, arrays).withColumn("features", W.flat_vector())
                  .withColumn("label", F.col("label").cast("double")), "rows")
    model = MO.deploy(MO.logreg(), SP.deploy_mask(rows, LAST[0]["test_start"]), scratch_path(t.spark, "model"))
    return model.transform(rows).select("asset", "window_end", F.col("label").cast("long").alias("label"),
                                        MO.probability().alias("y_score"))


@query("at_linear_model")
def _(t):
    """The fitted logistic regression of every fold explained on its test windows: per feature, summed over the window."""
    rows = _rows(t, I.FOLDS)

    def one(fold):
        mine = rows.filter(F.col("fold") == fold["fold"])
        train = mine.filter("role = 'train'")
        model = MO.fit(MO.logreg(), train)
        means = train.agg(Summarizer.mean(F.col("features")).alias("m")).select(vector_to_array("m")).scalar()
        cells = E.linear_model(mine.filter("role = 'test'"), model, means, len(FEATURES))
        return E.per_feature(cells, FEATURES).join(cells.select("asset", "window_end", "base", "logit"), ["asset", "window_end"]).withColumn("fold", F.lit(fold["fold"]))

    return reduce(DataFrame.unionByName, MO.at_once(I.FOLDS, one))


@query("at_tree_occlusion")
def _(t):
    """Every fold's forest on its test windows: per feature, the loss without it and without each of its time steps."""
    panel = staged(demo_panel(t, cross_asset=True), "panel")
    marked = W.mark_windows(panel, FEATURES)
    tensor = staged(SP.walk_forward(W.window_tensor(marked, FEATURES), I.FOLDS).filter("role IN ('train', 'test')"), "tensor")
    means = {r.fold: r.means for r in SP.scale_arrays(SP.fit_scaler(marked, I.FOLDS, FEATURES), FEATURES).collect()}      # one row per fold

    def one(fold):
        mine = tensor.filter(F.col("fold") == fold["fold"])
        train = mine.filter("role = 'train'").withColumn("features", W.flat_vector()).withColumn("label", F.col("label").cast("double"))
        found = TR.cell_contributions(mine.filter("role = 'test'"), MO.fit(MO.forest(), train), means[fold["fold"]], FEATURES, S.LOOKBACK)
        return TR.by_feature(found, FEATURES, S.LOOKBACK).withColumn("fold", F.lit(fold["fold"]))

    return reduce(DataFrame.unionByName, MO.at_once(I.FOLDS, one))


# --- monitoring --------------------------------------------------------------------
_C = I.CYCLES
cte("c_cpreds", f"""
SELECT asset, as_of, risk AS severity_band, strftime(as_of, '%Y-%m-%d') AS as_of_date, '0x' || sha256(asset || '|' || strftime(as_of, '%Y-%m-%d') || '|chain|{CODE}') AS prediction_id FROM c_decide""")
cte("c_coutcomes", f"""
SELECT *, CASE WHEN NOT resolved THEN 'UNRESOLVED' WHEN warned AND crashed THEN 'TRUE_POSITIVE' WHEN warned THEN 'FALSE_POSITIVE'
 WHEN crashed THEN 'FALSE_NEGATIVE' ELSE 'TRUE_NEGATIVE' END AS classification FROM (
 SELECT *, severity_band IN ('HIGH', 'CRITICAL') AS warned, coalesce(dd >= {THRESHOLD}, false) AS crashed FROM (
  SELECT p.prediction_id, p.asset, p.as_of, p.as_of_date, p.severity_band, count(b.close) >= 2 AS resolved,
   CASE WHEN count(b.close) >= 2 THEN (min_by(b.close, b.date) - min(b.close)) / min_by(b.close, b.date) END AS dd
  FROM c_cpreds p LEFT JOIN c_bars b ON b.asset = p.asset AND b.date BETWEEN p.as_of AND p.as_of + 14 GROUP BY ALL))""")
cte("c_back", """
SELECT *, CASE WHEN resolved THEN (SELECT min(c.as_of) FROM c_cycles c WHERE c.as_of >= o.as_of + 14) END AS resolved_at FROM c_coutcomes o""")


def chain_predictions(t):
    """The decision chain's predictions at every target asset and monitoring date."""
    chain = demo_chain(t)
    made = chain.at_points(chain.decisions()).withColumn("as_of_date", F.date_format("as_of", "yyyy-MM-dd"))
    return made.select(LG.prediction_id("asset", "as_of_date", F.lit("chain"), F.lit(CODE)).alias("prediction_id"), "asset", "as_of_date", F.lit(S.HORIZON_DAYS).alias("horizon_days"),
                       (F.col("final_score") / 100.0).alias("probability"), F.col("risk").alias("severity_band"))


def demo_backfill(t):
    preds = staged(chain_predictions(t), "predictions")
    return MN.backfill(preds, OC.resolve(preds, t.bars, THRESHOLD), _C["start"], _C["end"], _C["every_days"])


@query("mon_backfill", """
SELECT prediction_id, asset, as_of_date, severity_band, DAY(as_of + 14) AS matures, DAY(resolved_at) AS resolved_at,
 CASE WHEN resolved_at IS NULL THEN 'PENDING' ELSE classification END AS classification,
 CASE WHEN resolved_at IS NOT NULL THEN R6(dd) END AS actual_max_drawdown FROM c_back""")
def _(t):
    return demo_backfill(t)


@query("mon_cycle_summary", """
SELECT DAY(coalesce(i.c, r.c)) AS cycle, INT8(coalesce(predictions, 0)) AS predictions, INT8(coalesce(alerts, 0)) AS alerts,
 coalesce(alert_assets, '') AS alert_assets, INT8(coalesce(n, 0)) AS resolved FROM (
 SELECT as_of AS c, count(*) AS predictions, count(*) FILTER (WHERE severity_band IN ('HIGH', 'CRITICAL')) AS alerts,
  string_agg(asset, ',' ORDER BY asset) FILTER (WHERE severity_band IN ('HIGH', 'CRITICAL')) AS alert_assets FROM c_back GROUP BY 1) i
FULL JOIN (SELECT resolved_at AS c, count(*) AS n FROM c_back WHERE resolved_at IS NOT NULL GROUP BY 1) r ON i.c = r.c""")
def _(t):
    return MN.cycle_summary(demo_backfill(t))


# --- streams -----------------------------------------------------------------------
@query("mon_stream_bars", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, event_type, R6(min_by(value, {'t': ts, 'i': event_id})) AS open, R6(max(value)) AS high,
 R6(min(value)) AS low, R6(max_by(value, {'t': ts, 'i': event_id})) AS close, R6(sum(value)) AS volume, INT8(count(*)) AS trades
FROM events GROUP BY date_trunc('day', ts), event_type
HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def _(t):
    return SB.drain(SB.daily_bars(SB.read_events(t.spark, t.sf_dir, "events.parquet")), "bars")


def streamed_outcomes(t):
    preds = staged(demo_preds(t).select("prediction_id", "asset", F.to_timestamp("as_of_date").alias("pred_ts"), "severity_band"), "preds")
    prices = staged(t.bars.select("asset", F.col("date").cast("timestamp").alias("ts"), "close"), "prices")
    def stream(df):
        return t.spark.readStream.schema(df.schema).parquet(df.inputFiles()[0].rsplit("/", 1)[0])
    return SR.resolve_stream(SR.outcome_stream(stream(preds), stream(prices), S.HORIZON_DAYS, THRESHOLD))


@query("mon_stream_resolve", """
SELECT prediction_id, asset, strftime(as_of, '%Y-%m-%d %H:%M:%S') AS pred_day, R6(dd) AS actual_max_drawdown, classification
FROM c_outcomes WHERE resolved AND as_of + 16 <= (SELECT max(as_of) FROM c_preds)""")
def _(t):
    """Predictions whose horizon the watermark has not passed wait for later data."""
    return streamed_outcomes(t)
