"""Registered queries: payload decoding, files, ledger, outcomes and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import settings as S
from tidewatch.functions.canon import canonical_json, digest
from tidewatch.operators import health as H
from tidewatch.operators import ledger as LG
from tidewatch.operators import metrics as M
from tidewatch.operators import outcomes as OC
from tidewatch.operators import panel as P
from tidewatch.operators import risk as R
from tidewatch.operators import splits as SP
from tidewatch.operators import technical as TE
from tidewatch.operators import windows as W
from tidewatch.operators.asof import decision_points, latest_dates
from tidewatch.plans import oracle_panel as O
from tidewatch.plans.catalog_eval import KEYS, fx
from tidewatch.plans.catalog_panel import BAR_COLUMNS, THRESHOLD, _r6, demo_marked, demo_panel
from tidewatch.plans.panel_plan import own_features
from tidewatch.plans.registry import cte, query
from tidewatch.session import scratch_path, staged
from tidewatch.sources import decode as D
from tidewatch.sources import files as FI
from tidewatch.sources import inputs as I

_OWN = S.OWN_FEATURES
CODE = "r1"


# --- payloads: encode the demo inputs as API pages, a month per page -----------------
def _pages(df, entry, *keys):
    month = F.date_trunc("month", "date").cast("date").alias("page")
    return df.groupBy(*keys, month).agg(F.collect_list(entry).alias("entries"))


def _ms(day, seconds=0):
    return (F.unix_date(day).cast("long") * 86400 + seconds) * 1000


def _kline_pages(t):
    text = lambda c: F.col(c).cast("string")
    start = _ms(F.col("date"))
    fields = [start.cast("string"), text("open"), text("high"), text("low"), text("close"), text("volume"),
              (start + 86399999).cast("string"), text("quote_volume"), text("trades"), text("taker_buy_base"), F.lit("0"), F.lit("0")]
    return _pages(t.bars, F.array(*fields), "asset").select("asset", "page", F.to_json("entries").alias("payload"))


@query("src_klines", "SELECT asset, DAY(date) AS date, " + _r6([c for c in BAR_COLUMNS if c != "last_price"]) + " FROM c_bars")
def _(t):
    return D.klines(_kline_pages(t))


_point_days = "DATE '1995-06-01' AND DATE '2001-06-30'"


def _synthetic(close: str, source: str) -> str:
    prev = "lag(c) OVER (PARTITION BY asset ORDER BY date)"
    return (f"SELECT asset, date, c AS close, coalesce({prev}, c) AS open, greatest(coalesce({prev}, c), c) AS high, "
            f"least(coalesce({prev}, c), c) AS low, v FROM (SELECT asset, date, {close} AS c, {source})")


def _point_pages(t):
    stamp = _ms(F.col("date")) / 1000
    two = F.array(F.struct(stamp.cast("long").alias("timestamp"), F.col("open").alias("price")),
                  F.struct((stamp + 43200).cast("long").alias("timestamp"), F.col("close").alias("price")))
    return _pages(t.bars, two, "asset").select("asset", "page", F.to_json(F.flatten("entries")).alias("payload"))


cte("c_points", _synthetic("close", f"volume AS v FROM c_bars WHERE date BETWEEN {_point_days}"))


@query("src_price_points", """
SELECT asset, DAY(date) AS date, R6(close) AS close, R6(open) AS open, R6(high) AS high, R6(low) AS low,
 CAST(NULL AS DOUBLE) AS volume, CAST(NULL AS DOUBLE) AS quote_volume, CAST(NULL AS DOUBLE) AS trades FROM c_points""")
def _(t):
    return D.price_points(_point_pages(t), "1995-06-01", "2001-06-30")


def _chart_pages(t):
    noon, night = _ms(F.col("date"), 43200), _ms(F.col("date"), 80000)
    pair = lambda at, c: F.array(at.cast("double"), F.col(c))
    bars = t.bars
    prices = _pages(bars, F.array(pair(_ms(F.col("date")), "open"), pair(noon, "close")), "asset").select(
        "asset", "page", F.flatten("entries").alias("prices"))
    volumes = _pages(bars.filter("trades > 1"), F.array(pair(night, "volume")), "asset").select(
        "asset", "page", F.flatten("entries").alias("total_volumes"))
    return prices.join(volumes, ["asset", "page"], "left").select(
        "asset", F.to_json(F.struct("prices", "total_volumes")).alias("payload"))


cte("c_chart", _synthetic("close", "CASE WHEN trades > 1 THEN volume END AS v FROM c_bars"))


@query("src_market_chart", """
SELECT asset, DAY(date) AS date, R6(close) AS close, R6(v) AS volume, R6(open) AS open, R6(high) AS high, R6(low) AS low,
 R6(v * close) AS quote_volume, CAST(NULL AS DOUBLE) AS trades FROM c_chart""")
def _(t):
    return D.market_chart(_chart_pages(t))


@query("src_daily_index", "SELECT DAY(date) AS date, R6(value) AS value FROM c_index")
def _(t):
    at = (_ms(F.col("date")) / 1000).cast("long").cast("string").alias("timestamp")
    twice = F.array(F.struct(at, F.lit("0").alias("value")), F.struct(at, F.col("value").cast("string").alias("value")))
    pages = _pages(t.fg_index, twice).select("page", F.to_json(F.struct(F.flatten("entries").alias("data"))).alias("payload"))
    return D.daily_index(pages)


@query("src_nested_supply", "SELECT DAY(date) AS date, R6(value) AS value FROM c_supply")
def _(t):
    at = lambda s: ((_ms(F.col("date")) / 1000).cast("long") + s).cast("string").alias("date")
    total = lambda v: F.struct(v.cast("double").alias("peggedUSD")).alias("totalCirculatingUSD")
    entries = F.array(F.struct(at(0), total(F.lit(1.0))), F.struct(at(3600), total(F.col("value"))),
                      F.struct(at(7200), total(F.lit(None))))
    pages = _pages(t.supply, entries).select("page", F.to_json(F.flatten("entries")).alias("payload"))
    return D.nested_supply(pages)


@query("src_headlines", """
SELECT INT8(doc_id) AS id, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, md5(title) AS title_md5,
 CASE WHEN lang = 'en' THEN source ELSE 'cryptopanic' END AS source, upper(lang) || ',' || source AS asset
FROM c_headlines WHERE source <> 'src3'""")
def _(t):
    day = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    entry = F.struct(
        F.col("doc_id").alias("id"),
        F.when(F.col("source") == "src3", F.lit("not a time")).when(F.col("lang") != "fr", day).alias("published_at"),
        F.when(F.col("source") != "src3", day).alias("created_at"), "title",
        F.when(F.col("lang") == "en", F.struct(F.col("source").alias("domain"))).alias("source"),
        F.array(F.struct(F.upper("lang").alias("code")), F.struct(F.col("source").alias("code"))).alias("currencies"))
    pages = t.headlines.select(F.to_json(F.struct(F.array(entry).alias("results"))).alias("payload"))
    rows = D.headlines(pages)
    return rows.select("id", "published_at", F.md5("title").alias("title_md5"), "source", "asset")


def _sources(t):
    bars = t.bars.select("asset", "date", "close")
    first = bars.filter("asset = 'AMERICA' OR (asset = 'ASIA' AND date < '1995-02-15')")
    second = bars.filter("asset IN ('AMERICA', 'ASIA')")
    third = bars.filter("asset = 'EUROPE' AND date < '1995-09-01' OR asset = 'AFRICA' AND date < '1995-03-01'")
    return [("venue", first), ("points", second), ("chart", third)]


cte("c_tagged", """
SELECT 'venue' AS source, 0 AS k, asset, date, close FROM c_bars WHERE asset = 'AMERICA' OR (asset = 'ASIA' AND date < DATE '1995-02-15')
UNION ALL SELECT 'points', 1, asset, date, close FROM c_bars WHERE asset IN ('AMERICA', 'ASIA')
UNION ALL SELECT 'chart', 2, asset, date, close FROM c_bars WHERE (asset = 'EUROPE' AND date < DATE '1995-09-01') OR (asset = 'AFRICA' AND date < DATE '1995-03-01')""")
cte("c_first", """
SELECT * FROM (SELECT *, min(k) OVER (PARTITION BY asset) AS best FROM (
 SELECT *, count(*) OVER (PARTITION BY asset, k) AS n FROM c_tagged) WHERE n >= 90) WHERE k = best""")


@query("src_fallback", "SELECT asset, DAY(date) AS date, R6(close) AS close, source FROM c_first")
def _(t):
    return D.first_usable(_sources(t))


@query("src_excluded_assets", "SELECT asset, role FROM c_assets WHERE asset NOT IN (SELECT asset FROM c_first)")
def _(t):
    return D.uncovered(t.assets.select("asset", "role"), D.first_usable(_sources(t)))


# --- files ------------------------------------------------------------------------------
@query("panel_roundtrip", f"""
SELECT asset, DAY(date) AS date, R6(close) AS close, {_r6(S.TECHNICAL)}, INT8(label) AS label
FROM c_panel JOIN c_assets USING (asset) WHERE role = 'target'""")
def _(t):
    path = scratch_path(t.spark, "panel")
    FI.freeze_panel(demo_panel(t), path)
    targets = t.assets.filter("role = 'target'")
    return FI.load_panel(t.spark, path, targets).select("asset", "date", "close", *S.TECHNICAL, "label")


@query("sink_result_tables", "SELECT fold, model, R6(pr_auc) AS pr_auc, R6(f1) AS f1, R6(brier) AS brier, INT8(n_samples) AS n_samples FROM c_fold")
def _(t):
    path = scratch_path(t.spark, "per-fold")
    df = M.metric_suite(t.scores, KEYS).select(*KEYS, "pr_auc", "f1", "brier", "n_samples")
    FI.write_table(df, path)
    return FI.read_table(t.spark, path, "fold string, model string, pr_auc double, f1 double, brier double, n_samples bigint")


@query("windows_store", "SELECT asset, DAY(window_end) AS window_end, INT8(count(*)) AS n_rows, " + ", ".join(f"R6(sum({c})) AS sum_{c}" for c in _OWN)
       + " FROM c_tensor GROUP BY asset, window_end")
def _(t):
    """Every stored value counts: the sums of all columns over each window's rows."""
    path = scratch_path(t.spark, "windows")
    FI.write_windows(W.window_tensor(demo_marked(t), _OWN), path)
    total = F.aggregate(F.slice("feats", F.lit(2), F.size("feats") - 1), F.element_at("feats", 1), lambda acc, row: F.zip_with(acc, row, lambda a, b: a + b))
    stored = t.spark.read.parquet(path).withColumn("_t", total)
    return stored.select("asset", "window_end", F.size("feats").alias("n_rows"), *[F.col("_t")[i].alias(f"sum_{c}") for i, c in enumerate(_OWN)])


# --- demo predictions ---------------------------------------------------------------------
def demo_preds(t):
    """Predictions of the volatility percentile at every target asset and monitoring date."""
    panel = TE.with_realized_vol(t.bars).select("asset", "date", "close", *[f"realized_vol_{n}" for n in S.VOL_WINDOWS])
    at = latest_dates(t.bars, decision_points(t.cycles, t.assets))
    pct = R.percentiles(panel, ["realized_vol_30"]).select("asset", "date", F.col("percentile").alias("probability"))
    p = F.col("probability")
    severity = (F.when(p >= 0.95, "CRITICAL").when(p >= 0.8, "HIGH").when(p >= 0.4, "MODERATE").otherwise("LOW"))
    df = at.join(pct, ["asset", "date"], "left").join(panel, ["asset", "date"], "left")
    df = df.withColumn("as_of_date", F.date_format("as_of", "yyyy-MM-dd"))
    vols = [f"realized_vol_{n}" for n in S.VOL_WINDOWS]
    driver = F.struct(F.lit("realized_vol_30").alias("feature"), p.alias("contribution"), F.lit(1).alias("direction"))
    return df.select(
        LG.prediction_id("asset", "as_of_date", F.lit("rule"), F.lit(CODE)).alias("prediction_id"), "asset", "as_of_date",
        F.lit(14).alias("horizon_days"), (100.0 * p).alias("risk_score"), "probability", severity.alias("severity_band"),
        F.array(driver).alias("top_drivers"), F.lit("rule").alias("model_name"), F.lit("1").alias("model_version"),
        LG.feature_hash(vols).alias("feature_hash"), F.lit(CODE).alias("code_version"))


_num = lambda x: f"coalesce(CAST(CAST(round({x}, 8) AS DECIMAL(38,8)) AS VARCHAR), 'null')"
cte("c_points_asof", """
SELECT a.asset, c.as_of, (SELECT max(date) FROM c_bars b WHERE b.asset = a.asset AND b.date <= c.as_of) AS date
FROM c_assets a CROSS JOIN c_cycles c WHERE a.role = 'target'""")
cte("c_preds", f"""
SELECT *, 100.0::DOUBLE * probability AS risk_score, strftime(as_of, '%Y-%m-%d') AS as_of_date,
 CASE WHEN probability >= 0.95 THEN 'CRITICAL' WHEN probability >= 0.8 THEN 'HIGH' WHEN probability >= 0.4 THEN 'MODERATE' ELSE 'LOW' END AS severity_band,
 '0x' || sha256(asset || '|' || strftime(as_of, '%Y-%m-%d') || '|rule|{CODE}') AS prediction_id,
 '0x' || sha256('{{"realized_vol_14":' || {_num('realized_vol_14')} || ',"realized_vol_30":' || {_num('realized_vol_30')} || ',"realized_vol_7":' || {_num('realized_vol_7')} || '}}') AS feature_hash
FROM (SELECT p.asset, p.as_of, p.date, f.realized_vol_7, f.realized_vol_14, f.realized_vol_30,
  (SELECT CASE WHEN f.realized_vol_30 IS NULL THEN NULL ELSE count(*) FILTER (WHERE h.realized_vol_30 <= f.realized_vol_30) / CAST(count(h.realized_vol_30) AS DOUBLE) END
   FROM c_tech h WHERE h.asset = p.asset AND h.date <= p.date) AS probability
 FROM c_points_asof p JOIN c_tech f ON f.asset = p.asset AND f.date = p.date)""")


def _payload_sql(prob: str, score: str) -> str:
    """The canonical payload text, spelt out key by key in name order."""
    return ("""'{"as_of_date":"' || as_of_date || '","asset":"' || asset || '","code_version":"r1","feature_hash":"' || feature_hash """
            """|| '","horizon_days":14,"model_name":"rule","model_version":"1","prediction_id":"' || prediction_id || '","probability":' || """
            + _num(prob) + """ || ',"risk_score":' || """ + _num(score)
            + """ || ',"severity_band":"' || severity_band || '","top_drivers":[{"contribution":' || """ + _num(prob)
            + """ || ',"direction":1,"feature":"realized_vol_30"}]}'""")


cte("c_digests", f"SELECT *, '0x' || sha256({_payload_sql('probability', 'risk_score')}) AS digest FROM c_preds")
LEDGER_SCHEMA = "prediction_id string, asset string, as_of_date string, severity_band string, probability double, digest string, run string"


def _ledger_rows(t, run):
    return LG.with_digest(demo_preds(t)).select(
        "prediction_id", "asset", "as_of_date", "severity_band", "probability", "digest", F.lit(run).alias("run"))


@query("ledger_append", """
SELECT prediction_id, asset, as_of_date, severity_band, R6(probability) AS probability, digest,
 CASE WHEN asset = 'ASIA' THEN 'first' ELSE 'second' END AS run FROM c_digests""")
def _(t):
    path = scratch_path(t.spark, "ledger")
    first = staged(_ledger_rows(t, "first"), "predictions")
    LG.append_predictions(first.filter("asset = 'ASIA'"), path, LEDGER_SCHEMA)
    again = first.withColumn("run", F.lit("second"))
    LG.append_predictions(again.unionByName(again), path, LEDGER_SCHEMA)
    return LG.read_predictions(t.spark, path, LEDGER_SCHEMA)


@query("ledger_read", """
SELECT prediction_id, asset, as_of_date, severity_band, R6(probability) AS probability, digest, 'only' AS run FROM c_digests""")
def _(t):
    path = scratch_path(t.spark, "ledger")
    lines = staged(_ledger_rows(t, "only"), "predictions").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    broken = lines.select(F.explode(F.array(F.col("value"), F.lit(""), F.concat(F.lit('{"prediction_id": '), F.substring("value", 5, 9)))).alias("value"))
    broken.write.text(path)
    return FI.read_lines(t.spark, path, LEDGER_SCHEMA)


@query("ledger_outcome_append", """
SELECT prediction_id, asset, as_of_date, severity_band AS predicted_band, R6(probability) AS predicted_probability,
 R6(dd) AS actual_max_drawdown, crashed AS crash_occurred, classification, resolved FROM c_outcomes""")
def _(t):
    path = scratch_path(t.spark, "outcomes")
    outcomes = staged(OC.resolve(demo_preds(t), t.bars, THRESHOLD), "outcomes")
    LG.append_outcomes(OC.matured(outcomes, "1999-01-01"), path)
    LG.append_outcomes(outcomes, path)      # those of the first append are there already
    return LG.read_outcomes(t.spark, path, outcomes.schema).drop("horizon_days")


# --- digests --------------------------------------------------------------------------------
@query("ld_prediction_id", "SELECT asset, as_of_date, prediction_id FROM c_preds")
def _(t):
    return demo_preds(t).select("asset", "as_of_date", "prediction_id")


@query("ld_canonical_digest", f"SELECT prediction_id, {_payload_sql('probability', 'risk_score')} AS payload, digest FROM c_digests")
def _(t):
    df = demo_preds(t)
    return LG.with_digest(df.withColumn("payload", LG.canonical_payload(df))).select("prediction_id", "payload", "digest")


@query("ld_feature_hash", "SELECT asset, as_of_date, feature_hash FROM c_preds")
def _(t):
    return demo_preds(t).select("asset", "as_of_date", "feature_hash")


@query("ld_verify", f"""
SELECT prediction_id, asset, as_of_date, CASE WHEN asset = 'ASIA' THEN tampered ELSE digest END AS computed_digest,
 CASE WHEN as_of < DATE '2000-06-01' THEN digest END AS recorded_digest,
 CASE WHEN as_of >= DATE '2000-06-01' THEN 'NEVER_RECORDED' WHEN asset = 'ASIA' THEN 'MISMATCH' ELSE 'MATCH' END AS verdict,
 CASE WHEN as_of < DATE '2000-06-01' THEN INT8(2) END AS days_to_commit
FROM (SELECT *, '0x' || sha256({_payload_sql('probability', '(risk_score + 1)')}) AS tampered FROM c_digests)""")
def _(t):
    preds = staged(demo_preds(t), "predictions")
    recorded = (LG.with_digest(preds).filter("as_of_date < '2000-06-01'")
                .select("prediction_id", F.upper("digest").alias("digest"),
                        F.date_add(F.to_date("as_of_date"), 2).cast("timestamp").alias("committed_at")))
    altered = preds.withColumn("risk_score", F.when(F.col("asset") == "ASIA", F.col("risk_score") + 1).otherwise(F.col("risk_score")))
    return LG.verify(altered, recorded)


_sig = lambda c: (f"CASE WHEN {c} IS NULL THEN 'null' WHEN {c} = 0 THEN '0' ELSE CAST(CAST(floor({c} / pow(10.0::DOUBLE, floor(log10(abs({c})))) * 1e9 + 0.5) AS BIGINT) AS VARCHAR) "  # noqa: E731
                  f"|| 'e' || CAST(CAST(floor(log10(abs({c}))) AS BIGINT) AS VARCHAR) END")
_digest_cols = ["close", "volume"]
cte("c_rowhash", "SELECT sha256(asset || '|' || strftime(date, '%Y-%m-%d') || " + " || ".join(
    f"'|{c}=' || {_sig(c)}" for c in _digest_cols) + ") AS h FROM c_bars")
_piece = lambda i: f"CAST(sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT AS HUGEINT)) AS VARCHAR)"


@query("ld_dataset_digest", f"""
SELECT INT8(count(*)) AS n_rows, '0x' || sha256('{",".join(_digest_cols)}|' || count(*) || '|' || {" || '|' || ".join(_piece(i) for i in range(4))}) AS digest
FROM c_rowhash""")
def _(t):
    return LG.dataset_digest(t.bars.select("volume", "date", "asset", "close"))


# --- outcomes -------------------------------------------------------------------------------
cte("c_outcomes", f"""
SELECT *, CASE WHEN NOT resolved THEN 'UNRESOLVED' WHEN warned AND crashed THEN 'TRUE_POSITIVE' WHEN warned THEN 'FALSE_POSITIVE'
 WHEN crashed THEN 'FALSE_NEGATIVE' ELSE 'TRUE_NEGATIVE' END AS classification FROM (
 SELECT *, severity_band IN ('HIGH', 'CRITICAL') AS warned, coalesce(dd >= {THRESHOLD}, false) AS crashed FROM (
  SELECT p.prediction_id, p.asset, p.as_of, p.as_of_date, p.severity_band, p.probability, p.risk_score, count(b.close) >= 2 AS resolved,
   CASE WHEN count(b.close) >= 2 THEN (min_by(b.close, b.date) - min(b.close)) / min_by(b.close, b.date) END AS dd
  FROM c_preds p LEFT JOIN c_bars b ON b.asset = p.asset AND b.date BETWEEN p.as_of AND p.as_of + 14 GROUP BY ALL))""")


def demo_outcomes(t):
    return OC.resolve(demo_preds(t), t.bars, THRESHOLD)


@query("oc_resolve", """
SELECT prediction_id, asset, as_of_date, INT8(14) AS horizon_days, severity_band AS predicted_band, R6(probability) AS predicted_probability,
 R6(dd) AS actual_max_drawdown, crashed AS crash_occurred, classification, resolved FROM c_outcomes""")
def _(t):
    return demo_outcomes(t)


@query("oc_unresolved", "SELECT prediction_id, asset, as_of_date FROM c_outcomes WHERE NOT (resolved AND as_of + 14 <= DATE '1999-06-30')")
def _(t):
    preds = staged(demo_preds(t), "predictions")
    done = OC.resolve(OC.matured(preds, "1999-06-30"), t.bars, THRESHOLD).filter("resolved")
    return OC.unresolved(preds, done).select("prediction_id", "asset", "as_of_date")


BOUNDARY = "1999-11-17"


@query("oc_track_record", f"""
SELECT coalesce(period, 'all') AS period, INT8(count(*)) AS predictions, INT8(count(*) FILTER (WHERE resolved)) AS n_resolved,
 INT8(count(*) FILTER (WHERE k = 'TRUE_POSITIVE')) AS tp, INT8(count(*) FILTER (WHERE k = 'FALSE_POSITIVE')) AS fp,
 INT8(count(*) FILTER (WHERE k = 'FALSE_NEGATIVE')) AS fn, INT8(count(*) FILTER (WHERE k = 'TRUE_NEGATIVE')) AS tn,
 INT8(count(*) FILTER (WHERE NOT resolved)) AS pending, INT8(count(*) FILTER (WHERE k IN ('TRUE_POSITIVE', 'FALSE_POSITIVE'))) AS alerts,
 R6(count(*) FILTER (WHERE k = 'TRUE_POSITIVE') / CAST(nullif(count(*) FILTER (WHERE k IN ('TRUE_POSITIVE', 'FALSE_POSITIVE')), 0) AS DOUBLE)) AS precision,
 R6(count(*) FILTER (WHERE k = 'TRUE_POSITIVE') / CAST(nullif(count(*) FILTER (WHERE k IN ('TRUE_POSITIVE', 'FALSE_NEGATIVE')), 0) AS DOUBLE)) AS recall
FROM (SELECT *, classification AS k, CASE WHEN as_of_date > '{BOUNDARY}' THEN 'out_of_sample' ELSE 'in_sample' END AS period FROM c_outcomes)
GROUP BY GROUPING SETS ((period), ())""")
def _(t):
    preds = staged(demo_preds(t), "predictions")
    return OC.track_record(preds, OC.resolve(preds, t.bars, THRESHOLD), BOUNDARY)


cte("c_osteps", """
SELECT *, sum(pos) OVER w AS rp, sum(n) OVER w AS rn, sum(pos) OVER () AS p, sum(n) OVER () AS t FROM (
 SELECT probability AS s, sum(CAST(crashed AS INT)) AS pos, count(*) AS n FROM c_outcomes WHERE resolved AND probability IS NOT NULL GROUP BY 1)
WINDOW w AS (ORDER BY s DESC)""")


@query("oc_report", """
SELECT 'all' AS scope, INT8(count(*) FILTER (WHERE classification = 'TRUE_POSITIVE')) AS "TRUE_POSITIVE",
 INT8(count(*) FILTER (WHERE classification = 'FALSE_POSITIVE')) AS "FALSE_POSITIVE",
 INT8(count(*) FILTER (WHERE classification = 'FALSE_NEGATIVE')) AS "FALSE_NEGATIVE",
 INT8(count(*) FILTER (WHERE classification = 'TRUE_NEGATIVE')) AS "TRUE_NEGATIVE",
 R6((SELECT CASE WHEN max(p) BETWEEN 1 AND max(t) - 1 THEN sum(CAST(pos AS DOUBLE) / p * rp / rn) END FROM c_osteps)) AS pr_auc,
 R6((SELECT CASE WHEN max(p) BETWEEN 1 AND max(t) - 1 THEN sum(pos * ((t - p) - (rn - rp) + 0.5 * (n - pos))) / CAST(max(p * (t - p)) AS DOUBLE) END FROM c_osteps)) AS roc_auc,
 R6(avg((probability - CAST(crashed AS INT)) * (probability - CAST(crashed AS INT)))) AS brier,
 R6(avg(CASE WHEN probability IS NOT NULL THEN CAST(crashed AS INT) END)) AS positive_rate, INT8(count(probability)) AS n_samples
FROM c_outcomes WHERE resolved""")
def _(t):
    return OC.report(staged(demo_outcomes(t), "outcomes"))


@query("oc_ledger_view", """
SELECT prediction_id, asset, as_of_date, severity_band, R6(risk_score) AS risk_score, R6(probability) AS probability,
 CASE WHEN resolved AND as_of + 14 <= DATE '2000-11-01' THEN classification ELSE 'PENDING' END AS classification,
 CASE WHEN resolved AND as_of + 14 <= DATE '2000-11-01' THEN R6(dd) END AS actual_max_drawdown
FROM c_outcomes ORDER BY as_of_date DESC, asset, prediction_id LIMIT 100""")
def _(t):
    preds = staged(demo_preds(t), "predictions")
    done = OC.resolve(OC.matured(preds, "2000-11-01"), t.bars, THRESHOLD)
    view = OC.ledger_view(preds.select("prediction_id", "asset", "as_of_date", "severity_band", "risk_score", "probability"), done, 100)
    return view


_hw = "(PARTITION BY asset ORDER BY date RANGE BETWEEN CURRENT ROW AND INTERVAL 14 DAY FOLLOWING)"


@query("oc_hindsight", f"""
SELECT asset, DAY(date) AS date, R6(s) AS start_price, R6(m) AS min_price, R6(l) AS end_price, R6((s - m) / s) AS max_drawdown,
 (s - m) / s >= {THRESHOLD} AS crashed FROM (
 SELECT asset, date, CASE WHEN n >= 2 THEN close END AS s, CASE WHEN n >= 2 THEN m0 END AS m, CASE WHEN n >= 2 THEN l0 END AS l FROM (
 SELECT asset, date, close, count(close) OVER {_hw} AS n, min(close) OVER {_hw} AS m0, last_value(close) OVER {_hw} AS l0 FROM c_bars))""")
def _(t):
    return OC.hindsight(t.bars, 14, THRESHOLD)


# --- health ---------------------------------------------------------------------------------
def _psi_sql(cells: str) -> str:
    """PSI from a relation of (feature, value, side)."""
    return f"""
SELECT feature, CASE WHEN max(nr) >= 50 AND max(nc) >= 10 AND max(len(e)) >= 3 THEN sum((cs - rs) * ln(cs / rs)) END AS psi,
 max(nr) AS n_reference, max(nc) AS n_current FROM (
 SELECT *, greatest(r / CAST(nr AS DOUBLE), 1e-6) AS rs, greatest(c / CAST(nc AS DOUBLE), 1e-6) AS cs FROM (
  SELECT feature, bin, any_value(e) AS e, count(*) FILTER (WHERE side = 'r') AS r, count(*) FILTER (WHERE side = 'c') AS c,
   sum(count(*) FILTER (WHERE side = 'r')) OVER (PARTITION BY feature) AS nr, sum(count(*) FILTER (WHERE side = 'c')) OVER (PARTITION BY feature) AS nc
  FROM (SELECT x.*, e, len(list_filter(e[2:len(e) - 1], lambda v: v <= x.value)) AS bin FROM {cells} x JOIN (
    SELECT feature, list_sort(list_distinct(list(s[lo + 1] + (s[least(lo + 2, n)] - s[lo + 1]) * (h - lo)))) AS e FROM (
     SELECT *, CAST(floor(h) AS BIGINT) AS lo FROM (SELECT feature, s, n, (k / 10.0::DOUBLE) * (n - 1) AS h FROM (
      SELECT feature, list_sort(list(value)) AS s, count(*) AS n FROM {cells} WHERE side = 'r' AND value IS NOT NULL GROUP BY 1) CROSS JOIN range(11) t(k)))
    GROUP BY feature) q USING (feature) WHERE x.value IS NOT NULL) GROUP BY feature, bin))
GROUP BY feature"""


cte("c_psicells", "SELECT asset AS feature, realized_vol_30 AS value, CASE WHEN date < DATE '1999-01-01' THEN 'r' ELSE 'c' END AS side FROM c_tech")
cte("c_psi", _psi_sql("c_psicells"))


@query("hl_psi", "SELECT feature AS asset, R6(psi) AS psi, INT8(n_reference) AS n_reference, INT8(n_current) AS n_current FROM c_psi")
def _(t):
    df = TE.with_realized_vol(t.bars).select("asset", "date", F.col("realized_vol_30").alias("value"))
    old = F.col("date") < F.lit("1999-01-01").cast("date")
    return H.psi(df.filter(old), df.filter(~old), ["asset"])


_RECENT_DAYS = 180
cte("c_driftcells", "SELECT feature, value, side FROM (SELECT " + ", ".join(_OWN) + ", CASE WHEN window_end < DATE '2000-01-01' THEN 'r' ELSE 'c' END AS side "
    f"FROM c_tensor WHERE window_end < DATE '2000-01-01' OR window_end > (SELECT max(window_end) FROM c_tensor) - {_RECENT_DAYS}) UNPIVOT (value FOR feature IN (" + ", ".join(_OWN) + "))")
cte("c_drift", "SELECT *, CASE WHEN psi IS NULL THEN 'unknown' WHEN psi >= 0.25 THEN 'major' WHEN psi >= 0.1 THEN 'minor' ELSE 'stable' END AS severity FROM ("
    + _psi_sql("c_driftcells") + ")")


def demo_drift(t):
    """Drift between the training era and the latest 180 days, each row weighted by the windows holding it."""
    marked = staged(demo_marked(t), "marked")
    end = F.col("window_end")
    old = W.multiplicity(marked, end < F.lit("2000-01-01").cast("date"))
    last = marked.filter("emit").agg(F.max("window_end")).scalar()
    new = W.multiplicity(marked, end > F.date_sub(last, _RECENT_DAYS))
    weighted = staged(marked.withColumns({"_old": old, "_new": new}), "weighted")
    def side(w):
        return (P.unpivot(weighted.filter(F.col(w) > 0), _OWN, ["asset", "date", w])
                .select("feature", "value", F.col(w).alias("w")))
    return H.severity(H.psi(side("_old"), side("_new"), ["feature"], weight="w"))


@query("hl_drift", "SELECT feature, R6(psi) AS psi, INT8(n_reference) AS n_reference, INT8(n_current) AS n_current, severity FROM c_drift")
def _(t):
    return demo_drift(t)


cte("c_trend", """
SELECT *, slope < -0.01 AS declining FROM (SELECT model, count(*) AS n_folds, regr_slope(pr_auc, i) AS slope, min_by(pr_auc, i) AS first, max_by(pr_auc, i) AS last
FROM (SELECT model, pr_auc, CAST(row_number() OVER (PARTITION BY model ORDER BY fold) - 1 AS DOUBLE) AS i FROM c_fold) GROUP BY model HAVING count(*) >= 3 AND count(pr_auc) = count(*))""")


def demo_trend(t):
    return H.trend(M.ranking(t.scores, KEYS), "pr_auc")


@query("hl_trend", "SELECT model, INT8(n_folds) AS n_folds, R6(slope) AS slope, R6(first) AS first, R6(last) AS last, declining FROM c_trend")
def _(t):
    return demo_trend(t)
