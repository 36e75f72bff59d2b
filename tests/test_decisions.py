import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import analogues as A
from tidewatch.operators import precedents as PR
from tidewatch.operators import explain as E
from tidewatch.operators import ledger as LG
from tidewatch.operators import monitor as MN
from tidewatch.operators import outcomes as OC
from tidewatch.operators import risk as R
from tidewatch.operators.asof import latest_dates
from tidewatch.session import scratch_path
from tidewatch.sources import files as FI
from tidewatch.streaming import bars as SB
from tidewatch.streaming import resolve as SR

REPORT = ("component string, asset string, date date, score double, confidence double, status string, risk string, spread double, "
          f"evidence {R.EVIDENCE}")
DAY = dt.date(2022, 1, 1)


def reports(spark, rows):
    return spark.createDataFrame([(c, "A", DAY, s, conf, st, "LOW", sp, []) for c, s, conf, st, sp in rows], REPORT)


def test_orchestrate_needs_two_and_prefers_agreement(spark):
    lone = R.orchestrate(reports(spark, [("market", 70.0, .9, "OK", None), ("flow", None, 0., "UNAVAILABLE", None)])).first()
    assert lone["status"] == "UNAVAILABLE" and lone["score"] is None and lone["confidence"] == 0
    agree = R.orchestrate(reports(spark, [("market", 70.0, .8, "OK", None), ("flow", 70.0, .8, "OK", None), ("models", 70.0, .8, "OK", 0.)])).first()
    split = R.orchestrate(reports(spark, [("market", 10.0, .8, "OK", None), ("flow", 10.0, .8, "OK", None), ("models", 95.0, .8, "OK", 0.)])).first()
    assert agree["confidence"] > split["confidence"] and agree["score"] > split["score"] and agree["consensus"] == 1
    w = np.array([.25, .25, .4]) * .8
    assert split["score"] == pytest.approx((w * [10, 10, 95]).sum() / w.sum())


def _decide(spark, score, conf, penalty):
    p = spark.createDataFrame([("A", DAY, score, conf, "OK")], "asset string, date date, score double, confidence double, status string")
    d = spark.createDataFrame([("A", DAY, penalty, 1)], "asset string, date date, penalty double, challenges bigint")
    return R.decide(p, d).first()


def test_decide_bands_and_abstention(spark):
    assert _decide(spark, 90.0, .9, 0.0)["risk"] == "CRITICAL" and _decide(spark, 90.0, .9, 0.0)["decision"] == "ALERT"
    assert _decide(spark, 90.0, .9, 0.5)["risk"] == "HIGH"                    # 67.5 after half the doubt
    assert _decide(spark, 30.0, .9, 0.0)["decision"] == "NO_ALERT"
    assert _decide(spark, 90.0, .3, 0.5)["decision"] == "ABSTAIN"


def test_skeptic_caps_its_penalty(spark):
    rows = [("market", 90.0, .9, "OK", None), ("flow", 20.0, .9, "OK", None), ("sentiment", None, 0., "UNAVAILABLE", None), ("models", 99.0, .6, "OK", .4)]
    rep = reports(spark, rows)
    ctx = spark.createDataFrame([("A", DAY, 130.0, 100.0, 0.2, 0.05, 9.9, True)],
                                "asset string, date date, close double, long_mean double, netflow double, supply_change double, vol double, novel boolean")
    near = spark.createDataFrame([("A", DAY, 0.3)], "asset string, date date, best_similarity double")
    got = R.skeptic(R.orchestrate(rep), rep, ctx, near).first()
    assert got["challenges"] == 7 and got["penalty"] == pytest.approx(0.60)


def test_novelty_equals_expanding_quantile(spark, prices):
    from tidewatch.operators import technical as TE
    df = TE.with_realized_vol(prices).withColumns({"exchange_netflow_7": F.lit(0.0), "stablecoin_netflow": F.lit(0.0)})
    got = R.context(df, R.percentiles(df, ["realized_vol_30"])).filter("asset = 'A' AND vol IS NOT NULL").orderBy("date").toPandas()
    v = got["vol"].to_numpy()
    want = [bool(i + 1 >= 100 and v[i] > np.quantile(v[:i + 1], 0.99)) for i in range(len(v))]
    assert got["novel"].tolist() == want and any(want)


def test_latest_dates(spark):
    panel = spark.sql("SELECT 'A' AS asset, explode(array(date'2020-01-01', date'2020-01-05')) AS date")
    points = spark.sql("SELECT 'A' AS asset, explode(array(date'2019-12-31', date'2020-01-03', date'2020-01-05', date'2020-02-01')) AS as_of")
    got = {str(r["as_of"]): str(r["date"]) for r in latest_dates(panel, points).collect()}
    assert got == {"2020-01-03": "2020-01-01", "2020-01-05": "2020-01-05", "2020-02-01": "2020-01-05"}


def test_analogues_by_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4))
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(200)]
    df = spark.createDataFrame([("A", d, v.tolist()) for d, v in zip(days, x)], "asset string, date date, vec array<double>")
    points = spark.createDataFrame([("A", days[150], days[150])], "asset string, as_of date, date date")
    q = A.queries_at(df, points)
    h = x[:151]
    z, zq = (h - h.mean(0)) / h.std(0), (x[150] - h.mean(0)) / h.std(0)
    cos = (z @ zq) / np.linalg.norm(z, axis=1) / np.linalg.norm(zq)
    want = np.argsort(-cos[:61])[:3]                                          # at least 90 days before
    got = A.nearest_cosine(df, q).orderBy("rank").collect()
    assert [r["date"] for r in got] == [days[i] for i in want]
    inv = np.linalg.pinv(np.cov(z, rowvar=False) + np.eye(4) * 1e-6)
    dist = np.sqrt(np.einsum("ij,jk,ik->i", z - zq, inv, z - zq))
    panel = df.select("asset", "date", *[F.col("vec")[i].alias(f"v{i}") for i in range(4)])
    m = PR.nearest_mahalanobis(panel, [f"v{i}" for i in range(4)], points, lookback=1).orderBy("rank").collect()
    assert [r["similarity"] for r in m] == pytest.approx(sorted(1 / (1 + dist[:61]), reverse=True)[:3])


def test_spearman_with_ties(spark):
    rows = [("e1", f, v) for f, v in zip("abcd", [1., 2., 2., 4.])] + [("e2", f, v) for f, v in zip("abcd", [4., 3., 2., 1.])]
    df = spark.createDataFrame(rows, "episode string, feature string, value double")
    r = E.spearman(df).first()
    assert r["spearman"] == pytest.approx(np.corrcoef([1, 2.5, 2.5, 4], [4, 3, 2, 1])[0, 1])
    assert E.topk_jaccard(df, 2).first()["jaccard"] == pytest.approx(1 / 3)
    assert E.stability(E.spearman(df)).first()["reading"] == "NEGATIVE"


def _payload(spark, **change):
    row = {"prediction_id": "0x1", "asset": "A", "as_of_date": "2022-01-01", "horizon_days": 14, "risk_score": 61.123456789,
           "probability": float("nan"), "severity_band": "HIGH", "top_drivers": [("vol", 0.5, 1)], "model_name": "rule",
           "model_version": "1", "feature_hash": "0x2", "code_version": "c", **change}
    schema = ("prediction_id string, asset string, as_of_date string, horizon_days int, risk_score double, probability double, severity_band string, "
              "top_drivers array<struct<feature:string,contribution:double,direction:int>>, model_name string, model_version string, feature_hash string, code_version string")
    return spark.createDataFrame([tuple(row.values())], schema)


def test_canonical_payload_and_tamper(spark):
    df = _payload(spark)
    text = df.select(LG.canonical_payload(df)).first()[0]
    doc = json.loads(text)
    assert list(doc) == sorted(doc) and doc["probability"] is None and doc["risk_score"] == 61.12345679 and " " not in text
    recorded = LG.with_digest(df).select("prediction_id", "digest", F.lit("2022-01-03").cast("timestamp").alias("committed_at"))
    assert LG.verify(df, recorded).first()["verdict"] == "MATCH"
    assert LG.verify(_payload(spark, risk_score=61.1234567891), recorded).first()["verdict"] == "MATCH"
    assert LG.verify(_payload(spark, asset="B"), recorded).first()["verdict"] == "MISMATCH"
    assert LG.verify(_payload(spark, prediction_id="0x9"), recorded).first()["verdict"] == "NEVER_RECORDED"
    with pytest.raises(ValueError):
        LG.canonical_payload(df.drop("feature_hash"))


def test_dataset_digest_ignores_order(spark, prices):
    df = prices.select("asset", "date", "close", "volume")
    d = lambda x: LG.dataset_digest(x).first()["digest"]
    assert d(df) == d(df.select("volume", "close", "date", "asset").repartition(7, "close"))
    assert d(df) != d(df.withColumn("close", F.when(F.col("volume") > 1090, F.col("close") + 1e-3).otherwise(F.col("close"))))


def test_ledger_never_duplicates(spark):
    path = scratch_path(spark, "ledger")
    schema = "prediction_id string, run string"
    new = lambda ids, run: spark.createDataFrame([(i, run) for i in ids], schema)
    LG.append_predictions(new(["a", "b", "a"], "1"), path, schema)
    LG.append_predictions(new(["b", "c"], "2"), path, schema)
    got = sorted((r["prediction_id"], r["run"]) for r in FI.read_lines(spark, path, schema).collect())
    assert got == [("a", "1"), ("b", "1"), ("c", "2")]


def _preds(spark):
    rows = [("p1", "A", "2022-11-05", "HIGH"), ("p2", "A", "2022-11-25", "HIGH"), ("p3", "A", "2022-12-25", "LOW"), ("p4", "A", "2022-12-30", "LOW")]
    return (spark.createDataFrame(rows, "prediction_id string, asset string, as_of_date string, severity_band string")
            .withColumns({"horizon_days": F.lit(14), "probability": F.lit(0.5)}))


def _falling(spark):
    """4 x 100, 15 steps down to 68, then 68."""
    closes = [100.0] * 4 + [100 - 32 * i / 15 for i in range(1, 16)] + [68.0] * 41
    return spark.createDataFrame([("A", dt.date(2022, 11, 1) + dt.timedelta(days=i), c) for i, c in enumerate(closes)], "asset string, date date, close double")


def test_outcomes_maturity_and_track_record(spark):
    preds, prices = _preds(spark), _falling(spark)
    got = {r["prediction_id"]: r for r in OC.resolve(preds, prices, 0.2).collect()}
    assert got["p1"]["classification"] == "TRUE_POSITIVE" and got["p2"]["classification"] == "FALSE_POSITIVE"
    assert got["p3"]["classification"] == "TRUE_NEGATIVE" and got["p4"]["classification"] == "UNRESOLVED"
    assert OC.matured(preds, "2022-11-19").count() == 1 and OC.matured(preds, "2022-11-18").count() == 0
    rec = {r["period"]: r for r in OC.track_record(preds, OC.resolve(preds, prices, 0.2), "2022-11-30").collect()}
    assert rec["all"]["precision"] == 0.5 and rec["all"]["recall"] == 1 and rec["all"]["pending"] == 1
    assert rec["out_of_sample"]["precision"] is None
    filled = {r["prediction_id"]: r for r in MN.backfill(preds, OC.resolve(preds, prices, 0.2), "2022-11-05", "2022-12-25", 10).collect()}
    assert str(filled["p1"]["resolved_at"]) == "2022-11-25" and filled["p3"]["classification"] == "PENDING"


def test_streams_equal_batch(spark):
    preds, prices = _preds(spark), _falling(spark)
    folder = scratch_path(spark, "feed")
    p = preds.select("prediction_id", "asset", F.to_timestamp("as_of_date").alias("pred_ts"), "severity_band")
    q = prices.select("asset", F.col("date").cast("timestamp").alias("ts"), "close")
    p.write.parquet(f"{folder}/p")
    q.write.parquet(f"{folder}/q")
    stream = lambda d, df: spark.readStream.schema(df.schema).parquet(f"{folder}/{d}")
    out = SR.outcome_stream(stream("p", p), stream("q", q), 14, 0.2)
    path = scratch_path(spark, "out")
    got = {r["prediction_id"]: r["classification"] for r in SR.resolve_stream(out, path).collect()}
    assert got == {"p1": "TRUE_POSITIVE", "p2": "FALSE_POSITIVE"}            # the horizon of p3 has not closed
    again = SR.resolve_stream(SR.outcome_stream(stream("p", p), stream("q", q), 14, 0.2), path)   # replayed: nothing twice
    assert again.count() == 2
    events = spark.sql("""SELECT id AS event_id, CAST(timestamp_seconds(1700006400 + id * 7200) AS TIMESTAMP_NTZ) AS ts, id AS user_id,
      'view' AS event_type, CAST(id % 7 AS DOUBLE) AS value, '' AS props FROM range(100)""")
    events.coalesce(1).write.parquet(f"{folder}/e")
    live = SB.drain(SB.daily_bars(SB.read_events(spark, f"{folder}/e")), "bars")
    batch = SB.daily_bars(events.withColumn("ts", F.col("ts").cast("timestamp")))
    assert live.exceptAll(batch).isEmpty() and 0 < live.count() < batch.count()


def test_copies_of_a_prediction_and_restarts_change_no_outcome(spark):
    preds, prices = _preds(spark), _falling(spark)
    folder = scratch_path(spark, "feed")
    p = preds.select("prediction_id", "asset", F.to_timestamp("as_of_date").alias("pred_ts"), "severity_band")
    q = prices.select("asset", F.col("date").cast("timestamp").alias("ts"), "close").filter("day(ts) = 5 OR month(ts) > 11")
    p.unionByName(p).write.parquet(f"{folder}/p")
    q.write.parquet(f"{folder}/q")
    stream = lambda d, df: spark.readStream.schema(df.schema).parquet(f"{folder}/{d}")
    out = lambda: SR.outcome_stream(stream("p", p), stream("q", q), 14, 0.2)
    path, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    first = {r["prediction_id"] for r in SR.resolve_stream(out(), path, state).collect()}
    assert first == {"p2"}                       # p1 sees one price only; its copy must not make two of it
    assert {r["prediction_id"] for r in SR.resolve_stream(out(), path, state).collect()} == first
