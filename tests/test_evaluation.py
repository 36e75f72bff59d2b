import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch import settings as S
from tidewatch.functions.ranks import empirical_cdf, exact_quantiles, expanding_rank, running_totals
from tidewatch.operators import health as H
from tidewatch.operators import metrics as M
from tidewatch.operators import splits as SP
from tidewatch.operators import windows as W
from tidewatch.sources import inputs as I


@pytest.fixture(scope="module")
def values(spark):
    """Two keys, one ten times the other, with many ties."""
    return spark.sql("""SELECT CASE WHEN id % 11 = 0 THEN 'small' ELSE 'big' END AS k, CAST(id AS INT) AS i,
      CAST((id * 7919) % 613 AS DOUBLE) / 10 AS x FROM range(4000)""")


def test_expanding_rank_by_brute_force(values):
    got = expanding_rank(values, ["k"], "i", "x").toPandas()
    for _, g in got.groupby("k"):
        g = g.sort_values("i").reset_index(drop=True)
        x = g["x"].to_numpy()
        le = [(x[:j + 1] <= x[j]).sum() for j in range(len(x))]
        lt = [(x[:j + 1] < x[j]).sum() for j in range(len(x))]
        assert g["rank_le"].tolist() == le and g["rank_lt"].tolist() == lt
        assert g["rank_n"].tolist() == list(range(1, len(x) + 1))


def test_quantiles_and_cdf(values):
    pdf = values.toPandas()
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    for r in exact_quantiles(values, ["k"], "x", probs).collect():
        assert r["quantile"] == pytest.approx(np.quantile(pdf[pdf.k == r["k"]].x, r["prob"]), abs=1e-9)
    weighted = values.withColumn("w", F.col("i") % 3)
    for r in exact_quantiles(weighted, ["k"], "x", [0.3, 0.7], "w").collect():
        g = pdf[pdf.k == r["k"]]
        assert r["quantile"] == pytest.approx(np.quantile(np.repeat(g.x, g.i % 3), r["prob"]), abs=1e-9)
    cdf = empirical_cdf(values.filter("i < 2000"), values.filter("i >= 2000"), ["k"], "x").toPandas()
    for k, g in cdf.groupby("k"):
        ref = np.sort(pdf[(pdf.k == k) & (pdf.i < 2000)].x)
        np.testing.assert_allclose(g["cdf"], np.searchsorted(ref, g["x"], side="right") / len(ref))


def test_running_totals_descending(values):
    counted = values.groupBy("k", "x").agg(F.count(F.lit(1)).alias("n"))
    got = running_totals(counted, ["k"], "x", ["n"], descending=True, ranges=8).toPandas()
    for _, g in got.groupby("k"):
        g = g.sort_values("x", ascending=False)
        assert g["run_n"].tolist() == g["n"].cumsum().tolist()


def _ap(y, s):
    order = np.unique(s)[::-1]
    p, last, out = y.sum(), 0.0, 0.0
    for v in order:
        hit = s >= v
        recall = y[hit].sum() / p
        out += (recall - last) * y[hit].mean()
        last = recall
    return out


def test_metrics_by_hand(spark):
    rng = np.random.default_rng(3)
    y, s = (rng.random(300) < 0.2).astype(int), np.round(rng.random(300), 2)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "y_true": y, "y_score": s}))
    lone = spark.createDataFrame([("one", 0, 0.7), ("one", 0, 0.2)], "g string, y_true int, y_score double")
    rows = {r["g"]: r for r in M.metric_suite(df.unionByName(lone), ["g"]).collect()}
    a = rows["a"]
    assert a["pr_auc"] == pytest.approx(_ap(y, s))
    pos, neg = s[y == 1], s[y == 0]
    assert a["roc_auc"] == pytest.approx(((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()))
    assert a["brier"] == pytest.approx(((s - y) ** 2).mean())
    assert a["false_alarm_rate"] == pytest.approx((neg >= 0.5).mean())
    assert rows["one"]["pr_auc"] is None and rows["one"]["recall"] == 0
    best = M.best_threshold(df.unionByName(lone), ["g"])
    got = {r["g"]: r for r in best.collect()}
    cands = np.unique(np.quantile(s, M.CANDIDATE_PROBS))
    f1 = [2 * y[s >= t].sum() / ((s >= t).sum() + y.sum()) for t in cands]
    assert got["a"]["threshold"] == pytest.approx(cands[int(np.argmax(f1))]) and got["one"]["threshold"] == 0.5
    with pytest.raises(ValueError):
        M.aggregate_folds(df, ["accuracy"])


def test_lead_time(spark):
    days = pd.date_range("2020-01-01", periods=120)
    s = np.zeros(120)
    s[[30, 60, 61, 62]] = 0.9
    df = spark.createDataFrame(pd.DataFrame({"model": "m", "date": days.date, "y_score": s, "threshold": 0.5}))
    ep = spark.sql("""SELECT 'early' AS episode, date'2020-03-10' AS start, date'2020-03-12' AS end UNION ALL
      SELECT 'late', date'2020-02-28', date'2020-03-05' UNION ALL SELECT 'never', date'2020-02-01', date'2020-02-03'""")
    got = {r["episode"]: r for r in M.lead_time(df, ["model"], ep).collect()}
    assert got["early"]["lead_time_days"] == 9 and got["late"]["lead_time_days"] == -2
    assert not got["never"]["warned"] and got["never"]["lead_time_days"] is None


def _meta(spark, n=900):
    return spark.sql(f"""SELECT 'A' AS asset, date_add(d, 0) AS window_start, date_add(d, 29) AS window_end, date_add(d, 43) AS label_end,
      CAST(i % 9 = 0 AS INT) AS label FROM (SELECT date_add(date'1995-06-01', CAST(id AS INT)) AS d, id AS i FROM range({n}))""")


def test_walk_forward_embargo(spark):
    roles = SP.walk_forward(_meta(spark), I.FOLDS[:1])
    over = SP.split_overlap(roles).first()
    assert over["apart"] and over["shared"] == 0
    gap = (over["first_test_window"] - over["last_train_label"]).days
    assert gap > S.EMBARGO_DAYS
    tight = SP.split_overlap(SP.walk_forward(_meta(spark), I.FOLDS[:1], embargo=-60)).first()
    assert not tight["apart"]
    n = SP.usable_folds(roles).first()
    assert n["n_train"] > 0 and n["n_embargoed"] > 0 and n["n_test"] > 0


def test_calibration_is_later_and_embargoed(spark):
    parts = SP.calibration(SP.walk_forward(_meta(spark), I.FOLDS[:1]))
    r = parts.groupBy("part").agg(F.min("window_start").alias("lo"), F.max("label_end").alias("hi"), F.count("*").alias("n"))
    by = {x["part"]: x for x in r.collect()}
    assert (by["calibrate"]["lo"] - by["fit"]["hi"]).days > S.EMBARGO_DAYS
    few = SP.calibration(SP.walk_forward(_meta(spark).filter("window_start < '1995-09-01'"), I.FOLDS[:1]))
    assert {x["part"] for x in few.select("part").distinct().collect()} == {"fit"}


def test_invariants():
    ok = dict(lookback=30, horizon=14, embargo=45, folds=I.FOLDS, bands=S.BANDS, exclude_days=90)
    S.check_invariants(**ok)
    for change in ({"embargo": 43}, {"bands": {"moderate": 70, "high": 65, "critical": 80}}, {"exclude_days": 10},
                   {"folds": I.FOLDS[::-1]}):
        with pytest.raises(ValueError):
            S.check_invariants(**{**ok, **change})


def test_resample_follows_weights(spark):
    df = spark.range(20000).select(F.lit(0).alias("k"), "id", F.when(F.col("id") % 10 == 0, 5.0).otherwise(0.5).alias("weight"))
    drawn = SP.weighted_resample(df, ["k"], ["id"])
    n, heavy = drawn.count(), drawn.filter("id % 10 = 0").count()
    assert n == pytest.approx(20000, rel=0.03) and heavy / n == pytest.approx(5 / 9.5, abs=0.02)
    assert drawn.exceptAll(SP.weighted_resample(df.repartition(7), ["k"], ["id"])).isEmpty()


def test_psi(spark):
    rng = np.random.default_rng(0)
    a, same, moved = rng.normal(size=2000), rng.normal(size=2000), rng.normal(2, 1, 2000)
    frame = lambda x: spark.createDataFrame(pd.DataFrame({"k": "f", "value": x}))
    psi = lambda cur: H.severity(H.psi(frame(a), frame(cur), ["k"])).first()
    edges = np.unique(np.quantile(a, np.linspace(0, 1, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    r, c = (np.maximum(np.histogram(v, edges)[0] / 2000, 1e-6) for v in (a, moved))
    assert psi(moved)["psi"] == pytest.approx(((c - r) * np.log(c / r)).sum()) and psi(moved)["severity"] == "major"
    assert psi(same)["severity"] == "stable" and psi(same[:5])["psi"] is None
    assert psi(moved[:20])["severity"] == "major"


def test_feature_constant_in_a_fold_has_scale_one(spark):
    """It varies before the fold's windows and after its training part, far from the value it keeps there."""
    days = spark.sql("""SELECT 'A' AS asset, date_add(date'1995-01-01', CAST(id AS INT)) AS date, CASE WHEN id < 40 THEN id / 7D WHEN id < 700 THEN 1D ELSE (id % 3) / 7D END AS y,
      sin(id) + 1e4 AS x, 0 AS label, id >= 40 AS known FROM range(1200)""")
    marked = W.mark_windows(days.withColumn("x", F.when(F.col("known"), F.col("x"))), ["x", "y"])
    got = {(r.fold, r.feature): r for r in SP.fit_scaler(marked, I.FOLDS[:2], ["x", "y"]).collect()}
    assert (got["fold1_1997", "y"]["mean"], got["fold1_1997", "y"]["scale"]) == (1.0, 1.0)
    assert got["fold2_1998", "y"]["scale"] > 0.1
    frame = marked.toPandas()
    for fold in I.FOLDS[:2]:
        first = pd.Timestamp(fold["test_start"]).date() - pd.Timedelta(days=S.EMBARGO_DAYS)
        ends = frame.index[frame["emit"] & (frame["label_end"] < first)]
        values = np.concatenate([frame["x"].to_numpy()[i - S.LOOKBACK + 1:i + 1] for i in ends])
        r = got[fold["fold"], "x"]
        assert (r.n_windows, r["mean"], r["scale"]) == (len(ends), pytest.approx(values.mean(), abs=1e-9), pytest.approx(values.std(), abs=1e-9))
