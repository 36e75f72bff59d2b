"""Behaviour that must not change with size: long recursions, high rates, large levels, large graphs, plans without cross joins."""

import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch import settings as S
from tidewatch.functions import frames as FR
from tidewatch.functions.canon import json_value
from tidewatch.operators import contagion as X
from tidewatch.operators import explain as E
from tidewatch.operators import metrics as M
from tidewatch.operators import splits as SP
from tidewatch.plans import catalog, registry
from tidewatch.sources import inputs as I


def test_smoothing_equals_the_recursion_on_a_long_one_sided_series(spark):
    values = [100 - i * 0.5 for i in range(50)] + [75 + i * 0.1 for i in range(1150)]
    rows = [("A", i, max(values[i - 1] - values[i], 0.0) if i else None) for i in range(len(values))]
    got = FR.ewm_means(spark.createDataFrame(rows, "asset string, date int, loss double"), {"down": "loss"}, 1 / 14, 14).orderBy("date").collect()
    mean = None
    for r in got:
        if r.loss is not None:
            mean = r.loss if mean is None else mean * 13 / 14 + r.loss / 14
        assert r.down is None if r.date < 14 else r.down == pytest.approx(mean, rel=1e-9) and r.down > 0


@pytest.mark.parametrize("rate", [1, 50, 800, 5000])
def test_resampling_has_the_right_mean_at_any_rate(spark, rate):
    n = max(60, 400_000 // (rate * 20))
    n_all = n * rate
    # n heavy rows share all the weight among n_all rows, so each has the mean ``rate``.
    df = spark.range(n_all).withColumn("weight", F.when(F.col("id") < n, 1.0).otherwise(0.0))
    total = SP.weighted_resample(df, [], ["id"]).count()
    assert abs(total - n_all) <= max(0.02 * n_all, 4 * math.sqrt(n_all))


def test_scaler_keeps_the_spread_of_large_levels(spark):
    from datetime import date, timedelta

    start = date(2020, 1, 1)
    rows = [("A", start + timedelta(days=i), 1e9 + i % 2, 0) for i in range(400)]
    from tidewatch.operators import windows as W

    marked = W.mark_windows(spark.createDataFrame(rows, "asset string, date date, f double, label int"), ["f"])
    fold = {"fold": "x", "train_end": "2020-10-31", "test_start": "2020-12-20", "test_end": "2021-01-31"}
    got = SP.fit_scaler(marked, [fold], ["f"]).first()
    assert got["scale"] == pytest.approx(0.5, rel=1e-3) and got["mean"] == pytest.approx(1e9 + 0.5, abs=0.1)


def test_large_connected_graph_has_a_leading_vector(spark):
    nodes = [f"n{i:03d}" for i in range(120)]
    linked = {(i, j) for i in range(60) for j in range(i)} | {(i, i - 1) for i in range(60, 120)}
    rows = [("2020-01-01", nodes[min(i, j)], nodes[max(i, j)], 0.9 if (max(i, j), min(i, j)) in linked else 0.0) for i in range(120) for j in range(i)]
    pairs = spark.createDataFrame(rows, "date string, a string, b string, corr double").withColumn("date", F.to_date("date"))
    got = {r.asset: r.eigen_centrality_30 for r in X.eigen_centrality(pairs).collect()}
    m = np.zeros((120, 120))
    for i, j in linked:
        m[i, j] = m[j, i] = 0.9
    lead = np.abs(np.linalg.eigh(m)[1][:, -1])
    np.testing.assert_allclose([got[n] for n in nodes], lead, atol=1e-8)


def test_json_text_is_ascii_and_parses(spark):
    texts = ["x\ny\té", "plain", 'a"b\\c', "😀 \x01\b", "", None, "~\x7f"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", json_value(F.col("t"), "string").alias("j")).collect():
        assert r.j.isascii() and r.j.isprintable() and json.loads(r.j) == r.t


def test_plans_hold_no_cross_join(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        scores = spark.range(100).select((F.col("id") % 2).alias("y_true"), (F.col("id") / 100).alias("y_score"), F.col("id"), F.lit(1).alias("label"))
        profiles = spark.createDataFrame([("e1", "f", 1.0), ("e2", "f", 2.0)], "episode string, feature string, value double")
        frames = [M.metric_suite(scores, []), M.metric_suite(scores.withColumn("fold", F.col("id") % 3), ["fold"]), SP.with_class_weight(scores, []),
                  SP.weighted_resample(SP.with_class_weight(scores, []), [], ["id"]), E.topk_jaccard(profiles)]
        for frame in frames:
            assert "CartesianProduct" not in frame._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_attribution_sql_states_the_rules_for_labels_of_one_class(spark):
    """No label of the larger tables is positive: weights are NULL, profiles and shares 0, and the check SQL says so as well."""
    con = duckdb.connect()
    for name in ("lineitem", "supplier", "nation", "region", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.1/{name}.parquet'")
    assert con.execute(registry.compose("SELECT max(label) FROM c_label")).fetchone() == (0,)
    sql = catalog.oracles()
    said = {k: con.execute(sql[k]).fetchall() for k in ("at_ranked", "at_episode_profiles", "at_spearman", "at_stability", "at_top_features")}
    wide = spark.sql("SELECT 'A' AS asset, date_add(date'1996-04-01', CAST(id AS INT)) AS window_end, " + ", ".join(f"CAST(NULL AS DOUBLE) AS {f}" for f in S.OWN_FEATURES) + " FROM range(1800)")
    episodes = spark.createDataFrame(I.EPISODES, "episode string, start string, end string").selectExpr("episode", "date(start) AS start", "date(end) AS end")
    profiles = E.episode_profiles(wide, S.OWN_FEATURES, episodes).cache()
    plain = lambda df, *c: sorted(tuple(r) for r in registry.present(df).select(*c).collect())
    assert plain(E.ranked_mean(wide, S.OWN_FEATURES), "scope", "feature", "contribution", "abs_contribution", "share_of_total", "rank") == sorted(said["at_ranked"])
    assert plain(profiles, "episode", "feature", "value") == sorted((e, f, v) for e, _, f, v in said["at_episode_profiles"])
    assert plain(E.spearman(profiles), "a", "b", "spearman") == sorted(said["at_spearman"])
    assert plain(E.stability(E.spearman(profiles)), "stability_index", "n_pairs", "reading") == said["at_stability"] == [(0.0, 6, "LOW")]
    assert plain(E.top_features(profiles), "episode", "rank", "feature", "mean_abs_attribution", "share_of_total") == sorted(said["at_top_features"])


def test_correlation_with_a_constant_is_null_however_many_tasks_hold_it(spark):
    """49 rows of 1 a task: the merged moments of the constant keep a spread of 7e-17."""
    rows = spark.range(0, 147, 1, 3).selectExpr("1D AS one", "CAST(id % 7 AS DOUBLE) AS x", "CAST(CASE WHEN id % 5 > 0 THEN id % 7 END AS DOUBLE) AS part")
    assert rows.agg(F.stddev_pop("one")).first()[0] > 0
    got = rows.agg(FR.pair_corr("one", "x"), FR.pair_corr("x", "one"), FR.pair_corr("one", "one"), FR.pair_corr("x", "part")).first()
    assert list(got)[:3] == [None] * 3
    assert got[3] == pytest.approx(1.0)


@pytest.fixture
def in_three_tasks(spark):
    """Joins by shuffle into three tasks that nothing merges."""
    set_to = {"spark.sql.shuffle.partitions": "3", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in set_to}
    for k, v in set_to.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def _flat(spark, n):
    return spark.range(n).selectExpr("explode(array('E1', 'E2', 'E3')) AS episode", "concat('f', id) AS feature", "0D AS value")


@pytest.mark.parametrize("n", [171, 173])
def test_profiles_without_a_ranking_have_rank_correlation_0(in_three_tasks, n):
    """All ranks tied, features in three tasks: 0 by the rule, where noise over noise gave 1."""
    rows = E.spearman(_flat(in_three_tasks, n)).collect()
    assert sorted(tuple(r) for r in rows) == [("E1", "E2", 0.0), ("E1", "E3", 0.0), ("E2", "E3", 0.0)]


@pytest.mark.parametrize("n", [171, 173])
def test_profiles_without_a_ranking_have_a_low_stability(in_three_tasks, n):
    """The mean over three pairs is 0, a LOW one; noise over noise made it HIGH."""
    assert tuple(E.stability(E.spearman(_flat(in_three_tasks, n))).first()) == (0.0, 3, "LOW")


def _spearman_sql(con, rows):
    """What the check SQL says on given profiles."""
    con.execute("CREATE OR REPLACE TABLE c_prof0 (episode VARCHAR, feature VARCHAR, v DOUBLE)")
    con.executemany("INSERT INTO c_prof0 VALUES (?, ?, ?)", rows)
    for name in ("c_steps0", "c_stepranks0", "c_spear0"):
        con.execute(f"CREATE OR REPLACE VIEW {name} AS {registry.CTES[name]}")
    return sorted(con.execute(registry._expand(registry.ORACLES["at_spearman"])).fetchall())


@pytest.mark.parametrize("second, rho", [
    ({"a": 0.3, "b": 0.1 + 0.2, "c": 1.0, "d": 0.05, "e": 0.0}, 1.0),        # a and b tie, whichever sum is the larger by rounding
    ({"a": 0.3, "b": 0.3, "c": 1.0, "d": 0.05, "e": 2e-17}, 1.0),
    ({"a": 0.3, "b": 0.3, "c": 1.0, "d": 1e-17, "e": 0.0}, 0.973329),        # d is no more than e's noise
    ({"a": 0.3, "b": 0.3, "c": 1.0, "d": 1e-9, "e": 0.0}, 1.0),              # small, but no noise
    ({"a": 0.0, "b": 0.0, "c": 0.0, "d": 0.0, "e": 0.0}, 0.0),
])
def test_profile_values_apart_by_rounding_noise_share_a_rank(spark, second, rho):
    rows = [("E1", f, v) for f, v in {"a": 0.1 + 0.2, "b": 0.3, "c": 1.0, "d": 0.05, "e": 0.0}.items()] + [("E2", f, v) for f, v in second.items()]
    got = registry.present(E.spearman(spark.createDataFrame(rows, "episode string, feature string, value double"))).collect()
    assert [tuple(r) for r in got] == [("E1", "E2", rho)] == _spearman_sql(duckdb.connect(), rows)


@pytest.mark.parametrize("pairs, index, reading", [
    ([-0.1, -0.2, 0.3], 0.0, "LOW"), ([0.3, -0.2, -0.1], 0.0, "LOW"), ([0.1 + 0.2 - 0.3, 0.0], 0.0, "LOW"),
    ([0.6, 0.1, 0.5], 0.4, "MODERATE"), ([0.5, 0.1, 0.6], 0.4, "MODERATE"), ([0.9, 0.8, 0.4], 0.7, "HIGH"), ([0.4, 0.8, 0.9], 0.7, "HIGH"),
    ([-0.1, -0.2, 0.2999], -0.000033, "NEGATIVE"),
])
def test_stability_at_a_cut_point_reads_alike_in_any_order_of_pairs(spark, pairs, index, reading):
    got = registry.present(E.stability(spark.createDataFrame([(x,) for x in pairs], "spearman double").coalesce(1))).first()
    con = duckdb.connect()
    con.execute("CREATE TABLE c_spear0 (rho DOUBLE)")
    con.executemany("INSERT INTO c_spear0 VALUES (?)", [(x,) for x in pairs])
    assert tuple(got) == (index, len(pairs), reading) == con.execute(registry._expand(registry.ORACLES["at_stability"])).fetchone()
