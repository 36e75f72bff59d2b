"""Model builders on a small separable set: they fit, rank and explain."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tidewatch.operators import explain as E
from tidewatch.operators import models as MO
from tidewatch.operators import trees as TR


@pytest.fixture(scope="module")
def rows(spark):
    """400 windows of 3 steps and 2 features; the first feature of the last step decides, one row in five is positive."""
    x = [F.sin(F.col("id") * (k + 1) * 1.7 + k) for k in range(6)]
    made = spark.range(400).withColumn("x", F.array(*x)).withColumn("label", (F.col("x")[4] > 0.8).cast("double"))
    return made.select(F.lit("A").alias("asset"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("window_end"),
                       "label", array_to_vector("x").alias("features")).cache()


@pytest.mark.parametrize("build, resample", [(MO.logreg, False), (lambda: MO.forest(20, 5), False), (lambda: MO.gbt(10, 3, 0.3), False),
                                             (lambda: MO.mlp(6, (8, 4), 60), True)])
def test_builders_rank_positives_first(rows, build, resample):
    model = MO.fit(build(), rows, resample)
    got = [(r.p, r.label) for r in model.transform(rows).select(MO.probability().alias("p"), "label").collect()]
    positive = [p for p, y in got if y == 1]
    negative = [p for p, y in got if y == 0]
    assert np.mean([a > b for a in positive for b in negative]) > 0.95


def test_linear_contributions_add_up_to_the_logit(spark, rows):
    model = MO.fit(MO.logreg(), rows)
    cells = E.linear_model(rows, model, F.lit([0.1] * 6), 2)
    total = F.aggregate(F.flatten("contrib"), F.col("base"), lambda a, v: a + v)
    worst = cells.select(F.max(F.abs(total - F.col("logit")))).first()[0]
    assert worst < 1e-9
    assert cells.select(F.size("contrib").alias("n"), F.size(F.col("contrib")[0]).alias("w")).distinct().collect() == [(3, 2)]


def test_penalty_follows_the_number_of_rows(rows):
    assert MO._penalised(MO.logreg(), rows).getRegParam() == pytest.approx(1 / 400)


def test_deployed_model_scores_like_the_fitted_one(rows, tmp_path):
    loaded = MO.deploy(MO.logreg(), rows, str(tmp_path / "m"))
    fitted = MO.fit(MO.logreg(), rows)
    a, b = ([r[0] for r in m.transform(rows).orderBy("window_end").select(vector_to_array("probability")[1]).collect()] for m in (loaded, fitted))
    np.testing.assert_allclose(a, b, atol=1e-6)


def test_tree_contributions_equal_full_rescoring(spark, rows):
    """Node tables score as the forest does, and losses are those of scoring each blanked window again."""
    steps = F.array(*[F.slice(vector_to_array("features"), 2 * t + 1, 2) for t in range(3)])
    feats = rows.withColumn("feats", steps)
    model, means = MO.fit(MO.forest(40, 6), rows), [0.1, -0.2]
    got = {r.window_end: r for r in TR.cell_contributions(feats, model, means, ["used", "noise"], 3).collect()}
    full = {r.window_end: (list(r.x), r.p) for r in model.transform(rows).select("window_end", vector_to_array("features").alias("x"), MO.probability().alias("p")).collect()}
    assert all(abs(got[d].score - p) < 1e-12 for d, (_, p) in full.items()) and len(got) == len(full) == 400
    blanks = [({k}, ("cell_loss", k)) for k in range(6)] + [({f, f + 2, f + 4}, ("feature_loss", f)) for f in range(2)]
    for cells, (name, k) in blanks:
        changed = rows.withColumn("features", array_to_vector(F.array(*[F.lit(means[c % 2]) if c in cells else vector_to_array("features")[c] for c in range(6)])))
        for r in model.transform(changed).select("window_end", MO.probability().alias("p")).collect():
            assert got[r.window_end][name][k] == pytest.approx(full[r.window_end][1] - r.p, abs=1e-12)
    mean = lambda k: np.mean([abs(r.feature_loss[k]) for r in got.values()])
    assert mean(0) > 2 * mean(1)
    long = TR.by_feature(TR.cell_contributions(feats, model, means, ["used", "noise"], 3), ["used", "noise"], 3).filter("feature = 'noise'").first()
    assert (long.contribution, long.steps) == (got[long.window_end].feature_loss[1], got[long.window_end].cell_loss[1::2])


def test_forest_without_positive_rows_scores_zero(rows):
    """Its leaves and probabilities know one class alone."""
    negative = rows.filter("label = 0")
    model = MO.fit(MO.forest(5, 3), negative)
    assert {r.p for r in model.transform(rows).select(MO.probability().alias("p")).collect()} == {0.0}


def test_tree_contributions_without_positive_rows_are_zero(rows):
    feats = rows.withColumn("feats", F.array(*[F.slice(vector_to_array("features"), 2 * t + 1, 2) for t in range(3)]))
    found = TR.cell_contributions(feats, MO.fit(MO.forest(5, 3), rows.filter("label = 0")), [0.1, -0.2], ["used", "noise"], 3).collect()
    assert len(found) == 400 and {(r.score, *r.feature_loss, *r.cell_loss) for r in found} == {(0.0,) * 9}


def test_walk_forward_takes_folds_without_positive_rows(rows):
    """Forest and linear model fit and score; no positive calibration window leaves the threshold at one half."""
    whole = rows.withColumns({"window_start": F.date_sub("window_end", 2), "label_end": F.date_add("window_end", 1), "fold": F.lit("f")})
    parted = whole.withColumn("label", F.lit(0.0)).withColumn("role", F.when(F.col("window_end") < "2020-10-01", "train").otherwise("test"))
    got = MO.walk_forward(parted, {"forest": lambda: MO.forest(5, 3), "logreg": MO.logreg}, [{"fold": "f"}], embargo=5).collect()
    assert {(r.model, r.y_score, r.threshold) for r in got} == {("forest", 0.0, 0.5), ("logreg", 0.0, 0.5)}
    assert len(got) == 2 * rows.filter("window_end >= '2020-10-01'").count()
