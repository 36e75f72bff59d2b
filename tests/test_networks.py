"""Networks fitted by summed gradients: derivative, sums over any partitioning, course of a plain fit, defined edge cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import metrics as ME
from tidewatch.operators import models as MO
from tidewatch.operators import networks as N
from tidewatch.operators import splits as SP
from tidewatch.operators import windows as W

FOLDS = [{"fold": "f1", "train_end": "2020-09-30", "test_start": "2020-10-01", "test_end": "2020-12-31"},
         {"fold": "f2", "train_end": "2020-12-31", "test_start": "2021-01-01", "test_end": "2021-03-31"},
         {"fold": "empty", "train_end": "2010-12-31", "test_start": "2021-01-01", "test_end": "2021-03-31"}]
MEANS, SCALES = [0.1, -0.2], [0.6, 0.8]


@pytest.fixture(scope="module")
def tensor(spark):
    """450 windows of 3 steps and 2 features; a product of two cells decides."""
    x = [F.sin(F.col("id") * (k + 1) * 1.7 + k) for k in range(6)]
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int"))
    return spark.range(450).withColumn("x", F.array(*x)).select(
        F.lit("A").alias("asset"), day.alias("window_start"), day.alias("window_end"), F.date_add(day, 3).alias("label_end"),
        (F.col("x")[4] * F.col("x")[1] > 0.3).cast("int").alias("label"),
        F.array(*[F.slice("x", 2 * t + 1, 2) for t in range(3)]).alias("feats")).cache()


@pytest.fixture(scope="module")
def arrays(spark):
    return spark.createDataFrame([(f["fold"], MEANS, SCALES) for f in FOLDS[:2]], "fold string, means array<double>, scales array<double>")


def _plain(tensor, fold):
    """Scaled windows of one fold's training part in this process: values, labels, balanced weights, kept aside."""
    rows = [r for r in N.flagged(tensor, FOLDS, 5).collect() if r.train[fold]]
    x = (np.array([r.x for r in rows]) - np.tile(MEANS, 3)) / np.tile(SCALES, 3)
    y, aside = np.array([r.label for r in rows]), np.array([r.aside for r in rows])
    return x, y, np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())), aside


def test_gradient_equals_finite_difference():
    rng = np.random.default_rng(5)
    layers = N.Layers((6, 5, 4, 1))
    flat, x, y, w = layers.start(1), rng.normal(size=(40, 6)), rng.integers(0, 2, 40).astype(float), rng.uniform(0.5, 2, 40)
    got, h = layers.gradient(flat, x, y, w), 1e-6
    for k in range(layers.length):
        move = np.zeros(layers.length)
        move[k] = h
        want = (layers.loss(flat + move, x, y, w) - layers.loss(flat - move, x, y, w)) / (2 * h)
        assert got[k] == pytest.approx(want, abs=2e-6)


@pytest.mark.parametrize("partitions", [1, 7])
def test_sums_equal_one_plain_pass(tensor, partitions):
    rows, layers = N.flagged(tensor, FOLDS, 5), N.Layers((6, 5, 4, 1))
    weights = N.class_weights(rows, 3)
    assert weights[:2].all() and not weights[2].any()
    blocks = N.pack(rows.repartition(partitions, "window_end"), weights)
    nets = np.stack([layers.start(s) for s in (1, 2, 3)])
    got = N.sums(blocks, nets, layers, np.tile(MEANS, (3, 3)), np.tile(SCALES, (3, 3)), [0, 1], 3)
    for fold in (0, 1):
        x, y, w, aside = _plain(tensor, fold)
        part = lambda m: [layers.loss(nets[fold], x[m], y[m], w[m]), w[m].sum()]  # noqa: B023, E731
        want = [*part(~aside), *part(aside), *layers.gradient(nets[fold], x[~aside], y[~aside], w[~aside])]
        np.testing.assert_allclose(got[fold], want, rtol=1e-9, atol=1e-9)


def test_course_equals_a_plain_fit(spark, tensor):
    """Each fold's losses, step by step, are those of Adam on its own rows in one process; a fold that ended takes no steps."""
    rows, layers = N.flagged(tensor, FOLDS, 5), N.Layers((6, 5, 4, 1))
    blocks = N.pack(rows, N.class_weights(rows, 3)).cache()
    nets, course = N.fit(blocks, layers, np.tile(MEANS, (3, 3)), np.tile(SCALES, (3, 3)), [0, 1], max_iter=12, step=0.05)
    for fold in (0, 1):
        x, y, w, aside = _plain(tensor, fold)
        flat, a, b, seen = layers.start(42), 0.0, 0.0, []
        decay = np.zeros(layers.length)
        for weights, _ in layers.parts(decay):
            weights[:] = N.PENALTY
        for i in range(1, 13):
            mean = lambda m: layers.loss(flat, x[m], y[m], w[m]) / w[m].sum()  # noqa: B023, E731
            seen.append((mean(~aside), mean(aside), flat.copy()))
            g = (layers.gradient(flat, x[~aside], y[~aside], w[~aside]) + decay * flat) / w[~aside].sum()
            a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
            flat = flat - 0.05 * (a / (1 - 0.9 ** i)) / (np.sqrt(b / (1 - 0.999 ** i)) + 1e-8)
        np.testing.assert_allclose(course[fold], [s[:2] for s in seen], rtol=1e-6)
        np.testing.assert_allclose(nets[fold], min(seen, key=lambda s: s[1])[2], rtol=1e-5, atol=1e-7)


def test_walk_forward_ranks_positives_and_skips_folds_without_training(tensor, arrays):
    got = N.walk_forward(tensor, arrays, FOLDS, 5, (16, 8), 60, 0.05).collect()
    assert {r.fold for r in got} == {"f1", "f2"}
    days = {"f1": (dt.date(2020, 10, 1), dt.date(2020, 12, 31)), "f2": (dt.date(2021, 1, 1), dt.date(2021, 3, 25))}
    for fold, (first, last) in days.items():
        mine = [r for r in got if r.fold == fold]
        assert len(mine) == (last - first).days + 1 == len({r.window_end for r in mine})
        pairs = [a.y_score > b.y_score for a in mine for b in mine if a.label > b.label]
        assert np.mean(pairs) > 0.9


def test_no_windows_give_no_scores(tensor, arrays):
    out = N.walk_forward(tensor.limit(0), arrays, FOLDS, 5)
    assert out.isEmpty() and out.columns == ["fold", "asset", "window_end", "label", "y_score"]


def test_given_parts_are_fitted_and_scored_as_folds_are(tensor, arrays):
    """Parts made of the folds' roles give the walk-forward's scores; a window that is only held back is scored, never fitted on."""
    roles = SP.walk_forward(tensor, FOLDS, 5).filter("role IN ('train', 'test')")
    parts = roles.withColumn("part", F.when(F.col("role") == "train", "fit").otherwise("test"))
    got = {(r.fold, r.window_end): (r.part, r.y_score) for r in N.score_parts(tensor, arrays, parts, [f["fold"] for f in FOLDS], (5, 4), 3).collect()}
    want = {(r.fold, r.window_end): ("test", r.y_score) for r in N.walk_forward(tensor, arrays, FOLDS, 5, (5, 4), 3).collect()}
    assert got.keys() == want.keys() and want
    assert all(got[k][0] == "test" and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)
    late = F.col("window_end") > "2020-07-01"
    held = parts.withColumn("part", F.when((F.col("part") == "fit") & late, "calibrate").otherwise(F.col("part")))
    flipped = tensor.withColumn("label", F.when(late, 1 - F.col("label")).otherwise(F.col("label")))
    one, other = ({(r.fold, r.window_end): r.y_score for r in N.score_parts(x, arrays, held.filter("fold = 'f1'"), ["f1"], (5, 4), 3).collect()} for x in (tensor, flipped))
    assert len(one) == held.filter("fold = 'f1' AND part <> 'fit'").count() > len([k for k in want if k[0] == "f1"])
    assert one == pytest.approx(other, abs=1e-12)


def test_walk_forward_takes_models_of_all_folds_at_once(tensor):
    """The rule's scores by counting, and a threshold from the calibration part alone."""
    signals = tensor.select("asset", "window_end", F.col("feats")[2][0].alias("signal"))
    seen = []

    def rule(parts):
        seen.append(parts)
        return MO.rule_parts(parts, signals)

    rows = SP.walk_forward(tensor, FOLDS[:1], 5).filter("role IN ('train', 'test')").withColumn("features", W.flat_vector())
    out = MO.walk_forward(rows, {"logreg": lambda: MO.logreg(5)}, FOLDS[:1], 5, {"rule": rule}).collect()
    assert {(r.model, r.fold) for r in out} == {("logreg", "f1"), ("rule", "f1")}
    value = {r.window_end: r.signal for r in signals.collect()}
    part = {r.window_end: (r.part, r.label) for r in seen[0].collect()}
    known = [value[d] for d, (p, _) in part.items() if p == "fit"]
    share = {d: np.mean([v <= value[d] for v in known]) for d in part}
    mine = [r for r in out if r.model == "rule"]
    assert {r.date for r in mine} == {d for d, (p, _) in part.items() if p == "test"}
    assert all(r.y_score == pytest.approx(share[r.date]) for r in mine)
    held = [(share[d], y) for d, (p, y) in part.items() if p == "calibrate"]

    def f1(limit):
        hits = sum(1 for s, y in held if s >= limit - 1e-12 and y)
        return 2 * hits / max(1, sum(s >= limit - 1e-12 for s, _ in held) + sum(y for _, y in held))

    tried = np.quantile([s for s, _ in held], ME.CANDIDATE_PROBS)
    assert f1(mine[0].threshold) == pytest.approx(max(map(f1, tried))) and np.abs(tried - mine[0].threshold).min() < 1e-12


def test_folds_of_one_class_are_fitted_and_scored(tensor, arrays):
    """Both weights are 1, as for the other models; the network learns that no window is positive."""
    negative = tensor.withColumn("label", F.lit(0))
    assert N.class_weights(N.flagged(negative, FOLDS, 5), 3).tolist()[:2] == [[1.0, 1.0]] * 2
    got = N.walk_forward(negative, arrays, FOLDS, 5, (5, 4), 40, 0.05).collect()
    want = N.walk_forward(tensor, arrays, FOLDS, 5, (5, 4), 1).collect()
    assert {(r.fold, r.window_end) for r in got} == {(r.fold, r.window_end) for r in want} and got
    assert max(r.y_score for r in got) < 0.3
