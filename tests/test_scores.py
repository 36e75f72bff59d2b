"""Out-of-fold scores: who may see which fit."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import models as MO
from tidewatch.operators import scores as SC

D = datetime.date
FOLDS = [{"fold": "a", "train_end": "2020-12-31", "test_start": "2021-01-01", "test_end": "2021-06-30"},
         {"fold": "b", "train_end": "2021-06-30", "test_start": "2021-07-01", "test_end": "2021-12-31"}]


@pytest.fixture(scope="module")
def windows(spark):
    """Windows of one row each, two assets; in the second half of training the classes change sides."""
    rng = np.random.default_rng(1)
    rows = []
    for a in "XY":
        for d in range(730):
            day = D(2020, 1, 1) + datetime.timedelta(days=d)
            label = int(rng.random() < 0.3)
            rows.append((a, day, day, day + datetime.timedelta(days=3), label if d < 700 else None, float(rng.normal() + 2 * label * (1 if d < 360 else -1)), 5.0))
    return spark.createDataFrame(rows, "asset string, date date, window_end date, label_end date, label int, f double, flat double").withColumn("window_start", F.col("window_end")).cache()


def test_a_future_score_is_never_used(spark):
    keys = spark.createDataFrame([("X", D(2021, 3, 1)), ("X", D(2021, 8, 1)), ("X", D(2020, 3, 1)), ("Y", D(2021, 8, 1))], "asset string, date date")
    rows = [("m", "a", D(2020, 12, 1), D(2021, 1, 1), "X", D(2021, 3, 1), 0.1), ("m", "a", D(2020, 12, 1), D(2021, 1, 1), "X", D(2021, 8, 1), 0.2),
            ("m", "b", D(2021, 5, 1), D(2021, 7, 1), "X", D(2021, 8, 1), 0.3),
            # planted: in use only later, or trained past the date, or up to the very date
            ("m", "late", D(2020, 12, 1), D(2021, 3, 2), "X", D(2021, 3, 1), 0.9), ("m", "past", D(2021, 3, 5), D(2021, 2, 1), "X", D(2021, 3, 1), 0.9),
            ("m", "same", D(2021, 3, 1), D(2021, 2, 1), "X", D(2021, 3, 1), 0.9), ("m", "early", D(2021, 5, 1), D(2020, 1, 1), "X", D(2020, 3, 1), 0.9),
            ("n", "b", D(2021, 5, 1), D(2021, 7, 1), "X", D(2021, 8, 1), 0.7)]
    table = spark.createDataFrame(rows, "model string, fold string, trained_until date, valid_from date, asset string, date date, probability double")
    got = {(r.asset, r.date, r.model): (r.probability, r.fold) for r in SC.as_of(table, keys).collect()}
    assert got == {("X", D(2021, 3, 1), "m"): (0.1, "a"), ("X", D(2021, 8, 1), "m"): (0.3, "b"), ("X", D(2021, 8, 1), "n"): (0.7, "b")}


def test_discriminant_equals_the_closed_form(windows):
    table = SC.discriminant(windows, FOLDS, ["f", "flat"], embargo=10)
    assert table.columns == SC.COLUMNS
    got = {(r.fold, r.asset, r.date): r for r in table.collect()}
    rows = windows.collect()
    for fold, start, until in (("a", D(2021, 1, 1), D(2021, 7, 1)), ("b", D(2021, 7, 1), D(9999, 1, 1))):
        end = D(2020, 12, 31) if fold == "a" else D(2021, 6, 30)
        train = [r for r in rows if r.label is not None and r.window_start <= end and r.label_end < start - datetime.timedelta(days=10)]
        one, zero = (np.array([r.f for r in train if r.label == c]) for c in (1, 0))
        v = (len(one) * one.var() + len(zero) * zero.var()) / len(train)
        served = [r for r in rows if start <= r.date < until]
        assert {(a, d) for k, a, d in got if k == fold} == {(r.asset, r.date) for r in served}
        for r in served:
            logit = (one.mean() - zero.mean()) / v * (r.f - (one.mean() + zero.mean()) / 2)
            found = got[fold, r.asset, r.date]
            assert found.probability == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-9)
            assert (found.valid_from, found.trained_until) == (start, max(t.label_end for t in train))


def test_rule_counts_training_readings(windows):
    got = {(r.asset, r.date): r.probability for r in SC.rule(windows, FOLDS, "f", embargo=10).filter("fold = 'a'").collect()}
    train = [r.f for r in windows.collect() if r.label_end < D(2020, 12, 22)]
    for r in windows.filter("date >= '2021-01-01' AND date < '2021-02-01'").collect():
        assert got[r.asset, r.date] == pytest.approx(np.mean([x <= r.f for x in train]))


def test_one_class_or_nothing_has_no_scores(windows):
    assert SC.discriminant(windows.filter("label = 0 OR date >= '2021-01-01'"), FOLDS[:1], ["f"]).count() == 0
    assert SC.discriminant(windows.limit(0), FOLDS, ["f"]).count() == 0


def test_fitted_classifier(spark):
    """A logistic regression per fold over whole windows: unlabelled windows are scored, folds without fit are not."""
    rows = [("X", D(2020, 1, 1) + datetime.timedelta(days=d), math.sin(d * 1.7), None if d > 690 else int(math.sin(d * 1.7) > 0.5)) for d in range(720)]
    panel = spark.createDataFrame(rows, "asset string, date date, f double, label int")
    folds = [{"fold": "none", "train_end": "2020-01-02", "test_start": "2020-03-01", "test_end": "2020-03-05"}, *FOLDS]
    got = SC.fitted("logreg", MO.logreg(), panel, folds, ["f"]).collect()
    assert {r.fold for r in got} == {"a", "b"}
    assert {r.date for r in got} == {r[1] for r in rows if r[1] >= D(2021, 1, 1)}
    high = [r.probability for r in got if math.sin((r.date - D(2020, 1, 1)).days * 1.7) > 0.6]
    low = [r.probability for r in got if math.sin((r.date - D(2020, 1, 1)).days * 1.7) < 0.4]
    assert min(high) > max(low)
