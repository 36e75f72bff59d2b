"""Whole-window precedents against brute force on written-out windows."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import precedents as P

START = datetime.date(2020, 1, 1)


def rows(features, lengths, seed=3, holes=True):
    rng = np.random.default_rng(seed)
    out = []
    for a, n in lengths.items():
        walk = rng.normal(size=(n, features)).cumsum(axis=0) * 0.1 + rng.normal(size=(n, features)) + 1e4
        walk[:, 0] = 7.0 if a == "B" else walk[:, 0]                      # constant
        for d in range(n):
            v = [float(x) for x in walk[d]]
            if holes and d in (50, 51, 130):
                v[1] = None
            out.append((a, START + datetime.timedelta(days=d + d // 40), *v))
    return out


def brute(data, points, lookback, k, exclude, metric):
    found = {}
    for asset, as_of in points:
        mine = sorted(r[1:] for r in data if r[0] == asset)
        ends = [i for i in range(lookback - 1, len(mine)) if all(v is not None for r in mine[i - lookback + 1:i + 1] for v in r[1:]) and mine[i][0] <= as_of]
        if not ends:
            continue
        x = np.array([[v for r in mine[i - lookback + 1:i + 1] for v in r[1:]] for i in ends])
        spread = x.std(axis=0)
        z = (x - x.mean(axis=0)) / np.where(spread > 1e-9, spread, 1.0)
        if metric == "cosine":
            norm = np.linalg.norm(z, axis=1) * np.linalg.norm(z[-1])
            s = z @ z[-1] / np.where(norm > 1e-12, norm, 1.0)
        else:
            gone = z - z[-1]
            inverse = np.linalg.pinv(np.atleast_2d(np.cov(z, rowvar=False)) + 1e-6 * np.eye(z.shape[1]))
            s = 1 / (1 + np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", gone, inverse, gone), 0)))
        ranked = sorted((-s[i], mine[e][0]) for i, e in enumerate(ends) if (as_of - mine[e][0]).days >= exclude)[:k]
        for rank, (value, date) in enumerate(ranked, 1):
            found[asset, as_of, rank] = (date, -value)
    return found


@pytest.mark.parametrize("metric", ["cosine", "mahalanobis"])
@pytest.mark.parametrize("features, lookback, block", [(3, 5, 256), (3, 5, 16), (21, 30, 64)])
def test_precedents(spark, monkeypatch, metric, features, lookback, block):
    """Blocks of several sizes, several points per asset, holes, constant cells, points before any window."""
    monkeypatch.setattr(P, "BLOCK", max(block, lookback))
    monkeypatch.setattr(P, "GROUP", 2)
    monkeypatch.setattr(P, "RUN", 2)
    wide = features == 21
    data = rows(features, {"A": 400, "B": 330, "C": 9} if wide else {"A": 300, "B": 150, "C": 9}, holes=not wide)
    names = [f"f{i}" for i in range(features)]
    panel = spark.createDataFrame(data, "asset string, date date, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    points = [(a, START + datetime.timedelta(days=d)) for a in "ABC" for d in ((340, 500) if wide else (3, 40, 41, 100, 140, 141, 240, 500))]
    frame = spark.createDataFrame(points, "asset string, as_of date")
    nearest = P.nearest_cosine if metric == "cosine" else P.nearest_mahalanobis
    got = {(r.asset, r.as_of, r["rank"]): (r.date, r.similarity) for r in nearest(panel, names, frame, 3, 10, lookback).collect()}
    want = brute(data, points, lookback, 3, 10, metric)
    assert got.keys() == want.keys() and len(want) > 8
    for key, (date, value) in want.items():
        assert got[key][1] == pytest.approx(value, abs=1e-7)
        assert got[key][0] == date


def test_plan_does_not_grow_with_the_width(spark):
    sizes = []
    for n in (2, 12):
        panel = spark.createDataFrame(rows(n, {"A": 60}, holes=False), "asset string, date date, " + ", ".join(f"f{i} double" for i in range(n)))
        found = P.nearest_mahalanobis(panel, [f"f{i}" for i in range(n)], spark.createDataFrame([("A", START + datetime.timedelta(days=70))], "asset string, as_of date"), 3, 5, 4)
        sizes.append(len(found._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert sizes[0] == sizes[1]


def test_nothing(spark):
    panel = spark.createDataFrame([], "asset string, date date, f double")
    points = spark.createDataFrame([("A", START)], "asset string, as_of date")
    assert P.nearest_cosine(panel, ["f"], points).count() == 0
    assert P.nearest_mahalanobis(panel.withColumn("f", F.lit(1.0)), ["f"], points).count() == 0


def test_cells_constant_up_to_the_point_are_only_centred(spark):
    """They vary before the first window and after the point; the spread up to it has no rounding left."""
    rng = np.random.default_rng(5)
    data = [("A", START + datetime.timedelta(days=d), float(rng.normal()), 1.0 if 5 <= d < 400 else float(d % 3) / 7, None if d < 5 else 0.0) for d in range(600)]
    panel = spark.createDataFrame(data, "asset string, date date, x double, y double, z double")
    points = spark.createDataFrame([("A", START + datetime.timedelta(days=d)) for d in (150, 330, 395)], "asset string, as_of date")
    stored, ends = P.blocks(panel, ["x", "y", "z"], 4)
    for r in P._queries(stored, P._asked(points, ends), 3, 4).collect():
        assert r.spread[1::3] == [1.0] * 4 and all(0.5 < v < 1.5 and v != 1.0 for v in r.spread[0::3])
        assert r["query"][1::3] == pytest.approx(r["mean"][1::3], abs=1e-12)
    got = {(r.as_of, r["rank"]): (r.date, r.similarity) for r in P.nearest_cosine(panel, ["x", "y", "z"], points, 3, 20, 4).collect()}
    alone = {(r.as_of, r["rank"]): (r.date, r.similarity) for r in P.nearest_cosine(panel.filter("z IS NOT NULL"), ["x"], points, 3, 20, 4).collect()}
    assert len(got) == 9 and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in alone.items()}
    assert all(got[k][1] == pytest.approx(alone[k][1], abs=1e-9) for k in got)
