"""Centrality on rows and within tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import contagion as C


def graphs():
    """Dates with random graphs, whole and in pieces, two of them bipartite, one without edges, one too small."""
    rng = np.random.default_rng(4)
    out = []
    for day in range(1, 13):
        n = 3 + day % 6
        for i in range(n):
            for j in range(i):
                w = rng.uniform(-1, 1) if rng.random() < (0.3 if day % 3 else 0.9) else 0.05
                if day in (7, 8):
                    w = 0.6 + 0.01 * i if (i + j) % 2 else 0.0
                out.append((f"2020-01-{day:02d}", f"n{j}", f"n{i}", 0.1 if day == 10 else float(w)))
    return [*out, ("2020-02-01", "a", "b", 0.9), ("2020-02-02", "a", "b", None), ("2020-02-02", "a", "c", None), ("2020-02-02", "b", "c", None)]


def dense(rows):
    """Leading eigenvector per date by a dense solver, degree shares for graphs in pieces."""
    out = {}
    for date in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == date]
        if len(mine) < 3 or all(r[3] is None for r in mine):
            continue
        names = sorted({x for r in mine for x in r[1:3]})
        m = np.zeros((len(names), len(names)))
        for _, a, b, w in mine:
            if w is not None and abs(w) >= 0.3:
                m[names.index(a), names.index(b)] = m[names.index(b), names.index(a)] = abs(w)
        whole = (np.linalg.matrix_power(m + np.eye(len(names)), len(names)) > 0).all()
        v = np.abs(np.linalg.eigh(m)[1][:, -1]) if whole else m.sum(axis=1) / (m.sum() or 1)
        out |= {(date, a): x for a, x in zip(names, v, strict=True)}
    return out


@pytest.mark.parametrize("small", [C.SMALL_GRAPH, 10, 0])
def test_centrality_equals_a_dense_solve(spark, small):
    """Within tasks, on rows, and some of both."""
    rows = graphs()
    pairs = spark.createDataFrame(rows, "date string, a string, b string, corr double").withColumn("date", F.to_date("date"))
    got = {(str(r.date), r.asset): r.eigen_centrality_30 for r in C.eigen_centrality(pairs, small=small).collect()}
    want = dense(rows)
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, abs=1e-8), key


def test_no_pairs(spark):
    none = spark.createDataFrame([], "date date, a string, b string, corr double")
    assert C.eigen_centrality(none).count() == 0
