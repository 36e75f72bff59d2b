"""Product codes against plain integer k-means, and the bounds against all distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from tidewatch.llm import codes
from tidewatch.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, code string, _sum int, _hot string, vector string"


def brute(rows, parts=codes.PARTS, entries=codes.ENTRIES, rounds=codes.ROUNDS):
    """Codes, errors and codebooks in plain Python."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    cut = codes.limit(width * parts)
    ints = [[max(-cut, min(cut, math.floor(256 * float(np.float32(x))))) for x in v] + [0] * (width * parts - len(v)) for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books, out = [], [([], 0) for _ in kept]
    for p in range(parts):
        points = [tuple(v[p * width:(p + 1) * width]) for v in ints]
        book = [points[k] for k in first]

        def assign(points=points):
            return [min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(x, book[e], strict=True)), e)) for x in points]

        for _ in range(rounds):
            of = assign()
            for e in range(len(book)):
                mine = [x for x, o in zip(points, of, strict=True) if o == e]
                if mine:
                    book[e] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
        for k, o in enumerate(assign()):
            out[k] = (out[k][0] + [o], out[k][1] + sum((a - b) ** 2 for a, b in zip(points[k], book[o], strict=True)))
        books.extend(c for e in book for c in e)
    totals = {}
    for (_, _, lab), (_, err) in zip(kept, out, strict=True):
        totals[lab] = totals.get(lab, 0) + err
    sha = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return sorted(((i, bytes(c).hex(), err, totals[lab], sha) for (i, _, lab), (c, err) in zip(kept, out, strict=True)), key=repr)


def got(spark, rows):
    made = spark.createDataFrame([(i, v, lab, "c", 1, "h", "v") for i, v, lab in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, codes.coded_rows(made).collect()), key=repr)


def some(n, dims, seed=1, scale=0.3, steps=None):
    rng = random.Random(seed)
    draw = lambda: rng.gauss(0, scale) if steps is None else rng.randrange(steps) / 256
    return [(k, [draw() for _ in range(dims)], None if k % 5 == 0 else 3 if k % 3 else k) for k in range(n)]


def test_plain_and_awkward_rows(spark):
    rows = some(300, 32)
    rows += [(1000, None, 1), (1001, [None] * 32, 1), (1002, [float("nan")] * 32, 1), (1003, [float("inf")] + [0.0] * 31, 1), (5, rows[5][1], 2), (5, [0.1] * 32, None), (None, [0.2] * 32, None),
             (7000, [0.5] * 7, 4), (7001, [], 4), (7002, [3e30, -3e30] + [0.0] * 30, None)]
    random.Random(3).shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_ties(spark):
    """Few values per component: equal vectors, equal entries and equal distances everywhere."""
    rows = some(400, 16, steps=3) + some(200, 16, seed=9, steps=5)
    assert got(spark, rows) == brute(rows)


def test_widths_and_few_rows(spark):
    for rows in (some(20, 32), some(70, 13), some(1, 16), [(1, [], None)]):
        assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", range(4))
def test_bounds(seed):
    """After any move of the entries the carried bounds give the assignment that all distances give, for every ``b``."""
    rng = np.random.default_rng(seed)
    points = rng.integers(-200, 200, size=(500, 2, 3))
    if seed == 0:
        points //= 60
    shape = codes.Shape(6, float(abs(points).max()) / 256, 2, 24)
    book = points[:24].transpose(1, 0, 2).copy()
    step = codes.Assign(shape, 6, book, None, 0)
    state = step.first(points)
    for k in range(6):
        before, held = book, step.b
        book = book + rng.integers(-9 >> k, (9 >> k) + 1, size=book.shape)
        step = codes.Assign(shape, max(1, 6 - k), book, before, held)
        state = step.again(points, state[0], state[2], state[3], state[4])
        for p in range(2):
            square = ((points[:, p, None] - book[p]) ** 2).sum(axis=2)
            assert (state[0][:, p] == square.argmin(axis=1)).all() and (state[1][:, p] == square.min(axis=1)).all()
            listed = np.take_along_axis(square, state[2][:, p].astype(int), axis=1)
            assert (state[3][:, p] * shape.unit <= np.sqrt(listed)).all() and (np.diff(state[3][:, p].astype(int), axis=1) >= 0).all()
            others = np.ones_like(square, dtype=bool)
            np.put_along_axis(others, state[0][:, p, None].astype(int), False, axis=1)
            np.put_along_axis(others, state[2][:, p].astype(int), False, axis=1)
            assert (state[4][:, p] * shape.unit <= np.sqrt(np.where(others, square, 1 << 40).min(axis=1))).all()
    assert (state[5] < 24).any()


def test_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert codes.coded_rows(empty).count() == 0
    assert codes.coded_rows(spark.createDataFrame([(1, None, 1, "c", 1, "h", "v")], SCHEMA)).count() == 0
    spark.createDataFrame([(i, v, lab, "c", 1, "h", "v") for i, v, lab in some(90, 32)], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["op13_vector_codes"](spark, str(tmp_path)).dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]


def test_a_round_reads_as_many_bounds_as_the_one_before_needed(spark, monkeypatch):
    """Where entries hardly move, few listed entries are in doubt: the last round reads fewer than the quarter first kept."""
    made, kept = [], codes.Assign.__init__

    def noted(self, shape, b, *args):
        kept(self, shape, b, *args)
        made.append((self.b, *args[2:]))

    monkeypatch.setattr(codes.Assign, "__init__", noted)
    rng = np.random.default_rng(4)
    centres = rng.integers(-900, 900, size=(64, 32)) / 2.0
    rows = [(i, [float(x) for x in centres[i % 64] + rng.normal(size=32) / 100], 1, "c", 1, "h", "v") for i in range(640)]
    coded, _ = codes.compress(spark.createDataFrame(rows, SCHEMA))
    assert [m[0] for m in made] == [16, 16, 8] and [m[1] for m in made] == [0, 16, 16]
    assert coded.columns == ["vec_id", "label", "code", "error"] and coded.count() == 640


def test_bounds_beyond_those_read_count_as_one():
    """No more listed entries are looked at than the round was told to read, and the assignment is that of all distances."""
    rng = np.random.default_rng(8)
    points = rng.integers(-200, 200, size=(500, 2, 3))
    shape = codes.Shape(6, float(abs(points).max()) / 256, 2, 24)
    before = points[:24].transpose(1, 0, 2).copy()
    code, _, near, low, outer, _ = codes.Assign(shape, 6, before, None, 0).first(points)
    book = before + rng.integers(-9, 10, size=before.shape)
    got = codes.Assign(shape, 2, book, before, 6).again(points, code, near, low, outer)
    short = codes.Assign(shape, 2, book, before, 6, True).again(points, code, near, low, outer)
    assert set(np.unique(got[5]).tolist()) <= {0, 1, 2, 24} and got[2].shape == (500, 2, 2) and len(short) == 2
    for p in range(2):
        square = ((points[:, p, None] - book[p]) ** 2).sum(axis=2)
        assert (got[0][:, p] == square.argmin(axis=1)).all() and (short[0][:, p] == got[0][:, p]).all() and (short[1][:, p] == square.min(axis=1)).all()
