"""Extensions and runs against brute force."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tests.llm.conftest import rows
from tidewatch.llm import periods
from tidewatch.llm.queries import QUERIES


def words(text):
    return (text or "").encode().split()


def brute(w):
    """All runs by comparing all words q apart, for all q."""
    out = {}
    for q in range(1, len(w) // 3 + 1):
        k = 0
        while k < len(w) - q:
            if w[k] != w[k + q]:
                k += 1
                continue
            end = k
            while end < len(w) - q and w[end] == w[end + q]:
                end += 1
            if end + q - k >= max(24, 3 * q):
                out.setdefault((k, end + q - k), q)
            k = end
    return sorted((s, n, q) for (s, n), q in out.items())


def row(doc, w):
    found = sorted(brute(w), key=lambda r: (r[0], r[2]))
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return (doc, len(found), *top, None if top[0] is None else 1000 * top[1] // top[2], hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def test_cover():
    assert sorted({(int(a) - int(b)) % 31 for a in periods.COVER for b in periods.COVER}) == list(range(31))
    assert periods.SHIFT.max() < 31


@pytest.mark.parametrize("n, letters", [(0, 1), (1, 1), (40, 1), (700, 1), (900, 2), (500, 60), (3000, 3)])
def test_extensions(n, letters):
    rng = np.random.default_rng(n + letters)
    codes = rng.integers(0, letters, n)
    if n > 800:
        codes[400:800] = np.tile(codes[:50], 8)
        codes[n // 2:n // 2 + 90] = codes[:90]
    lcp = periods.Extensions(codes)
    if not n:
        return
    i, j = rng.integers(0, n + 1, 4000), rng.integers(0, n + 1, 4000)
    i, j = i[i != j], j[i != j]
    want = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        k = 0
        while max(a, b) + k < n and codes[a + k] == codes[b + k]:
            k += 1
        want.append(k)
    assert lcp.ask(i, j).tolist() == want


def made():
    """Texts with nested, neighbouring, overlapping and cut-off repetitions."""
    rng = random.Random(11)
    out = []
    for k in range(120):
        w: list[str] = []
        while len(w) < rng.choice([10, 60, 200, 500]):
            unit = rng.choices("abcdef", k=rng.randint(1, 30))
            for _ in range(rng.randint(0, 2)):
                unit = unit * rng.choice([1, 2, 3, 4])
            w += rng.choices("abxyz", k=rng.randint(0, 5)) + unit[:rng.randint(1, len(unit))] + unit * rng.choice([0, 1, 2, 3, 5])
        out.append(w if k else ["a"] * 300)
    return out


def test_runs(spark, monkeypatch):
    """Small batches and few places asked at once give the same."""
    texts = made()
    docs = spark.createDataFrame([(k, " \n".join(w)) for k, w in enumerate(texts)], "doc_id long, text string").repartition(2)
    want = Counter(row(k, " ".join(w).encode().split()) for k, w in enumerate(texts))
    assert sum(r[1] for r in want) > 100
    for chars, asked in ((4_000_000, 500_000), (900, 40)):
        monkeypatch.setattr(periods, "BATCH_CHARS", chars)
        monkeypatch.setattr(periods, "ASKED", asked)
        found = periods.find(docs)
        assert Counter(map(tuple, found.drop("n_words", "runs").collect())) == want
    assert Counter((r.doc_id, tuple(map(tuple, r.runs))) for r in found.collect()) == Counter((k, tuple(sorted(brute(" ".join(w).encode().split()), key=lambda r: (r[0], r[2])))) for k, w in enumerate(texts))


def test_awkward_rows(docs, nothing):
    got = periods.find(docs)
    assert got.columns == ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.drop("n_words", "runs").collect())) == Counter(row(d, words(t)) for d, t, *_ in rows() if d != 12) + Counter(map(tuple, got.where("doc_id = 12").drop("n_words", "runs").collect()))
    assert got.where("doc_id = 12").first().n_words == 20_000
    assert periods.find(nothing).count() == 0


def test_query(spark, tmp_path):
    """The query's own texts: a tenth of the documents repeat a stretch to their end."""
    texts = [(d, " ".join(w) if d % 3 else None) for d, w in enumerate(made() * 2)] + [(None, "a b " * 20), (None, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for doc, text in texts:
        w = words(text)
        h, n = zlib.crc32(str(doc).encode()), len(w)
        if doc is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want[row(doc, w)] += 1
    got = QUERIES["op11_word_runs"](spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"), ("exponent_milli", "bigint"), ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    assert Counter(map(tuple, got.collect())) == want
