"""Syncmer fingerprints and likeness against a plain version, with texts beyond 65,536 pieces."""

import re

import pytest
import xxhash
from conftest import prose, rows
from pyspark.sql import functions as F

from tidewatch.llm import syncmers as S


def _chain(*numbers):
    seed = 42
    for n in numbers:
        seed = xxhash.xxh64_intdigest(n.to_bytes(8, "little"), seed)
    return seed


def _signed(n):
    return n - (1 << 64) if n >> 63 else n


def plain_anchors(text):
    """Hash and first place of every kept anchor."""
    pieces = re.findall("[^\x20\x09-\x0D]{1,24}", text or "")
    if not pieces:
        return {}
    if len(pieces) < 4:
        return {xxhash.xxh64_intdigest(" ".join(pieces).encode(), 42) & 0xFFFFFFFF: 0}
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    inner = [_chain(a, b) for a, b in zip(h, h[1:])]
    found = {}
    for i in range(len(inner) - 2):
        a, b, c = inner[i:i + 3]
        if min(_signed(a), _signed(c)) <= _signed(b):
            found.setdefault(_chain(a, b, c) & 0xFFFFFFFF, i)
    order = sorted(found)
    return {x: found[x] for k, x in enumerate(order) if k < 48 or x < 2 ** 32 // 16}


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    union = [x for k, x in enumerate(sorted(a.keys() | b.keys())) if k < 48 or x < 2 ** 32 // 16]
    shifts = sorted(b[x] - a[x] for x in union if x in a and x in b)
    return sum(abs(s - shifts[len(shifts) // 2]) <= 8 for s in shifts) / len(union)


@pytest.fixture(scope="module")
def texts():
    tail, long = prose(77, 400), prose(55, 70_000)
    return [t for _, t, *_ in rows()] + [prose(41, 20_000) + " " + tail, prose(42, 19_000) + " " + tail, tail, long, prose(56, 300) + " " + long, "a b c", "a b c d"]


@pytest.fixture(scope="module")
def made(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return df.select("doc_id", S.anchors(F.coalesce("text", F.lit(""))).alias("a")).cache()


def test_anchors_equal_the_plain_version(made, texts):
    for r in made.collect():
        want = plain_anchors(texts[r.doc_id])
        assert r.a == sorted(r.a) and {x >> S.PLACE: x & (2 ** S.PLACE - 1) for x in r.a} == want
    printed = made.select(S.as_text(F.col("a")).alias("t"), F.size("a").alias("n")).collect()
    assert all(len(r.t) == 16 * r.n for r in printed)


def test_likeness_equals_the_plain_version(made, texts):
    """Every text against the one after it and against some others, both ways."""
    n = len(texts)
    pairs = [(i, (i + k) % n) for i in range(n) for k in (0, 1, 3, n - 1)]
    a, b = made.select(F.col("doc_id").alias("i"), F.col("a")), made.select(F.col("doc_id").alias("j"), F.col("a").alias("b"))
    wanted = made.sparkSession.createDataFrame(pairs, "i long, j long")
    plain = [plain_anchors(t) for t in texts]
    for r in wanted.join(a, "i").join(b, "j").select("i", "j", S.likeness(F.col("a"), F.col("b")).alias("p")).collect():
        assert r.p == pytest.approx(plain_likeness(plain[r.i], plain[r.j]), abs=1e-12), (r.i, r.j)


def test_shared_passages_of_long_texts_are_seen(made, texts):
    """The last 400 words of 20,000 are shared; a text of 70,000 pieces stands whole behind 300 others."""
    n = len(texts) - 7
    one = made.where(F.col("doc_id") == n).select(F.col("a"))
    two = made.where(F.col("doc_id") == n + 1).select(F.col("a").alias("b"))
    assert one.join(two).select(S.likeness(F.col("a"), F.col("b"))).first()[0] > 0
    one = made.where(F.col("doc_id") == n + 3).select(F.col("a"))
    two = made.where(F.col("doc_id") == n + 4).select(F.col("a").alias("b"))
    assert one.join(two).select(S.likeness(F.col("a"), F.col("b"))).first()[0] > 0.95
