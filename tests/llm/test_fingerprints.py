"""Fingerprints of documents hold every anchor, and likeness goes by all of them: against a plain version."""

import hashlib
import re

import pytest
import xxhash
from conftest import prose
from pyspark.sql import functions as F

from tidewatch.llm import syncmers as S
from tidewatch.llm.queries import QUERIES


def _chain(*numbers):
    seed = 42
    for n in numbers:
        seed = xxhash.xxh64_intdigest(n.to_bytes(8, "little"), seed)
    return seed


def _signed(n):
    return n - (1 << 64) if n >> 63 else n


def plain(text):
    """Hash and first place of every anchor."""
    pieces = re.findall("[^\x20\x09-\x0D]{1,24}", text or "")
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    inner = [_chain(a, b) for a, b in zip(h, h[1:], strict=False)]
    found = {}
    for i in range(len(inner) - 2):
        a, b, c = inner[i:i + 3]
        if min(_signed(a), _signed(c)) <= _signed(b):
            found.setdefault(_chain(a, b, c) & 0xFFFFFFFF, i)
    return found if found or not pieces else {xxhash.xxh64_intdigest(" ".join(pieces).encode(), 42) & 0xFFFFFFFF: 0}


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    shifts = sorted(b[x] - a[x] for x in a.keys() & b.keys())
    return sum(abs(s - shifts[len(shifts) // 2]) <= 8 for s in shifts) / len(a.keys() | b.keys())


def digits(found):
    return "".join(f"{x << S.PLACE | place:016x}" for x, place in sorted(found.items()))


def silent():
    """Three texts of four words whose only k-mer is no anchor (of two neighbouring ones one is)."""
    def none(k):
        return next(t for t in (prose(9000 + 50 * k + s, 4) for s in range(50)) if list(plain(t)) == [xxhash.xxh64_intdigest(t.encode(), 42) & 0xFFFFFFFF])
    return [none(0), none(1), none(2)]


@pytest.fixture(scope="module")
def texts():
    long = prose(61, 3000).split()
    changed = [*long[:1500], "changed", *long[1501:]]
    return [" ".join(long), " ".join(changed), prose(62, 20_000), "", "one two", *silent(), prose(63, 500), "ha ha ha " * 60, None, prose(64, 70) + " " + prose(63, 500)]


def test_a_document_is_told_by_every_anchor(spark, texts, tmp_path):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op7_syncmers"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        text, after = text or "", texts[k - 1] or ""
        half = len(text) // 2
        made = text[:len(text) - half] + after[:half]
        own, changed = plain(text), plain(made)
        assert (got[k].n_chars, got[k].edited_sha256) == (len(text), hashlib.sha256(made.encode()).hexdigest())
        assert (got[k].fingerprint, got[k].edited_fingerprint) == (digits(own), digits(changed))
        assert got[k].near_edited == pytest.approx(plain_likeness(own, changed), abs=1e-12)
        assert got[k].near_next == pytest.approx(plain_likeness(own, plain(after)), abs=1e-12)


def test_one_changed_word_of_three_thousand_is_seen(spark, texts):
    """The sketch may hold none of the four k-mers around it; every anchor does."""
    a, b = (spark.createDataFrame([(t,)], "t string").select(S.anchors(F.col("t"), True).alias(n)) for t, n in zip(texts[:2], "ab", strict=True))
    near = a.join(b).select(S.likeness(F.col("a"), F.col("b"), True)).first()[0]
    assert 0.99 < near < 1


def test_a_text_without_anchors_is_told_by_all_its_pieces(spark):
    """Before, such texts had empty fingerprints, so any two of them had likeness 1."""
    rows = spark.createDataFrame([(t,) for t in silent()], "t string")
    for every in (False, True):
        made = rows.select(S.anchors(F.col("t"), every).alias("a"))
        assert made.where(F.size("a") == 1).count() == made.distinct().count() == 3
        assert made.join(made.select(F.col("a").alias("b")), F.col("a") < F.col("b")).select(S.likeness(F.col("a"), F.col("b"), every)).distinct().collect() == [(0.0,)]
