"""Benchmark windows found by shift tables, against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose, rows
from tidewatch.llm import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width):
    out = Counter()
    strings = {}
    for item, text in items:
        w = words(text)
        m = min(width, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            strings.setdefault(tuple(w[k:k + m]), set()).add(item)
    sizes = {len(s) for s in strings}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if tuple(w[k:k + m]) in strings:
                    hit.update(range(k, k + m))
                    found |= strings[tuple(w[k:k + m])]
        out[doc, len(w), tuple(sorted(hit)), tuple(sorted(str(i) for i in found if i is not None))] += 1
    return out


def got(frame):
    return Counter((r.doc_id, r.n_words, tuple(k for s in r.spans for k in range(s.start, s.end)), tuple(r.item_ids)) for r in frame.collect())


ITEMS = [(1, prose(2, 30)), (2, prose(3, 14).upper().replace(" ", " -- ")), (3, "ha ha"), (4, "日本語"), (5, None), (6, ""), (7, "... !"), (None, prose(8, 12)), (8, prose(2, 30)),
         (9, prose(12, 40)), (9, prose(15, 12)), (10, "one two three")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in ITEMS], "item_id long, text string, doc_id int, spans string").repartition(3)


@pytest.mark.parametrize("shard", [contamination.SHARD_CHARS, 300])
def test_awkward_rows(docs, items, monkeypatch, shard):
    """One shard, and many passes over small shards, give the same."""
    monkeypatch.setattr(contamination, "SHARD_CHARS", shard)
    found = contamination.find(docs, items)
    assert found.columns == ["doc_id", "n_words", "n_hit", "spans", "item_ids"]
    assert got(found) == brute([r[:2] for r in rows()], ITEMS, 10)
    assert found.where("n_hit <> aggregate(spans, 0L, (s, x) -> s + x.end - x.start)").count() == 0


def test_small_alphabet(spark, monkeypatch):
    """Windows of every length over few words, so that blocks and buckets are full; batches and lanes are small."""
    monkeypatch.setattr(contamination, "BATCH_CHARS", 500)
    monkeypatch.setattr(contamination, "LANE", 7)
    monkeypatch.setattr(contamination, "COMPARED", 50)
    rng = random.Random(5)
    letters = "a b c dd É x1".split()
    items = [(i, " ".join(rng.choices(letters, k=rng.choice([1, 2, 3, 4, 5, 6, 9])))) for i in range(3, 40)]
    made = [(d, ", ".join(rng.choices([*letters, "zz", "q"], k=rng.randint(0, 120)))) for d in range(60)]
    frame = spark.createDataFrame(made, "doc_id long, text string").repartition(2)
    for width in (1, 2, 4, 5):
        own = [(i, t) for i, t in items if len(t.split()) >= width]
        assert got(contamination.find(frame, spark.createDataFrame(own, "item_id long, text string"), width)) == brute(made, own, width)


def test_nothing(docs, nothing, items, spark):
    assert contamination.find(nothing, items).count() == 0
    none = contamination.find(docs, items.limit(0))
    assert none.count() == len(rows()) and none.where("n_hit > 0 or size(item_ids) > 0").count() == 0


def test_keep_clean(docs, items):
    kept = contamination.keep_clean(docs, items)
    assert kept.columns == docs.columns
    leaked = {d for (d, _, hit, _) in brute([r[:2] for r in rows()], ITEMS, 10) if hit and d is not None}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, *_ in rows() if d not in leaked)


def test_query_columns(spark, tmp_path, docs, items):
    from tidewatch.llm.queries import QUERIES

    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    items.select("item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = QUERIES["op12_contamination"](spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"), ("contaminated", "boolean")]
    assert out.where(F.col("contaminated") != (F.col("n_hit") > 0)).count() == 0
