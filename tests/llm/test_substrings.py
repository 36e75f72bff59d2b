"""What substring deduplication sends where: even buckets, and only parts that share more than their anchor."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from conftest import prose
from pyspark.sql import functions as F

from tidewatch.llm import blocks, substrings, suffixes, tables


def _frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


def _plain(texts, length=100):
    seen, out = set(), []
    for doc, text in enumerate(texts):
        raw, gone = text.encode(), set()
        for i in range(len(raw) - length + 1):
            if raw[i:i + length] in seen:
                gone.update(range(i, i + length))
            seen.add(raw[i:i + length])
        out.append((doc, len(gone), hashlib.sha256(bytes(b for i, b in enumerate(raw) if i not in gone)).hexdigest()))
    return Counter(out)


def _got(frame):
    return Counter((r.doc_id, r.n_removed, r.kept_sha256) for r in substrings.removed(frame).collect())


def test_buckets_are_even(spark):
    """Anchors are least hashes; by their own top bits a third of them would be in the first of 64 buckets."""
    texts = [prose(7000 + k, 400) for k in range(60)]
    found = substrings.records(blocks.write_blocks(_frame(spark, texts), "b"), 100, 64)
    sizes = found.groupBy("bucket").agg(F.sum(F.length("c")).alias("n")).toPandas()["n"]
    assert len(sizes) == 64 and sizes.max() < 2 * sizes.mean()


def test_a_shared_anchor_alone_sends_no_bytes(spark):
    """A passage of 45 bytes is in no window of 100 that two texts share, however many hold it."""
    passage = "0123456789 abcdefghij KLMNOPQRST uvwxyz 98765"
    texts = [f"{prose(4000 + k, 25)} {passage} {prose(6000 + k, 25)}" for k in range(80)]
    stored = blocks.write_blocks(_frame(spark, texts), "b")
    notes = tables.staged_small(substrings.sorted_out(substrings.records(stored, 100, 16)), "n")
    assert notes.where("kind = 1").count() > 0
    assert substrings.called(stored, notes, 100).where("n > 0").isEmpty()


def test_parts_against_brute_force(spark, monkeypatch):
    """Copies edited at a place of their own, in halves, in small parts and in single windows; a chunk of few runs."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 6000)
    whole = prose(1, 120)
    texts = [whole[:40 + 9 * k] + f"<{k}>" + whole[40 + 9 * k:] for k in range(60)] + [whole, whole, prose(2, 60) + whole]
    want = _plain(texts)
    for crowded, single, chunk in ((500, 10_000, 1 << 20), (2, 10_000, 2000), (2, 3, 500)):
        monkeypatch.setattr(substrings, "CROWDED", crowded)
        monkeypatch.setattr(substrings, "SINGLE", single)
        monkeypatch.setattr(substrings, "CHUNK", chunk)
        assert _got(_frame(spark, texts)) == want


def test_a_key_with_one_string_needs_no_suffix_array(spark, monkeypatch):
    """Rows of equal key and bytes are lost to the first; only keys with two strings are sorted by suffixes."""
    sorted_ = []
    monkeypatch.setattr(suffixes, "suffix_array", lambda text, of=suffixes.suffix_array: sorted_.append(len(text)) or of(text))
    one, two = (b"x" * 40 + bytes(range(65, 125)) + tail for tail in (b"aa", b"ab"))
    rows = [(1, 5, 0, 10, 3, 50, one), (1, 6, 0, 20, 3, 60, one), (2, 5, 0, 100, 3, 140, one), (2, 7, 0, 200, 3, 240, two), (3, 9, 0, 400, 3, 440, one)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["key", "doc", "block", "p", "n", "anchor", "bytes"])
    lost = sorted(x for b in substrings.shards(iter([batch]), 100) for r in b.column("reply").to_pylist() for x in np.frombuffer(r, dtype=substrings._LOST).tolist())
    assert lost == [(20, 3), (200, 2)]
    assert sorted_[0] == len(one) + len(two) + 3 and max(sorted_) == sorted_[0]
