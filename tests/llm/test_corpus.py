"""Rules, classifier, fingerprints and deduplication against brute force on a table of awkward rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, prose, rows
from tidewatch.llm import blocks, gam, graph, rules, simhash, substrings, suffixes, syncmers, tables, windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Quality rules

def counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_rule_counts(docs, labels):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.apply_rules(docs, labels).collect())
    want = Counter((d, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]) for d, t, *_ in rows() for c in [counts(t)])
    assert got == want


def test_binomial_tail(spark):
    cases = [(0, 50), (3, 900), (12, 3000), (700, 90_000), (5, 100), (2, 400)]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", rules.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    for r in got:
        exact = math.fsum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.01) + (r.n - i) * math.log(0.99)) for i in range(r.k + 1))
        assert r.p == pytest.approx(1.0 if r.k >= r.n * 0.01 else exact, rel=1e-8)


def test_cutoffs_keep_good_documents(spark):
    """Many labelled documents: junk goes, the share of good documents lost per stratum stays under the stated risk."""
    made = [(i, prose(i, 20) if i % 10 else "a### b*** " + " ".join(f"{w}$$$" for w in prose(i, 14).split()), "en" if i % 3 else "de") for i in range(6000)]
    many = spark.createDataFrame(made, "doc_id long, text string, lang string").repartition(4)
    marks = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(6000)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in rules.apply_rules(many, marks).where("kept").select("doc_id").collect()}
    assert not any(i in kept for i in range(0, 6000, 10))
    for lang in (0, 1):
        good = [i for i in range(6000) if i % 10 and bool(i % 3) == bool(lang)]
        assert sum(i not in kept for i in good) <= 0.05 * len(good)
    assert set(rules.keep(many, marks).columns) == {"doc_id", "text", "lang"}
    # Without labels only the base rules hold.
    none = rules.apply_rules(many, marks.limit(0)).where("not kept and not base_failed").count()
    assert none == 0


def test_rules_on_nothing(docs, nothing, labels):
    assert rules.apply_rules(nothing, labels).count() == 0
    kept = rules.keep(docs, labels)
    assert kept.columns == docs.columns and kept.exceptAll(docs).isEmpty() and kept.count() > 5
    assert rules.keep(docs.drop("lang"), labels).count() == rules.keep(docs, labels.limit(0)).count()


# Classifier

def test_classifier_learns_and_scores_every_row(spark, docs, nothing, labels):
    junk = lambda i: " ".join([prose(i, 1)] * 30) if i % 2 else "!!! ### " + prose(i, 20).upper()
    made = [(i, prose(i, 60) if i % 4 else junk(i // 4)) for i in range(1200)]
    corpus = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(1200)], "doc_id long, quality int, toxic int")
    model = gam.train(corpus, marks)
    held = corpus.where(gam.held_out(F.col("doc_id"))).select("doc_id", gam.scorer(model)(F.col("text")).alias("s")).collect()
    assert len(held) > 150 and np.mean([(r.s >= 0.5) == (r.doc_id % 4 != 0) for r in held]) > 0.97
    scored = docs.select("doc_id", gam.scorer(model)(F.col("text")).alias("s")).collect()
    assert len(scored) == len(rows()) and all(0 <= r.s <= 1 for r in scored)
    assert nothing.select(gam.scorer(model)(F.col("text"))).count() == 0
    blank = gam.train(docs, labels.limit(0))
    assert {r[0] for r in docs.select(gam.scorer(blank)(F.col("text"))).collect()} == {0.5}


def test_pair_tables_catch_an_interaction():
    r = np.random.default_rng(1)
    x = r.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x, y)
    assert (0, 1) in {tuple(sorted(p)) for p in model.pairs}
    fresh = r.random((2000, 4))
    assert np.mean((model.score(fresh) > 0.5) == ((fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.5))) > 0.9


# SimHash

def naive_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(words)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, docs, nothing):
    # A chain of texts that differ in one word each, besides the awkward rows.
    words = prose(77, 400).split()
    chain = [(1000 + k, " ".join(w if i >= k else f"z{i}" for i, w in enumerate(words))) for k in range(12)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(chain, "doc_id long, text string"))
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(both).collect()]
    texts = [(d, t) for d, t, *_ in rows()] + chain
    prints = [naive_fingerprint(t) for _, t in texts]
    root = list(range(len(texts)))
    for _ in root:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if bin(a ^ b).count("1") <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    least = defaultdict(list)
    for (d, _), r in zip(texts, root, strict=True):
        if d is not None:
            least[r].append(d)
    want = Counter((d, f"{p:016x}", min(least[r], default=None)) for (d, _), p, r in zip(texts, prints, root, strict=True))
    assert Counter((d, bytes(f).hex(), c) for d, f, c in got) == want
    assert simhash.near_duplicates(nothing).count() == 0


def test_large_buckets_are_split_without_loss(spark, monkeypatch):
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 3, dtype=np.uint64)
    made = sorted({int(base[r.integers(3)]) ^ sum(1 << int(b) for b in r.integers(0, 64, r.integers(0, 4))) for _ in range(400)})
    distinct = spark.createDataFrame([(bytearray(v.to_bytes(8, "big")), v - (1 << 64) if v >> 63 else v) for v in made], "fp binary, node long")
    monkeypatch.setattr(simhash, "BUCKET", 30)
    monkeypatch.setattr(simhash, "RUN", 8)
    roots = {r.node & (1 << 64) - 1: r.root for r in graph.components(simhash.links(distinct, simhash.EXACT)).collect()}
    forest = simhash.Forest()
    for i, a in enumerate(made):
        for b in made[:i]:
            if bin(a ^ b).count("1") <= 3:
                forest.join(a, b)
    groups = defaultdict(set)
    for v in made:
        groups[forest.root(v)].add(roots.get(v, v))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_similar_documents_leave_one(spark, docs):
    words = prose(5, 300).split()
    near = [(50 + k, " ".join("new" if i == 40 * k + 7 else w for i, w in enumerate(words))) for k in range(6)]      # Jaccard about 0.93
    far = [(70 + k, prose(500 + k, 300)) for k in range(20)]
    made = spark.createDataFrame(near + far, "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.keep_one(made).collect())
    assert kept == [50] + list(range(70, 90))
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns and out.exceptAll(docs).isEmpty()
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(15) == 1 and 4 not in ids and 1 in ids and ids.count(None) == 2


def shingles_of(text):
    words = text.split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_copies_have_the_similarity_itself(spark):
    """Pairs planted around 0.75, 0.80 and 0.85: none below 0.8 is linked, and almost all from 0.8 on are."""
    pairs, texts = [], []
    for k in range(450):
        words = prose(2000 + k, 300).split()
        changed = (8, 6, 5)[k % 3]                         # five shingles go with each word and five come: 0.76, 0.82, 0.84
        step = 300 // changed
        other = [f"z{i}" if i % step == step // 2 and i // step < changed else w for i, w in enumerate(words)]
        if k % 3 == 1:                                     # down to 0.80
            other = other[3:]
        a, b = " ".join(words), " ".join(other)
        pairs.append((2 * k, 2 * k + 1, jaccard(shingles_of(a), shingles_of(b))))
        texts += [(2 * k, a), (2 * k + 1, b)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()}
    assert kept >= {a for a, _, _ in pairs}
    below = [b in kept for _, b, j in pairs if j < 0.8]
    near = [b not in kept for _, b, j in pairs if 0.8 <= j < 0.83]
    nearer = [b not in kept for _, b, j in pairs if j >= 0.83]
    assert min(len(below), len(near), len(nearer)) >= 140
    assert all(below) and sum(near) >= 0.96 * len(near) and sum(nearer) >= 0.98 * len(nearer)


@pytest.mark.parametrize("most", [4_000_000, 1_000])
def test_families_of_templated_texts_against_brute_force(spark, monkeypatch, most):
    """Texts of one template are not chained together by links below 0.8; with the small limit every family is split."""
    monkeypatch.setattr(simhash, "SHINGLES", most)
    r = np.random.default_rng(9)
    texts = []
    for family in range(12):
        base = prose(5000 + family, 250).split()
        for k in range(12):
            spots = set(r.integers(0, 250, r.integers(1, 9)).tolist())
            texts.append((100 * family + k, " ".join(f"y{family}x{k}x{i}" if i in spots else w for i, w in enumerate(base))))
    sets = [shingles_of(t) for _, t in texts]
    forest = simhash.Forest()
    for i, a in enumerate(sets):
        for j in range(i):
            if jaccard(a, sets[j]) >= 0.8:
                forest.join(texts[i][0], texts[j][0])
    want = {forest.root(d) for d, _ in texts}
    assert 12 < len(want) < 130
    assert {x.doc_id for x in simhash.keep_one(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()} == want


def test_components_of_long_paths(spark):
    path = [(i, i + 1) for i in range(300)] + [(1000, k) for k in range(1001, 1100)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[i] for i in range(1000, 1100)} == {1000}


# Suffix arrays and substrings

def test_suffix_array_and_common_prefixes():
    r = np.random.default_rng(0)
    for trial in range(60):
        text = np.append(np.tile(r.integers(1, 1 + r.integers(1, 5), r.integers(1, 30)), 1 + 4 * (trial % 3 == 0)), 0)
        order, plain = suffixes.suffix_array(text), text.tolist()
        assert order.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
        common = suffixes.permuted_common_prefixes(text, order, np.arange(len(text)) == 0, 500)
        for a, b in zip(order[1:].tolist(), order.tolist(), strict=False):
            k = 0
            while max(a, b) + k < len(plain) and plain[a + k] == plain[b + k]:
                k += 1
            assert common[a] == k


def naive_bytes(texts, length):
    """Documents by ascending id; a missing id loses nothing and comes last."""
    seen, out = set(), []
    for doc, text in sorted(((d, t or "") for d, t in texts), key=lambda x: (x[0] is None, x[0] or 0)):
        raw = text.encode()
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - length + 1):
            if raw[i:i + length] in seen and doc is not None:
                gone[i:i + length] = True
            seen.add(raw[i:i + length])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((doc, len(raw), int(gone.sum()), len(edges) // 2, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("crowded", [5000, 1])
def test_substrings_against_brute_force(spark, docs, nothing, monkeypatch, crowded):
    """With the limit at one, every anchor is divided by what the windows of a part share."""
    monkeypatch.setattr(substrings, "CROWDED", crowded)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 4000)
    r = np.random.default_rng(2)
    passages = [prose(300 + k, 40) for k in range(6)]
    mixed = [(100 + k, " ".join([prose(400 + k, 15), passages[r.integers(6)][r.integers(40):], prose(600 + k, 9), passages[r.integers(6)]])) for k in range(60)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(mixed, "doc_id long, text string")).repartition(5)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.removed(both).collect())
    assert got == naive_bytes([(d, t) for d, t, *_ in rows()] + mixed, 100)
    assert substrings.removed(nothing).count() == 0


@pytest.mark.parametrize("single", [10_000, 20])
def test_a_passage_in_many_documents_is_sent_once(spark, monkeypatch, single):
    """Differing neighbours make every border run distinct, yet a shard holds no string of bytes twice."""
    monkeypatch.setattr(substrings, "CROWDED", 10)
    monkeypatch.setattr(substrings, "SINGLE", single)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 8000)
    passage = prose(1, 60)
    texts = [(k, f"{prose(4000 + k, 25)} {passage} {prose(6000 + k, 25)}") for k in range(120)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.removed(frame).collect())
    assert got == naive_bytes(texts, 100)
    stored = blocks.write_blocks(frame, "b")
    notes = tables.staged_small(substrings.sorted_out(substrings.records(stored, 100, 16)), "n")
    rows = substrings.called(stored, notes, 100).where("n > 0")
    assert rows.groupBy("block", "key", "bytes").count().where("count > 1").isEmpty()
    if single == 20:       # what meets under a key of a very crowded anchor is one string
        assert rows.groupBy("key").agg(F.count_distinct("bytes").alias("k"), F.count(F.lit(1)).alias("n")).where("k > 20").isEmpty()


def test_windows_against_brute_force(spark, docs, nothing, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 4000)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.n_spans, r.kept_sha256) for r in windows.removed(blocks.write_blocks(docs, "w")).collect())
    words = [(d, WORD.findall(t or "")) for d, t, *_ in rows()]
    first = {}
    for d, w in words:
        for i in range(len(w) - 49):
            key = tuple(w[i:i + 50])
            first[key] = min(first.get(key, math.inf), math.inf if d is None else d)
    want, texts = [], []
    for (d, w), (_, text, *_) in zip(words, rows(), strict=True):
        gone = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i:i + 50])] < d:
                gone[i:i + 50] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        want.append((d, len(w), int(gone.sum()), len(edges) // 2, hashlib.sha256(" ".join(kept).encode()).hexdigest()))
        texts.append((d, text if not gone.any() else kept))
    assert got == Counter(want)
    cut = windows.cut(docs)
    assert cut.schema == docs.schema or [f.name for f in cut.schema] == docs.columns
    rest = Counter((r.doc_id, r.text if r.text is None else tuple(WORD.findall(r.text)), r.start, r._m) for r in cut.collect())
    assert rest == Counter((d, None if t is None else tuple(t) if isinstance(t, list) else tuple(WORD.findall(t)), 9, "m") for d, t in texts)
    assert windows.cut(nothing).count() == 0


# Syncmers

def test_syncmers(docs, nothing):
    got = syncmers.edited(docs).collect()
    order = sorted(((d, t or "") for d, t, *_ in rows()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (d, t) in enumerate(order):
        half = len(t) // 2
        want.append((d, len(t), hashlib.sha256((t[:len(t) - half] + order[(k + 1) % len(order)][1][:half]).encode()).hexdigest()))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(want)
    prints = defaultdict(set)
    texts = {(d, len(t)): t for d, t in order}
    for r in got:
        prints[texts[r.doc_id, r.n_chars]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.near_edited > r.near_next or r.n_chars < 200 or r.near_next == 1.0 or r.doc_id == 9   # its next is its near copy
    assert all(len(p) == 1 for p in prints.values())
    assert syncmers.edited(nothing).count() == 0


def test_anchors_do_not_depend_on_what_surrounds_them(spark):
    core = prose(3, 60)
    made = spark.createDataFrame([(0, core), (1, prose(4, 30) + " " + core), (2, prose(5, 100))], "doc_id long, text string")
    kept = {r.doc_id: {x >> syncmers.PLACE for x in r.a} for r in made.select("doc_id", syncmers.anchors(F.col("text")).alias("a")).collect()}
    assert len(kept[0] & kept[1]) >= 0.5 * len(kept[0]) and not kept[0] & kept[2]
    pair = made.select("doc_id", syncmers.anchors(F.col("text")).alias("a"))
    a = pair.where("doc_id = 0").select(F.col("a"))
    b = pair.where("doc_id = 1").select(F.col("a").alias("b"))
    assert a.join(b).select(syncmers.likeness(F.col("a"), F.col("b"))).first()[0] > 0.3


# Pipeline

def test_pipeline_stages(spark, tmp_path, docs, nothing, labels):
    import corpus_pipeline

    plain = [c for c in SCHEMA.split(", ")]
    for corpus in (docs, nothing):
        where = str(tmp_path / f"in{corpus.count()}")
        corpus.write.parquet(f"{where}/documents.parquet")
        labels.write.parquet(f"{where}/labels.parquet")
        frame = spark.read.parquet(f"{where}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, where)
            assert out.columns == [c.split()[0] for c in plain], name
            assert out.count() <= frame.count()
        packed = corpus_pipeline.run(spark, where)
        assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(packed.columns)
        ids = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
        assert ids <= {r[0] for r in rows()}
        if corpus is docs:
            assert 13 not in ids and 5 not in ids and not {1, 4} <= ids and 12 in ids
