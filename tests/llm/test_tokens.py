"""Token store, packing, attribution and SentencePiece scan against the tokenizer libraries themselves."""

import glob
import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import rows
from tidewatch.llm import attribution, packing, pieces, token_store, tokens
from tidewatch.session import scratch_path


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def ordered():
    """Rows as the store orders them: missing ids first, then by id and text."""
    return sorted(((d, t or "") for d, t, *_ in rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_encoder_equals_the_library(vocabulary, name):
    encoder = tokens.PieceEncoder(vocabulary(name))
    odd = ["", " ", "  ", "a  b", " a", "a ", "a\n b", "x <|endoftext|> y", "x<|endoftext|>y", "a\x1cb", "a\u0085b", "K ﬁ", "1234 12,5 ²³", "\t a\r\nb", "'s 's'S", "Σας", "é x"]
    for text in odd + [t or "" for _, t, *_ in rows()]:
        assert encoder.array(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text[:40]


def test_token_store(spark, docs, vocabulary):
    file = vocabulary("word_bpe_49k.json")
    path = scratch_path(spark, "store")
    token_store.write_store(docs, path, file, end_id=2)
    library = Tokenizer.from_file(file)
    want, at = [], 0
    for doc, text in ordered():
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        want.append((doc, at, len(ids), crc(ids)))
        at += len(ids)
    got = token_store.read_store(spark, path).drop("ids").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    found = token_store.lookup(spark, path, [3, 10, 555]).collect()
    assert sorted(r.doc_id for r in found) == [3, 10]
    assert all(np.frombuffer(r.ids, "<u2").tolist() == library.encode(dict(ordered())[r.doc_id], add_special_tokens=False).ids + [2] for r in found)
    assert spark.read.parquet(f"{path}/segments").select("dict_hash").distinct().count() == 1


def test_lookup_reads_few_row_groups(spark, vocabulary, monkeypatch, capsys):
    """400 documents in segments of 600 bytes: one id is looked up in under 2 % of the bytes, by statistics in the files."""
    monkeypatch.setattr(token_store, "SEGMENT_BYTES", 600)
    monkeypatch.setattr(token_store, "GROUP_BYTES", 1000)
    file, path = vocabulary("word_bpe_49k.json"), scratch_path(spark, "store")
    docs = spark.createDataFrame([(3 * i if i > 5 else None, " ".join(f"w{i * j % 9973}" for j in range(60))) for i in range(400)], "doc_id long, text string")
    token_store.write_store(docs, path, file, end_id=2)
    groups = [g for f in glob.glob(f"{path}/segments/*.parquet") for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]

    def bounds(g):
        first, last = (next(c for c in map(g.column, range(g.num_columns)) if c.path_in_schema == n).statistics for n in ("first_id", "last_id"))
        return (first.min, last.max) if first.has_min_max else None

    asked = 3 * 177
    hit = [g.total_byte_size for g in groups if bounds(g) and bounds(g)[0] <= asked <= bounds(g)[1]]
    assert hit and sum(hit) < 0.02 * sum(g.total_byte_size for g in groups)
    token_store.holding(spark, path, [asked]).explain("formatted")
    plan = capsys.readouterr().out
    assert f"LessThanOrEqual(first_id,{asked})" in plan and f"GreaterThanOrEqual(last_id,{asked})" in plan
    assert [r.doc_id for r in token_store.lookup(spark, path, [asked, asked + 1]).collect()] == [asked]
    many = list(range(100, 1100, 2))
    assert sorted(r.doc_id for r in token_store.lookup(spark, path, many).collect()) == [d for d in many if d % 3 == 0]
    assert token_store.lookup(spark, path, []).count() == 0
    assert token_store.read_store(spark, path).count() == 400


def test_empty_token_store(spark, nothing, vocabulary):
    path = scratch_path(spark, "store")
    token_store.write_store(nothing, path, vocabulary("word_bpe_49k.json"), end_id=2)
    assert token_store.read_store(spark, path).count() == 0


def test_packing(docs, nothing, vocabulary):
    file = vocabulary("byte_bpe_50k.json")
    got = packing.pack(docs, file, end_id=1, length=256).collect()
    library = Tokenizer.from_file(file)
    want = Counter((d, tuple(library.encode(t, add_special_tokens=False).ids + [1])) for d, t in ordered())
    # Rebuild documents from pieces: repeated ids are told apart by their sequence and order.
    pieces_of = {}
    for r in got:
        assert r.length == len(r.ids) // 2 and r.ids_crc32 == crc(np.frombuffer(r.ids, "<u2"))
        pieces_of.setdefault((r.doc_id, r.doc_tokens, r.start), []).append(tuple(np.frombuffer(r.ids, "<u2").tolist()))
    for (doc, ids), times in want.items():
        at = 0
        while at < len(ids):
            options = [p for p in pieces_of[doc, len(ids), at] if p == ids[at:at + len(p)]]
            assert options
            at += len(options[0])
    assert sum(r.length for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0
    assert packing.pack(nothing, file, end_id=1).count() == 0


def test_hilbert_curve_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert(grid, bits=3)
    assert sorted(keys) == list(range(512))
    steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_attribution_by_line(docs, nothing, vocabulary):
    file = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(file)
    got = {}
    for r in attribution.count_tokens(docs, file, rule="most").collect():
        got.setdefault((r.doc_id, r.doc_tokens), []).append((r.section, r.start, r.length, r.n_tokens))
    for doc, text in ordered():
        e = library.encode(text, add_special_tokens=False)
        lines = text.splitlines(keepends=True) if "\x1c" not in text and "\x85" not in text else [text]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).tolist() if lines else [0, 0]
        counts = Counter()
        for a, b in e.offsets:
            counts[max(range(len(starts) - 1), key=lambda i: (min(b, starts[i + 1]) - max(a, starts[i]), -i))] += 1
        want = [(i, starts[i], starts[i + 1] - starts[i], float(counts[i])) for i in range(len(starts) - 1)]
        assert all(w in got[doc, len(e.ids)] for w in want)
    assert attribution.count_tokens(nothing, file).count() == 0


def test_attribution_rules_and_fields(spark, vocabulary):
    borders = np.array([0, 3, 4, 10])
    start, end = np.array([0, 2, 5]), np.array([2, 5, 10])
    assert attribution.allocate(start, end, borders, "start").tolist() == [2, 0, 1]
    assert attribution.allocate(start, end, borders, "end").tolist() == [1, 0, 2]
    assert attribution.allocate(start, end, borders, "most").tolist() == [2, 0, 1]
    np.testing.assert_allclose(attribution.allocate(start, end, borders, "share"), [1 + 1 / 3, 1 / 3, 1 + 1 / 3])
    turns = spark.createDataFrame([(1, 0, "user", "Hello there"), (1, 1, None, "")], "conv_id long, turn int, role string, text string")
    for rule in attribution.RULES:
        out = attribution.count_tokens(turns, vocabulary("byte_bpe_50k.json"), ["role", "text"], rule, keep=("conv_id", "turn")).collect()
        assert len(out) == 4
        for turn in (0, 1):
            mine = [r for r in out if r.turn == turn]
            assert sum(r.n_tokens for r in mine) == pytest.approx(mine[0].doc_tokens)
    with pytest.raises(ValueError):
        attribution.count_tokens(turns, "x", rule="none")


@pytest.mark.parametrize("chunk", [400, 50_000])
def test_pieces_equal_the_library(docs, nothing, vocabulary, chunk):
    import sentencepiece

    file = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=file)
    encoded = pieces.encode(docs, file, chunk=chunk)
    got = Counter((r.doc_id, r.n_tokens, r.ids_crc32, r.decoded_sha256) for r in encoded.collect())
    want = Counter((d, len(i), crc(i), hashlib.sha256(t.encode()).hexdigest()) for d, t in ordered() for i in [library.encode(t)])
    assert got == want
    assert Counter(map(tuple, pieces.decode(encoded, file).collect())) == Counter(ordered())
    assert pieces.encode(nothing, file).count() == 0


def test_transfer_matrices_combine_associatively():
    r = np.random.default_rng(3)
    a, b, c = (np.where(r.random((4, 4)) < 0.3, -np.inf, r.random((4, 4))) for _ in range(3))
    np.testing.assert_allclose(pieces.combine(pieces.combine(a, b), c), pieces.combine(a, pieces.combine(b, c)))
