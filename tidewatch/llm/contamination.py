"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are all windows of ``width`` consecutive words of the items; an item of fewer words, but not none, is one
window. Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. Texts become arrays of word numbers
in the items' vocabulary (0: a word of no item), so equal numbers are equal words and the comparison is exact.

Windows of equal length share one search. The shift table says for the hash of two adjacent words how far the window's
end may move without passing an occurrence (all of ``length - 1`` words if no test string holds the two); where it says
zero, the bucket of test strings with these last two words and the text's first two is compared word by word. A batch of
texts is searched from many starts at once, each moving by its own shifts.

The tables are broadcast. Items are dealt into shards of about ``SHARD_CHARS`` characters (a longer item is alone in its
shard), and each shard is one pass over the documents, so no broadcast grows with the number of items.

Defined results: a missing or empty text, or one without words, has no words and no hits. Missing item texts hold no
window; items without id mark words but are not listed; rows with one item id are one item. Every row of the documents
is judged alone, so repeated rows and ids have a row each. Texts are whole whatever their length. Other columns are not
read and cannot clash. An empty table of documents gives no rows, an empty table of items no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import tables
from tidewatch.session import staged

WIDTH = 10
#: Characters of items whose tables are broadcast at once.
SHARD_CHARS = 4_000_000
#: Characters of text searched at once, words each start is responsible for, and comparisons made at once.
BATCH_CHARS, LANE, COMPARED = 4_000_000, 256, 1_000_000
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
SCHEMA = "doc_id long, n_words long, n_hit long, spans array<struct<start: long, end: long>>, item_ids array<string>"

#: Bytes to the bytes of words: A-Z lower-cased, every other ASCII character that is no letter or digit a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(raw: bytes) -> list[bytes]:
    """The words of UTF-8 text."""
    return raw.translate(_FOLD).split()


class Search:
    """The Wu-Manber tables of test strings of one length, as rows of word numbers."""

    def __init__(self, strings: np.ndarray) -> None:
        self.strings, (n, self.length) = strings, strings.shape
        self.block = min(2, self.length)
        self.mask = (1 << max(12, (8 * n * self.length).bit_length())) - 1
        shift = np.full(self.mask + 1, self.length - self.block + 1, dtype=np.int64)
        for end in range(self.block - 1, self.length):
            np.minimum.at(shift, self._slot(strings[:, end - self.block + 1], strings[:, end]), self.length - 1 - end)
        self.shift = shift
        keys = self._bucket(strings, np.arange(n), 0)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def _slot(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        mixed = (first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + last.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (mixed >> np.uint64(20)).astype(np.int64) & self.mask

    def _bucket(self, codes: np.ndarray, rows: np.ndarray, axis: int) -> np.ndarray:
        """Hash of the last and first blocks of strings (``axis`` 0: whole rows, 1: from places of one long array)."""
        value = np.zeros(len(rows), dtype=np.uint64)
        for k in sorted({0, self.block - 1, self.length - self.block, self.length - 1}):
            word = codes[rows, k] if axis == 0 else codes[rows + k]
            value = (value ^ word.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        return value

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of all occurrences in ``codes``, and the rows of the strings that occur there."""
        at = np.arange(self.length - 1, len(codes), LANE)
        stop = np.minimum(at + LANE, len(codes))
        ends = []
        while len(at):
            step = self.shift[self._slot(codes[at - self.block + 1], codes[at])]
            ends.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        starts = np.concatenate(ends) - self.length + 1 if ends else np.zeros(0, dtype=np.int64)
        key = self._bucket(codes, starts, 1)
        low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
        starts, low, sizes = starts[high > low], low[high > low], (high - low)[high > low]
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // COMPARED)) + 1
        for part in np.split(np.arange(len(starts)), cuts):
            size = sizes[part]
            begin = np.repeat(starts[part], size)
            row = self.order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[part], size)]
            for k in range(self.length):
                same = codes[begin + k] == self.strings[row, k]
                begin, row = begin[same], row[same]
            found.append((begin, row))
        return np.concatenate([b for b, _ in found]), np.concatenate([r for _, r in found])


class Tables:
    """Vocabulary, searches and owners of the test strings of one shard of items."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int) -> None:
        self.number: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items if i is not None})
        place = {name: k for k, name in enumerate(self.names)}
        owners: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item, raw in items:
            codes = [self.number.setdefault(w, len(self.number) + 1) for w in words(raw)]
            length = min(width, len(codes))
            for k in range(len(codes) - length + 1 if length else 0):
                of = owners.setdefault(length, {}).setdefault(tuple(codes[k:k + length]), set())
                if item is not None:
                    of.add(place[item])
        self.searches = []
        for _, strings in sorted(owners.items()):
            held = list(strings.values())
            sizes = np.array([len(o) for o in held], dtype=np.int64)
            flat = np.fromiter(chain.from_iterable(sorted(o) for o in held), dtype=np.int64, count=int(sizes.sum()))
            self.searches.append((Search(np.array(list(strings), dtype=np.int64)), np.cumsum(sizes) - sizes, sizes, flat))

    def mark(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
        """Of texts: their numbers of words, each one's first place, which places are hit, and each one's items.

        Texts lie one after another with one place between them that matches nothing.
        """
        split = [words(t) for t in texts]
        counts = np.array([len(w) for w in split], dtype=np.int64)
        firsts = np.cumsum(counts + 1) - counts - 1
        total = int(counts.sum()) + len(texts)
        codes = np.fromiter(map(self.number.get, chain.from_iterable(chain(w, (None,)) for w in split), repeat(0)), dtype=np.int64, count=total)
        change, seen = np.zeros(total + 1, dtype=np.int64), [np.zeros(0, dtype=np.int64)]
        for search, begins, sizes, flat in self.searches:
            starts, rows = search.find(codes)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + search.length, -1)
            size = sizes[rows]
            item = flat[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begins[rows], size)]
            doc = np.searchsorted(firsts, np.repeat(starts, size), side="right") - 1
            seen.append(np.unique(doc * max(1, len(self.names)) + item))
        items: list[list[str]] = [[] for _ in texts]
        for pair in np.unique(np.concatenate(seen)).tolist():
            items[pair // len(self.names)].append(self.names[pair % len(self.names)])
        return counts, firsts, np.cumsum(change)[:total] > 0, items


def _shards(items: DataFrame) -> list[DataFrame]:
    """``item, text`` in parts of about ``SHARD_CHARS`` characters: dealt by a hash, into more parts while one is too large."""
    picked = items.where("text is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text"))
    key = F.xxhash64("item", "text")
    amount, most = picked.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)), F.coalesce(F.max(F.char_length("text")), F.lit(0))).first()
    shards = 1 + amount // SHARD_CHARS
    while shards > 1:
        largest = picked.groupBy(F.pmod(key, F.lit(shards)).alias("s")).agg(F.sum(F.char_length("text")).alias("c")).agg(F.max("c")).first()[0]
        if largest <= max(2 * SHARD_CHARS, most):
            break
        shards *= 2
    return [picked.where(F.pmod(key, F.lit(shards)) == shard).distinct() for shard in range(shards)]


def find(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_hit, spans, item_ids`` per document: hit words as maximal ranges ``[start, end)`` of word
    numbers, and the ids of items with an occurring window, as text in ascending order."""
    spark = docs.sparkSession
    found = tables.texts(docs).select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
                                      F.expr("cast(array() as array<struct<start: long, end: long>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("item_ids"))
    shards = _shards(items)
    for k, shard in enumerate(shards):
        if k:                                    # more than one shard: texts go on to the next with what was found
            found = staged(found, "contamination")
        known = spark.sparkContext.broadcast(Tables([(r.item, r.text.encode()) for r in shard.collect()], width))
        more = k + 1 < len(shards)
        found = found.mapInArrow(_marker(known, more), SCHEMA + ", text string" * more)
    return found


def _marker(known, keep_text: bool):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            ends = np.cumsum([len(t) for t in raw])
            at = 0
            while at < len(raw):
                to = min(len(raw), int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_CHARS)) + 1)
                part = batch.slice(at, to - at)
                counts, firsts, hit, items = known.value.mark(raw[at:to])
                for doc, held in enumerate(part.column("spans").to_pylist()):
                    for span in held:
                        hit[firsts[doc] + span["start"]:firsts[doc] + span["end"]] = True
                items = [sorted({*new, *held}) for new, held in zip(items, part.column("item_ids").to_pylist(), strict=True)]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                owner = np.searchsorted(firsts, edges[::2], side="right") - 1
                spans: list[list[dict]] = [[] for _ in counts]
                for doc, a, b in zip(owner.tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    spans[doc].append({"start": a - int(firsts[doc]), "end": b - int(firsts[doc])})
                columns = {"doc_id": part.column("doc_id"), "n_words": pa.array(counts), "n_hit": pa.array([sum(s["end"] - s["start"] for s in found) for found in spans], pa.int64()),
                           "spans": pa.array(spans, SPAN), "item_ids": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_pydict(columns | ({"text": part.column("text")} if keep_text else {}))
                at = to

    return run


def keep_clean(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows whose text holds no window of an item, with all their columns; a document without id is never dropped."""
    leaked = find(docs.where("doc_id is not null"), items, width).where("n_hit > 0").select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
