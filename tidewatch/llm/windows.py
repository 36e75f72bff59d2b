"""Substring deduplication by Rabin-Karp hashes of every window of ``width`` consecutive words.

Three passes over blocks of documents (:mod:`blocks`):

1. Each block hashes all its windows: a polynomial over the 64-bit word hashes, modulo 2^64, built by doubling. Equal
   hashes of a block are merged (they stand for one record with the block's smallest document), so a passage held by a
   third of all documents adds one record per block, not one per document. Records go to buckets by the hash's top bits.
2. Each bucket finds the smallest document of every hash over all blocks and replies to each block with one bit per
   record: does a smaller document elsewhere hold this window?
3. Each block applies the bits and its own order of documents, and merges the covered words into maximal removal spans.

Windows are judged on the input. Repeats within one document, or among rows of the same id, remove nothing. A row
without id removes nothing and loses nothing. Rows without text or with fewer words than the window lose nothing.
Hashes have 64 bits: for n windows in all, about n^2 / 2^65 pairs of different windows meet by chance (0.0005 at
10^8 windows).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import blocks, tables

WIDTH = 50
BASE = 0x9E3779B97F4A7C15
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of each ``width`` consecutive values: sum of value * BASE^(distance to the last), modulo 2^64."""
    total, covered = None, 0
    power, size = values, 1               # hash of ``size`` values from each place on
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                if total is None:
                    total = power
                else:
                    m = max(0, len(values) - covered - size + 1)
                    total = total[:m] * np.uint64(pow(BASE, size, 1 << 64)) + power[covered:covered + m]
                covered += size
            if 2 * size > width:
                return total[:max(0, len(values) - width + 1)]
            power = power[:len(power) - size] * np.uint64(pow(BASE, size, 1 << 64)) + power[size:] if len(power) > size else power[:0]
            size *= 2


def _hashed(block: blocks.Block, width: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each document, the first word of each document, the start words of all windows, and their hashes."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = [block.text(k).split() for k in range(len(block))]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    firsts = np.cumsum(counts) - counts
    values = np.fromiter((digest(w) for doc in words for w in doc), dtype=np.uint64, count=int(counts.sum()))
    whole = np.repeat(firsts + counts, counts) - np.arange(len(values)) >= width   # enough words left in the document
    starts = np.flatnonzero(whole)
    return words, firsts, starts, rolling(values, width)[starts] if len(starts) else np.zeros(0, dtype=np.uint64)


def _edges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among ascending hashes."""
    lows = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, lows), [len(hashes)]])


def records(stored: DataFrame, width: int, buckets: int) -> DataFrame:
    """``bucket, block, hashes, firsts``: the distinct window hashes of each block with their smallest documents."""
    def hashed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in blocks.read_blocks(stream):
            _, firsts, starts, hashes = _hashed(block, width)
            distinct, place = np.unique(hashes, return_index=True)
            owners = block.ids[np.searchsorted(firsts, starts[place], side="right") - 1]
            edges = _edges(distinct, buckets)
            full = [b for b in range(buckets) if edges[b] < edges[b + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([number] * len(full), pa.int64()), pa.array([blocks.packed(distinct[edges[b]:edges[b + 1]]) for b in full], pa.binary()),
                 pa.array([blocks.shifted(owners[edges[b]:edges[b + 1]]) for b in full], pa.binary())],
                names=["bucket", "block", "hashes", "firsts"])

    return stored.mapInArrow(hashed, "bucket int, block long, hashes binary, firsts binary")


def replies(found: DataFrame, buckets: int) -> DataFrame:
    """``block, bucket, reply``: one bit per record of the block, set if a smaller document elsewhere has its hash."""
    def judged(numbers: list[int], bucket: int, hashes: list[np.ndarray], firsts: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(h) for h in hashes])
        every, docs = np.concatenate(hashes), np.concatenate(firsts)
        order = np.argsort(every, kind="stable")
        same = every[order]
        heads = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
        least = np.repeat(np.minimum.reduceat(docs[order], heads), np.diff(np.append(heads, len(same))))
        later = np.zeros(len(every), dtype=bool)
        later[order] = least < docs[order]
        parts = np.split(later, np.cumsum(sizes)[:-1])
        marked = [(n, np.packbits(p).tobytes()) for n, p in zip(numbers, parts, strict=True) if p.any()]
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in marked], pa.int64()), pa.array([bucket] * len(marked), pa.int32()), pa.array([p for _, p in marked], pa.binary())],
                                          names=["block", "bucket", "reply"])

    def by_bucket(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, ([], [], [])
        for batch in stream:
            for bucket, number, raw, first in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "hashes", "firsts")), strict=True):
                if bucket != current and held[0]:
                    yield judged(held[0], current, held[1], held[2])
                    held = ([], [], [])
                current = bucket
                held[0].append(number)
                held[1].append(blocks.unpacked(raw))
                held[2].append(blocks.unshifted(first))
        if held[0]:
            yield judged(held[0], current, held[1], held[2])

    # Buckets are equal ranges of hashes, so their numbers place them; ranges would be sampled by hashing all windows once more.
    n = tables.partitions(found.sparkSession)
    return (found.repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket")
            .mapInArrow(by_bucket, "block long, bucket int, reply binary"))


def judge(stored: DataFrame, width: int = WIDTH) -> DataFrame:
    """Blocks with their replies, ready for :func:`removed` or :func:`cut`."""
    # Buckets follow the session's partitions, so that one bucket's hashes fit a task whatever the corpus.
    buckets = 4 * tables.partitions(stored.sparkSession)
    found = tables.staged_small(replies(records(stored, width, buckets), buckets), "window-replies")
    return blocks.with_replies(stored, found)


def _removals(block: blocks.Block, given: dict[int, list[bytes]], width: int, buckets: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each document, the first word of each document, and which words go."""
    words, firsts, starts, hashes = _hashed(block, width)
    distinct, place, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    owner = np.searchsorted(firsts, starts, side="right") - 1
    edges = _edges(distinct, buckets)
    elsewhere = np.zeros(len(distinct), dtype=bool)
    for bucket, bits in given.items():
        elsewhere[edges[bucket]:edges[bucket + 1]] = np.unpackbits(np.frombuffer(bits[0], dtype=np.uint8))[:edges[bucket + 1] - edges[bucket]]
    targets = block.targets[owner]
    goes = (elsewhere[inverse] & (targets != blocks.FIRST)) | (block.ids[owner[place]][inverse] < targets)
    total = sum(map(len, words))
    change = np.zeros(total + 1, dtype=np.int64)
    np.add.at(change, starts[goes], 1)
    np.add.at(change, starts[goes] + width, -1)
    return words, firsts, np.cumsum(change)[:total] > 0


def removed(stored: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_removed, n_spans, kept_sha256, spans`` per document; spans are word ranges ``[start, end)``."""
    buckets = 4 * tables.partitions(stored.sparkSession)

    def apply(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, given in blocks.answered(stream):
            words, firsts, goes = _removals(block, given, width, buckets)
            out = []
            for doc, first in zip(words, firsts, strict=True):
                mask = goes[first:first + len(doc)]
                runs = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                kept = doc if not len(runs) else [w for w, gone in zip(doc, mask, strict=True) if not gone]
                out.append((len(doc), int(mask.sum()), len(runs) // 2, hashlib.sha256(b" ".join(kept)).hexdigest(), [{"start": int(a), "end": int(b)} for a, b in runs.reshape(-1, 2)]))
            columns = list(zip(*out, strict=True))
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([block.doc_ids(), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3]), pa.array(columns[4], spans)],
                                             names=["doc_id", "n_words", "n_removed", "n_spans", "kept_sha256", "spans"])

    return judge(stored, width).mapInArrow(apply, "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>")


def cut(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The same rows with the repeated words cut out of ``text``; everything else, spaces and lines of kept words
    included, stays. A text that loses all its words becomes empty; a missing text stays missing."""
    buckets = 4 * tables.partitions(docs.sparkSession)
    stored = blocks.write_blocks(docs, "window-blocks", keep_rest=True)

    def apply(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, given in blocks.answered(stream):
            words, firsts, goes = _removals(block, given, width, buckets)
            kept = []
            for k, (doc, first) in enumerate(zip(words, firsts, strict=True)):
                mask, text = goes[first:first + len(doc)], block.text(k)
                if mask.any():
                    ends = [m.span() for m in _WORD.finditer(text)]
                    pieces, at = [], 0
                    for a, b in np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).reshape(-1, 2):
                        pieces.append(text[at:ends[a][0]])
                        at = ends[b][0] if b < len(ends) else len(text)
                    text = b"".join([*pieces, text[at:]]) if not mask.all() else b""
                kept.append(text.decode())
            rest = block.rest()
            yield pa.RecordBatch.from_arrays([rest.column("rest"), pa.array(kept, pa.string(), mask=rest.column("missing").to_numpy(zero_copy_only=False))], names=["rest", "text"])

    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    inner = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in [docs.schema["doc_id"], *others])
    out = judge(stored, width).mapInArrow(apply, f"rest struct<{inner}>, text string")
    return out.select(*(F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns))
