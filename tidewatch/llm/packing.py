"""Packing of documents into training sequences along a space-filling curve.

Each document's ids are hashed into a 64-component vector, brought to unit length and projected by a fixed random matrix
to three dimensions. The Hilbert key of that point orders the corpus: documents next to each other on the curve are close
in all three dimensions, so a sequence holds documents of one kind. The curve is cut into ranges by Spark, and each range
is one stream of ids that is cut every ``length`` ids. Only the end of a range can be short: it is cut at the powers of
two of its binary form, so nothing is padded at all.

Rows without text are empty documents (only the end id), rows without id are packed like others, equal rows each get
their place. Ties on the curve are broken by a hash of the id, so a group of equal documents spreads over ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import tables, tokens

HASHED = 64
DIMENSIONS = 3
BITS = 16
LENGTH = 2048

PIECES = ("part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, local_sequence long, offset long")


def _mixed(numbers: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing of integers (splitmix64)."""
    with np.errstate(over="ignore"):
        z = numbers.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def projection() -> np.ndarray:
    """The fixed 64 x 3 matrix: columns of unit length at right angles."""
    normal = np.random.default_rng(20).standard_normal((HASHED, DIMENSIONS))
    return np.linalg.qr(normal)[0]


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of integer points (rows) with ``bits`` bits per dimension.

    The coordinates become the transposed form of the index by exchanging or inverting low bits per level, then by Gray
    decoding (J. Skilling, Programming the Hilbert curve, 2004), for all points at once.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(n):
            inverted = (x[i] & level) != 0
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inverted, low, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        flip ^= np.where((x[n - 1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def tokenised(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``doc_id, curve, ids``: ids with the end id, and the place on the curve."""
    def encode(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        hashes = _mixed(np.arange(max(encoder.tokenizer.get_vocab_size(), end_id + 1)))
        # Components count twice, once for each sign; the counts of a batch are one pass over all its ids.
        place = (2 * (hashes % np.uint64(HASHED)) + (hashes >> np.uint64(63))).astype(np.int32)
        matrix, last = projection(), np.array([end_id], dtype=encoder.dtype).tobytes()
        for batch in stream:
            for rows in tables.batches([batch], ["doc_id", "text"], 4_000_000):
                out = [encoder.encode(text) + last for _, text in rows]
                ids = np.frombuffer(b"".join(out), dtype=encoder.dtype)
                row = np.repeat(np.arange(len(out), dtype=np.int32), [len(o) // encoder.width for o in out])
                signed = np.bincount(row * np.int32(2 * HASHED) + place[ids], minlength=len(out) * 2 * HASHED).reshape(len(out), HASHED, 2)
                vectors = (signed[:, :, 0] - signed[:, :, 1]).astype(float)
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                cells = np.clip(((vectors @ matrix + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(hilbert(cells)), pa.array(out, pa.binary())],
                                                 names=["doc_id", "curve", "ids"])

    return tables.texts(docs).mapInArrow(encode, "doc_id long, curve long, ids binary")


def cut(tokenised_docs: DataFrame, width: int, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """Pieces of every range of the curve, in order: ``PIECES``, with ``keep_ids`` also the ids of each piece."""
    def pack(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        dtype = np.dtype(f"<u{width}")
        sequence: int = 0
        open_pieces: list[list] = []      # of the sequence that is not full yet
        filled: int = 0

        def emit(pieces: list[list]) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True))
            arrays = [pa.array([part] * len(pieces), pa.int32()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                      pa.array([len(c) for c in columns[2]], pa.int64()), pa.array([tokens.crc32(c) for c in columns[2]], pa.int64()),
                      *(pa.array(c, pa.int64()) for c in columns[3:])]
            names = ["part", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "local_sequence", "offset"]
            if keep_ids:
                arrays.append(pa.array([c.tobytes() for c in columns[2]], pa.binary()))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        done: list[list] = []
        for batch in stream:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, at = np.frombuffer(raw, dtype=dtype), 0
                while at < len(ids):
                    take = min(length - filled, len(ids) - at)
                    open_pieces.append([doc, at, ids[at:at + take], len(ids), sequence, filled])
                    at, filled = at + take, filled + take
                    if filled == length:
                        done += open_pieces
                        open_pieces, filled, sequence = [], 0, sequence + 1
                if len(done) >= 4096:
                    yield emit(done)
                    done = []
        # The rest of the range: one sequence for each power of two in its length.
        rest, open_pieces = open_pieces, []
        goals = [1 << b for b in range(filled.bit_length() - 1, -1, -1) if filled >> b & 1]
        goal, filled = (goals.pop(0) if goals else 0), 0
        for doc, start, ids, total, _, _ in rest:
            at = 0
            while at < len(ids):
                take = min(goal - filled, len(ids) - at)
                done.append([doc, start + at, ids[at:at + take], total, sequence, filled])
                at, filled = at + take, filled + take
                if filled == goal and goals:
                    goal, filled, sequence = goals.pop(0), 0, sequence + 1
        if done:
            yield emit(done)

    spark = tokenised_docs.sparkSession
    ordered = (tokenised_docs.withColumn("_tie", F.xxhash64("doc_id")).repartitionByRange(tables.partitions(spark), "curve", "_tie")
               .sortWithinPartitions("curve", "_tie", "doc_id", "ids").select("doc_id", "ids"))
    return ordered.mapInArrow(pack, PIECES + (", ids binary" if keep_ids else ""))


def numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` of a written table with ``sequence_id``, counted over all ranges, in place of the number in a range."""
    counts = pieces.groupBy("part").agg((F.max("local_sequence") + 1).alias("n"))
    offsets = F.broadcast(tables.part_offsets(counts, "part", "n", "part_start"))  # one row per range
    return (pieces.join(offsets, "part").withColumn("sequence_id", F.col("part_start") + F.col("local_sequence"))
            .drop("part", "part_start", "local_sequence"))


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, keep_ids: bool = True) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, offset, sequence_id`` and the ids of every piece."""
    width = tokens.encoder(tokenizer).width
    ids = tables.staged_small(tokenised(docs, tokenizer, end_id), "pack-ids")
    return numbered(tables.staged_small(cut(ids, width, length, keep_ids), "pack-pieces"))
