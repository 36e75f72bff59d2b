"""Blocks of documents: a few megabytes of text in one row, written once and read by every later pass.

Passes over whole texts exchange a few packed arrays per block instead of a row per window, and find the same documents
in the same order again because the blocks are a table. A block never exceeds ``BLOCK_BYTES`` by more than one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import tables

BLOCK_BYTES = 6_000_000
SCHEMA = "block long, ids binary, sizes binary, payload binary, rest binary"
#: Stands for a missing id: as a source later than every document, as a target earlier than every document.
LAST, FIRST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def write_blocks(docs: DataFrame, name: str, keep_rest: bool = False) -> DataFrame:
    """Documents in blocks, by ascending id within each (a missing id last). ``keep_rest`` also carries the other
    columns, whatever they are, so that whole rows come back."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")] if keep_rest else []
    picked = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.coalesce(F.col("text"), F.lit("")).alias("_text"), F.col("text").isNull().alias("_missing"),
                         *([F.struct("doc_id", *(F.col(f"`{c}`") for c in rest)).alias("_rest")] if keep_rest else []))

    def block(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        press = zstandard.ZstdCompressor(level=3)
        for batch in _resized(stream):
            docs_ = np.array([LAST if d is None else d for d in batch.column(0).to_pylist()], dtype=np.int64)
            order = np.argsort(docs_, kind="stable")
            batch = batch.take(pa.array(order))
            raw = [t.encode() for t in batch.column(1).to_pylist()]
            kept = b""
            if keep_rest:
                sink = pa.BufferOutputStream()
                part = pa.RecordBatch.from_arrays([batch.column(3), batch.column(2)], names=["rest", "missing"])
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_batch(part)
                kept = sink.getvalue().to_pybytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in (
                    docs_[order].tobytes(), np.array([len(r) for r in raw], dtype=np.int64).tobytes(), press.compress(b"".join(raw)), press.compress(kept)))],
                names=["block", "ids", "sizes", "payload", "rest"])
            number += 1

    from tidewatch.session import scratch_path

    path = scratch_path(docs.sparkSession, name)
    picked.mapInArrow(block, SCHEMA).write.option("compression", "none").parquet(path)
    return docs.sparkSession.read.schema(SCHEMA).parquet(path)


def _resized(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``BLOCK_BYTES`` of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in stream:
        ends = np.cumsum(np.array([len(t) if t is not None else 0 for t in batch.column(1).to_pylist()], dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = min(int(np.searchsorted(ends, base + BLOCK_BYTES - size)) + 1, batch.num_rows)
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1] - base)
            at = to
            if size >= BLOCK_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Block:
    """One block in memory: ids, targets and texts of its documents."""

    def __init__(self, ids: bytes, sizes: bytes, payload: bytes, rest: bytes) -> None:
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        self.ids = np.frombuffer(ids, dtype=np.int64)
        self.targets = np.where(self.ids == LAST, FIRST, self.ids)
        self.ends = np.cumsum(np.frombuffer(sizes, dtype=np.int64))
        self.starts = self.ends - np.frombuffer(sizes, dtype=np.int64)
        self.raw = open_.decompress(payload)
        self._rest = open_.decompress(rest)

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, k: int) -> bytes:
        return self.raw[self.starts[k]:self.ends[k]]

    def doc_ids(self) -> pa.Array:
        return pa.array(self.ids, mask=self.ids == LAST)

    def rest(self) -> pa.RecordBatch:
        """The other columns (as a struct) and whether the text was missing."""
        with pa.ipc.open_stream(self._rest) as reader:
            return reader.read_next_batch()


def read_blocks(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    """Blocks of Arrow rows, one in memory at a time."""
    for batch in stream:
        for row in range(batch.num_rows):
            values = {n: batch.column(n)[row].as_py() for n in ("block", "ids", "sizes", "payload", "rest")}
            yield values.pop("block"), Block(**values)


def with_replies(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """Blocks and the replies meant for them (``block, bucket, reply``) side by side: each block's row is followed by its
    replies in order of their buckets."""
    shape = {"ids": "binary", "sizes": "binary", "payload": "binary", "rest": "binary"}
    left = blocks.select("block", F.lit(-1).alias("bucket"), *shape, F.lit(None).cast("binary").alias("reply"))
    right = replies.select("block", "bucket", *(F.lit(None).cast(t).alias(c) for c, t in shape.items()), "reply")
    return left.unionByName(right).repartition(tables.partitions(blocks.sparkSession), "block").sortWithinPartitions("block", "bucket")


def answered(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, dict[int, list[bytes]]]]:
    """Each block with its replies by bucket, from rows in the order of :func:`with_replies`."""
    current: Block | None = None
    replies: dict[int, list[bytes]] = {}
    for batch in stream:
        buckets = batch.column("bucket").to_pylist()
        for row, bucket in enumerate(buckets):
            if bucket < 0:
                if current is not None:
                    yield current, replies
                current, replies = Block(*(batch.column(n)[row].as_py() for n in ("ids", "sizes", "payload", "rest"))), {}
            else:
                replies.setdefault(bucket, []).append(batch.column("reply")[row].as_py())
    if current is not None:
        yield current, replies


def packed(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit integers as their differences, in as many bytes as the largest difference needs."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=values[:1])
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return values[:1].tobytes() + bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, dtype=np.uint64)
    width = raw[8]
    narrow = np.frombuffer(raw, dtype=np.uint8, offset=9).reshape(-1, width)
    wide = np.zeros((len(narrow), 8), dtype=np.uint8)
    wide[:, :width] = narrow
    with np.errstate(over="ignore"):
        return np.cumsum(wide.reshape(-1).view("<u8"), dtype=np.uint64) + np.frombuffer(raw, dtype="<u8", count=1)[0]


def shifted(values: np.ndarray) -> bytes:
    """Any 64-bit integers as differences from the least, in 1, 2, 4 or 8 bytes each."""
    if not len(values):
        return b""
    low = values.min()
    with np.errstate(over="ignore"):
        above = values.astype(np.uint64) - low.astype(np.uint64)
    top = int(above.max())
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return np.int64(low).tobytes() + bytes([width]) + above.astype(f"<u{width}").tobytes()


def unshifted(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        return (np.frombuffer(raw, dtype=f"<u{raw[8]}", offset=9).astype(np.uint64) + np.frombuffer(raw, dtype="<u8", count=1)[0]).astype(np.int64)
