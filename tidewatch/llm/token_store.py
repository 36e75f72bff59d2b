"""Token ids as a compressed binary store with random access to short documents.

Layout below one folder, all Parquet so that any store Spark reaches can hold it and the output committer makes lost
executors harmless:

``dictionary``  one row: ``dict_hash`` (sha256 of the zstandard dictionary), ``dictionary``, ``sample_docs``
``segments``    about one megabyte of frames per row, in ascending id order: ``part, seq, first_id, last_id, dict_hash, payload``
                and the offset index ``doc_id, n_tokens, start_in_part, frame_start, frame_end`` as arrays. ``part`` numbers
                the ranges of ids, ``seq`` the segments of a range. Row groups are small (``GROUP_BYTES``), so that the
                files' own statistics of ``first_id`` and ``last_id`` lead a lookup to the few that hold its ids.

Every document is one zstandard frame over its ids, little-endian, of the width the vocabulary needs. All frames share
one dictionary trained on serialised id arrays, which is what makes frames of a few dozen ids small.

Rows without text are empty documents (only the end id). Rows without id come first. Rows with the same id are stored
one after the other, ordered by text. An empty table gives an empty store with an untrained dictionary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import tables, tokens

#: Documents whose ids train the dictionary, and how many bytes of ids each of them adds at most. The dictionary only
#: sets how small frames get, never what is in them.
SAMPLE_DOCS = 1500
SAMPLE_BYTES = 8192
DICTIONARY_BYTES = 65536
SEGMENT_BYTES = 1 << 20
GROUP_BYTES = 4 << 20
LEVEL = 3
#: Ranges of ids that a lookup asks the files for; more ids than that share ranges.
RANGES = 64

_SEGMENTS = ("part int, seq int, first_id long, last_id long, dict_hash string, payload binary, doc_id array<long>, n_tokens array<long>, "
             "start_in_part array<long>, frame_start array<long>, frame_end array<long>")


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> tuple[bytes, int]:
    """A dictionary from the documents with the smallest id hashes (at most ``SAMPLE_DOCS``), and how many they were."""
    import zstandard

    ids = (docs.select("doc_id", F.xxhash64("doc_id").alias("_h")).orderBy("_h", "doc_id").limit(SAMPLE_DOCS).select("doc_id").distinct())
    sample = docs.join(F.broadcast(ids), "doc_id").select("text").limit(SAMPLE_DOCS)  # at most SAMPLE_DOCS long ids

    def serialise(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer)
        last = np.array([end_id], dtype=encode.dtype).tobytes()
        for batch in stream:
            yield pa.RecordBatch.from_pydict({"ids": pa.array([(encode.encode(t) + last)[:SAMPLE_BYTES] for t in batch.column(0).to_pylist()], pa.binary())})

    samples = sorted(bytes(r.ids) for r in sample.mapInArrow(serialise, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, threads=0).as_bytes(), len(samples)
    except zstandard.ZstdError:  # too few samples to train on: their bytes themselves are the dictionary
        return (b"".join(samples) or bytes(8)).ljust(8, b"\0")[:DICTIONARY_BYTES], len(samples)


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode ``doc_id, text`` in ascending id order into a store below ``path``."""
    spark = docs.sparkSession
    docs = tables.texts(docs)
    raw, n = train_dictionary(docs, tokenizer, end_id)
    digest = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(digest, bytearray(raw), n)], "dict_hash string, dictionary binary, sample_docs long").coalesce(1).write.parquet(f"{path}/dictionary")

    def encode(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        encoder = tokens.encoder(tokenizer)
        last = np.array([end_id], dtype=encoder.dtype).tobytes()
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw))
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        held: dict[str, list] = {k: [] for k in ("doc_id", "n_tokens", "start_in_part", "frame_start", "frame_end")}
        frames: list[bytes] = []
        size = 0

        def segment() -> pa.RecordBatch:
            longs = pa.list_(pa.int64())
            known = [d for d in held["doc_id"] if d is not None] or [None]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([known[0]], pa.int64()), pa.array([known[-1]], pa.int64()), pa.array([digest]), pa.array([b"".join(frames)], pa.binary()),
                 *(pa.array([v], longs) for v in held.values())],
                names=["part", "seq", "first_id", "last_id", "dict_hash", "payload", *held])

        for batch in stream:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text) + last
                frame = press.compress(ids)
                count = len(ids) // encoder.width
                for k, v in zip(held, (doc, count, start, size, size + len(frame)), strict=True):
                    held[k].append(v)
                frames.append(frame)
                start, size = start + count, size + len(frame)
                if size >= SEGMENT_BYTES:
                    yield segment()
                    seq, size = seq + 1, 0
                    frames.clear()
                    held = {k: [] for k in held}
        if frames:
            yield segment()

    (docs.repartitionByRange(tables.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(encode, _SEGMENTS).write.option("compression", "none").option("parquet.block.size", GROUP_BYTES)
     .option("parquet.page.size.row.check.min", 1).parquet(f"{path}/segments"))


def read_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    """Hash and bytes of the store's one dictionary, checked against each other."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    raw = bytes(row.dictionary)
    if hashlib.sha256(raw).hexdigest() != row.dict_hash:
        raise ValueError(f"the dictionary of {path} is not the one its hash names")
    return row.dict_hash, raw


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """``part, part_start``: ids stored in all smaller parts. One row per written range."""
    counts = (spark.read.parquet(f"{path}/segments").select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
              .groupBy("part").agg(F.sum("n").alias("n")))
    return tables.part_offsets(counts, "part", "n", "part_start")


def decode(segments: DataFrame, raw: bytes, digest: str, width: int) -> DataFrame:
    """``part, doc_id, start_in_part, n_tokens, ids_crc32, ids``: every frame of the given segments, decompressed."""
    def read(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        for batch in stream:
            for row in batch.to_pylist():
                if row["dict_hash"] != digest:
                    raise ValueError("a segment was written with another dictionary")
                ids = [press.decompress(row["payload"][a:b]) for a, b in zip(row["frame_start"], row["frame_end"], strict=True)]
                arrays = [np.frombuffer(x, dtype=f"<u{width}") for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(ids), pa.int32()), pa.array(row["doc_id"], pa.int64()), pa.array(row["start_in_part"], pa.int64()),
                     pa.array([len(a) for a in arrays], pa.int64()), pa.array([tokens.crc32(a) for a in arrays], pa.int64()), pa.array(ids, pa.binary())],
                    names=["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32", "ids"])

    return segments.select("part", "dict_hash", "payload", "doc_id", "start_in_part", "frame_start", "frame_end").mapInArrow(
        read, "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long, ids binary")


def read_store(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` of every document, from the files."""
    digest, raw = read_dictionary(spark, path)
    rows = decode(spark.read.parquet(f"{path}/segments"), raw, digest, width)
    starts = F.broadcast(part_starts(spark, path))  # one row per range of the store, at most its number of partitions
    return rows.join(starts, "part").select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32", "ids")


def holding(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Segments that may hold an asked-for id. Both bounds of every range reach the scan, which skips row groups by them."""
    ids = sorted({int(d) for d in doc_ids})
    ranges = [ids[len(ids) * k // RANGES:len(ids) * (k + 1) // RANGES] for k in range(RANGES)] if len(ids) > RANGES else [[d] for d in ids]
    near = [(F.col("first_id") <= r[-1]) & (F.col("last_id") >= r[0]) for r in ranges]
    return spark.read.parquet(f"{path}/segments").where(reduce(Column.__or__, near, F.lit(False)))


def lookup(spark: SparkSession, path: str, doc_ids: list[int], width: int = 2) -> DataFrame:
    """Ids of single documents: only row groups whose id range holds an asked-for id are read, and only those documents' frames
    decompressed. Ids that the store lacks give no row; documents without id cannot be asked for."""
    digest, raw = read_dictionary(spark, path)
    wanted = F.array(*(F.lit(int(d)) for d in doc_ids)).cast("array<bigint>")
    segments = holding(spark, path, doc_ids).where(F.arrays_overlap("doc_id", wanted))
    for name in ("start_in_part", "frame_start", "frame_end"):
        segments = segments.withColumn(name, F.filter(name, lambda x, i: F.array_contains(wanted, F.element_at("doc_id", i + 1))))
    segments = segments.withColumn("doc_id", F.filter("doc_id", lambda x: F.array_contains(wanted, x)))
    return decode(segments, raw, digest, width).select("doc_id", "n_tokens", "ids_crc32", "ids")
