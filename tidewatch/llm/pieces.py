"""SentencePiece encoding and decoding; giant documents by a parallel max-plus scan.

The models at hand are byte-pair models. A sequence of pieces is the encoding of a text exactly if every two neighbours
are compatible, that is, if the merges applied to just the two spell them again. So encoding is a best path: a step from
piece ``a`` to piece ``b`` weighs the score of ``b`` if they are compatible and minus infinity if not, and the
encoding is the path of greatest sum. (Viterbi over scores alone would give a unigram segmentation, not this model's.)

A document longer than ``CHUNK`` characters is cut at fixed places. The state at a cut is the piece that covers the
character before it. Each chunk, alone and with only ``longest piece`` characters of its neighbours, yields the matrix
of best sums from its entry states to its exit states; matrices combine associatively by the max-plus product. The scan over
a document's small matrices fixes the state at every cut, and each chunk is then traced back by itself. Shorter documents
are one chunk and go to the library, whose ids these are.

A missing text is empty and has no ids. Rows are encoded one by one; rows that share an id are each returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import tables, tokens

CHUNK = 50_000
NEVER = -np.inf
#: The state before the first character.
BEGIN = (-1, 0, -1)


class Pieces:
    """One model: its library object, scores, compatibility of neighbours, and the bytes of its ids."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        self.bytes_: list[bytes] = []
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        for i in range(n):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_.append(bytes([int(piece[3:5], 16)]))
            elif self.library.is_control(i) or self.library.is_unknown(i):
                self.bytes_.append(b"")
            else:
                self.bytes_.append(piece.replace("▁", " ").encode())
                if not self.library.is_unused(i):
                    self.score[piece], self.id[piece] = self.library.get_score(i), i
        self.longest = max(map(len, self.score), default=1)
        self._fits: dict[tuple[str, str], bool] = {}

    def normalise(self, text: str) -> str:
        return self.library.normalize(text) if text else ""

    def fits(self, a: str, b: str) -> bool:
        """Whether the merges applied to the two spelled out keep them apart and whole."""
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            known = self._fits[a, b] = self.merged(a + b) == [a, b]
        return known

    def merged(self, text: str) -> list[str]:
        """Byte-pair merges of a short string: always the neighbours whose union scores best, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1], NEVER)
                if score > best:
                    best, at = score, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def spelled(self, piece: str) -> list[int]:
        """Ids of one piece: its own, or those of its bytes."""
        known = self.id.get(piece)
        return [known] if known is not None else [self.byte_id.get(b, self.library.unk_id()) for b in piece.encode()]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text behind ids, without the blank that encoding puts before it."""
        raw = b"".join(map(self.bytes_.__getitem__, ids.tolist()))
        return raw[1:] if raw[:1] == b" " else raw


@lru_cache(maxsize=2)
def model(path: str) -> Pieces:
    """One model per worker process and file."""
    return Pieces(path)


# A state is (start, end, kind): the span of a piece in the document; the kind is 0, or -1 for the beginning.


def covering(m: Pieces, text: str, offset: int, cut: int, last: bool) -> list[tuple[int, int, int]]:
    """States at ``cut``: all pieces that begin before it and end at or after it. ``text`` begins at place ``offset`` of the
    document and reaches the longest piece beyond the cut, or to the document's end if ``last``."""
    found = []
    for start in range(max(offset, cut - m.longest), cut):
        for end in range(cut, cut + 1 if last else min(start + m.longest, offset + len(text)) + 1):
            if end - start == 1 or text[start - offset:end - offset] in m.score:
                found.append((start, end, 0))
    return found


def paths(m: Pieces, text: str, offset: int, entry: tuple[int, int, int], cut: int) -> tuple[dict[int, int], dict[int, float]]:
    """From one entry state: for every place that a compatible sequence reaches, where its last piece begins, and the sum.

    At most one sequence of pieces is compatible throughout for each place, so the first one found is the best one."""
    begin = {entry[1]: entry[0]}
    total = {entry[1]: 0.0}
    score, fits, longest = m.score, m.fits, m.longest
    first = entry[1]
    for end in range(first + 1, cut + longest):
        if end - offset > len(text):
            break
        for start in range(end - 1, max(first, end - longest) - 1, -1):
            before = begin.get(start)
            if before is None or start >= cut:
                continue
            piece = text[start - offset:end - offset]
            weight = score.get(piece)
            if weight is None:
                if end - start > 1:
                    continue
                weight = 0.0
            if before < 0 or fits(text[before - offset:start - offset], piece):
                begin[end], total[end] = start, total[start] + weight
                break
    return begin, total


def transfer(m: Pieces, text: str, offset: int, entries: list[tuple[int, int, int]], exits: list[tuple[int, int, int]], cut: int) -> np.ndarray:
    """Best sums from entry to exit states of a chunk that ends at ``cut``."""
    out = np.full((len(entries), len(exits)), NEVER)
    settled: tuple[dict[int, int], dict[int, float]] | None = None
    for i, entry in enumerate(entries):
        begin, total = _paths_until_same(m, text, offset, entry, cut, settled)
        if settled is None and total.keys() - {entry[1]}:
            settled = begin, total
        for j, (start, end, _) in enumerate(exits):
            if begin.get(end) == start and end in total:
                out[i, j] = total[end]
    return out


def _paths_until_same(m: Pieces, text: str, offset: int, entry: tuple[int, int, int], cut: int, known: tuple[dict[int, int], dict[int, float]] | None):
    """Like :func:`paths`; from where the last pieces of a longest piece's reach are those of ``known``, its rest is taken over."""
    if known is None:
        return paths(m, text, offset, entry, cut)
    reach = min(cut, entry[1] + 8 * m.longest)
    begin, total = paths(m, text, offset, entry, reach)
    places = range(max(entry[1], reach - m.longest), reach + 1)
    shared = [p for p in places if p in total]
    if reach < cut and shared and all(begin.get(p) == known[0].get(p) for p in places):
        shift = total[shared[0]] - known[1][shared[0]]
        later = {p: b for p, b in known[0].items() if p > reach and b >= reach - m.longest}
        return begin | later, total | {p: known[1][p] + shift for p in later}
    return paths(m, text, offset, entry, cut)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two transfer matrices."""
    return np.max(a[:, :, None] + b[None, :, :], axis=1, initial=NEVER)


def states_of(matrices: list[np.ndarray]) -> list[int]:
    """The state at every cut on the best path, first to last. Prefix products come from an associative scan by doubling."""
    prefix = list(matrices)
    step = 1
    while step < len(prefix):
        prefix = [combine(prefix[k - step], prefix[k]) if k >= step else prefix[k] for k in range(len(prefix))]
        step *= 2
    chosen = [int(np.argmax(prefix[-1][0]))]
    for k in range(len(matrices) - 1, 0, -1):
        chosen.append(int(np.argmax(prefix[k - 1][0] + matrices[k][:, chosen[-1]])))
    return chosen[::-1]


def trace(m: Pieces, text: str, offset: int, entry: tuple[int, int, int], exit_: tuple[int, int, int], cut: int) -> list[int]:
    """Ids of the pieces after the entry state up to the exit state, that one included."""
    begin, _ = paths(m, text, offset, entry, cut)
    spans, end = [], exit_[1]
    while end > entry[1]:
        spans.append((begin[end], end))
        end = begin[end]
    return [i for start, end in reversed(spans) for i in m.spelled(text[start - offset:end - offset])]


_CHUNKS = "uid long, doc_id long, chunk int, chunks int, offset long, cut long, text string"
_SPAN = "array<struct<start: long, end: long, kind: int>>"


def _cuts(length: int, size: int) -> list[int]:
    return [*range(size, length - size // 2, size), length]


def encode(docs: DataFrame, model_file: str, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, ids, decoded_sha256`` of every row; ids are unsigned 32-bit integers."""
    spark = docs.sparkSession
    whole = tables.texts(docs)
    shape = "doc_id long, n_tokens long, ids_crc32 long, ids binary, decoded_sha256 string"

    def digest(m: Pieces, doc_ids: list, arrays: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, pa.int64()), pa.array([len(a) for a in arrays], pa.int64()), pa.array([tokens.crc32(a) for a in arrays], pa.int64()),
             pa.array([a.astype("<u4").tobytes() for a in arrays], pa.binary()), pa.array([hashlib.sha256(m.decode(a)).hexdigest() for a in arrays])],
            names=["doc_id", "n_tokens", "ids_crc32", "ids", "decoded_sha256"])

    def short(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_file)
        for rows in tables.batches(stream, ["doc_id", "text"], 1_000_000):
            yield digest(m, [r[0] for r in rows], [np.array(x, dtype=np.int64) for x in m.library.encode([r[1] for r in rows], num_threads=1)])

    def split(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, uid = model(model_file), TaskContext.get().partitionId() << 33
        for rows in tables.batches(stream, ["doc_id", "text"], 1):
            for doc, text in rows:
                text = m.normalise(text)
                ends = _cuts(len(text), chunk)
                starts = [0, *ends[:-1]]
                offsets = [max(0, s - m.longest) for s in starts]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uid] * n), pa.array([doc] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32()), pa.array(offsets, pa.int64()), pa.array(ends, pa.int64()),
                     pa.array([text[o:e + m.longest] for o, e in zip(offsets, ends, strict=True)])],
                    names=["uid", "doc_id", "chunk", "chunks", "offset", "cut", "text"])
                uid += 1

    def states(m: Pieces, k: int, n: int, offset: int, cut: int, text: str) -> tuple[list, list]:
        begins = offset + m.longest if k else 0
        if k and offset == 0:
            begins = chunk
        return [BEGIN] if k == 0 else covering(m, text, offset, begins, False), covering(m, text, offset, cut, k == n - 1)

    columns = ("uid", "chunk", "chunks", "offset", "cut", "text")

    def matrices(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_file)
        for batch in stream:
            for uid, k, n, offset, cut, text in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                entries, exits = states(m, k, n, offset, cut, text)
                table = transfer(m, text, offset, entries, exits, cut)
                spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())]))
                named = [[{"start": s, "end": e, "kind": t} for s, e, t in x] for x in (entries, exits)]
                yield pa.RecordBatch.from_arrays([pa.array([uid]), pa.array([k], pa.int32()), pa.array([named[0]], spans), pa.array([named[1]], spans), pa.array([table.reshape(-1).tolist()], pa.list_(pa.float64()))],
                                                 names=["uid", "chunk", "entries", "exits", "sums"])

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(uid: int, rows: list[tuple]) -> pa.RecordBatch:
            tables_ = [np.array(r[3]).reshape(len(r[1]), len(r[2])) for r in rows]
            chosen = states_of(tables_)
            exits = [r[2][j] for r, j in zip(rows, chosen, strict=True)]
            entries = [rows[0][1][0], *exits[:-1]]
            kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())])
            return pa.RecordBatch.from_arrays([pa.array([uid] * len(rows)), pa.array([r[0] for r in rows], pa.int32()), pa.array(entries, kind), pa.array(exits, kind)], names=["uid", "chunk", "entry", "leave"])

        current, rows = None, []
        for batch in stream:
            for uid, *row in zip(*(batch.column(c).to_pylist() for c in ("uid", "chunk", "entries", "exits", "sums")), strict=True):
                if uid != current and rows:
                    yield solved(current, rows)
                    rows = []
                current = uid
                rows.append(tuple(row))
        if rows:
            yield solved(current, rows)

    def traced(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_file)
        for batch in stream:
            for row in batch.to_pylist():
                entry, leave = ((s["start"], s["end"], s["kind"]) for s in (row["entry"], row["leave"]))
                ids = np.array(trace(m, row["text"], row["offset"], entry, leave, row["cut"]), dtype="<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([row["uid"]]), pa.array([row["doc_id"]], pa.int64()), pa.array([row["chunk"]], pa.int32()), pa.array([ids], pa.binary())], names=["uid", "doc_id", "chunk", "ids"])

    def joined(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_file)
        current, doc, parts = None, None, []
        for batch in stream:
            for uid, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id", "ids")), strict=True):
                if uid != current and parts:
                    yield digest(m, [doc], [np.frombuffer(b"".join(parts), dtype="<u4").astype(np.int64)])
                    parts = []
                current, doc = uid, doc_id
                parts.append(ids)
        if parts:
            yield digest(m, [doc], [np.frombuffer(b"".join(parts), dtype="<u4").astype(np.int64)])

    n = tables.partitions(spark)
    giant = F.char_length("text") > chunk
    chunks = tables.staged_small(whole.where(giant).repartition(n, F.xxhash64("doc_id")).mapInArrow(split, _CHUNKS), "piece-chunks")
    spread = chunks.repartition(n, "uid", "chunk")      # a giant document's chunks are solved all over the cluster
    solved = tables.staged_small(spread.mapInArrow(matrices, f"uid long, chunk int, entries {_SPAN}, exits {_SPAN}, sums array<double>"), "piece-matrices")
    span = "struct<start: long, end: long, kind: int>"
    path = solved.repartition(n, "uid").sortWithinPartitions("uid", "chunk").mapInArrow(scan, f"uid long, chunk int, entry {span}, leave {span}")
    ids = chunks.join(path, ["uid", "chunk"]).mapInArrow(traced, "uid long, doc_id long, chunk int, ids binary")
    long_ = ids.repartition(n, "uid").sortWithinPartitions("uid", "chunk").mapInArrow(joined, shape)
    return whole.where(~giant).mapInArrow(short, shape).unionByName(long_)


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""
    def read(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_file)
        for batch in stream:
            out = [m.decode(np.frombuffer(x or b"", dtype="<u4")).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(read, "doc_id long, text string")
