"""Product codes of vectors: integer k-means per part with Drake-Hamerly adaptive bounds.

Components become integers floor(256 x). Vectors are cut into equal consecutive parts, and each part position has a
codebook of its own. Every round assigns all parts, then moves the entries to their parts' floored means; a last
assignment gives the codes. Distances that decide are computed in integers, ties go to the lower index.

Each round writes a table with, per part, its assigned entry, its ``b`` next closest entries, an ascending lower bound for
each of these, and one outer bound for all entries left. When the entries have moved, every bound gives way by the
distance its entry moved, the outer one by the largest such distance, and stays a bound. The next round computes the
integer distance to the assigned entry; only entries whose bound isn't above it are computed as well, and if not even the
outer bound is, all of them. Bounds are stored rounded down to a unit that the data's range fixes, and count as above a
distance only by more than a rounding margin, so that uncertain cases are always decided by integers. ``b`` of the next
round, up to that many as were kept, is the depth that all but one in a hundred parts needed, between an eighth and a quarter
of the entries; the first table keeps a quarter. A round reads ``b`` entries of the table before it, the first one left out
bounding the rest, and keeps as many. The last round gives codes and distances alone.

Only codebooks, sums per entry and the depths' histogram pass the driver: their size depends on the codebooks alone.

Defined results: rows without vector, or with a missing or non-finite component, are dropped. The codebooks start with the
smallest ids (missing ids last, equal ids by their vectors); fewer rows than entries give smaller codebooks. Vectors
shorter than the longest, or of a length that the number of parts does not divide, count as padded with zeros. Components
beyond +-``limit`` (2^25 at 1,024 components, so that no sum of squares leaves 64 bits) count as that limit. Repeated rows
and ids have a row each. Errors of one label are added over all its rows, missing labels together; a sum beyond 64 bits
is null. Other columns are not read and cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import tables
from tidewatch.llm.tables import staged_small

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Rows in memory at once, and the share of rows from which a label is joined by broadcast: at most its inverse many.
ROWS, HOT = 2048, 1 / 256
#: Largest value of a stored bound.
TOP = 65_535


def finite(vector: Column) -> Column:
    """Neither missing nor holding a missing or non-finite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def limit(width: int) -> int:
    """Largest component whose squared differences can be added over all components in 63 bits."""
    return 1 << ((62 - max(1, width).bit_length()) // 2 - 1)


class Shape:
    """Sizes of parts and codebooks, and the unit of stored bounds."""

    def __init__(self, dims: int, largest: float, parts: int, entries: int) -> None:
        self.parts, self.entries = parts, entries
        self.width = max(1, -(-dims // parts))
        self.limit = limit(self.width * parts)
        reach = min(float(self.limit), 256.0 * largest + 1.0)
        self.unit = max(1e-9, 2.0 * reach * self.width ** 0.5 / TOP)
        self.kind = np.dtype("<i2" if reach < 32_000 else "<i4")

    def integers(self, vectors: pa.ListArray) -> np.ndarray:
        """Rows x parts x width."""
        out = np.zeros((len(vectors), self.parts * self.width))
        ends = np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(vectors)), np.diff(ends))
        out[row, np.arange(len(flat)) - ends[row]] = np.clip(np.floor(256.0 * flat), -self.limit, self.limit)
        return out.astype(np.int64).reshape(len(vectors), self.parts, self.width)

    def stored(self, distance: np.ndarray) -> np.ndarray:
        """Distances as bounds: rounded down, one unit less for the floating steps before."""
        return np.clip(np.floor(distance / self.unit) - 1, 0, TOP).astype("<u2")


def nearest(points: np.ndarray, book: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of points x width: assigned entry, squared distance, the next ``b`` entries, their distances, the next distance.

    All entries are computed. Where no entry is left for the outer bound it is infinite.
    """
    square = ((points[:, None, :] - book[None]) ** 2).sum(axis=2)
    order = np.argsort(square, axis=1, kind="stable")
    ranked = np.take_along_axis(square, order, axis=1)
    outer = np.sqrt(ranked[:, b + 1].astype(float)) if b + 1 < len(book) else np.full(len(points), np.inf)
    return order[:, 0], ranked[:, 0], order[:, 1:b + 1], np.sqrt(ranked[:, 1:b + 1].astype(float)), outer


class Assign:
    """Rows of integers with bounds to the same with the entries nearest now."""

    def __init__(self, shape: Shape, b: int, book: np.ndarray, before: np.ndarray | None, held: int, last: bool = False) -> None:
        """``book``: parts x entries x width; ``before``: the codebooks the bounds were made for, ``held`` entries each;
        ``last``: only entries and squared distances are asked for."""
        self.shape, self.book, self.held, self.last = shape, book, held, last
        self.b = min(b, max(0, book.shape[1] - 1))
        self.moved = None if before is None else np.sqrt(((book - before) ** 2).sum(axis=2).astype(float)) * (1 + 1e-9)

    def first(self, points: np.ndarray) -> tuple[np.ndarray, ...]:
        made = [self._packed(*nearest(points[:, p], self.book[p], self.b)) for p in range(self.shape.parts)]
        depth = () if self.last else (np.full(points.shape[:2], self.book.shape[1], dtype=np.uint8),)
        return tuple(np.stack(part, axis=1) for part in zip(*made, strict=True)) + depth

    def _packed(self, code, square, near, low, outer):
        if self.last:
            return code.astype(np.uint8), square
        low, outer = self.shape.stored(low), self.shape.stored(outer)
        return code.astype(np.uint8), square, near.astype(np.uint8), np.minimum(low, outer[:, None]), outer

    def again(self, points: np.ndarray, code: np.ndarray, near: np.ndarray, low: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, ...]:
        if self.b < near.shape[2]:
            near, low, outer = near[:, :, :self.b], low[:, :, :self.b], low[:, :, self.b]
        made = [self._part(p, points[:, p], code[:, p].astype(np.int64), near[:, p].astype(np.int64), low[:, p], outer[:, p]) for p in range(self.shape.parts)]
        return tuple(np.stack(part, axis=1) for part in zip(*made, strict=True))

    def _part(self, p, points, code, near, low, outer):
        shape, book, moved = self.shape, self.book[p], self.moved[p]
        b, rows = near.shape[1], np.arange(len(points))
        # Bounds give way; then each one is made valid for its entry and all after it.
        low = np.concatenate([low * shape.unit - moved[near], (outer * shape.unit - moved.max(initial=0.0))[:, None]], axis=1)
        if b + 1 >= len(book):
            low[:, b] = np.inf                                   # every entry is listed
        low = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]
        square = ((points - book[code]) ** 2).sum(axis=1)
        upper = np.sqrt(square.astype(float))
        # Entries from place z on are surely farther; z = b + 1 if not even the outer bound tells.
        above = low > (upper + shape.unit)[:, None]
        depth = np.where(above.any(axis=1), above.argmax(axis=1), b + 1)
        out_code, out_square, out_near, out_low, out_outer = code.copy(), square.copy(), near.copy(), low[:, :b].copy(), low[:, b].copy()
        for z in np.unique(depth[(depth > 0) & (depth <= b)]).tolist():
            of = rows[depth == z]
            among = np.concatenate([code[of, None], near[of, :z]], axis=1)
            exact = ((points[of, None, :] - book[among]) ** 2).sum(axis=2)
            order = np.lexsort((among, exact), axis=1)
            among, exact = np.take_along_axis(among, order, axis=1), np.take_along_axis(exact, order, axis=1)
            out_code[of], out_square[of], out_near[of, :z], out_low[of, :z] = among[:, 0], exact[:, 0], among[:, 1:], np.sqrt(exact[:, 1:].astype(float))
        wide = rows[depth == b + 1]
        if len(wide):
            out_code[wide], out_square[wide], out_near[wide], out_low[wide], out_outer[wide] = nearest(points[wide], book, b)
        if self.last:
            return out_code.astype(np.uint8), out_square
        tail = np.concatenate([out_low, out_outer[:, None]], axis=1)
        tail = np.minimum.accumulate(tail[:, ::-1], axis=1)[:, ::-1]
        out = self._packed(out_code, out_square, out_near, np.maximum(tail[:, :b], 0.0), np.maximum(tail[:, b], 0.0))
        return (*out, np.where(depth > b, len(book), depth).astype(np.uint8))


def _state(kept: DataFrame, shape: Shape, step: Assign, fresh: bool) -> DataFrame:
    """The table of a round: codes, squared distances, and before the last integers, near entries, bounds and depths of all parts."""
    fields = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = f"vec_id {fields['vec_id']}, label {fields['label']}, code binary, error long" + ("" if step.last else ", ints binary, near binary, low binary, outer binary, depth binary")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                n = batch.num_rows
                if fresh:
                    points = shape.integers(batch.column("vector"))
                    code, square, *carried = step.first(points)
                else:
                    read = lambda name, kind, *size: np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype=kind).reshape(n, shape.parts, *size)
                    points = read("ints", shape.kind, shape.width).astype(np.int64)
                    code, square, *carried = step.again(points, read("code", "u1"), read("near", "u1", step.held), read("low", "<u2", step.held), read("outer", "<u2"))
                binary = lambda x: pa.array([row.tobytes() for row in np.ascontiguousarray(x)], pa.binary())
                columns = [batch.column("vec_id"), batch.column("label"), binary(code), pa.array(square.sum(axis=1), pa.int64())]
                names = ["vec_id", "label", "code", "error"]
                if not step.last:
                    columns += [binary(points.astype(shape.kind)), *map(binary, carried)]
                    names += ["ints", "near", "low", "outer", "depth"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return kept.mapInArrow(run, schema)


def _moved(state: DataFrame, shape: Shape, book: np.ndarray) -> tuple[np.ndarray, int]:
    """Codebooks after a round, and the number of near entries for the next: sums per entry and the depths' histogram."""
    parts, entries, width = book.shape
    cells = parts * entries * (width + 1)

    def sums(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), dtype=np.int64)
        depths = np.zeros(256, dtype=np.int64)
        for batch in stream:
            n = batch.num_rows
            points = np.frombuffer(b"".join(batch.column("ints").to_pylist()), dtype=shape.kind).reshape(n, parts, width)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(n, parts)
            depths += np.bincount(np.frombuffer(b"".join(batch.column("depth").to_pylist()), dtype=np.uint8), minlength=256)
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                heads = np.flatnonzero(np.diff(code[order, p], prepend=-1))
                entry = code[order[heads], p]
                total[p, entry, :width] += np.add.reduceat(points[order, p].astype(np.int64), heads, axis=0) if n else 0
                total[p, entry, width] += np.diff(np.append(heads, n))
        flat = np.concatenate([total.reshape(-1), depths])
        full = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(flat[full], pa.int64())], names=["cell", "amount"])

    flat = np.zeros(cells + 256, dtype=object)
    for r in state.select("ints", "code", "depth").mapInArrow(sums, "cell long, amount long").groupBy("cell").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount")).collect():
        flat[r.cell] = int(r.amount)
    total = flat[:cells].reshape(parts, entries, width + 1)
    moved = book.copy()
    for p, e in np.ndindex(parts, entries):
        if total[p, e, width]:
            moved[p, e] = [s // total[p, e, width] for s in total[p, e, :width]]
    shares = np.cumsum(flat[cells:].astype(np.int64)) >= 0.99 * flat[cells:].sum()
    return moved, int(np.clip(shares.argmax(), max(1, entries // 8), max(1, entries // 4)))


def compress(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error`` per kept row (``code``: one byte per part), and the final codebooks
    (parts x entries x width, or an empty array where no row is kept). At most 256 entries."""
    column = F.col(f"`{vector}`")
    kept = vectors.where(finite(column)).select("vec_id", "label", column.cast("array<double>").alias("vector"))
    dims, largest = kept.agg(F.max(F.size("vector")), F.max(F.expr("array_max(transform(vector, x -> abs(x)))"))).first()
    starts = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not starts:
        return kept.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), np.zeros((parts, 0, 0), dtype=np.int64)
    shape = Shape(dims, largest or 0.0, parts, len(starts))
    book = np.ascontiguousarray(shape.integers(pa.array([r.vector for r in starts], pa.list_(pa.float64()))).transpose(1, 0, 2))
    state = kept
    step = Assign(shape, max(1, len(starts) // 4), book, None, 0, rounds == 0)
    for k in range(rounds + 1):
        state = _state(state, shape, step, fresh=k == 0)
        if k == rounds:
            break
        state = staged_small(state, "vector-bounds")
        before, held = book, step.b
        book, b = _moved(state, shape, book)
        step = Assign(shape, min(b, held), book, before, held, k + 1 == rounds)
    return state.select("vec_id", "label", "code", "error"), book


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` (a written table) with ``label_error``: the errors of all rows of its label, missing labels together.

    Labels with over ``HOT`` of all rows are fewer than its inverse and joined by broadcast; the others by their value.
    """
    total = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    sums = staged_small(total.select(F.col("label").alias("_label"), F.expr("try_cast(_sum as bigint)").alias("label_error"), "_rows"), "label-errors")
    bar = (sums.agg(F.sum("_rows")).first()[0] or 0) * HOT
    hot, rest = sums.where(F.col("_rows") > bar).drop("_rows"), sums.where(F.col("_rows") <= bar).drop("_rows")
    marked = coded.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), coded["label"].eqNullSafe(F.col("_label")), "left").drop("_label")
    few = marked.where("_hot").drop("_hot")
    many = marked.where("_hot is null").drop("_hot", "label_error").join(rest, coded["label"].eqNullSafe(F.col("_label")), "left").drop("_label")
    return few.unionByName(many)


def digest(book: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, comma-separated."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def coded_rows(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` per kept row, the code in hex."""
    coded, book = compress(vectors, vector)
    found = with_label_errors(tables.staged_small(coded, "vector-codes"))
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))
