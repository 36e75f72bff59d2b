"""SimHash near-duplicates through tables of distances to reference fingerprints (pivots).

A fingerprint has ``lanes`` words of 64 bits. Its pivot table holds, for every block of bits and every reference, how many
bits of the block differ from the reference; summed over blocks that is the Hamming distance to the reference. Two facts
about fingerprints within ``radius`` bits of each other drive the search:

* with more blocks than differing bits, some blocks are equal, so their rows of the pivot table are equal: fingerprints
  meet in buckets keyed by the table rows of ``equal`` blocks;
* by the triangle inequality no coordinate of the table differs by more than ``radius``: pairs with a larger maximum
  coordinate difference are discarded, the others are verified bit by bit.

With one lane, five blocks and two equal ones, radius 3 is exact: three differing bits spoil three blocks at most. With
several lanes the blocks of each lane make keys of their own, and the search finds similar documents with a probability
that the numbers of lanes and blocks set (see ``SIMILAR``). There the bits only make candidates: the documents of a group
of candidates are compared by their whole shingle sets, and only links that hold there make components (:func:`verified`).

Only distinct fingerprints are compared, so copies cost nothing. A bucket yields a spanning forest of its links, never all
pairs: small buckets are compared as sorted runs, in large ones points are probed one by one until all points not yet
probed belong to one component. Buckets beyond ``BUCKET`` are dealt out in pairs of sub-blocks.

A missing text has no words; a text without words has fingerprint zero, linked like any other. Rows with one id are one
document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import graph, tables
from tidewatch.llm.packing import _mixed

REFERENCES = 16
#: Fingerprints that one task compares with each other at most; larger buckets are split.
BUCKET = 20_000
#: Buckets up to this size are compared as runs.
RUN = 64
#: Shingles that one task verifies at most in one group of candidates, give or take; larger groups are split.
SHINGLES = 4_000_000


@dataclass(frozen=True)
class Shape:
    """What a fingerprint is made of and how near ones are found."""

    words: int = 3
    lanes: int = 1
    blocks: int = 5
    equal: int = 2
    radius: int = 3
    distinct: bool = False     # count each shingle of a text once
    carried: int = 0           # lanes that go to the buckets and that the radius is about; 0: all

    def masks(self) -> list[int]:
        cuts = [round(64 * k / self.blocks) for k in range(self.blocks + 1)]
        return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


#: The contract of the query: three-word shingles, three bits.
EXACT = Shape()
#: Candidates for a similarity of 0.8 or more of the sets of five-word shingles. Sets of similarity 0.8 have a cosine of 0.89,
#: so 15 % of the bits differ. One of 56 blocks of 16 bits is equal with probability 0.985 at 0.8 and 0.998 at 0.85. Of the
#: 256 bits in the buckets 39 differ, with a standard deviation of 5.7; the radius is 3.7 deviations above the mean.
#: Each shingle counts once, as in that similarity, so that a line repeated in two texts does not make them alike.
SIMILAR = Shape(words=5, lanes=14, blocks=4, equal=1, radius=60, distinct=True, carried=4)


def shingle_hashes(raw: bytes, shape: Shape) -> np.ndarray:
    """XXH64 with seed 42 of each shingle of a text, in order of place, or of its distinct shingles in ascending order."""
    import xxhash

    words = raw.lower().split()      # bytes: only A-Z are lowered, only space and the controls 9 to 13 separate
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest, k = xxhash.xxh64_intdigest, shape.words
    shingles = (b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))
    hashes = np.fromiter((digest(s, 42) for s in shingles), dtype=np.uint64)
    return np.unique(hashes) if shape.distinct else hashes


def set_number(hashes: np.ndarray) -> int:
    """A signed 64-bit number of a set of shingles."""
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), 43) - (1 << 63)


def fingerprint(raw: bytes, shape: Shape) -> np.ndarray:
    """The lanes of one text: those of its shingles."""
    return lanes_from(shingle_hashes(raw, shape), shape)


def lanes_from(hashes: np.ndarray, shape: Shape) -> np.ndarray:
    """A bit of the first lane is what most hashes have there; further lanes mix the hashes anew. Zero without hashes."""
    lanes = np.zeros(shape.lanes, dtype=np.uint64)
    if not len(hashes):
        return lanes
    for lane in range(shape.lanes):
        with np.errstate(over="ignore"):
            own = _mixed(hashes + np.uint64(lane) * np.uint64(0xD1342543DE82EF95)) if lane else hashes
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(own), 1 << 16):
            ones += np.unpackbits(own[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        lanes[lane] = np.packbits(2 * ones > len(own), bitorder="little").view(np.uint64)[0]
    return lanes


def fingerprints(docs: DataFrame, shape: Shape) -> DataFrame:
    """``doc_id, fp``: the lanes as bytes, highest first."""
    def hashed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out = [fingerprint(t.encode(), shape).astype(">u8").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "fp"])

    return tables.texts(docs).mapInArrow(hashed, "doc_id long, fp binary")


def lanes_of(raw: list[bytes], shape: Shape) -> np.ndarray:
    """Stored fingerprints as numbers: fingerprints x lanes."""
    return np.frombuffer(b"".join(raw), dtype=">u8").astype(np.uint64).reshape(-1, shape.lanes)


def references(shape: Shape) -> np.ndarray:
    """The fixed reference fingerprints, one row each."""
    return _mixed(np.arange(1, REFERENCES * shape.lanes + 1) * 7919).reshape(REFERENCES, shape.lanes)


def pivot_rows(fps: np.ndarray, lane: int, mask: int, shape: Shape) -> np.ndarray:
    """Bits of one block that differ from each reference: fingerprints x references."""
    return np.bitwise_count((fps[:, lane, None] ^ references(shape)[None, :, lane]) & np.uint64(mask)).astype(np.uint8)


def distances(fps: np.ndarray, shape: Shape) -> np.ndarray:
    """Hamming distance of each fingerprint to each reference: the coordinates of the pivot filter."""
    total = np.zeros((len(fps), REFERENCES), dtype=np.int16)
    for lane in range(shape.lanes):
        total += np.bitwise_count(fps[:, lane, None] ^ references(shape)[None, :, lane])
    return total


def bucket_keys(fps: np.ndarray, shape: Shape) -> np.ndarray:
    """The keys of each fingerprint: one for each choice of ``equal`` blocks of a lane, from their pivot rows."""
    weights = _mixed(np.arange(101, 101 + REFERENCES))
    keys = []
    with np.errstate(over="ignore"):
        for lane in range(shape.lanes):
            rows = [_mixed((pivot_rows(fps, lane, m, shape) * weights).sum(1, dtype=np.uint64)) for m in shape.masks()]
            for chosen in combinations(range(shape.blocks), shape.equal):
                key = np.full(len(fps), lane, dtype=np.uint64)
                for block in chosen:
                    key = _mixed(key * np.uint64(31) + rows[block] + np.uint64(block))
                keys.append(key)
    return np.stack(keys, axis=1)


class Forest:
    """Union-find over the nodes of one task that have links; keeps the links that joined something."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, node: int) -> int:
        parent = self.parent
        top = node
        while (up := parent.get(top, top)) != top:
            top = up
        while node != top:
            parent[node], node = top, parent.get(node, node)
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.parent.setdefault(min(a, b), min(a, b))
        return True


def _near(fps: np.ndarray, table: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs are links: one coordinate after the other discards, what remains is verified."""
    keep = np.arange(len(left))
    for k in range(REFERENCES):
        keep = keep[np.abs(table[left[keep], k] - table[right[keep], k]) <= radius]
        if not len(keep):
            return keep
    return keep[np.bitwise_count(fps[left[keep]] ^ fps[right[keep]]).sum(1) <= radius]


def link_run(keys: np.ndarray, fps: np.ndarray, nodes: np.ndarray, forest: Forest, radius: int, shape: Shape) -> None:
    """Links within small buckets: in rows sorted by key, each row meets the row ``lag`` places on, for all buckets at once."""
    table = distances(fps, shape)
    for lag in range(1, RUN):
        left = np.flatnonzero(keys[lag:] == keys[:-lag])
        if not len(left):
            return
        for i in left[_near(fps, table, left, left + lag, radius)]:
            forest.join(int(nodes[i]), int(nodes[i + lag]))


def link_large(fps: np.ndarray, nodes: np.ndarray, forest: Forest, radius: int, shape: Shape) -> None:
    """Links within one large bucket. Each probe finds all neighbours of one point. Pairs of points that were never probed
    are left untested only if one component already holds them both, so the components are exact."""
    table = distances(fps, shape)
    label = np.arange(len(fps))
    probed = np.zeros(len(fps), dtype=bool)
    everyone = np.arange(len(fps))
    while True:
        open_ = np.flatnonzero(~probed)
        rest = open_[:0]
        if len(open_):
            largest = open_[np.flatnonzero(label[open_] == np.bincount(label[open_]).argmax())[0]]   # one of its points
            rest = open_[label[open_] != label[largest]]
        if not len(rest):
            return
        for point in rest[:256]:
            if label[point] == label[largest]:     # joined it meanwhile
                continue
            probed[point] = True
            for hit in _near(fps, table, np.full(len(fps), point), everyone, radius):
                if label[hit] != label[point]:
                    forest.join(int(nodes[point]), int(nodes[hit]))
                    label[label == label[hit]] = label[point]


def links(distinct: DataFrame, shape: Shape) -> DataFrame:
    """``a, b`` of a spanning forest of each task's links between distinct fingerprints (``fp, node``)."""
    spark = distinct.sparkSession
    whole, shape = shape, replace(shape, lanes=shape.carried or shape.lanes)

    def keyed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                raw = part.column("fp").to_pylist()
                keys = bucket_keys(lanes_of(raw, whole), whole).astype(np.int64)
                n = keys.shape[1]
                rows = np.repeat(np.arange(len(raw)), n)
                carried = pa.array([fp[:8 * shape.lanes] for fp in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), part.column("node").take(pa.array(rows)), carried.take(pa.array(rows))], names=["key", "node", "fp"])

    rows = distinct.select("node", "fp").mapInArrow(keyed, "key long, node long, fp binary")
    large = tables.staged_small(rows.groupBy("key").count().where(F.col("count") > BUCKET).select("key", F.ceil(F.col("count") / BUCKET).cast("int").alias("parts")), "large-buckets")
    rows = rows.withColumn("unit", F.lit(0).cast("long"))
    if not large.isEmpty():
        # Each sub-block of a large bucket meets each other one, itself included, in a unit of its own.
        own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))
        dealt = rows.join(large, "key", "left").withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", other)
        rows = dealt.withColumn("unit", F.greatest("own", "other").cast("long") * 2147483648 + F.least("own", "other")).select("key", "node", "fp", "unit")
    ordered = rows.repartition(tables.partitions(spark), "key", "unit").sortWithinPartitions("key", "unit")

    def linked(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        made: list[tuple[int, int]] = []
        join = forest.join

        def kept(a: int, b: int) -> bool:
            if join(a, b):
                made.append((a, b))
                return True
            return False

        forest.join = kept  # type: ignore[method-assign]

        def flush(keys: np.ndarray, fps: np.ndarray, nodes: np.ndarray) -> None:
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
            sizes = np.diff(np.append(starts, len(keys)))
            small = np.repeat((sizes > 1) & (sizes <= RUN), sizes)
            link_run(np.repeat(np.arange(len(sizes)), sizes)[small], fps[small], nodes[small], forest, shape.radius, shape)
            for start, size in zip(starts[sizes > RUN], sizes[sizes > RUN], strict=True):
                link_large(fps[start:start + size], nodes[start:start + size], forest, shape.radius, shape)

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0
        for batch in stream:
            held.append((np.stack([batch.column("key").to_numpy(), batch.column("unit").to_numpy()], axis=1),
                         lanes_of(batch.column("fp").to_pylist(), shape), batch.column("node").to_numpy()))
            count += batch.num_rows
            if count >= 100_000:
                keys, fps, nodes = (np.concatenate(x) for x in zip(*held, strict=True))
                last = int(np.flatnonzero((keys != keys[-1]).any(1))[-1]) + 1 if (keys != keys[-1]).any() else 0   # the last bucket may go on
                if last:
                    flush(keys[:last], fps[:last], nodes[:last])
                held = [(keys[last:], fps[last:], nodes[last:])]
                count = len(keys) - last
        if held:
            flush(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for at in range(0, len(made), 50_000):
            a, b = zip(*made[at:at + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return ordered.mapInArrow(linked, "a long, b long")


def near_duplicates(docs: DataFrame, shape: Shape = EXACT) -> DataFrame:
    """``doc_id, fp, component_id`` of every document. The component is its smallest id (missing if no member has one)."""
    marked = tables.staged_small(fingerprints(docs, shape), "fingerprints")
    # One lane is its own number; several are numbered by a 64-bit hash.
    node = F.conv(F.hex("fp"), 16, -10).cast("long") if shape.lanes == 1 else F.xxhash64("fp")
    distinct = tables.staged_small(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("node", node), "distinct-fingerprints")
    roots = graph.components(links(distinct, shape))
    placed = distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = tables.staged_small(placed.join(smallest, "root").select("fp", "n", "component_id"), "placed-fingerprints")
    # Fingerprints with very many copies join by broadcast, so that their documents stay where they are: each holds over a
    # hundred-thousandth of all rows, so there are fewer than a hundred thousand of them. The rest is joined by shuffle.
    total = known.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") > max(2000, total // 100_000)
    copies = marked.join(F.broadcast(known.where(often).select("fp", "component_id", F.lit(True).alias("_often"))), "fp", "left")
    some = copies.where("_often").select("doc_id", "fp", "component_id")
    rest = copies.where("_often is null").select("doc_id", "fp").join(known.where(~often).select("fp", "component_id"), "fp")
    return some.unionByName(rest.select("doc_id", "fp", "component_id"))


def _alike(sets: list[np.ndarray], nodes: np.ndarray, forest: Forest) -> None:
    """Links of similarity 0.8 or more between the given sets of shingles: each probe counts what one set shares with every
    other. Pairs that were never probed are left uncounted only if one component already holds them both."""
    sizes = np.array([len(x) for x in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], np.repeat(np.arange(len(sets)), sizes)[order]
    label = np.arange(len(sets))
    probed = np.zeros(len(sets), dtype=bool)
    while True:
        open_ = np.flatnonzero(~probed)
        if not len(open_):
            return
        largest = open_[np.flatnonzero(label[open_] == np.bincount(label[open_]).argmax())[0]]
        rest = open_[label[open_] != label[largest]]
        if not len(rest):
            return
        for point in rest[:256]:
            if label[point] == label[largest]:     # joined it meanwhile
                continue
            probed[point] = True
            low, high = np.searchsorted(every, sets[point]), np.searchsorted(every, sets[point], side="right")
            held = high - low
            at = np.arange(held.sum()) + np.repeat(low - (np.cumsum(held) - held), held)
            common = np.bincount(owner[at], minlength=len(sets))
            # common / (a + b - common) >= 4 / 5
            for hit in np.flatnonzero((9 * common >= 4 * (sizes + sizes[point])) & (label != label[point])):
                if label[hit] != label[point]:
                    forest.join(int(nodes[point]), int(nodes[hit]))
                    label[label == label[hit]] = label[point]


def verified(docs: DataFrame, candidates: DataFrame, shape: Shape) -> DataFrame:
    """``a, b`` of a spanning forest of each task's links between the distinct shingle sets of ``candidates (node, least, n,
    root)``: all those of one root are compared with each other by the sets themselves, read again from document ``least``."""
    spark = docs.sparkSession
    groups = candidates.groupBy("root").agg(F.ceil(F.sum("n") / SHINGLES).cast("int").alias("parts"))
    dealt = tables.staged_small(candidates.join(groups, "root").select("node", "root", "parts", F.col("least").alias("_id")), "candidates")
    ids = dealt.select("_id").distinct()
    # Up to a million ids go to where the texts are.
    wanted = tables.texts(docs).join(F.broadcast(ids) if dealt.count() <= 1_000_000 else ids, F.col("doc_id") == F.col("_id"), "left_semi")

    def hashed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            sets = [shingle_hashes(t.encode(), shape) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_number(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["_id", "node", "hashes"])

    # Rows that share an id may hold several texts, of which only the candidate is meant.
    sets = wanted.mapInArrow(hashed, "_id long, node long, hashes binary").join(dealt, ["_id", "node"])
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    # Each part of a large group meets each other one, itself included, in a unit of its own.
    rows = sets.withColumn("own", own).withColumn("other", other)
    rows = rows.select("root", (F.greatest("own", "other").cast("long") * 2147483648 + F.least("own", "other")).alias("unit"), "node", "hashes")
    ordered = rows.repartition(tables.partitions(spark), "root", "unit").sortWithinPartitions("root", "unit", "node")

    def linked(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple[int, int] | None = None
        held: dict[int, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            made: list[tuple[int, int]] = []
            forest = Forest()
            join = forest.join
            forest.join = lambda a, b: join(a, b) and not made.append((a, b))  # type: ignore[method-assign]
            if len(held) > 1:
                _alike(list(held.values()), np.array(list(held), dtype=np.int64), forest)
            for at in range(0, len(made), 50_000):
                a, b = zip(*made[at:at + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in stream:
            for root, unit, node, raw in zip(*(batch.column(c).to_pylist() for c in ("root", "unit", "node", "hashes")), strict=True):
                if (root, unit) != current:
                    yield from flush()
                    held = {}
                current = root, unit
                held[node] = np.frombuffer(raw, dtype=np.uint64)      # a row stored twice counts once
        yield from flush()

    return ordered.mapInArrow(linked, "a long, b long")


def near_copies(docs: DataFrame, shape: Shape = SIMILAR) -> DataFrame:
    """``node, least, component_id``: of every distinct set of shingles among the documents with an id, the smallest id, and
    the smallest id of its component of sets with a similarity of 0.8 or more."""
    named = docs.where("doc_id is not null")

    def hashed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            sets = [shingle_hashes(t.encode(), shape) for t in batch.column(1).to_pylist()]
            out = ([set_number(x) for x in sets], [len(x) for x in sets], [lanes_from(x, shape).astype(">u8").tobytes() for x in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary()), strict=True))], names=["doc_id", "node", "n", "fp"])

    marked = tables.texts(named).mapInArrow(hashed, "doc_id long, node long, n long, fp binary")
    distinct = tables.staged_small(marked.groupBy("node", "n", "fp").agg(F.min("doc_id").alias("least")), "distinct-shingle-sets")
    groups = graph.components(links(distinct, shape))
    found = verified(named, distinct.join(groups, "node").select("node", "least", "n", "root"), shape)
    roots = graph.components(found)
    placed = distinct.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(smallest, "root").select("node", "least", "component_id")


def keep_one(docs: DataFrame, shape: Shape = SIMILAR) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id stays (of several rows with
    that id, the one whose text hash is least). Rows without an id are in no one's way and all stay."""
    stays = near_copies(docs, shape).select(F.col("component_id").alias("_id")).distinct()
    from pyspark.sql import Window

    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_id"), tables.whole_row(docs)).join(stays, "_id")
    text = F.col("_whole.text")
    first = F.row_number().over(Window.partitionBy("_id").orderBy(F.xxhash64(text), text))
    one = named.withColumn("_first", first).where("_first = 1").select("_whole.*")
    return one.unionByName(docs.where("doc_id is null"))
