"""Exact substring deduplication over bytes with suffix arrays of shards.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document with a smaller id, or at a
smaller place of the same document. Windows of ``length`` bytes are brought together by content:

1. Each block marks the anchor of every window: the least hash of its substrings of ``GRAM`` bytes. Equal windows have equal
   anchors at equal places, and neighbouring windows mostly share one, so runs of windows become one record: anchor hash,
   hash of the run's bytes, place. Equal runs of one block are one record. Records go to buckets by a mixed hash of the
   anchor: the anchors themselves, least hashes, crowd at the lower end.
2. A bucket sees all runs of an anchor. Of equal runs all but the first lose their windows. Anchors with a single
   distinct run are done; the others' distinct runs are cut out of their blocks.
3. Those runs are divided into parts: halves, or starts of ``PART`` places where an anchor has over ``CROWDED`` distinct
   runs. All windows of a part share a core of bytes, and equal windows are in parts with equal cores. Parts with their
   core as the anchor go through step 2 once more: most runs share no more than their anchor and are done.
4. Shards of the parts that are left, whole cores each, are sorted by their suffixes: an array induced from leftmost-smaller
   substrings, then permuted common prefixes (:mod:`suffixes`). Neighbours that agree in ``length`` bytes are one window,
   of which the earliest start stays. Of a core with over ``SINGLE`` distinct parts each window is a part of its own, merged
   within its block and again as it arrives, sorted. So a shard holds each string of bytes once, and one core has up to
   ``SINGLE`` of them.
5. The blocks unite all lost windows to maximal spans.

So every document is read whole and every window is judged on the input; nothing is sampled. Runs and parts are compared by
64-bit hashes, windows of different parts by their bytes.

A missing text is empty; texts under ``length`` bytes lose nothing, nor do rows without an id, which also come after all
others. Of rows with the same id the one stored first counts as earlier.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import blocks, suffixes, tables
from tidewatch.llm.packing import _mixed
from tidewatch.session import scratch_path

LENGTH = 100
GRAM = 32
#: Bytes of text whose windows are marked at once, and of runs that one suffix array holds.
CHUNK, SHARD = 1 << 20, 1 << 20
#: Distinct runs from which an anchor's parts are small, and window starts per small part.
CROWDED, PART = 500, 8
#: Distinct parts from which those of a core are single windows.
SINGLE = 10_000
#: Blocks whose records make one bucket, where the session has fewer partitions.
BUCKET = 4
BASE = 0xD6E8FEB86659FD93
_BYTES = _mixed(np.arange(256) + 1009)


def _powers(n: int) -> np.ndarray:
    """The first ``n`` powers of ``BASE`` and of its inverse."""
    made = np.full((2, n), [[BASE], [pow(BASE, -1, 1 << 64)]], dtype=np.uint64)
    made[:, 0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(made, axis=1, out=made)


_usual = functools.cache(lambda: _powers(CHUNK + 1))               # for every text but a long document


class _Prefixes:
    """Hashes of any substrings of a text: sums of byte values times powers of ``BASE``, brought to the same power."""

    def __init__(self, raw: np.ndarray) -> None:
        power, self.inverse = _usual()[:, :len(raw) + 1] if len(raw) <= CHUNK else _powers(len(raw) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * power[:-1], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def every(self, width: int) -> np.ndarray:
        """Hashes of all substrings of ``width`` bytes, in order of place."""
        with np.errstate(over="ignore"):
            return _mixed((self.sums[width:] - self.sums[:-width]) * self.inverse[:-width])


def runs(block: blocks.Block, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor, in order of place: first start ``p``, number of starts ``n``, place of the anchor
    after ``p``, hash ``a`` of the anchor, hash ``c`` of anchor, shape and bytes. Places count from the block's start."""
    raw = np.frombuffer(block.raw, dtype=np.uint8)
    out: list[np.ndarray] = []
    k = 0
    while k < len(block):
        first = k
        begin = block.starts[k]
        while k < len(block) and (k == first or block.ends[k] - begin <= CHUNK):
            k += 1
        piece = raw[begin:block.ends[k - 1]]
        if len(piece) < length:
            continue
        hashed = _Prefixes(piece)
        grams = hashed.every(gram)
        bits = np.uint64(len(piece).bit_length())
        # High bits of the hash, then the place from the end: of equal hashes the last counts.
        least = (grams >> bits << bits) | (len(piece) - np.arange(len(grams))).astype(np.uint64)
        size, width = 1, length - gram + 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[:len(least) - (width - size)], least[width - size:])
        anchor = len(piece) - (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        room = np.repeat(block.ends[first:k] - begin, block.ends[first:k] - block.starts[first:k])[:len(anchor)] - np.arange(len(anchor))
        starts = np.flatnonzero(room >= length)                   # windows that end within their document
        if not len(starts):
            continue
        breaks = np.concatenate([[True], (anchor[starts[1:]] != anchor[starts[:-1]]) | (np.diff(starts) != 1)])
        heads = np.flatnonzero(breaks)
        p, n = starts[heads], np.diff(np.append(heads, len(starts)))
        at = anchor[p]
        content = hashed.of(p, p + n - 1 + length)
        with np.errstate(over="ignore"):
            c = _mixed(content + (n * 256 + (at - p)).astype(np.uint64) * np.uint64(BASE)) ^ grams[at]
        out.append(np.stack([(p + begin).astype(np.uint64), n.astype(np.uint64), (at - p).astype(np.uint64), grams[at], c]))
    every = np.concatenate(out, axis=1) if out else np.zeros((5, 0), dtype=np.uint64)
    return {"p": every[0].astype(np.int64), "n": every[1].astype(np.int64), "rel": every[2].astype(np.int64), "a": every[3], "c": every[4]}


def _buckets(stored: DataFrame) -> int:
    """As many as the session has partitions, and enough that one bucket fits a task in any session."""
    return max(tables.partitions(stored.sparkSession), -(-stored.count() // BUCKET))


def _by_anchor(a: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Order by ``a``, then by the keys. Most anchors stand alone, so only the others are sorted by more."""
    order = np.argsort(a)
    same = a[order][1:] == a[order][:-1]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same))[:len(a)]
    among = order[tied]
    order[tied] = among[np.lexsort((*(k[among] for k in reversed(keys)), a[among]))]
    return order


_RECORDS = "bucket int, block long, a binary, c binary, doc binary, p binary, n binary, rel binary"


def _dealt(number: int, found: dict[str, np.ndarray], buckets: int) -> pa.RecordBatch:
    """The records of a block by bucket, equal ones (by ``a`` and ``c``) once: the first in order of place. The others are
    lost and make one row with them in ``p`` and nothing in ``a``."""
    order = _by_anchor(found["a"], found["c"], found["p"])
    found = {k: v[order] for k, v in found.items()}
    again = np.append(False, (found["a"][1:] == found["a"][:-1]) & (found["c"][1:] == found["c"][:-1]))[:len(order)]
    lost = np.zeros(int(again.sum()), dtype=_LOST)
    lost["p"], lost["n"] = found["p"][again], found["n"][again]
    found = {k: v[~again] for k, v in found.items()}
    lows = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
    edges = np.concatenate([[0], np.searchsorted(found["a"], lows), [len(found["a"])]])
    full = np.flatnonzero(edges[:-1] < edges[1:]).tolist()
    part = [slice(edges[b], edges[b + 1]) for b in full]
    columns = [[blocks.packed(found["a"][s]) for s in part], [found["c"][s].tobytes() for s in part], [blocks.shifted(found["doc"][s]) for s in part],
               [found["p"][s].astype("<u4").tobytes() for s in part], [blocks.shifted(found["n"][s]) for s in part], [blocks.shifted(found["rel"][s]) for s in part]]
    if len(lost):
        full.append(int(_mixed(np.array([number]))[0] % np.uint64(buckets)))
        for column, value in zip(columns, (b"", b"", b"", lost.tobytes(), b"", b""), strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([number] * len(full), pa.int64()), *(pa.array(x, pa.binary()) for x in columns)],
                                      names=["bucket", "block", "a", "c", "doc", "p", "n", "rel"])


def records(stored: DataFrame, length: int, buckets: int) -> DataFrame:
    """``bucket, block, a, c, doc, p, n, rel``: packed arrays of the distinct runs of each block, and its lost ones."""
    def marked(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in blocks.read_blocks(stream):
            found = runs(block, length)
            found["doc"] = block.ids[np.searchsorted(block.ends, found["p"], side="right")]
            found = {k: v[found["doc"] != blocks.LAST] for k, v in found.items()}
            yield _dealt(number, found | {"a": _mixed(found["a"])}, buckets)

    return stored.mapInArrow(marked, _RECORDS)


#: kind 0: runs or parts lost entirely (p, n); kind 1: those whose bytes are called for (p, n, rel, a, crowded).
_NOTES = "block long, bucket int, kind int, reply binary"
_CALL = np.dtype([("p", "<u4"), ("n", "<u2"), ("rel", "<u2"), ("a", "<u8"), ("crowded", "u1")])
_LOST = np.dtype([("p", "<u4"), ("n", "<u2")])


def sorted_out(found: DataFrame) -> DataFrame:
    """Per block and bucket: runs (or parts) lost to an equal earlier one, and distinct ones that share their anchor with others."""
    def judge(bucket: int, rows: list[tuple]) -> pa.RecordBatch:
        sizes = [len(r[1]) for r in rows]
        which = np.repeat(np.arange(len(rows)), sizes)
        number = np.repeat(np.array([r[0] for r in rows]), sizes)
        a, c, doc, p, n, rel = (np.concatenate([r[k] for r in rows]) for k in range(1, 7))
        order = _by_anchor(a, c, doc, number, p)
        sa, sc = a[order], c[order]
        new_anchor = np.concatenate([[True], sa[1:] != sa[:-1]])
        new_run = new_anchor | np.concatenate([[True], sc[1:] != sc[:-1]])
        group = np.cumsum(new_anchor) - 1
        kinds = np.bincount(group[new_run])                         # distinct runs of each anchor
        called = new_run & (kinds[group] > 1)
        out: dict[tuple[int, int], np.ndarray] = {}
        for kind, chosen, form in ((0, ~new_run, _LOST), (1, called, _CALL)):
            at = order[chosen]
            note = np.zeros(len(at), dtype=form)
            note["p"], note["n"] = p[at], n[at]
            if kind:
                note["rel"], note["a"], note["crowded"] = rel[at], a[at], (kinds[group[chosen]] > CROWDED) + 1 * (kinds[group[chosen]] > max(CROWDED, SINGLE))
            by_row = np.argsort(which[at], kind="stable")
            cuts = np.searchsorted(which[at][by_row], np.arange(len(rows) + 1))
            for k in range(len(rows)):
                if cuts[k] < cuts[k + 1]:
                    out[k, kind] = note[by_row[cuts[k]:cuts[k + 1]]]
        return pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k, _ in out], pa.int64()), pa.array([bucket] * len(out), pa.int32()),
                                           pa.array([kind for _, kind in out], pa.int32()), pa.array([x.tobytes() for x in out.values()], pa.binary())], names=["block", "bucket", "kind", "reply"])

    def by_bucket(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for batch in stream:
            own = batch.filter(pa.compute.equal(pa.compute.binary_length(batch.column("a")), 0))
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([own.column("block"), own.column("bucket"), pa.array([0] * own.num_rows, pa.int32()), own.column("p")], names=["block", "bucket", "kind", "reply"])
            for bucket, number, a, c, doc, p, n, rel in zip(*(batch.column(k).to_pylist() for k in ("bucket", "block", "a", "c", "doc", "p", "n", "rel")), strict=True):
                if not a:
                    continue
                if bucket != current and rows:
                    yield judge(current, rows)
                    rows = []
                current = bucket
                rows.append((number, blocks.unpacked(a), np.frombuffer(c, dtype="<u8"), blocks.unshifted(doc), np.frombuffer(p, dtype="<u4").astype(np.int64), blocks.unshifted(n), blocks.unshifted(rel)))
        if rows:
            yield judge(current, rows)

    # Buckets are equal ranges of hashes, so their numbers place them; ranges would be sampled by marking all windows once more.
    n = tables.partitions(found.sparkSession)
    return found.repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket").mapInArrow(by_bucket, _NOTES)


def cut_out(stored: DataFrame, notes: DataFrame, length: int) -> DataFrame:
    """Blocks of the runs that were called for: a run's bytes as a text, its document as the id, its call in the rest."""
    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for number, block, given in _numbered(stream):
            calls = np.concatenate([np.frombuffer(r, dtype=_CALL) for rs in given.values() for r in rs] or [np.zeros(0, _CALL)])
            if not len(calls):
                continue
            calls = calls[np.argsort(calls["p"], kind="stable")]
            begin, sizes = calls["p"].astype(np.int64), calls["n"].astype(np.int64) - 1 + length
            docs = block.ids[np.searchsorted(block.ends, begin, side="right")]
            sink = pa.BufferOutputStream()
            part = pa.RecordBatch.from_arrays([pa.array(calls[name]) for name in _CALL.names], names=list(_CALL.names))
            with pa.ipc.new_stream(sink, part.schema) as writer:
                writer.write_batch(part)
            raw = b"".join([block.raw[p:p + size] for p, size in zip(begin.tolist(), sizes.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in (docs.tobytes(), sizes.tobytes(), press.compress(raw), press.compress(sink.getvalue().to_pybytes())))],
                names=["block", "ids", "sizes", "payload", "rest"])

    spark = stored.sparkSession
    path = scratch_path(spark, "suffix-runs")
    blocks.with_replies(stored, notes.where("kind = 1")).mapInArrow(cut, blocks.SCHEMA).write.option("compression", "none").parquet(path)
    return spark.read.schema(blocks.SCHEMA).parquet(path)


def _call(block: blocks.Block) -> dict[str, np.ndarray]:
    """The calls of a block of runs."""
    rest = block.rest()
    return {name: rest.column(name).to_numpy() for name in _CALL.names}


def parts(held: DataFrame, length: int, buckets: int, gram: int = GRAM) -> DataFrame:
    """Like :func:`records` for the parts of the runs in ``held``; ``a`` is the hash of anchor, place and core of a part."""
    half = (length - gram + 2) // 2

    def divided(block: blocks.Block, call: dict[str, np.ndarray], first: int, last: int) -> dict[str, np.ndarray]:
        begin = block.starts[first]
        hashed = _Prefixes(np.frombuffer(block.raw, dtype=np.uint8)[begin:block.ends[last - 1]])
        p, n, rel = (call[k][first:last].astype(np.int64) for k in ("p", "n", "rel"))
        size = np.where(call["crowded"][first:last] > 0, PART, half)
        low, high = (rel - n + 1) // size, rel // size             # windows start ``rel - n + 1`` to ``rel`` bytes before the anchor
        run = np.repeat(np.arange(last - first), high - low + 1)
        j = np.arange(len(run)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[run]
        p, n, size, anchor = p[run], n[run], size[run], (p + rel)[run]
        # Starts in (anchor - size (j + 1), anchor - size j] all cover the same bytes around the anchor.
        start, end = np.maximum(p, anchor - size * (j + 1) + 1), np.minimum(p + n - 1, anchor - size * j)
        shift = block.starts[first:last][run] - begin - p
        core = hashed.of(anchor - size * j + shift, anchor - size * (j + 1) + 1 + length + shift)
        content = hashed.of(start + shift, end + length + shift)
        with np.errstate(over="ignore"):
            a = _mixed(core + j.astype(np.uint64) * np.uint64(BASE)) ^ call["a"][first:last][run]
            c = _mixed(content + ((end - start) * 256 + (anchor - start)).astype(np.uint64) * np.uint64(BASE))
        return {"a": _mixed(a), "c": c, "doc": block.ids[first:last][run], "p": start, "n": end - start + 1, "rel": anchor - start}

    def marked(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in blocks.read_blocks(stream):
            call, out, first = _call(block), [], 0
            while first < len(block):
                last = max(first + 1, int(np.searchsorted(block.ends, block.starts[first] + CHUNK, side="right")))
                out.append(divided(block, call, first, last))
                first = last
            yield _dealt(number, {k: np.concatenate([x[k] for x in out]) for k in out[0]}, buckets)

    return held.mapInArrow(marked, _RECORDS)


def called(stored: DataFrame, notes: DataFrame, length: int) -> DataFrame:
    """``key, doc, block, p, n, anchor, bytes``: the bytes of every part whose core is in other parts, too, keyed by the core.
    Parts lost to an equal earlier one make rows with ``n`` = -1 that list them."""
    def sending(rows: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*rows, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(np.array(c[0], dtype=np.uint64).astype(np.int64)), *(pa.array(x, pa.int64()) for x in c[1:6]), pa.array(c[6], pa.binary())],
                                          names=["key", "doc", "block", "p", "n", "anchor", "bytes"])

    def answer(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block, given in _numbered(stream):
            calls = np.concatenate([np.frombuffer(r, dtype=_CALL) for rs in given.values() for r in rs] or [np.zeros(0, _CALL)])
            calls = calls[np.argsort(calls["p"], kind="stable")]
            begins = _call(block)["p"].astype(np.int64)
            run = np.searchsorted(begins, calls["p"], side="right") - 1
            docs, places = block.ids[run], block.starts[run] + calls["p"] - begins[run]
            rows: list[tuple] = []
            sent: set[bytes] = set()
            again: list[tuple[int, int]] = []
            for (p, n, rel, a, crowded), doc, at in zip(calls.tolist(), docs.tolist(), places.tolist(), strict=True):
                if len(rows) >= 20_000:
                    yield sending(rows)
                    rows = []
                if crowded < 2:
                    rows.append((a, doc, number, p, n, p + rel, block.raw[at:at + n - 1 + length]))
                    continue
                for k in range(n):
                    window = block.raw[at + k:at + k + length]
                    told = hashlib.blake2b(window, digest_size=16, key=a.to_bytes(8, "little")).digest()
                    if told in sent:
                        again.append((p + k, 1))
                        continue
                    sent.add(told)
                    rows.append((int.from_bytes(told[:8], "little"), doc, number, p + k, 1, p + rel, window))
            if again:
                rows.append((int(_mixed(np.array([number]))[0]), 0, number, 0, -1, 0, np.array(again, dtype=_LOST).tobytes()))
            yield sending(rows)

    held = cut_out(stored, notes, length)
    judged = tables.staged_small(sorted_out(parts(held, length, _buckets(held))), "suffix-parts")
    rows = blocks.with_replies(held, judged.where("kind = 1")).mapInArrow(answer, "key long, doc long, block long, p long, n long, anchor long, bytes binary")
    zero = F.lit(0).cast("long")
    return rows.unionByName(judged.where("kind = 0").select(F.xxhash64("block", "bucket").alias("key"), zero.alias("doc"), "block", zero.alias("p"), F.lit(-1).cast("long").alias("n"), zero.alias("anchor"), F.col("reply").alias("bytes")))


def _numbered(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, blocks.Block, dict[int, list[bytes]]]]:
    """Like :func:`blocks.answered`, with the blocks' numbers."""
    numbers: list[int] = []

    def noted() -> Iterator[pa.RecordBatch]:
        for batch in stream:
            numbers.extend(n for n, b in zip(batch.column("block").to_pylist(), batch.column("bucket").to_pylist(), strict=True) if b < 0)
            yield batch

    for k, (block, given) in enumerate(blocks.answered(noted())):
        yield numbers[k], block, given


def lost_in_shard(rows: list[tuple[int, int, int, int, int, bytes]], length: int) -> list[np.ndarray]:
    """For each run (``doc, block, p, n, anchor, bytes``) which of its windows also start earlier in another run here."""
    sizes = np.array([len(r[5]) for r in rows])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.zeros(begins[-1] + 1, dtype=np.int64)               # bytes as 2 to 257, 1 between runs, 0 at the end
    body = np.ones(begins[-1], dtype=bool)
    body[begins[1:] - 1] = False
    text[:-1][body] = np.frombuffer(b"".join(r[5] for r in rows), dtype=np.uint8).astype(np.int64) + 2
    text[:-1][~body] = 1
    order = suffixes.suffix_array(text)
    fresh = np.zeros(len(text), dtype=bool)
    fresh[begins] = True
    common = suffixes.permuted_common_prefixes(text, order, fresh, int(sizes.max()) + 8)
    group = np.cumsum(common[order] < length)                     # equal windows are neighbours
    earlier = np.empty(len(rows), dtype=np.int64)                 # rank of each run by document and place
    earlier[np.lexsort(([r[4] for r in rows], [r[1] for r in rows], [r[0] for r in rows]))] = np.arange(len(rows))
    owner = np.append(np.repeat(np.arange(len(rows)), sizes + 1), -1)[order]
    window = owner >= 0
    window &= order - begins[owner] <= (sizes - length)[owner]
    place, owner, group = order[window], owner[window], group[window]
    best = np.full(int(group.max()) + 1, len(rows), dtype=np.int64)
    np.minimum.at(best, group, earlier[owner])
    lost = np.zeros(len(text), dtype=bool)
    lost[place] = earlier[owner] > best[group]
    return [lost[b:b + r[3]] for b, r in zip(begins, rows, strict=False)]


def shards(stream: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """``block, reply`` of the rows of :func:`called`, sorted by key and bytes: of rows with equal key and bytes the first is
    held and the others are lost; of a key with several strings the suffix arrays tell; a key with one is done."""
    held: list[tuple] = []
    size, start, last, shown = 0, 0, None, None                    # the rows of the last key are held from ``start`` on
    notes: dict[int, list] = {}

    def flush() -> pa.RecordBatch:
        for row, lost in zip(held, lost_in_shard(held, length) if held else [], strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], lost.astype(np.int8), [0]]))).reshape(-1, 2)
            notes.setdefault(row[1], []).extend((row[2] + a, b - a) for a, b in edges.tolist())
        made = {k: v for k, v in notes.items() if v}
        notes.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array([np.array(v, dtype=_LOST).tobytes() for v in made.values()], pa.binary())], names=["block", "reply"])

    for batch in stream:
        ready = batch.filter(pa.compute.less(batch.column("n"), 0))
        if ready.num_rows:
            yield pa.RecordBatch.from_arrays([ready.column("block"), ready.column("bytes")], names=["block", "reply"])
        for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "block", "p", "n", "anchor", "bytes")), strict=True):
            _, number, p, n, _, raw = row
            if n < 0:
                continue
            if key == last and raw == shown:
                notes.setdefault(number, []).append((p, n))
                continue
            if key != last:
                if len(held) == start + 1:
                    size -= len(held.pop()[5])
                if size >= SHARD:
                    yield flush()
                    held, size = [], 0
                start = len(held)
            last, shown = key, raw
            held.append(tuple(row))
            size += len(raw)
    if len(held) == start + 1:
        held.pop()
    yield flush()


def compared(snippets: DataFrame, length: int) -> DataFrame:
    """``block, reply``: windows lost to earlier ones in other parts, by suffix arrays over :func:`shards` of whole keys."""
    dealt = snippets.repartition(tables.partitions(snippets.sparkSession), "key").sortWithinPartitions("key", "bytes", "doc", "block", "anchor")
    return dealt.mapInArrow(lambda stream: shards(stream, length), "block long, reply binary")


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` per document; spans are byte ranges ``[start, end)``."""
    stored = blocks.write_blocks(docs, "suffix-blocks")
    notes = tables.staged_small(sorted_out(records(stored, length, _buckets(stored))), "suffix-notes")
    more = tables.staged_small(compared(called(stored, notes, length), length), "suffix-lost")
    lost = notes.where("kind = 0").select("block", "bucket", "reply").unionByName(more.select("block", F.lit(0).alias("bucket"), "reply"))

    def apply(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, given in blocks.answered(stream):
            gone = np.concatenate([np.frombuffer(r, dtype=_LOST) for rs in given.values() for r in rs] or [np.zeros(0, _LOST)])
            p, n = gone["p"].astype(np.int64), gone["n"].astype(np.int64)
            change = np.zeros(len(block.raw) + 1, dtype=np.int32)
            np.add.at(change, p, 1)
            np.add.at(change, p + n - 1 + length, -1)
            goes = np.cumsum(change)[:-1] > 0
            out = []
            for k in range(len(block)):
                mask, text = goes[block.starts[k]:block.ends[k]], block.text(k)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).reshape(-1, 2)
                kept = text if not len(edges) else np.frombuffer(text, dtype=np.uint8)[~mask].tobytes()
                out.append((len(text), len(text) - len(kept), len(edges), hashlib.sha256(kept).hexdigest(), [{"start": int(a), "end": int(b)} for a, b in edges]))
            c = list(zip(*out, strict=True))
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([block.doc_ids(), *(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3]), pa.array(c[4], spans)],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return blocks.with_replies(stored, lost).mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>")
