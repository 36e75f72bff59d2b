"""Periodic runs of words: longest common extensions over a difference cover, asked along harmonic grids.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and at least ``max(24, 3 q)``
words that no neighbouring word extends. A batch of texts is one array of numbers, a word's number holding its text, so
that nothing is equal across texts.

Extensions: places are sampled by a difference cover modulo 31: for any two places some shift below 31 brings both onto
sampled ones. Only sampled suffixes are sorted: first by the names of their next 31 words (hashes, held against the words
themselves), then by doubling of whole blocks, which stays within the sample. The common blocks of neighbours in that
order go into a sparse table of minima. The extension of two places is at most 30 words compared up to the
synchronised sampled places, a range minimum, and at most 30 words after the common blocks.

Enumeration: a run of period q holds three places of the grid 0, q, 2q, ... of which each equals the next, so for each q
only grid places equal to both next ones are asked for their extension (n/1 + n/2 + ... places for a text of n words). The
first grid place of a run extends more than q words; its start is found by bisection over extensions. A stretch found under
several periods keeps the smallest one.

Defined results: a text without words, empty or missing, has no runs and an empty collapsed text. Every row is judged
alone, so repeated rows and ids have a row each. Texts are whole whatever their length: memory is in proportion to a
text's words times the logarithm of their number. Equally repetitive runs: the one that starts first, then the smaller
period. Other columns are not read and cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm import tables
from tidewatch.llm.windows import rolling

#: Least number of words of a run, and of its periods.
LEAST, TIMES = 24, 3
#: A difference cover: every number below 31 is a difference of two of these modulo 31.
MODULUS, COVER = 31, np.array([1, 5, 11, 24, 25, 27])
#: Characters of text in memory at once, and grid places asked at once.
BATCH_CHARS, ASKED = 4_000_000, 500_000
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = ("doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start: long, length: long, period: long>>, "
          "runs_sha256 string, collapsed_sha256 string")


def _shifts() -> np.ndarray:
    """For remainders of two places the least shift that brings both into the cover."""
    out = np.full((MODULUS, MODULUS), MODULUS, dtype=np.int64)
    for a in range(MODULUS):
        inside = np.isin((a + np.arange(MODULUS)) % MODULUS, COVER)
        for b in range(MODULUS):
            out[a, b] = np.argmax(inside & np.isin((b + np.arange(MODULUS)) % MODULUS, COVER))
    return out


SHIFT = _shifts()
_SLOT = np.full(MODULUS, -1)
_SLOT[COVER] = np.arange(len(COVER))


class Extensions:
    """Longest common extensions of places of ``codes`` (64-bit numbers from 0)."""

    def __init__(self, codes: np.ndarray) -> None:
        self.n = len(codes)
        pad = 3 * MODULUS
        self.codes = np.concatenate([codes.astype(np.int64), -1 - np.arange(pad, dtype=np.int64)])     # nothing equals the padding
        blocks = (self.n + MODULUS) // MODULUS + 1
        places = (np.arange(blocks)[:, None] * MODULUS + COVER).reshape(-1)
        levels = [self._names(places)]
        step = len(COVER)
        while True:
            rank = levels[-1]
            again = np.bincount(rank, minlength=len(rank))[rank] > 1
            if not again.any():
                break
            levels.append(self._doubled(rank, np.flatnonzero(again), step))
            step *= 2
        order = np.argsort(levels[-1], kind="stable")
        self.rank = levels[-1]
        self.minima = self._minima(self._common(levels, order))

    def _names(self, places: np.ndarray) -> np.ndarray:
        """Rank of every place by the next 31 words: equal exactly where the words are. Ranks count the smaller ones."""
        seed = 0x9E3779B97F4A7C15
        while True:
            with np.errstate(over="ignore"):
                mixed = (self.codes.astype(np.uint64) + np.uint64(1)) * np.uint64(seed)
                mixed ^= mixed >> np.uint64(32)
                mixed *= np.uint64(0xD6E8FEB86659FD93)
                mixed ^= mixed >> np.uint64(29)
            _, first, name, size = np.unique(rolling(mixed, MODULUS)[places], return_index=True, return_inverse=True, return_counts=True)
            shared = np.flatnonzero(size[name] > 1)
            mine, model = places[shared], places[first[name[shared]]]
            if all((self.codes[mine + k] == self.codes[model + k]).all() for k in range(MODULUS)):
                return (np.cumsum(size) - size)[name]
            seed = (seed * 6364136223846793005 + 1442695040888963407) % (1 << 64) | 1

    @staticmethod
    def _doubled(rank: np.ndarray, again: np.ndarray, step: int) -> np.ndarray:
        """Ranks by twice as many blocks; only the places ``again`` still share theirs."""
        after = again + step
        follow = np.where(after < len(rank), rank[np.minimum(after, len(rank) - 1)], -1)
        order = np.lexsort((follow, rank[again]))
        own, follow, sorted_ = rank[again][order], follow[order], again[order]
        at = np.arange(len(order))
        group = np.concatenate([[True], own[1:] != own[:-1]])
        fresh = group | np.concatenate([[True], follow[1:] != follow[:-1]])
        out = rank.copy()
        out[sorted_] = own + np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        return out

    @staticmethod
    def _common(levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
        """Common blocks of each sampled suffix with the one before it in order."""
        out = np.zeros(len(order), dtype=np.int32)
        left, right = order[:-1].copy(), order[1:].copy()
        at = np.flatnonzero(levels[0][left] == levels[0][right])
        left, right = left[at], right[at]
        last = len(order) - 1
        for k in range(len(levels) - 1, -1, -1):
            inside = (left <= last) & (right <= last)
            same = inside & (levels[k][np.minimum(left, last)] == levels[k][np.minimum(right, last)])
            out[at[same] + 1] += 1 << k
            left[same] += len(COVER) << k
            right[same] += len(COVER) << k
        return out

    @staticmethod
    def _minima(common: np.ndarray) -> list[np.ndarray]:
        table, size = [common], 1
        while 2 * size <= len(common):
            before = table[-1]
            table.append(np.minimum(before[:-size], before[size:]))
            size *= 2
        return table

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from ``i`` and ``j`` on, at most ``most`` each."""
        out, alive, k = np.zeros(len(i), dtype=np.int64), np.flatnonzero(most > 0), 0
        while len(alive):
            alive = alive[self.codes[i[alive] + k] == self.codes[j[alive] + k]]
            k += 1
            out[alive] = k
            alive = alive[most[alive] > k]
        return out

    def ask(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of each pair of different places from 0 to n."""
        shift = SHIFT[i % MODULUS, j % MODULUS]
        out = self._compared(i, j, shift)
        far = np.flatnonzero(out == shift)
        a, b = i[far] + shift[far], j[far] + shift[far]
        low, high = (np.sort(np.stack([self.rank[x // MODULUS * len(COVER) + _SLOT[x % MODULUS]] for x in (a, b)]), axis=0) if len(far) else np.zeros((2, 0), dtype=np.int64))
        size = np.frexp((high - low).astype(float))[1] - 1          # the smallest of common[low + 1 .. high]
        blocks = np.zeros(len(far), dtype=np.int64)
        for k in np.unique(size).tolist():
            of = np.flatnonzero(size == k)
            blocks[of] = np.minimum(self.minima[k][low[of] + 1], self.minima[k][high[of] + 1 - (1 << k)])
        whole = blocks * MODULUS
        out[far] += whole + self._compared(a + whole, b + whole, np.full(len(far), MODULUS))
        return out


def runs(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows ``start, end, period`` of all runs of texts that lie one after another in ``codes``, longest text first.

    ``sizes``: words of each text, descending. Equal numbers never lie in different texts.
    """
    held: list[np.ndarray] = []
    reach = np.cumsum(sizes)
    places: list[np.ndarray] = []
    lcp: Extensions | None = None
    asked = 0

    def settle() -> None:
        nonlocal lcp, asked
        grid = np.concatenate(places, axis=1) if places else np.zeros((2, 0), dtype=np.int64)
        places.clear()
        asked = 0
        if not grid.shape[1]:
            return
        lcp = lcp or Extensions(codes)
        i, q = grid
        far = lcp.ask(i, i + q)
        # The place before it in the grid reaches this one: the same run, already seen.
        known = np.concatenate([[False], (q[1:] == q[:-1]) & (i[:-1] + q[:-1] == i[1:]) & (far[:-1] >= q[:-1])])
        first = np.flatnonzero(~known & (far > q))
        i, q, far = i[first], q[first], far[first]
        low, high = np.maximum(i - q + 1, 0), i.copy()            # the least x from which words q apart are equal up to i
        while (low < high).any():
            middle = (low + high) // 2
            open_ = np.flatnonzero(low < high)
            fits = np.zeros(len(i), dtype=bool)
            fits[open_] = lcp.ask(middle[open_], middle[open_] + q[open_]) >= i[open_] - middle[open_]
            high = np.where(fits, middle, high)
            low = np.where(fits | (low >= high), low, np.minimum(middle + 1, high))
        held.append(np.stack([high, i + q + far, q], axis=1))

    for q in range(1, int(sizes[0]) // TIMES + 1 if len(sizes) else 1):
        texts = int(np.searchsorted(-sizes, -max(LEAST, TIMES * q), side="right"))
        if not texts:
            break
        end = int(reach[texts - 1])
        same = codes[0:end - q:q] == codes[q:end:q]
        at = np.flatnonzero(same[:-1] & same[1:])
        if len(at):
            places.append(np.stack([at * q, np.full(len(at), q)]))
            asked += len(at)
            if asked >= ASKED:
                settle()
    settle()
    found = np.concatenate(held) if held else np.zeros((0, 3), dtype=np.int64)
    found = found[found[:, 1] - found[:, 0] >= np.maximum(LEAST, TIMES * found[:, 2])]
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    return found[np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1)])] if len(found) else found


def _before(a: tuple[int, int, int], b: tuple[int, int, int]) -> int:
    """Order by falling length/period (exact), then start, then period."""
    return b[1] * a[2] - a[1] * b[2] or a[0] - b[0] or a[2] - b[2]


def _judged(texts: list[bytes]) -> list[tuple]:
    """Of each text: number of words, its runs (start, length, period) by start and period, and its words left."""
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    flat = pa.array(chain.from_iterable(split[d] for d in order), pa.binary()) if sizes.sum() else pa.array([], pa.binary())
    number = flat.dictionary_encode()
    words = number.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    codes = words + np.repeat(np.arange(len(order), dtype=np.int64), sizes[order]) * max(1, len(number.dictionary))
    found = runs(codes, sizes[order])
    firsts = np.cumsum(sizes[order]) - sizes[order]
    owner = np.searchsorted(firsts + sizes[order], found[:, 0], side="right")
    mine: dict[int, list[tuple[int, int, int]]] = {}
    for k, (start, end, period) in zip(owner.tolist(), found.tolist(), strict=True):
        mine.setdefault(int(order[k]), []).append((start - int(firsts[k]), end - start, period))
    out = []
    for doc, own in enumerate(split):
        here = sorted(mine.get(doc, []), key=lambda r: (r[0], r[2]))
        if here:
            goes = np.zeros(len(own) + 1, dtype=np.int64)
            for start, length, period in here:
                goes[start + period] += 1
                goes[start + length] -= 1
            own = [w for w, gone in zip(own, np.cumsum(goes) > 0, strict=False) if not gone]
        out.append((int(sizes[doc]), here, own))
    return out


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_runs``; of the most repetitive run ``start, length, period, exponent_milli`` (null if there is
    none); all ``runs`` by start and period, ``runs_sha256`` of their lines ``start,length,period``, and
    ``collapsed_sha256`` of the words outside every run's repetitions, joined by one space."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            ends = np.cumsum([len(t) for t in raw])
            at = 0
            while at < len(raw):
                to = min(len(raw), int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_CHARS)) + 1)
                rows = []
                for n, here, own in _judged(raw[at:to]):
                    top = min(here, key=cmp_to_key(_before), default=(None, None, None))
                    lines = "".join(f"{a},{b},{c}\n" for a, b, c in here)
                    rows.append((n, len(here), *top, None if top[0] is None else 1000 * top[1] // top[2], [{"start": a, "length": b, "period": c} for a, b, c in here],
                                 hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(own)).hexdigest()))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, to - at), *(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], RUNS), pa.array(columns[7]), pa.array(columns[8])],
                    names=["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "runs_sha256", "collapsed_sha256"])
                at = to

    return tables.texts(docs).mapInArrow(run, SCHEMA)
