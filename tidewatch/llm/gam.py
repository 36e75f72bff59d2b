"""Quality classifier: a generalised additive model with pairwise interactions over text statistics.

Each text gives a few dozen numbers. Each number is binned at quantiles of the training rows, and the model is one lookup
table per number plus one per chosen pair of numbers: a score is a sum of table entries, added for whole batches at once.
The tables are learned by cyclic gradient boosting: round after round, each number in turn gets a shallow tree on its
bins, fitted to the current residuals and added to its table with a small step. Pairs follow on what the single tables
leave unexplained; those whose best cross of two cuts explains most are taken.

Training uses at most ``MAX_ROWS`` labelled rows, those with the smallest hashes of their ids; this is the only bound,
and scoring reads every row. Rows whose label or id is missing are not trained on. A missing text counts as empty; empty
texts get a score like others. Without labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit uses at most.
MAX_ROWS = 16_000
BINS, PAIR_BINS = 64, 12
ROUNDS, PAIR_ROUNDS, STEP = 250, 120, 0.08
PAIRS = 8
#: Rows a leaf needs, and the weight of the penalty on its value.
LEAF_ROWS, PENALTY = 15, 2.0

FEATURES = ["log_words", "word_length", "distinct_words", "same_as_last", "repeated_triples", "upper_share", "digit_share", "exclaims", "symbols", "bars",
            "brackets", "stops", "dup_lines", "compressed", "line_length", "top_word", "high_bytes", "short_words", "long_words", "capitals"]

_GROUPS = [range(65, 91), range(97, 123), range(48, 58), [33], [35, 36, 37, 38, 42], [124], [60, 62, 91, 93, 123, 125], [44, 46, 58, 59], range(128, 256), [10]]


def features(texts: list[str]) -> np.ndarray:
    """One row of ``FEATURES`` per text, from its whole length."""
    import zstandard

    groups = np.zeros((256, len(_GROUPS)))
    for k, members in enumerate(_GROUPS):
        groups[list(members), k] = 1
    press = zstandard.ZstdCompressor(level=1)
    out = np.zeros((len(texts), len(FEATURES)))
    for row, text in enumerate(texts):
        raw = text.encode("utf-8", "replace")
        words = text.split()
        n, size = max(1, len(words)), max(1, len(raw))
        upper, lower, digits, exclaims, symbols, bars, brackets, stops, high, newlines = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ groups
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        numbers: dict[str, int] = {}
        codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
        triples = (codes[:-2] * len(numbers) + codes[1:-1]) * len(numbers) + codes[2:] if len(words) > 2 else codes[:0]
        lines = [x for x in text.split("\n") if x.strip()]
        out[row] = (
            np.log1p(len(words)), lengths.sum() / n, len(numbers) / n, np.count_nonzero(codes[1:] == codes[:-1]) / n,
            1 - len(np.unique(triples)) / max(1, len(triples)) if len(triples) else 0.0, upper / max(1.0, upper + lower), digits / size, exclaims / n, symbols / n,
            bars / n, brackets / n, stops / n, 1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0, len(press.compress(raw)) / (size + 20), np.log1p(size / (newlines + 1)),
            np.bincount(codes).max() / n if len(codes) else 0.0, high / size, np.count_nonzero(lengths <= 3) / n, np.count_nonzero(lengths >= 12) / n,
            sum(w[0].isupper() for w in words) / n)
    return out


@dataclass
class Model:
    """Lookup tables: plain arrays, a few kilobytes in all."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, k], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + PENALTY)


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of a run of bins; place 0 if none has enough rows on both sides."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    gain[(nl < LEAF_ROWS) | (n.sum() - nl < LEAF_ROWS)] = 0
    at = int(np.argmax(gain))
    return (float(gain[at]), at + 1) if gain[at] > 0 else (0.0, 0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Values per bin of a tree of depth two."""
    runs = [(0, len(g))]
    for _ in range(2):
        runs = [r for a, b in runs for cut in [_best_cut(g[a:b], h[a:b], n[a:b])[1]] for r in ([(a, a + cut), (a + cut, b)] if cut else [(a, b)])]
    values = np.zeros(len(g))
    for a, b in runs:
        values[a:b] = g[a:b].sum() / (h[a:b].sum() + PENALTY)
    return values


def _best_cross(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best pair of cuts, one on each axis: four leaves."""
    sums = [np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (g, h, n)]
    quarters = [[c[1:-1, 1:-1], c[1:-1, -1:] - c[1:-1, 1:-1], c[-1:, 1:-1] - c[1:-1, 1:-1], c[-1, -1] - c[1:-1, -1:] - c[-1:, 1:-1] + c[1:-1, 1:-1]] for c in sums]
    gain = sum(_gain(q, w) for q, w in zip(quarters[0], quarters[1], strict=True)) - _gain(g.sum(), h.sum())
    gain[np.minimum.reduce(quarters[2]) < LEAF_ROWS] = 0
    if not gain.size or gain.max() <= 0:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    leaf = [q[i, j] / (w[i, j] + PENALTY) for q, w in zip(quarters[0], quarters[1], strict=True)]
    values = np.zeros_like(g)
    values[:i + 1, :j + 1], values[:i + 1, j + 1:], values[i + 1:, :j + 1], values[i + 1:, j + 1:] = leaf
    return float(gain[i, j]), values


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of single tables, then of pair tables, under the logistic loss."""
    if not len(y):
        return Model()
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Model(base=float(np.log(rate / (1 - rate))))
    model.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    cells = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T, strict=True)]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    rows = [np.bincount(c, minlength=len(t)) for c, t in zip(cells, model.tables, strict=True)]
    for _ in range(ROUNDS):
        for k, table in enumerate(model.tables):
            g, h = slopes()
            step = STEP * _shallow_tree(np.bincount(cells[k], g, len(table)), np.bincount(cells[k], h, len(table)), rows[k])
            table += step
            total += step[cells[k]]
    model.pair_edges = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for c in x.T]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model.pair_edges, x.T, strict=True)]
    sizes = [len(e) + 1 for e in model.pair_edges]

    def grid(a: int, b: int, weights: np.ndarray | None) -> np.ndarray:
        return np.bincount(coarse[a] * sizes[b] + coarse[b], weights, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])

    g, h = slopes()
    gains = sorted(((_best_cross(grid(a, b, g), grid(a, b, h), grid(a, b, None))[0], a, b) for a in range(len(sizes)) for b in range(a)), reverse=True)
    model.pairs = [(a, b) for gain, a, b in gains[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            step = STEP * _best_cross(grid(a, b, g), grid(a, b, h), grid(a, b, None))[1]
            table += step
            total += step[coarse[a], coarse[b]]
    return model


def held_out(doc_id: Column) -> Column:
    """A fifth of all ids, by the CRC-32 of their text; a missing id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows that are not held out (``MAX_ROWS`` at most). Their features, not their texts, reach the driver."""
    known = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.min("quality").cast("double").alias("_label")).where(~held_out(F.col("doc_id"))))
    present = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    picked = present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")  # at most MAX_ROWS short rows

    def extract(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            x = features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_label"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    # Repeated rows of an id are trained on once.
    small = (rows.mapInArrow(extract, "doc_id long, label double, x array<double>").groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("r"))
             .select("doc_id", "r.*").limit(MAX_ROWS).toPandas().sort_values("doc_id"))
    return fit(np.array(small["x"].tolist()).reshape(len(small), len(FEATURES)), small["label"].to_numpy(dtype=float))


def scorer(model: Model):
    """A vectorised column function from text to the score."""
    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(np.concatenate([model.score(features(part.iloc[k:k + 512].tolist())) for k in range(0, len(part), 512)] or [np.zeros(0)]))

    return lambda text: score(F.coalesce(text, F.lit("")))
