"""A feed-forward classifier over windows: the networks of all folds are fitted in one pass over the data per step.

Every window is packed once, with one weight per fold, into blocks of ``BLOCK`` rows; no fold has a copy of it. A step sends
the weights out (some 350 kB a fold), a task sums loss and gradient of its blocks for every fold that still learns,
the tasks' sums are added in about as many groups as the root of their number, and the driver takes one Adam step. What
reaches the driver depends on the networks' size and that number of groups, not on the rows.

Classes are balanced by weights in the loss, in place of drawing rows anew. One training window in ten, by a hash of its
key, is kept aside; a fold ends when its loss there has not improved by ``TOLERANCE`` for ``PATIENCE`` steps, and the best
weights are used. A fold lacking one of the classes gets no network and no scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import settings as S
from tidewatch.operators import splits as SP
from tidewatch.operators import windows as W
from tidewatch.session import staged

BLOCK = 1024
# --- fixed values: the builder's defaults -------------------------------------------
HIDDEN, MAX_ITER, PATIENCE, TOLERANCE, PENALTY = (64, 32), 500, 15, 1e-4, 1e-4


@dataclass(frozen=True)
class Layers:
    """Sizes from the input to the single output; weights of one network lie in one flat array."""

    sizes: tuple[int, ...]

    @property
    def length(self) -> int:
        return sum((a + 1) * b for a, b in zip(self.sizes, self.sizes[1:]))

    def parts(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Views of ``flat``: (weights, offsets) per layer."""
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + (a + 1) * b]))
            at += (a + 1) * b
        return out

    def start(self, seed: int) -> np.ndarray:
        """Uniform within the root of 6 (2 before the output) over the sizes on both sides."""
        rng, flat = np.random.default_rng(seed), np.zeros(self.length)
        for k, (weights, offsets) in enumerate(self.parts(flat)):
            bound = np.sqrt((2.0 if k == len(self.sizes) - 2 else 6.0) / sum(weights.shape))
            weights[:] = rng.uniform(-bound, bound, weights.shape)
            offsets[:] = rng.uniform(-bound, bound, offsets.shape)
        return flat

    def values(self, flat: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """The input and every layer's values; the last holds log-odds."""
        seen, parts = [x], self.parts(flat)
        for k, (weights, offsets) in enumerate(parts):
            z = seen[-1] @ weights + offsets
            seen.append(z if k == len(parts) - 1 else np.maximum(z, 0.0))
        return seen

    def loss(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
        z = self.values(flat, x)[-1][:, 0]
        return float(w @ (np.logaddexp(0.0, z) - z * y))

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Of the summed weighted log-loss."""
        seen, out = self.values(flat, x), np.zeros(self.length)
        back = (w * (sigmoid(seen[-1][:, 0]) - y))[:, None]
        for (weights, _), (dw, db), below in zip(self.parts(flat)[::-1], self.parts(out)[::-1], seen[-2::-1]):
            dw[:], db[:] = below.T @ back, back.sum(axis=0)
            back = (back @ weights.T) * (below > 0)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0.0, -z))


def flagged(tensor: DataFrame, folds: list[dict], embargo: int = S.EMBARGO_DAYS) -> DataFrame:
    """(asset, window_end, label, x, train, test, aside): each window once, with a flag per fold for its two roles."""
    role = [SP.fold_role(f, embargo) for f in folds]
    flags = [F.array(*[F.coalesce(r == kind, F.lit(False)) for r in role]).alias(kind) for kind in ("train", "test")]
    return tensor.select("asset", "window_end", F.col("label").cast("double").alias("label"), W.flat().alias("x"), *flags, _aside())


def _aside() -> Column:
    """Whether a window is among the tenth kept aside for the early end."""
    return (F.pmod(F.xxhash64("asset", "window_end"), F.lit(10)) == 0).alias("aside")


def class_weights(rows: DataFrame, n: int) -> np.ndarray:
    """Per fold the weights of label 0 and 1, n / (2 n_class); 1 where a fold has one class only, zeros where it has no windows."""
    counts = rows.agg(*[F.sum(F.when(F.col("train")[i], v)).alias(f"{k}{i}") for i in range(n) for k, v in (("n", F.lit(1.0)), ("p", F.col("label")))]).first()
    out = np.zeros((n, 2))
    for i in range(n):
        total, ones = counts[f"n{i}"] or 0.0, counts[f"p{i}"] or 0.0
        if 0 < ones < total:
            out[i] = total / (2 * (total - ones)), total / (2 * ones)
        elif total:
            out[i] = 1.0
    return out


def pack(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """Blocks of training windows: values, labels, weights per fold and whether they are kept aside, as plain arrays."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, BLOCK):
                b = big.slice(at, BLOCK)
                y = b["label"].to_numpy(zero_copy_only=False)
                train = b["train"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).T
                w = train * weights[:, y.astype(int)]
                cells = [b["x"].flatten().to_numpy(), y, w, b["aside"].to_numpy(zero_copy_only=False).astype(float)]
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c, dtype=float).tobytes()], pa.binary()) for c in cells], list("xywv"))

    chosen = rows.filter(F.exists("train", lambda f: f)).select("x", "label", "train", "aside")
    return chosen.mapInArrow(blocks, "x binary, y binary, w binary, v binary")


def sums(blocks: DataFrame, nets: np.ndarray, layers: Layers, means: np.ndarray, scales: np.ndarray, active: list[int], groups: int) -> dict[int, np.ndarray]:
    """Per active fold: training loss and weight, loss and weight aside, then the gradient; each a sum over all rows."""
    shared = blocks.sparkSession.sparkContext.broadcast(nets)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros((len(active), 4 + layers.length)), shared.value
        for batch in batches:
            for cells in zip(*(batch[c] for c in "xywv")):
                x, y, w, v = (np.frombuffer(c.as_buffer()) for c in cells)
                x, w = x.reshape(len(y), -1), w.reshape(-1, len(y))
                for k, fold in enumerate(active):
                    for at, mine in ((0, (w[fold] > 0) & (v == 0)), (2, (w[fold] > 0) & (v > 0))):
                        if mine.any():
                            z = (x[mine] - means[fold]) / scales[fold]
                            total[k, at] += layers.loss(known[fold], z, y[mine], w[fold, mine])
                            total[k, at + 1] += w[fold, mine].sum()
                            if at == 0:
                                total[k, 4:] += layers.gradient(known[fold], z, y[mine], w[fold, mine])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % groups] * len(active), pa.int32()), pa.array(active, pa.int32()),
                                          pa.array([t.tobytes() for t in total], pa.binary())], ["part", "fold", "total"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, total in zip(batch["fold"].to_pylist(), batch["total"]):
                found[fold] = found.get(fold, 0.0) + np.frombuffer(total.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([t.tobytes() for t in found.values()], pa.binary())], ["fold", "total"])

    rows = (blocks.mapInArrow(part, "part int, fold int, total binary").repartition(groups, "part")
            .mapInArrow(added, "fold int, total binary").collect())       # at most groups x folds rows
    shared.unpersist()
    out = {fold: np.zeros(4 + layers.length) for fold in active}
    for r in rows:
        out[r.fold] += np.frombuffer(r.total)
    return out


def fit(blocks: DataFrame, layers: Layers, means: np.ndarray, scales: np.ndarray, usable: list[int], max_iter: int = MAX_ITER,
        step: float = 0.003, seed: int = 42) -> tuple[np.ndarray, dict[int, list[tuple[float, float]]]]:
    """The best weights of every fold, and the course of its mean losses (training, aside)."""
    n = len(means)
    nets, best = np.stack([layers.start(seed)] * n), np.zeros((n, layers.length))
    first, second = np.zeros_like(nets), np.zeros_like(nets)
    lowest, idle, course = np.full(n, np.inf), np.zeros(n, int), {f: [] for f in usable}
    decay = np.zeros(layers.length)
    for weights, _ in layers.parts(decay):
        weights[:] = PENALTY
    groups = max(1, int(np.ceil(np.sqrt(blocks.rdd.getNumPartitions()))))
    active = list(usable)
    for i in range(1, max_iter + 1):
        for fold, s in sums(blocks, nets, layers, means, scales, active, groups).items():
            loss = s[2] / s[3] if s[3] else s[0] / s[1]
            course[fold].append((s[0] / s[1], loss))
            idle[fold] = 0 if loss < lowest[fold] - TOLERANCE else idle[fold] + 1
            if loss < lowest[fold]:
                lowest[fold], best[fold] = loss, nets[fold]
            g = (s[4:] + decay * nets[fold]) / s[1]
            first[fold] = 0.9 * first[fold] + 0.1 * g
            second[fold] = 0.999 * second[fold] + 0.001 * g * g
            nets[fold] -= step * (first[fold] / (1 - 0.9 ** i)) / (np.sqrt(second[fold] / (1 - 0.999 ** i)) + 1e-8)
        active = [f for f in active if idle[f] < PATIENCE]
        if not active:
            break
    return best, course


def score(rows: DataFrame, nets: np.ndarray, layers: Layers, means: np.ndarray, scales: np.ndarray, names: list[str], usable: list[int]) -> DataFrame:
    """(fold, asset, window_end, label, y_score) of every fold's test windows."""
    shared = rows.sparkSession.sparkContext.broadcast(nets)
    chosen = rows.filter(F.exists("test", lambda f: f))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b["x"].flatten().to_numpy().reshape(b.num_rows, -1)
            test = b["test"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for f in usable:
                at = np.flatnonzero(test[:, f])
                p = sigmoid(layers.values(shared.value[f], (x[at] - means[f]) / scales[f])[-1][:, 0])
                some = b.select(["asset", "window_end", "label"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array([names[f]] * len(at), pa.string()), some["asset"], some["window_end"],
                                                  some["label"].cast(pa.int64()), pa.array(p, pa.float64())], ["fold", "asset", "window_end", "label", "y_score"])

    return chosen.select("asset", "window_end", "label", "x", "test").mapInArrow(
        scored, "fold string, asset string, window_end date, label long, y_score double")


def walk_forward(tensor: DataFrame, arrays: DataFrame, folds: list[dict], embargo: int = S.EMBARGO_DAYS, hidden: tuple[int, ...] = HIDDEN,
                 max_iter: int = MAX_ITER, step: float = 0.003, seed: int = 42) -> DataFrame:
    """Fit on every fold's training windows, score its test windows. ``arrays`` holds the folds' means and scales."""
    rows = staged(flagged(tensor, folds, embargo), "windows")
    return fit_score(rows, arrays, [f["fold"] for f in folds], hidden, max_iter, step, seed)


def score_parts(tensor: DataFrame, arrays: DataFrame, parts: DataFrame, names: list[str], hidden: tuple[int, ...] = HIDDEN,
                max_iter: int = MAX_ITER, step: float = 0.003, seed: int = 42) -> DataFrame:
    """Fit on the windows that ``parts`` (fold, part, asset, window_end) calls ``fit``, score all its others; ``part`` is returned too."""
    of = parts.groupBy("asset", "window_end").agg(F.collect_set(F.when(F.col("part") == "fit", F.col("fold"))).alias("train"),
                                                  F.collect_set(F.when(F.col("part") != "fit", F.col("fold"))).alias("test"))
    flags = [F.array(*[F.array_contains(kind, n) for n in names]).alias(kind) for kind in ("train", "test")]
    rows = staged(tensor.join(of, ["asset", "window_end"]).select("asset", "window_end", F.col("label").cast("double").alias("label"), W.flat().alias("x"), *flags, _aside()), "windows")
    scored = fit_score(rows, arrays, names, hidden, max_iter, step, seed)
    return scored.join(parts.filter("part <> 'fit'").select("fold", "asset", "window_end", "part"), ["fold", "asset", "window_end"])


def fit_score(rows: DataFrame, arrays: DataFrame, names: list[str], hidden: tuple[int, ...] = HIDDEN, max_iter: int = MAX_ITER,
              step: float = 0.003, seed: int = 42) -> DataFrame:
    """Fit per fold on the windows flagged ``train``, score those flagged ``test``."""
    stats = {r.fold: r for r in arrays.collect()}                             # one row per fold
    weights = class_weights(rows, len(names))
    usable = [i for i, name in enumerate(names) if weights[i].any() and name in stats]
    shape = rows.select(F.size("x").alias("n")).first()
    if shape is None or not usable:
        return score(rows, np.zeros((len(names), 0)), Layers(()), np.zeros(0), np.zeros(0), names, [])
    layers = Layers((shape.n, *hidden, 1))
    def wide(field: str) -> np.ndarray:
        return np.stack([np.resize(stats[n][field], shape.n) if n in stats else np.ones(shape.n) for n in names])
    means, scales = wide("means"), wide("scales")
    blocks = staged(pack(rows, weights), "blocks").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        nets, _ = fit(blocks, layers, means, scales, usable, max_iter, step, seed)
    finally:
        blocks.unpersist()
    return score(rows, nets, layers, means, scales, names, usable)
