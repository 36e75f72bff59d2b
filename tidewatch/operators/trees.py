"""Fitted tree ensembles as node tables, and what their scores owe to single cells of a window.

A fitted forest becomes arrays of nodes (a few hundred bytes a tree level, bounded by trees and depth, not by data), which
are broadcast. A window is scored in whole columns: all windows of a batch walk one tree at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import scratch_path

#: Windows walked together.
WALKED = 1024


class Nodes:
    """Trees as arrays: feature (-1 for a leaf), threshold, children and the share of the positive class."""

    def __init__(self, rows: list) -> None:
        by_tree: dict[int, list] = {}
        for r in rows:
            by_tree.setdefault(r.tree, []).append(r)
        self.trees = []
        for _, nodes in sorted(by_tree.items()):
            n = max(r.id for r in nodes) + 1
            feature, left, right = np.full(n, -1), np.arange(n), np.arange(n)
            threshold, value = np.zeros(n), np.zeros(n)
            for r in nodes:
                if r.left >= 0:
                    feature[r.id], threshold[r.id], left[r.id], right[r.id] = r.feature, r.threshold, r.left, r.right
                value[r.id] = r.value
            self.trees.append((feature, threshold, left, right, value))

    @staticmethod
    def walk(tree, x: np.ndarray, at: np.ndarray, blank: np.ndarray | None, means: np.ndarray | None) -> np.ndarray:
        """Leaf of each row from node ``at`` on; row i reads ``means`` in cell ``blank[i]``."""
        feature, threshold, left, right, _ = tree
        rows = np.arange(len(x))
        while (open_ := feature[at] >= 0).any():
            cell = np.maximum(feature[at], 0)
            value = x[rows, cell]
            if blank is not None:
                value = np.where(cell == blank, means[cell], value)
            at = np.where(open_, np.where(value <= threshold[at], left[at], right[at]), at)
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of the positive class, the mean over trees."""
        return sum(t[4][self.walk(t, x, np.zeros(len(x), dtype=np.int64), None, None)] for t in self.trees) / len(self.trees)

    def without_cells(self, x: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and rows x cells: how much of each is lost when the cell shows its mean.

        A tree changes only for cells tested on the row's own path, so each node of the path is blanked in turn and the row
        goes on from there; a cell tested twice counts from its first test.
        """
        rows = np.arange(len(x))
        full, lost = np.zeros(len(x)), np.zeros(x.shape)
        for tree in self.trees:
            feature, threshold, left, right, value = tree
            leaf = self.walk(tree, x, np.zeros(len(x), dtype=np.int64), None, None)
            full += value[leaf]
            at, seen = np.zeros(len(x), dtype=np.int64), []
            while (open_ := feature[at] >= 0).any():
                cell = np.where(open_, feature[at], -1)
                fresh = open_ & ~np.any([cell == s for s in seen], axis=0) if seen else open_
                of = rows[fresh]
                other = self.walk(tree, x[of], at[of], cell[of], means)
                lost[of, cell[of]] += value[leaf[of]] - value[other]
                seen.append(cell)
                at = np.where(open_, np.where(x[rows, np.maximum(cell, 0)] <= threshold[at], left[at], right[at]), at)
        return full / len(self.trees), lost / len(self.trees)

    def without(self, x: np.ndarray, means: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """Rows x groups: the loss when all cells of a group show their means; only trees that test such a cell are walked."""
        out = np.zeros((len(x), int(groups.max()) + 1))
        start = np.zeros(len(x), dtype=np.int64)
        for tree in self.trees:
            used = np.unique(groups[np.unique(tree[0][tree[0] >= 0])])
            leaf = tree[4][self.walk(tree, x, start, None, None)]
            for g in used.tolist():
                out[:, g] += leaf - tree[4][self.walk(tree, np.where(groups == g, means, x), start, None, None)]
        return out / len(self.trees)


def node_table(model: Model) -> Nodes:
    """The nodes of a fitted random forest, read from its saved form; fitted without positive rows, its leaves hold one class alone."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = scratch_path(spark, "forest")
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    node = F.col("nodeData")
    stats = node["impurityStats"]
    rows = saved.select(F.col("treeID").alias("tree"), node["id"].alias("id"), node["leftChild"].alias("left"), node["rightChild"].alias("right"), node["split"]["featureIndex"].alias("feature"),
                        F.get(node["split"]["leftCategoriesOrThreshold"], 0).alias("threshold"),
                        F.when(F.aggregate(stats, F.lit(0.0), lambda a, v: a + v) > 0, F.coalesce(F.get(stats, F.lit(1)), F.lit(0.0)) / F.aggregate(stats, F.lit(0.0), lambda a, v: a + v)).otherwise(0.0).alias("value"))
    return Nodes(rows.collect())


def cell_contributions(windows: DataFrame, model: Model, means: list[float], features: list[str], lookback: int) -> DataFrame:
    """``asset, window_end, score``; ``feature_loss`` per feature (all its steps blanked) and ``cell_loss`` per step and feature.

    ``windows`` holds ``feats``; blanked cells show the feature's mean. One pass, each window once.
    """
    width = len(features)
    known = windows.sparkSession.sparkContext.broadcast(node_table(model))
    wide = np.tile(np.asarray(means, dtype=float), lookback)
    groups = np.tile(np.arange(width), lookback)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for at in range(0, whole.num_rows, WALKED):
                batch = whole.slice(at, WALKED)
                x = batch.column("flat").flatten().to_numpy().reshape(batch.num_rows, -1)
                score, cells = known.value.without_cells(x, wide)
                by_feature = known.value.without(x, wide, groups)
                yield pa.RecordBatch.from_pydict({"asset": batch.column("asset"), "window_end": batch.column("window_end"), "score": pa.array(score),
                                                  "feature_loss": pa.array(list(by_feature), pa.list_(pa.float64())), "cell_loss": pa.array(list(cells), pa.list_(pa.float64()))})

    return windows.select("asset", "window_end", F.flatten("feats").alias("flat")).mapInArrow(
        run, "asset string, window_end date, score double, feature_loss array<double>, cell_loss array<double>")


def by_feature(contributions: DataFrame, features: list[str], lookback: int) -> DataFrame:
    """``asset, window_end, feature, contribution, steps``: the feature's loss, and that of each of its cells, oldest first."""
    places = F.sequence(F.lit(0), F.lit(lookback - 1))

    def one(i: int, name: str) -> Column:
        steps = F.transform(places, lambda t: F.get("cell_loss", (t * len(features) + i).cast("int")))
        return F.struct(F.lit(name).alias("feature"), F.col("feature_loss")[i].alias("contribution"), steps.alias("steps"))

    each = F.array(*[one(i, name) for i, name in enumerate(features)])
    return contributions.select("asset", "window_end", F.explode(each).alias("e")).select("asset", "window_end", "e.*")
