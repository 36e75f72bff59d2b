"""Nearest earlier windows of a decision point over whole look-back windows, which are never written out.

An asset's rows are cut into blocks of ``BLOCK`` rows that also carry the ``lookback - 1`` rows before them, so a task slides
over a block to get its windows, each flattened oldest row first. A point asks for the last complete window at or before
its date; history, and the moments it is scaled by, end at that date.

* Moments: sums and squares per block, then running sums over an asset's blocks. A point takes those of the blocks before
  its own and adds the windows of its own block up to its date, so scaling costs one block per point.
* Cosine: with history scaled by mean m and deviation s, similarities of a block with many points are the matrix products
  of its windows with (q - m) / s^2, and of windows and their squares with m / s^2 and 1 / s^2. Each block meets the
  points of its asset in groups of ``GROUP`` and keeps the ``k`` best per point.
* Mahalanobis: X'X of blocks, added up in tiles of ``TILE`` columns, gives each point's covariance; it is ridged, factored once
  per point, and blocks are scored against the factor. The plan is the same for every width.

Sums of a cell are taken of what lies above the asset's first window, which every history holds, so neither large levels nor
values after the point cancel the spread: it errs by n roundings at most, and a constant cell's is exact. A point without a
complete window, or with none far enough back, has no precedent. A constant cell is only centred.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import settings as S
from tidewatch.functions.frames import finite
from tidewatch.operators.asof import latest_dates
from tidewatch.session import staged

#: Windows per block, points per group, blocks added up in one task, columns per tile of a covariance.
BLOCK, GROUP, RUN, TILE = 256, 64, 32, 128
RIDGE = 1e-6
FOUND = "asset string, as_of date, date date, similarity double"


def blocks(panel: DataFrame, features: list[str], lookback: int = S.LOOKBACK) -> tuple[DataFrame, DataFrame]:
    """Blocks (``asset, block, days, ends, cells``: day numbers, whether a complete window of this block ends on the row,
    values above the asset's means), and the ends of complete windows (``asset, date, block``)."""
    own = Window.partitionBy("asset")
    order, back = own.orderBy("date"), own.orderBy("date").rowsBetween(1 - lookback, 0)
    known = [finite(F.col(f).cast("double")) for f in features]
    whole = F.forall(F.array(*known), lambda x: x.isNotNull())
    rows = (panel.select("asset", "date", *[k.alias(f"_{i}") for i, k in enumerate(known)], whole.alias("_whole"))
            .withColumns({"_row": F.row_number().over(order) - 1, "_end": (F.sum(F.col("_whole").cast("int")).over(back) == lookback),
                          "_cells": F.array(*[F.coalesce(F.col(f"_{i}") - F.avg(f"_{i}").over(own), F.lit(0.0)) for i in range(len(features))])})
            .withColumn("block", F.floor(F.col("_row") / BLOCK)))
    rows = staged(rows.select("asset", "date", "block", "_row", "_end", "_cells"), "precedent-rows")
    halo = F.when(F.pmod("_row", F.lit(BLOCK)) > BLOCK - lookback, F.array(F.col("block"), F.col("block") + 1)).otherwise(F.array("block"))
    item = F.struct("_row", F.unix_date("date").alias("day"), (F.col("_end") & (F.col("_to") == F.col("block"))).alias("end"), "_cells")
    dealt = rows.withColumn("_to", F.explode(halo)).groupBy("asset", F.col("_to").alias("block")).agg(F.array_sort(F.collect_list(item)).alias("r"))
    packed = dealt.filter(F.exists("r", lambda x: x["end"])).select(
        "asset", "block", F.col("r.day").alias("days"), F.col("r.end").alias("ends"), F.flatten("r._cells").alias("cells"))
    return staged(packed, "precedent-blocks"), rows.filter("_end").select("asset", "date", "block")


def _windows(batch: pa.RecordBatch, row: int, width: int, lookback: int) -> tuple[np.ndarray, np.ndarray]:
    """Days and flattened windows of a block."""
    get = lambda c: batch.column(c)[row].values.to_numpy(zero_copy_only=False)
    at = np.flatnonzero(get("ends"))
    cells = get("cells").reshape(-1, width)
    return get("days")[at], np.stack([cells[i - lookback + 1:i + 1].reshape(-1) for i in at])


def _asked(points: DataFrame, ends: DataFrame) -> DataFrame:
    """``asset, as_of, date, block``: the window each point asks for."""
    return latest_dates(ends, points.select("asset", "as_of").distinct()).join(ends, ["asset", "date"])


def _queries(stored: DataFrame, asked: DataFrame, width: int, lookback: int) -> DataFrame:
    """``asset, as_of, day, block, query, mean, spread`` per point; the spread of a constant cell is 1."""
    def heads(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row in range(batch.num_rows):
                yield pa.RecordBatch.from_pydict({"asset": batch.column("asset").slice(row, 1), "first": pa.array([_windows(batch, row, width, lookback)[1][0]], pa.list_(pa.float64()))})

    def above(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Days, windows above the first one, the first one."""
        days, x = _windows(batch, row, width, lookback)
        first = batch.column("first")[row].values.to_numpy()
        return days, x - first, first

    def sums(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row in range(batch.num_rows):
                _, x, _ = above(batch, row)
                yield pa.RecordBatch.from_pydict({"asset": batch.column("asset").slice(row, 1), "block": batch.column("block").slice(row, 1), "n": pa.array([len(x)], pa.int64()),
                                                  "s": pa.array([x.sum(axis=0)], pa.list_(pa.float64())), "q": pa.array([(x * x).sum(axis=0)], pa.list_(pa.float64()))})

    earliest = stored.groupBy("asset").agg(F.min("block").alias("block"))
    stored = stored.join(stored.join(earliest, ["asset", "block"]).mapInArrow(heads, "asset string, first array<double>"), "asset")
    before = Window.partitionBy("asset", "pos").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    cells = (stored.mapInArrow(sums, "asset string, block long, n long, s array<double>, q array<double>")
             .select("asset", "block", "n", F.posexplode(F.arrays_zip("s", "q")).alias("pos", "c"))
             .select("asset", "block", "pos", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(o) for c, o in ((F.col("n"), "n"), (F.col("c.s"), "s"), (F.col("c.q"), "q"))]))
    prefix = (cells.join(asked.select("asset", "block").distinct(), ["asset", "block"])
              .groupBy("asset", "block").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "s", "q"))).alias("p"))
              .select("asset", "block", "n", F.col("p.s").alias("s"), F.col("p.q").alias("q")))
    here = asked.groupBy("asset", "block").agg(F.collect_list(F.struct("as_of", F.unix_date("date").alias("day"))).alias("points"))

    def scaled(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row in range(batch.num_rows):
                days, x, first = above(batch, row)
                n0, s0, q0 = batch.column("n")[row].as_py(), *(batch.column(c)[row].values.to_numpy() for c in ("s", "q"))
                out = []
                for point in batch.column("points")[row].as_py():
                    part = x[days <= point["day"]]
                    n = n0 + len(part)
                    mean = (s0 + part.sum(axis=0)) / n
                    spread = np.sqrt(np.maximum((q0 + (part * part).sum(axis=0)) / n - mean * mean, 0.0))
                    out.append((point["as_of"], point["day"], part[-1] + first, mean + first, np.where(spread > 1e-12, spread, 1.0)))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_pydict({"asset": pa.array([batch.column("asset")[row].as_py()] * len(out)), "as_of": pa.array(columns[0], pa.date32()), "day": pa.array(columns[1], pa.int32()),
                                                  "block": pa.array([batch.column("block")[row].as_py()] * len(out), pa.int64()),
                                                  **{name: pa.array(list(c), pa.list_(pa.float64())) for name, c in zip(("query", "mean", "spread"), columns[2:], strict=True)}})

    joined = stored.join(here, ["asset", "block"]).join(prefix, ["asset", "block"])
    return staged(joined.mapInArrow(scaled, "asset string, as_of date, day int, block long, query array<double>, mean array<double>, spread array<double>"), "precedent-queries")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("asset", "as_of").orderBy(F.desc("similarity"), "date")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _kept(asset: str, as_ofs: list, days: np.ndarray, similarity: np.ndarray, limits: list[int], k: int) -> Iterator[pa.RecordBatch]:
    """The k best windows of a block for each point (columns of ``similarity``), none after the point's limit."""
    for p, (as_of, last) in enumerate(zip(as_ofs, limits, strict=True)):
        at = np.flatnonzero(days <= last)
        at = at[np.lexsort((days[at], -similarity[at, p]))][:k]
        if len(at):
            yield pa.RecordBatch.from_pydict({"asset": pa.array([asset] * len(at)), "as_of": pa.array([as_of] * len(at), pa.date32()),
                                              "date": pa.array(days[at], pa.int32()).cast(pa.date32()), "similarity": pa.array(similarity[at, p])})


def nearest_cosine(panel: DataFrame, features: list[str], points: DataFrame, k: int = S.ANALOGUE_K, exclude_days: int = S.ANALOGUE_EXCLUDE_DAYS,
                   lookback: int = S.LOOKBACK) -> DataFrame:
    """``asset, as_of, date, similarity, rank``: the k most similar windows ending at least ``exclude_days`` before ``as_of``."""
    stored, ends = blocks(panel, features, lookback)
    queries = _queries(stored, _asked(points, ends), len(features), lookback)
    number = F.floor((F.row_number().over(Window.partitionBy("asset").orderBy("as_of")) - 1) / GROUP)
    groups = (queries.withColumn("_g", number).groupBy("asset", "_g")
              .agg(F.collect_list(F.struct("as_of", F.date_sub("as_of", exclude_days).alias("last"), "query", "mean", "spread")).alias("points"), F.max(F.unix_date("as_of") - exclude_days).alias("last")))
    pairs = stored.join(groups, "asset").filter(F.col("days")[0] <= F.col("last"))
    width = len(features)

    def search(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row in range(batch.num_rows):
                days, x = _windows(batch, row, width, lookback)
                asked = batch.column("points")[row].values
                q, m, s = (asked.field(c).flatten().to_numpy().reshape(len(asked), -1) for c in ("query", "mean", "spread"))
                weight = 1.0 / (s * s)
                toward = (q - m) * weight
                dots = x @ toward.T - (m * toward).sum(axis=1)
                squares = (x * x) @ weight.T - 2.0 * (x @ (m * weight).T) + (m * m * weight).sum(axis=1)
                norm = np.sqrt(np.maximum(squares, 0.0)) * np.sqrt(((q - m) ** 2 * weight).sum(axis=1))
                limits = asked.field("last").cast(pa.int32()).to_pylist()
                yield from _kept(batch.column("asset")[row].as_py(), asked.field("as_of").to_pylist(), days, dots / np.where(norm > 1e-12, norm, 1.0), limits, k)

    return _best(pairs.mapInArrow(search, FOUND), k)


def _covariances(stored: DataFrame, queries: DataFrame, width: int, lookback: int) -> DataFrame:
    """``asset, as_of, i, j, n, tile``: X'X around the mean of each point's history, in tiles of the upper triangle."""
    wanted = (stored.join(queries.select("asset", "as_of", F.col("day").alias("last"), F.col("block").alias("_own"), "mean"), "asset").filter(F.col("block") <= F.col("_own"))
              .withColumn("_run", F.floor(F.col("block") / RUN)).repartition("asset", "as_of", "_run").sortWithinPartitions("asset", "as_of", "_run"))

    def tiles(key, n, total) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(total), TILE):
            for j in range(i, len(total), TILE):
                yield pa.RecordBatch.from_pydict({"asset": pa.array([key[0]]), "as_of": pa.array([key[1]], pa.date32()), "i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()),
                                                  "n": pa.array([n], pa.int64()), "tile": pa.array([total[i:i + TILE, j:j + TILE].tobytes()], pa.binary())})

    def added(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, n, total = None, 0, None
        for batch in stream:
            for row in range(batch.num_rows):
                key = tuple(batch.column(c)[row].as_py() for c in ("asset", "as_of", "_run"))
                if key != current:
                    if current is not None:
                        yield from tiles(current, n, total)
                    current, n, total = key, 0, 0.0
                days, x = _windows(batch, row, width, lookback)
                x = x[days <= batch.column("last")[row].as_py()] - batch.column("mean")[row].values.to_numpy()
                n, total = n + len(x), total + x.T @ x
        if current is not None:
            yield from tiles(current, n, total)

    schema = "asset string, as_of date, i int, j int, n long, tile binary"

    def sums(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(t) for t in part["tile"])
        return pd.DataFrame({"asset": [key[0]], "as_of": [key[1]], "i": [key[2]], "j": [key[3]], "n": [int(part["n"].sum())], "tile": [total.tobytes()]})

    return wanted.mapInArrow(added, schema).groupBy("asset", "as_of", "i", "j").applyInPandas(sums, schema)


def nearest_mahalanobis(panel: DataFrame, features: list[str], points: DataFrame, k: int = S.ANALOGUE_K, exclude_days: int = S.ANALOGUE_EXCLUDE_DAYS,
                        lookback: int = S.LOOKBACK) -> DataFrame:
    """The same by 1 / (1 + Mahalanobis distance) under the ridged covariance of the scaled history."""
    stored, ends = blocks(panel, features, lookback)
    width = len(features)
    queries = _queries(stored, _asked(points, ends), width, lookback)
    size = width * lookback

    def factor(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """One point's matrix: its size is the square of the window's, whatever the history."""
        total = np.zeros((size, size))
        for i, j, tile in zip(part["i"], part["j"], part["tile"], strict=True):
            block = np.frombuffer(tile).reshape(min(TILE, size - i), -1)
            total[i:i + block.shape[0], j:j + block.shape[1]] = block
            total[j:j + block.shape[1], i:i + block.shape[0]] = block.T
        n, spread = part["n"].iloc[0], np.asarray(part["spread"].iloc[0])
        scaled = total / max(1, n - 1) / np.outer(spread, spread) + RIDGE * np.eye(size)
        toward = np.linalg.inv(np.linalg.cholesky(scaled)) / spread
        return pd.DataFrame({"asset": [key[0]], "as_of": [key[1]], "factor": [toward.tobytes()]})

    factors = staged(_covariances(stored, queries, width, lookback).join(queries.select("asset", "as_of", "spread"), ["asset", "as_of"])
                     .groupBy("asset", "as_of").applyInPandas(factor, "asset string, as_of date, factor binary"), "precedent-factors")
    far = F.unix_date("as_of") - exclude_days
    work = (stored.join(queries.select("asset", "as_of", "query"), "asset").filter(F.col("days")[0] <= far)
            .select("asset", "as_of", F.floor(F.col("block") / RUN).alias("_run"), "block", "days", "ends", "cells", "query", F.lit(None).cast("binary").alias("factor")))
    first = (work.select("asset", "as_of", "_run").distinct().join(factors, ["asset", "as_of"])
             .select("asset", "as_of", "_run", F.lit(-1).cast("long").alias("block"), *[F.lit(None).cast(t).alias(c) for c, t in (("days", "array<int>"), ("ends", "array<boolean>"), ("cells", "array<double>"), ("query", "array<double>"))], "factor"))
    dealt = work.unionByName(first).repartition("asset", "as_of", "_run").sortWithinPartitions("asset", "as_of", "_run", "block")

    def search(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toward = None
        for batch in stream:
            for row in range(batch.num_rows):
                if batch.column("block")[row].as_py() < 0:
                    toward = np.frombuffer(batch.column("factor")[row].as_py()).reshape(size, size)
                    continue
                days, x = _windows(batch, row, width, lookback)
                gone = (x - batch.column("query")[row].values.to_numpy()) @ toward.T
                as_of = batch.column("as_of")[row]
                yield from _kept(batch.column("asset")[row].as_py(), [as_of.as_py()], days, 1.0 / (1.0 + np.sqrt((gone * gone).sum(axis=1)))[:, None], [as_of.cast(pa.int32()).as_py() - exclude_days], k)

    return _best(dealt.mapInArrow(search, FOUND), k)
