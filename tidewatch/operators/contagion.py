"""Cross-asset co-movement: pair correlations, lead-lag and graph centrality."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import settings as S
from tidewatch.functions.frames import pair_corr
from tidewatch.operators.panel import date_grid, returns_long
from tidewatch.session import staged

CENTRALITY_PLACES = 12
#: A date's centralities are settled once none moved by more than this in so many rounds; rounds at most.
CENTRALITY_TOLERANCE, CENTRALITY_ROUNDS, CENTRALITY_MOST = 1e-10, 12, 1200
#: Asset pairs of a date up to which its graph is iterated within one task.
SMALL_GRAPH = 2048


def grid_returns(panel: DataFrame, window: int = S.CORR_WINDOW) -> DataFrame:
    """Returns with a row for every grid date from an asset's first date to ``window`` past its last.

    ``usable`` marks an asset with at least half a window of returns, on grid
    dates that have a whole window behind them.
    """
    known = returns_long(panel)
    grid = date_grid(panel)
    life = (known.groupBy("asset").agg(F.min("g").alias("lo"), F.max("g").alias("hi"))
            .withColumn("last_g", F.max("hi").over(Window.partitionBy()))  # one row per asset
            .select("asset", F.explode(F.sequence("lo", F.least(F.col("hi") + window - 1, F.col("last_g")))).alias("g")))
    span = Window.partitionBy("asset").orderBy("g").rangeBetween(-(window - 1), 0)
    return (life.join(known.drop("date"), ["asset", "g"], "left").join(grid, "g")
            .withColumn("usable", (F.col("g") > window)
                        & (F.count("ret").over(span) >= max(3, window // 2))))


def pairwise_corr(r: DataFrame, window: int = S.CORR_WINDOW) -> DataFrame:
    """Rolling correlation of every pair of usable assets, pair-complete, from ``grid_returns``.

    The number of pairs is the size of the result. Pairs form by an equi-join on
    the date, then each pair is its own window partition.
    """
    a = r.select("g", "date", F.col("asset").alias("a"), F.col("ret").alias("ra"), F.col("usable").alias("ua"))
    b = r.select("g", F.col("asset").alias("b"), F.col("ret").alias("rb"), F.col("usable").alias("ub"))
    span = Window.partitionBy("a", "b").orderBy("g").rangeBetween(-(window - 1), 0)
    return (a.join(b, (a["g"] == b["g"]) & (F.col("a") < F.col("b"))).drop(b["g"])
            .withColumn("corr", pair_corr("ra", "rb", span))
            .filter("ua AND ub").select("date", "g", "a", "b", "corr"))


def market_corr(pairs: DataFrame, min_assets: int = S.MIN_ASSETS) -> DataFrame:
    """Mean and population deviation of the pair correlations per date."""
    min_pairs = min_assets * (min_assets - 1) // 2
    return (pairs.groupBy("date").agg(
        F.count(F.lit(1)).alias("_pairs"), F.avg("corr").alias("mean_pairwise_corr_30"),
        F.stddev_pop("corr").alias("corr_dispersion_30"))
        .filter((F.col("_pairs") >= min_pairs) & F.col("mean_pairwise_corr_30").isNotNull()).drop("_pairs"))


def lead_lag(r: DataFrame, primary: str, window: int = S.CORR_WINDOW,
             max_lag: int = S.LEAD_LAG_MAX, min_assets: int = S.MIN_ASSETS) -> DataFrame:
    """Per date, mean over the other assets of lag x correlation at the lag that leads best, from ``grid_returns``.

    0 where the primary asset is not usable or leads nobody.
    """
    lead_order = Window.partitionBy("asset").orderBy("g")
    leader = (r.filter(F.col("asset") == primary)
              .select("g", F.col("usable").alias("lead_usable"),
                      *[F.lag("ret", k).over(lead_order).alias(f"lead_{k}") for k in range(1, max_lag + 1)]))
    pairs = r.filter(F.col("asset") != primary).join(leader, "g", "left")
    best = []
    for k in range(1, max_lag + 1):
        span = Window.partitionBy("asset").orderBy("g").rangeBetween(-(window - 1 - k), 0)
        both = F.col(f"lead_{k}").isNotNull() & F.col("ret").isNotNull()
        enough = F.count(F.when(both, 1)).over(span) >= max_lag + 2
        c = F.when(enough, pair_corr(f"lead_{k}", "ret", span))
        pairs = pairs.withColumn(f"_c{k}", c)
        best.append(F.when(F.col(f"_c{k}").isNotNull(), F.struct(
            F.abs(f"_c{k}").alias("strength"), F.lit(-k).alias("neg_lag"), F.col(f"_c{k}").alias("corr"))))
    pairs = pairs.withColumn("_best", F.greatest(*best))
    led = F.coalesce(-F.col("_best.neg_lag") * F.col("_best.corr"), F.lit(0.0))
    usable = F.col("usable").cast("int")
    return (pairs.groupBy("date", "g").agg(
        F.sum(usable).alias("_followers"), F.max(F.coalesce("lead_usable", F.lit(False)).cast("int")).alias("_lead"),
        F.avg(F.when(F.col("usable"), led)).alias("_led"))
        .filter(F.col("_followers") + F.col("_lead") >= min_assets)
        .select("date", F.when(F.col("_lead") == 1, F.col("_led")).otherwise(F.lit(0.0)).alias("btc_lead_lag_5")))


def corr_graph(pairs: DataFrame, min_weight: float = S.MIN_EDGE_WEIGHT) -> DataFrame:
    """Edges with |corr| at or above the threshold."""
    return (pairs.withColumn("weight", F.abs("corr")).filter(F.col("weight") >= min_weight)
            .select("date", "a", "b", "weight"))


def degree_centrality(pairs: DataFrame, min_weight: float = S.MIN_EDGE_WEIGHT) -> DataFrame:
    """Weighted degree of each asset over the total of its date; 0 on a date without edges."""
    ends = pairs.select("date", F.explode(F.array("a", "b")).alias("asset"), F.abs("corr").alias("w"))
    degree = ends.groupBy("date", "asset").agg(
        F.sum(F.when(F.col("w") >= min_weight, F.col("w")).otherwise(0.0)).alias("degree"))
    total = F.sum("degree").over(Window.partitionBy("date"))
    return degree.select("date", "asset", F.coalesce(F.col("degree") / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias("degree_share"))


def _unit(state: DataFrame) -> DataFrame:
    """Values of a date divided by their Euclidean length."""
    length = state.groupBy("date").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_length"))
    return state.join(length, "date").withColumn("x", F.col("x") / F.col("_length")).drop("_length")


def _until(state: DataFrame, edges: DataFrame, step: Column, settled: Column, rounds: int, most: int,
           finish: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``state`` (date, node, value) after ``step`` along the edges until ``settled`` holds for all values of a date.

    Values are written every ``rounds`` rounds; finished dates take no part in later rounds.
    """
    done = []
    for at in range(rounds, most + 1, rounds):
        new = state
        for _ in range(rounds):
            new = edges.join(new, ["date", "node"]).groupBy("date", F.col("to").alias("node")).agg(step)
        moved = finish(new).join(state.withColumnsRenamed({c: "_was" for c in state.columns if c not in ("date", "node")}), ["date", "node"])
        still = moved.groupBy("date").agg((F.min(settled) | F.lit(at + rounds > most)).alias("_settled"))
        out = staged(moved.join(still, "date").drop("_was"), "centrality")
        done.append(out.filter("_settled").drop("_settled"))
        state = out.filter("NOT _settled").drop("_settled")
        if state.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def _leading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per row (a date's edges in arrays): the same rounds with the same end as on rows, or nothing if it is in pieces."""
    for batch in batches:
        out = []
        for date, node, to, w in zip(batch["date"], batch["node"], batch["to"], batch["w"], strict=True):
            names, place = np.unique(np.concatenate([node, to]), return_inverse=True)
            m = np.zeros((len(names), len(names)))
            m[place[len(node):], place[:len(node)]] = w
            reached = np.arange(len(names)) == 0
            while (more := reached | (m[:, reached] > 0).any(axis=1)).sum() > reached.sum():
                reached = more
            if not reached.all():
                continue
            x = np.full(len(names), len(names) ** -0.5)
            for _ in range(CENTRALITY_MOST // CENTRALITY_ROUNDS):
                was = x
                for _ in range(CENTRALITY_ROUNDS):
                    x = m @ x
                x = x / np.sqrt((x * x).sum())
                if abs(x - was).max() <= CENTRALITY_TOLERANCE:
                    break
            out.append(pd.DataFrame({"date": date, "node": names, "x": x}))
        if out:
            yield pd.concat(out)


def eigen_centrality(pairs: DataFrame, min_weight: float = S.MIN_EDGE_WEIGHT, min_assets: int = S.MIN_ASSETS, small: int = SMALL_GRAPH) -> DataFrame:
    """Eigenvector centrality of the |corr| graph, per date and usable asset.

    The identity is added to the graph, so that values converge on bipartite graphs too. Every ``CENTRALITY_ROUNDS``
    rounds they are brought to length 1; a date is finished once no value moved by more than ``CENTRALITY_TOLERANCE`` since
    then, or after ``CENTRALITY_MOST`` rounds. Graphs in several pieces (isolated assets count) have no single leading
    vector and get degree shares; graphs without edges get 0.

    Dates of up to ``small`` asset pairs are iterated within tasks, many dates each. Larger graphs stay rows: edges and
    values by (date, node), a round is one join and one partial aggregate over all dates at once, and pieces are found by
    the least label around each node, carried along the edges in the same way.
    """
    weight = F.coalesce(F.when(F.abs("corr") >= min_weight, F.abs("corr")), F.lit(0.0))
    min_pairs = min_assets * (min_assets - 1) // 2
    dates = (pairs.withColumn("w", weight).groupBy("date").agg(F.count(F.lit(1)).alias("_pairs"), F.count("corr").alias("_known"), F.max("w").alias("_top"))
             .filter((F.col("_pairs") >= min_pairs) & (F.col("_known") > 0)).select("date", (F.col("_top") > 0).alias("linked"), (F.col("_pairs") <= small).alias("small")))
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to"))))
    links = staged(pairs.withColumn("w", weight).select("date", ends.alias("e"), "w").select("date", "e.node", "e.to", "w").join(dates, "date"), "links")
    nodes = links.groupBy("date", "node").agg(F.sum("w").alias("degree"), F.max("linked").alias("linked"), F.max("small").alias("small"))
    total = nodes.groupBy("date").agg(F.sum("degree").alias("_total"))
    own = nodes.filter("linked").select("date", "node", F.col("node").alias("to"), F.lit(1.0).alias("w"), "small")
    edges = links.filter("w > 0").select("date", "node", "to", "w", "small").unionByName(own)

    packed = edges.filter("small").groupBy("date").agg(F.collect_list(F.struct("node", "to", "w")).alias("e"))      # at most 2 * small + its nodes
    values = packed.select("date", "e.node", "e.to", "e.w").mapInPandas(_leading, "date date, node string, x double")
    if not links.filter("NOT small").isEmpty():
        large = staged(edges.filter("NOT small").drop("small"), "edges")
        labels = large.groupBy("date", "node").agg(F.min("node").alias("least"))
        labels = _until(labels, large, F.min("least").alias("least"), F.col("least") == F.col("_was"), 4, 1 << 30)
        whole = labels.groupBy("date").agg((F.min("least") == F.max("least")).alias("whole")).filter("whole").select("date")
        large = staged(large.join(whole, "date"), "edges")
        start = staged(_unit(large.select("date", "node").distinct().withColumn("x", F.lit(1.0))), "centrality")
        if not start.isEmpty():
            values = values.unionByName(_until(start, large, F.sum(F.col("w") * F.col("x")).alias("x"), F.abs(F.col("x") - F.col("_was")) <= CENTRALITY_TOLERANCE,
                                               CENTRALITY_ROUNDS, CENTRALITY_MOST, _unit))
    share = F.coalesce(F.col("degree") / F.nullif("_total", F.lit(0.0)), F.lit(0.0))
    found = nodes.join(values, ["date", "node"], "left").join(total, "date")
    return found.select("date", F.col("node").alias("asset"), (F.round(F.coalesce("x", share), CENTRALITY_PLACES) + 0.0).alias("eigen_centrality_30"))


def with_contagion(panel: DataFrame, prices: DataFrame, primary: str) -> DataFrame:
    """The panel with the market-wide columns by date and the centrality by (date, asset).

    ``prices`` is the narrow (asset, date, close) source. Returns and pair
    correlations are each read several times, so they are written once.
    """
    r = staged(grid_returns(prices.select("asset", "date", "close")), "returns")
    pairs = staged(pairwise_corr(r), "pairs")
    return (panel.join(market_corr(pairs), "date", "left")
            .join(lead_lag(r, primary), "date", "left")
            .withColumn("btc_lead_lag_5", F.when(F.col("mean_pairwise_corr_30").isNotNull(), F.col("btc_lead_lag_5")))
            .join(eigen_centrality(pairs), ["date", "asset"], "left"))
