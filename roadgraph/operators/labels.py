"""Shortest paths of pairs from two-hop labels (Cohen et al. 2003), pruned as they are made (Akiba, Iwata & Yoshida 2013).

A node's label lists hubs with their distances such that any two connected nodes share a hub on one of their shortest paths. A
pair is then a join of two short lists instead of a search. Hubs are taken in batches from the highest degrees on; all
hubs of a batch, of all graphs, search together, and a search doesn't go on from a node whose distance is already told by
hubs of earlier batches. For pairs whose path has its highest hub in a batch no node on it is pruned, so labels are complete.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgraph.operators.dense import both, split
from roadgraph.operators.paths import MAX_ROUNDS, G, adjacency
from roadgraph.plans.loops import kept

#: Each batch has about so many times the hubs of all before it; the first has n / GROWTH**BATCHES of a graph's n nodes.
GROWTH = 4
BATCHES = 6
#: Rounds of a search whose finds are merged into one table at once.
MERGED = 4


def _batches(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """graph_id, node_id, batch from 0 by falling degree, ties by a hash. Bounds are quantiles from sketches, so no task ranks a whole graph."""
    degree = adj.groupBy(G, F.col("u").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))
    key = F.coalesce("degree", F.lit(0)) * 2**20 + F.pmod(F.xxhash64("node_id"), F.lit(2**20))
    own = kept(nodes.select(G, "node_id").distinct().join(degree, [G, "node_id"], "left").select(G, "node_id", key.alias("key")))
    shares = [1 - GROWTH**-k for k in range(BATCHES, 0, -1)]
    bounds = own.groupBy(G).agg(F.percentile_approx("key", shares, 10_000).alias("bounds"))
    below = lambda b: F.size(F.filter(b, lambda x: F.col("key") <= x))
    return kept(own.join(bounds, G).select(G, "node_id", below("bounds").alias("batch")))


def _told(rows: DataFrame, roots: DataFrame, labels: DataFrame) -> DataFrame:
    """graph_id, src, dst, via of rows (graph_id, src, dst) whose distance labels tell; roots has the labels of all src."""
    hubs = roots.select(G, F.col("node_id").alias("src"), "hub", F.col("dist").alias("there"))
    at = labels.select(G, F.col("node_id").alias("dst"), "hub", F.col("dist").alias("back"))
    return rows.select(G, "src", "dst").join(hubs, [G, "src"]).join(at, [G, "dst", "hub"]).groupBy(G, "src", "dst").agg(F.min(F.col("there") + F.col("back")).alias("via"))


def hub_labels(nodes: DataFrame, edges: DataFrame, weight: str = "w") -> DataFrame:
    """graph_id, node_id, hub, dist. Weights are positive; parallel edges count with the least, self-loops not at all. A node
    without edges has itself as only hub. Small graphs are answered from one row each (dense.py); for large ones there are as many
    rounds a batch as its longest search has edges."""
    return both(split(nodes, edges, weight), "labels", lambda n, e: _hub_labels(n, e, "w"))


def _hub_labels(nodes: DataFrame, edges: DataFrame, weight: str) -> DataFrame:
    adj = kept(adjacency(edges, weight))
    batch = _batches(nodes, adj)
    to = adj.select(G, F.col("u").alias("dst"), F.col("v").alias("next"), "w")
    labels: list[DataFrame] = []
    for k in sorted(r.batch for r in batch.select("batch").distinct().collect()):  # at most BATCHES + 1
        hubs = batch.filter(F.col("batch") == k).select(G, F.col("node_id").alias("src"))
        start = kept(hubs.select(G, "src", F.col("src").alias("dst"), F.lit(0).cast("long").alias("dist")))
        so_far = reduce(DataFrame.union, labels) if labels else None
        roots = kept(so_far.join(hubs.withColumnRenamed("src", "node_id"), [G, "node_id"], "left_semi")) if labels else None
        best, last = start, start
        for round_ in range(1, MAX_ROUNDS):
            step = last.join(to, [G, "dst"]).groupBy(G, "src", F.col("next").alias("dst")).agg(F.min(F.col("dist") + F.col("w")).alias("cand"))
            new = step.join(best, [G, "src", "dst"], "left").filter("dist is null or cand < dist").select(G, "src", "dst", "cand")
            if labels:
                new = new.join(_told(new, roots, so_far), [G, "src", "dst"], "left").filter("via is null or cand < via")
            last = kept(new.select(G, "src", "dst", F.col("cand").cast("long").alias("dist")))
            if last.isEmpty():
                break
            best = best.union(last).groupBy(G, "src", "dst").agg(F.min("dist").alias("dist"))
            best = best if round_ % MERGED else kept(best)
        else:
            raise RuntimeError(f"a search did not end in {MAX_ROUNDS} rounds")
        labels.append(kept(best).select(G, F.col("dst").alias("node_id"), F.col("src").alias("hub"), "dist"))
    return reduce(DataFrame.union, labels)


def labelled_pair_paths(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds dist to pairs (graph_id, a, b), as paths.pair_paths does; null without a path."""
    ends = pairs.select(G, "a", "b").distinct()
    there = labels.select(G, F.col("node_id").alias("a"), "hub", F.col("dist").alias("da"))
    back = labels.select(G, F.col("node_id").alias("b"), "hub", F.col("dist").alias("db"))
    found = ends.join(there, [G, "a"]).join(back, [G, "b", "hub"]).groupBy(G, "a", "b").agg(F.min(F.col("da") + F.col("db")).alias("dist"))
    return pairs.join(found, [G, "a", "b"], "left")
