"""Components, distances and shortest-path counts of many graphs at once.

nodes(graph_id, node_id, ...) and edges(graph_id, u, v, w); graph_id may be any type. Small graphs are answered from one row each
(dense.py). For large ones state is one row per (graph, source, node); work is dealt by graph and source, so one large graph
still spreads.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadgraph.operators.components import component_labels
from roadgraph.operators.dense import Split, both, split
from roadgraph.plans.loops import kept

G = "graph_id"
MAX_ROUNDS = 10_000
#: Layers of a graph of shortest paths that one job computes.
LAYERS = 4


def adjacency(edges: DataFrame, weight: str = "w") -> DataFrame:
    """Both directions of every edge, once per pair with its least weight; self-loops are left out."""
    one = edges.filter("u <> v").select(G, "u", "v", F.col(weight).alias("w"))
    both = one.union(one.select(G, F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    return both.groupBy(G, "u", "v").agg(F.min("w").alias("w"))


def components(nodes: DataFrame, edges: DataFrame, parts: Split | None = None) -> DataFrame:
    """graph_id, node_id, comp_id (least node of the component); isolated nodes are components of their own. Here and below
    parts is split(nodes, edges), where it is known."""
    return both(parts or split(nodes, edges, None), "components", _components)


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    labels = component_labels(edges.select(G, "u", "v"), [G]).select(G, F.col("node").alias("node_id"), F.col("component"))
    return nodes.select(G, "node_id").join(labels, [G, "node_id"], "left").select(G, "node_id", F.coalesce("component", "node_id").alias("comp_id"))


def largest_component(comp: DataFrame) -> DataFrame:
    """graph_id, comp_id, size of the largest component of each graph; of equal ones that of the least node."""
    sizes = comp.groupBy(G, "comp_id").agg(F.count(F.lit(1)).alias("size"), F.min("node_id").alias("first"))
    top = sizes.groupBy(G).agg(F.min(F.struct((-F.col("size")).alias("less"), "first", "comp_id", "size")).alias("t"))
    return top.select(G, "t.comp_id", "t.size")


def _starts(nodes: DataFrame, sources: DataFrame | None) -> DataFrame:
    own = nodes.select(G, F.col("node_id").alias("src"))
    return own if sources is None else own.join(sources.select(G, "src").distinct(), [G, "src"], "left_semi")


def hop_distances(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, parts: Split | None = None) -> DataFrame:
    """graph_id, src, dst, hops of all reachable pairs, the source itself with 0."""
    return both(parts or split(nodes, edges, None, sources), "hops", lambda n, e: _hop_distances(n, e, sources))


def _hop_distances(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """A round per hop; only new rows go on."""
    adj = kept(adjacency(edges.withColumn("w", F.lit(1))).select(G, F.col("u").alias("dst"), F.col("v").alias("next")))
    found = [kept(_starts(nodes, sources).select(G, "src", F.col("src").alias("dst"), F.lit(0).alias("hops")))]
    for d in range(1, MAX_ROUNDS):
        seen = reduce(DataFrame.union, found[-2:])  # of an undirected graph only the last two layers touch the next
        step = found[-1].join(adj, [G, "dst"]).select(G, "src", F.col("next").alias("dst")).distinct()
        new = kept(step.join(seen, [G, "src", "dst"], "left_anti").withColumn("hops", F.lit(d)))
        if new.isEmpty():
            return reduce(DataFrame.union, found)
        found.append(new)
    raise RuntimeError(f"hop distances did not end in {MAX_ROUNDS} rounds")


def hop_counts(nodes: DataFrame, edges: DataFrame, parts: Split | None = None) -> DataFrame:
    """graph_id, hops, k: how many ordered pairs are that far apart, nodes and themselves at 0."""
    return both(parts or split(nodes, edges, None), "by_hops", lambda n, e: _hop_distances(n, e).groupBy(G, "hops").agg(F.count(F.lit(1)).alias("k")))


def reachable_components(hops: DataFrame) -> DataFrame:
    """components, from hop_distances of all nodes: the least node that a node reaches."""
    return hops.groupBy(G, F.col("src").alias("node_id")).agg(F.min("dst").alias("comp_id"))


def _in_order(place: str, value) -> Column:
    """Sum of a group's few values in the order of place, so that it doesn't depend on partitioning."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(place), value.alias("value_in_order"))))
    return F.aggregate(listed, F.lit(0.0), lambda total, x: total + x["value_in_order"])


def efficiency(nodes: DataFrame, edges: DataFrame, hops: DataFrame | None = None, sources: DataFrame | None = None, parts: Split | None = None) -> DataFrame:
    """graph_id, n, efficiency: mean of 1 / hops over ordered pairs, 0 for pairs without a path and for graphs of one node.
    hops: hop_distances, where they are known. sources(graph_id, src): an estimate from these sources only, for large graphs."""
    if sources is not None:
        found = hop_distances(nodes, edges, sources).filter("hops > 0").groupBy(G).agg(F.sum(1 / F.col("hops")).alias("s"))
        k = sources.groupBy(G).agg(F.count_distinct("src").alias("k"))
        n = nodes.groupBy(G).agg(F.count(F.lit(1)).alias("n")).join(k, G, "left").join(found, G, "left")
        return n.select(G, "n", F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce("s", F.lit(0.0)) / (F.col("k") * (F.col("n") - 1))).alias("efficiency"))
    if hops is not None:
        return efficiency_of(nodes, hops.groupBy(G, "hops").agg(F.count(F.lit(1)).alias("k")))
    parts = parts or split(nodes, edges, None)
    return efficiency_of(parts.nodes, hop_counts(nodes, edges, parts))


def efficiency_of(nodes: DataFrame, by_hops: DataFrame) -> DataFrame:
    """efficiency from the number k of ordered pairs by hops: by_hops(graph_id, hops, k)."""
    by_hops = by_hops.filter("hops > 0 and k > 0")
    sums = by_hops.groupBy(G).agg(_in_order("hops", F.col("k") / F.col("hops")).alias("s"))
    n = nodes.groupBy(G).agg(F.count(F.lit(1)).alias("n"))
    value = F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce("s", F.lit(0.0)) / (F.col("n") * (F.col("n") - 1)))
    return n.join(sums, G, "left").select(G, "n", value.alias("efficiency"))


def distances(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, weight: str = "w", parts: Split | None = None) -> DataFrame:
    """graph_id, src, dst, dist: weighted distances."""
    return both(parts or split(nodes, edges, weight, sources), "dist", lambda n, e: _distances(n, e, sources, "w"))


def _distances(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, weight: str = "w") -> DataFrame:
    """By relaxing only what got shorter in the round before. A round writes no more than what it made shorter."""
    adj = kept(adjacency(edges, weight).select(G, F.col("u").alias("dst"), F.col("v").alias("next"), "w"))
    found = [kept(_starts(nodes, sources).select(G, "src", F.col("src").alias("dst"), F.lit(0).cast("long").alias("dist")))]
    for _ in range(MAX_ROUNDS):
        step = found[-1].join(adj, [G, "dst"]).groupBy(G, "src", F.col("next").alias("dst")).agg(F.min(F.col("dist") + F.col("w")).alias("cand"))
        met = step.join(_least(found), [G, "src", "dst"], "left").filter("dist is null or cand < dist")
        new = kept(met.select(G, "src", "dst", F.col("cand").alias("dist")))
        if new.isEmpty():
            return _least(found)
        found.append(new)
    raise RuntimeError(f"distances did not end in {MAX_ROUNDS} rounds")


def _least(found: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, found).groupBy(G, "src", "dst").agg(F.min("dist").alias("dist"))


def layered(first: DataFrame, step: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """first, step(first), step(step(first)) and so on until nothing is left. Several layers are computed in one job, which
    shares their shuffles, and kept together."""
    layers, last = [first], first
    for _ in range(MAX_ROUNDS):
        some = []
        for k in range(LAYERS):
            last = step(last)
            some.append(last.withColumn("layer", F.lit(k)))
        some = kept(reduce(DataFrame.union, some))
        layers.append(some.drop("layer"))
        last = some.filter(F.col("layer") == LAYERS - 1).drop("layer")
        if last.isEmpty():
            return layers
    raise RuntimeError(f"shortest paths have more than {MAX_ROUNDS * LAYERS} layers")


@dataclass
class ShortestPaths:
    """Tables that centralities share: dist (graph_id, src, dst, dist, sigma) and dag (graph_id, src, u, v, share),
    the edges on shortest paths with share = sigma(u) / sigma(v). Rows of small graphs are made when they are asked for;
    parts has these graphs, and large the tables of all others, if there are any."""

    nodes: DataFrame
    dist: DataFrame
    dag: DataFrame
    parts: Split | None = None
    large: ShortestPaths | None = None


def path_counts(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, weight: str = "w", parts: Split | None = None) -> ShortestPaths:
    """Distances, numbers of shortest paths and the edges they use. Weights are positive integers, so equal paths tie exactly."""
    parts = parts or split(nodes, edges, weight, sources)
    others = parts.others()
    large = _path_counts(*others, sources, "w") if others else None
    if parts.rows is None:
        return large
    return ShortestPaths(nodes, both(parts, "sigma", lambda n, e: large.dist), both(parts, "dag", lambda n, e: large.dag), parts, large)


def _path_counts(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, weight: str = "w") -> ShortestPaths:
    dist = kept(_distances(nodes, edges, sources, weight))
    a = dist.select(G, "src", F.col("dst").alias("u"), F.col("dist").alias("du"))
    b = dist.select(G, "src", F.col("dst").alias("v"), F.col("dist").alias("dv"))
    dag = kept(a.join(adjacency(edges, weight), [G, "u"]).join(b, [G, "src", "v"]).filter("du + w = dv").select(G, "src", "u", "v"))
    start = kept(dist.filter("src = dst").select(G, "src", F.col("src").alias("x"), F.lit(1.0).alias("c")))
    layers = layered(start, lambda x: x.withColumnRenamed("x", "u").join(dag, [G, "src", "u"]).groupBy(G, "src", F.col("v").alias("x")).agg(F.sum("c").alias("c")))
    sigma = reduce(DataFrame.union, layers).groupBy(G, "src", F.col("x").alias("dst")).agg(F.sum("c").alias("sigma"))
    dist = kept(dist.join(sigma, [G, "src", "dst"]))
    s = dist.select(G, "src", "dst", "sigma")
    shares = dag.join(s.select(G, "src", F.col("dst").alias("u"), F.col("sigma").alias("su")), [G, "src", "u"]).join(
        s.select(G, "src", F.col("dst").alias("v"), F.col("sigma").alias("sv")), [G, "src", "v"]
    )
    return ShortestPaths(nodes, dist, kept(shares.select(G, "src", "u", "v", (F.col("su") / F.col("sv")).alias("share"))))


def avg_shortest_path(nodes: DataFrame, edges: DataFrame, weight: str = "w", dist: DataFrame | None = None, parts: Split | None = None) -> DataFrame:
    """graph_id, avg_path: mean weighted distance between the nodes of the largest component; null if it has one node.
    dist: distances of all nodes of large graphs, where they are known."""
    parts = parts or split(nodes, edges, weight)
    return parts.nodes.select(G).distinct().join(both(parts, "average", lambda n, e: _averages(n, e, dist)), G, "left")


def _averages(nodes: DataFrame, edges: DataFrame, dist: DataFrame | None) -> DataFrame:
    comp = kept(_components(nodes, edges))
    big = comp.join(largest_component(comp).select(G, "comp_id"), [G, "comp_id"])
    own = big.select(G, F.col("node_id").alias("src"))
    d = dist.join(own, [G, "src"], "left_semi") if dist is not None else _distances(nodes, edges, own)
    return d.filter("src <> dst").groupBy(G).agg(F.avg("dist").alias("avg_path"))


def pair_paths(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, weight: str = "w") -> DataFrame:
    """Adds dist to pairs (graph_id, a, b); null without a path. Only the pairs' sources are searched from."""
    asked = pairs.select(G, F.col("a").alias("src"), F.col("b").alias("dst"))
    d = distances(nodes, edges, asked, weight)
    return pairs.join(d.select(G, F.col("src").alias("a"), F.col("dst").alias("b"), "dist"), [G, "a", "b"], "left")
