"""Betweenness, rankings and health of many graphs at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadgraph.operators.dense import Split, both, split
from roadgraph.operators.paths import G, ShortestPaths, avg_shortest_path, components, efficiency, largest_component, layered, path_counts
from roadgraph.operators.ranking import ranked
from roadgraph.plans.loops import kept


def _ranked(bc: DataFrame, place: str) -> DataFrame:
    """Adds the place of a node by betweenness, then number; sums that differ only by the order of additions count as equal."""
    return ranked(bc, G, [F.desc(F.round("betweenness", 9)), F.asc("node_id")], place)


def dependencies(paths: ShortestPaths) -> DataFrame:
    """graph_id, src, x, delta: how much of the shortest paths from src runs through x (Brandes 2001), summed in layers."""
    first = paths.dist.select(G, "src", F.col("dst").alias("v"), F.lit(1.0).alias("c"))
    layers = layered(first, lambda x: x.join(paths.dag, [G, "src", "v"]).groupBy(G, "src", F.col("u").alias("v")).agg(F.sum(F.col("share") * F.col("c")).alias("c")))
    return kept(reduce(DataFrame.union, layers[1:]).groupBy(G, "src", F.col("v").alias("x")).agg(F.sum("c").alias("delta")))


def _counted(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(G).agg(F.count(F.lit(1)).alias("n"))


def pivots(nodes: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k source nodes per graph by hash, for approximate centralities of large graphs (Brandes & Pich 2007)."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(G).cast("string"), F.col("node_id").cast("string")).cast("binary"))
    at = F.row_number().over(Window.partitionBy(G).orderBy(order, "node_id"))
    return nodes.withColumn("at", at).filter(F.col("at") <= k).select(G, F.col("node_id").alias("src"))


def node_betweenness(paths: ShortestPaths, delta: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """graph_id, node_id, betweenness over all nodes; ends of paths don't count; scaled by 1 / ((n - 1)(n - 2)) for n > 2.
    k: paths start from that many pivots only, and sums are scaled by n / k."""
    through = lambda d: d.filter("x <> src").groupBy(G, F.col("x").alias("node_id")).agg(F.sum("delta").alias("s"))
    if delta is None and paths.parts is not None:
        sums = both(paths.parts, "nodes", lambda *_: through(dependencies(paths.large)))
    else:
        sums = through(delta if delta is not None else dependencies(paths))
    n = F.col("n")
    scale = F.when(n > 2, 1.0 / ((n - 1) * (n - 2))).otherwise(0.5) * (n / F.least(n, F.lit(k)) if k else F.lit(1.0))
    return paths.nodes.select(G, "node_id").join(_counted(paths.nodes), G).join(sums, [G, "node_id"], "left").select(
        G, "node_id", (F.coalesce("s", F.lit(0.0)) * scale).alias("betweenness")
    )


def _flow(paths: ShortestPaths, delta: DataFrame) -> DataFrame:
    """graph_id, u, v (u < v), s: how much of all shortest paths runs along each edge."""
    d = delta.select(G, "src", F.col("x").alias("v"), "delta")
    flow = paths.dag.join(d, [G, "src", "v"], "left").select(G, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), (F.col("share") * (1 + F.coalesce("delta", F.lit(0.0)))).alias("x"))
    return flow.groupBy(G, "u", "v").agg(F.sum("x").alias("s"))


def edge_betweenness(paths: ShortestPaths, edges: DataFrame, delta: DataFrame | None = None) -> DataFrame:
    """graph_id, u, v (u < v), betweenness of every edge, scaled by 1 / (n (n - 1))."""
    if delta is None and paths.parts is not None:
        sums = both(paths.parts, "edges", lambda *_: _flow(paths.large, dependencies(paths.large)))
    else:
        sums = _flow(paths, delta if delta is not None else dependencies(paths))
    own = edges.filter("u <> v").select(G, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    n = F.col("n")
    return own.join(_counted(paths.nodes), G).join(sums, [G, "u", "v"], "left").select(G, "u", "v", (F.coalesce("s", F.lit(0.0)) / (n * (n - 1))).alias("betweenness"))


def max_normalize(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """Adds value divided by its group's maximum; a maximum of 0 counts as 1."""
    top = F.col("top_of_group")
    tops = df.groupBy(group).agg(F.max(value).alias("top_of_group"))
    return df.join(tops, group).withColumn(out, F.col(value) / F.when(top == 0, 1.0).otherwise(top)).select(*df.columns, out)


def edge_criticality(edge_bc: DataFrame) -> DataFrame:
    return max_normalize(edge_bc, G, "betweenness", "criticality")


def degree(edges: DataFrame) -> DataFrame:
    """graph_id, node_id, degree; a self-loop counts twice."""
    ends = edges.select(G, F.explode(F.array("u", "v")).alias("node_id"))
    return ends.groupBy(G, "node_id").agg(F.count(F.lit(1)).alias("degree"))


def gatekeepers(bc: DataFrame, nodes: DataFrame, edges: DataFrame, k: int | None = None) -> DataFrame:
    """All nodes, or the first k per graph, by betweenness, then node_id, with position, kind, degree and rank from 1."""
    own = _ranked(bc, "rank")
    own = own if k is None else own.filter(F.col("rank") <= k)
    own = nodes.join(own, [G, "node_id"]).join(degree(edges), [G, "node_id"], "left").na.fill(0, ["degree"])
    return own.select(G, "node_id", "pos_r", "pos_c", "kind", "betweenness", "degree", "rank")


def top_fraction(df: DataFrame, group: str, value: str, fraction: float, *ties: str, digits: int | None = None) -> DataFrame:
    """max(1, ceil(n * fraction)) rows of each group with the largest values. digits: values that round to the same number count as
    equal; for sums whose last digits depend on the order of additions."""
    key = F.col(value) if digits is None else F.round(value, digits)
    own = ranked(df.filter(F.col(group).isNotNull()), group, [key.desc(), *map(F.asc, ties)], "place_in_group", "n_in_group")
    return own.filter(F.col("place_in_group") <= F.greatest(F.lit(1), F.ceil(F.col("n_in_group") * fraction))).select(*df.columns)


def cap(df: DataFrame, n: int, order: list[str], group: str | None = None) -> DataFrame:
    """The first n rows by order, of every group or of all; fewer where there are fewer."""
    if group is None:
        return df.orderBy(*order).limit(n)
    return df.withColumn("place_in_group", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place_in_group") <= n).select(*df.columns)


def snapshot(nodes: DataFrame, edges: DataFrame, baseline: DataFrame | None = None, dist: DataFrame | None = None, parts: Split | None = None) -> DataFrame:
    """graph_id, efficiency, resilience (to baseline(graph_id, e0), else to itself), n_components, largest, isolated, avg_path.
    isolated counts all nodes outside the largest component. parts: split(nodes, edges), and dist: distances of all nodes of large graphs, where they are known."""
    parts = parts or split(nodes, edges)
    comp = kept(components(nodes, edges, parts))
    counts = comp.groupBy(G).agg(F.count_distinct("comp_id").alias("n_components"), F.count(F.lit(1)).alias("n_nodes"))
    big = largest_component(comp).select(G, F.col("size").alias("largest"))
    all_ = efficiency(nodes, edges, parts=parts).drop("n").join(counts, G).join(big, G).join(avg_shortest_path(nodes, edges, dist=dist, parts=parts), G, "left")
    all_ = all_.join(baseline, G, "left") if baseline is not None else all_.withColumn("e0", F.col("efficiency"))
    r = F.when(F.coalesce("e0", F.lit(0.0)) == 0, 0.0).otherwise(F.col("efficiency") / F.col("e0"))
    return all_.select(G, "efficiency", r.alias("resilience"), "n_components", "largest", (F.col("n_nodes") - F.col("largest")).alias("isolated"), "avg_path")


def survivors(nodes: DataFrame, edges: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without removed(graph_id, node_id) and all edges that touch them."""
    gone = removed.select(G, "node_id").distinct()
    left = edges.join(gone.select(G, F.col("node_id").alias("u")), [G, "u"], "left_anti").join(gone.select(G, F.col("node_id").alias("v")), [G, "v"], "left_anti")
    return nodes.join(gone, [G, "node_id"], "left_anti"), left


def _far(paths: ShortestPaths) -> DataFrame | None:
    """Distances of large graphs, where there are any."""
    return paths.large.dist if paths.large is not None else paths.dist if paths.parts is None else None


def _steps(nodes: DataFrame, fraction: float, n_steps: int | None) -> DataFrame:
    want = F.lit(n_steps) if n_steps else F.greatest(F.lit(1), F.ceil(F.col("n") * fraction))
    return _counted(nodes).select(G, F.least(want, F.col("n") - 1).cast("int").alias("steps"))


def removal_curve(nodes: DataFrame, edges: DataFrame, fraction: float = 0.2, n_steps: int | None = None, adaptive: bool = True, parts: Split | None = None) -> DataFrame:
    """graph_id, step, removed_node and a snapshot after each removal; step 0 is the whole graph. parts: split(nodes, edges), where it is known.

    adaptive: every step ranks the damaged graphs anew and takes the top node out; a small graph goes through all its steps in
    one row (dense.py), and large ones advance together. Otherwise nodes go by the first ranking, and every step is a scenario of
    its own in one job.
    """
    if adaptive:
        curve = both(parts or split(nodes, edges), "curve", lambda n, e: _removals(n, e, fraction, n_steps, True), fraction, n_steps)
        return curve.filter(F.col(G).isNotNull())
    return _removals(nodes, edges, fraction, n_steps, False)


def _removals(nodes: DataFrame, edges: DataFrame, fraction: float, n_steps: int | None, adaptive: bool) -> DataFrame:
    steps = kept(_steps(nodes, fraction, n_steps))
    paths = path_counts(nodes, edges)
    base = kept(snapshot(nodes, edges, dist=_far(paths), parts=paths.parts))
    e0 = base.select(G, F.col("efficiency").alias("e0"))
    first = base.select(G, F.lit(0).alias("step"), F.lit(None).cast("long").alias("removed_node"), *base.columns[1:])
    if not adaptive:
        order = kept(_ranked(node_betweenness(paths), "at").join(steps, G).filter("at <= steps"))
        s = order.select(G, F.col("at").alias("step"))
        key = F.struct(G, "step")
        gone = s.join(order.select(G, "node_id", "at"), G).filter("at <= step").select(key.alias("k"), "node_id")
        n, e = (df.join(s, G).withColumn("k", key) for df in (nodes, edges))
        as_graph = lambda df: df.drop(G).withColumnRenamed("k", G)
        sn, se = survivors(as_graph(n), as_graph(e), as_graph(gone))
        base0 = s.join(e0, G).select(key.alias(G), "e0")
        shot = snapshot(sn, se, base0).select(f"{G}.*", *[c for c in base.columns if c != G])
        at = order.select(G, F.col("at").alias("step"), F.col("node_id").alias("removed_node"))
        return first.unionByName(shot.join(at, [G, "step"]))
    out, gone = [first], None
    most = steps.agg(F.max("steps")).first()[0] or 0
    n, e = nodes, edges
    for k in range(1, most + 1):  # the paths that rank a graph's nodes are those of its last snapshot
        open_ = steps.filter(F.col("steps") >= k).select(G)
        n, e = n.join(open_, G, "left_semi"), e.join(open_, G, "left_semi")
        first_of = F.min(F.struct((-F.round("betweenness", 9)).alias("x"), "node_id"))
        top = kept(node_betweenness(paths).join(open_, G, "left_semi").groupBy(G).agg(first_of.alias("t")).select(G, "t.node_id"))
        n, e = (kept(x) for x in survivors(n, e, top))
        paths = path_counts(n, e)
        out.append(snapshot(n, e, e0, _far(paths), paths.parts).join(top, G).select(G, F.lit(k).alias("step"), F.col("node_id").alias("removed_node"), *base.columns[1:]))
    return reduce(DataFrame.union, out)


def full_report(nodes: DataFrame, edges: DataFrame, k: int | None = None, fraction: float = 0.2) -> DataFrame:
    """graph_id, place, and side by side the gatekeeper of that rank (node_id, betweenness, degree) and the step of that number of
    the adaptive removal curve (removed_node, efficiency, resilience, largest, isolated). Step 0 is the whole graph; where one of
    both is longer, the other's columns are null."""
    parts = split(nodes, edges)
    top = gatekeepers(node_betweenness(path_counts(nodes, edges, parts=parts)), nodes, edges, k).select(G, F.col("rank").alias("place"), "node_id", "betweenness", "degree")
    curve = removal_curve(nodes, edges, fraction, parts=parts).select(G, F.col("step").alias("place"), "removed_node", "efficiency", "resilience", "largest", "isolated")
    return top.join(curve, [G, "place"], "full_outer")
