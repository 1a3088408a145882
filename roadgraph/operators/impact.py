"""What-if scenarios: who is hit, what survives, how much efficiency is lost. Scenarios are rows; thousands make one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadgraph.operators.centrality import edge_betweenness, node_betweenness, survivors, top_fraction
from roadgraph.operators.dense import Split, losses, split
from roadgraph.operators.paths import G, adjacency, components, efficiency, efficiency_of, hop_counts, hop_distances, largest_component, path_counts, reachable_components
from roadgraph.operators.tiles import straight_point, straight_points
from roadgraph.plans.loops import kept

#: Stands for an endless loss of time.
NO_PATH_PENALTY = 999.0
#: Side of the grid cells in which nodes and blasts meet.
CELL = 64
#: How many times wider a cell is than the ones below it, where nearest nodes are looked for; copies of cells on upper levels.
FAN = 8
#: Places that the smallest cells hold on average, at most.
FULL = 64
SALTS = 16


def near_pairs(a: DataFrame, b: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Rows of a (keys, ar, ac) and b (keys, br, bc) at most reach apart, with d2. Both meet in grid cells of side reach, by sorting, as the
    nine copies of b are more than they look to Spark."""
    cell = lambda x: F.floor(F.col(x) / reach).cast("long")
    spread = b.withColumn("cr", F.explode(F.array(*(cell("br") + i for i in (-1, 0, 1))))).withColumn("cc", F.explode(F.array(*(cell("bc") + i for i in (-1, 0, 1)))))
    met = a.withColumn("cr", cell("ar")).withColumn("cc", cell("ac")).join(spread.hint("merge"), [*keys, "cr", "cc"]).drop("cr", "cc")
    dr, dc = F.col("ar") - F.col("br"), F.col("ac") - F.col("bc")
    return met.withColumn("d2", dr * dr + dc * dc).filter(F.col("d2") <= reach * reach)


def nearest_node(points: DataFrame, nodes: DataFrame, reach: float | None = None, few: bool = False) -> DataFrame:
    """Adds node_id and d2 of the nearest node to points (graph_id, point_id, r, c); null if none is within reach, or, without
    a reach, if the graph has none or r or c is null. Ties: least node. few: there are fewer points than nodes, so within reach
    points are sent to the cells around them instead of nodes."""
    p = points.select(G, "point_id", F.col("r").alias("ar"), F.col("c").alias("ac"))
    n = nodes.select(G, "node_id", F.col("pos_r").alias("br"), F.col("pos_c").alias("bc"))
    nearest = lambda met, *key: met.groupBy(*key).agg(F.min(F.struct("d2", "node_id")).alias("b"))
    if reach is None:
        met = p.join(nearest(_nearest_cells(p, n), G, "ar", "ac"), [G, "ar", "ac"]).select(G, "point_id", "b.*")
    elif few:
        turned = lambda df, x, y: df.withColumnsRenamed({f"{x}r": f"{y}r", f"{x}c": f"{y}c"})
        met = near_pairs(turned(n, "b", "a"), turned(p, "a", "b"), [G], reach)
    else:
        met = near_pairs(p, n, [G], reach)
    best = nearest(met, G, "point_id")
    return points.join(best.hint("merge"), [G, "point_id"], "left").select(*points.columns, F.col("b.node_id").alias("node_id"), F.col("b.d2").alias("d2"))


def _nearest_cells(p: DataFrame, n: DataFrame) -> DataFrame:
    """Places (graph_id, ar, ac) of p, each once, and node_id and d2 of what may be nearest, however far it is.

    Nodes at one place count as the least of them, so that the work grows with places and not with how many share one. Cells of
    nodes form a tree, each FAN times as wide as the ones below it. From the top, a point keeps the cells whose box begins no
    farther than the nearest end of any box that it sees; only these are opened, so a point meets few cells on each level. On upper levels, where all points of a graph may ask one cell, cells are there SALTS times.
    """
    n = kept(n.dropna(subset=["br", "bc"]).groupBy(G, "br", "bc").agg(F.min("node_id").alias("node_id")))
    p = kept(p.dropna(subset=["ar", "ac"]).groupBy(G, "ar", "ac").agg(F.min("point_id").alias("point_id")))
    span = n.agg(F.max(F.greatest(F.abs("br"), F.abs("bc")))).first()[0]
    if span is None:
        return n.join(p, G).withColumn("d2", F.lit(0)).limit(0)
    at = lambda x, side: F.floor(F.col(x) / side).cast("long")
    side, places = float(CELL), n.count()
    while places > FULL * n.select(G, at("br", side), at("bc", side)).distinct().count():
        side /= FAN
    levels = [side]
    while levels[-1] <= span:
        levels.append(levels[-1] * FAN)
    gap = lambda x, low, high, f: f(F.col(low) - F.col(x), F.col(x) - F.col(high))
    square = lambda x: x * x
    seen = p.withColumn("salt", F.pmod(F.xxhash64("point_id"), F.lit(SALTS)).cast("int"))
    keys = [G]
    boxes = n.groupBy(G, at("br", levels[0]).alias("cr"), at("bc", levels[0]).alias("cc")).agg(*(f(x).alias(f"{k}_{x}") for x in ("br", "bc") for f, k in ((F.min, "low"), (F.max, "high"))))
    boxes = kept(boxes)
    for k in reversed(range(len(levels))):
        up = [F.floor(F.col(x) * levels[0] / levels[min(k + 1, len(levels) - 1)]).cast("long").alias(f"up_{x}") for x in ("cr", "cc")]
        own = [F.floor(F.col(x) * levels[0] / levels[k]).cast("long").alias(f"own_{x}") for x in ("cr", "cc")]
        cells = boxes.select("*", *up, *own).groupBy(G, "up_cr", "up_cc", "own_cr", "own_cc").agg(
            *(f(f"{side}_{x}").alias(f"{side}_{x}") for x in ("br", "bc") for f, side in ((F.min, "low"), (F.max, "high")))
        )
        salted = k > 0 or len(levels) == 1
        if salted:
            cells = cells.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        met = seen.join(cells, [*keys, *(["salt"] if salted else [])])
        near = square(gap("ar", "low_br", "high_br", lambda a, b: F.greatest(a, b, F.lit(0)))) + square(gap("ac", "low_bc", "high_bc", lambda a, b: F.greatest(a, b, F.lit(0))))
        far = square(gap("ar", "low_br", "high_br", lambda a, b: F.greatest(F.abs(a), F.abs(b)))) + square(gap("ac", "low_bc", "high_bc", lambda a, b: F.greatest(F.abs(a), F.abs(b))))
        met = met.withColumn("near", near).withColumn("best", F.min(far).over(Window.partitionBy(G, "point_id"))).filter("near <= best")
        seen = met.select(G, "point_id", "ar", "ac", "salt", F.col("own_cr").alias("up_cr"), F.col("own_cc").alias("up_cc"))
        keys = [G, "up_cr", "up_cc"]
    own = n.select("*", at("br", levels[0]).alias("up_cr"), at("bc", levels[0]).alias("up_cc"))
    dr, dc = F.col("ar") - F.col("br"), F.col("ac") - F.col("bc")
    return seen.drop("salt").join(own, keys).drop("up_cr", "up_cc").withColumn("d2", dr * dr + dc * dc)


def blast_hits(nodes: DataFrame, scenarios: DataFrame) -> DataFrame:
    """scenario_id, graph_id, node_id of all nodes within a scenario's radius. Both meet in grid cells, so one large graph
    with many scenarios is not compared node by node; a negative radius hits nothing."""
    r, side = F.col("radius"), F.lit(float(CELL))
    edge = lambda x, sign: F.floor((F.col(x) + sign * r) / side).cast("long")
    s = scenarios.filter("radius >= 0").select("scenario_id", G, "epi_r", "epi_c", "radius", F.explode(F.sequence(edge("epi_r", -1), edge("epi_r", 1))).alias("cr"), F.sequence(edge("epi_c", -1), edge("epi_c", 1)).alias("ccs"))
    s = s.select("*", F.explode("ccs").alias("cc")).drop("ccs")
    n = nodes.select(G, "node_id", "pos_r", "pos_c", F.floor(F.col("pos_r") / side).cast("long").alias("cr"), F.floor(F.col("pos_c") / side).cast("long").alias("cc"))
    dr, dc = F.col("pos_r") - F.col("epi_r"), F.col("pos_c") - F.col("epi_c")
    return n.join(s.hint("merge"), [G, "cr", "cc"]).filter(dr * dr + dc * dc <= r * r).select("scenario_id", G, "node_id")


def _per_scenario(df: DataFrame, scenarios: DataFrame) -> DataFrame:
    """df once for each scenario of its graph, with the scenario as graph_id."""
    return df.join(scenarios.select("scenario_id", G), G).drop(G).withColumnRenamed("scenario_id", G)


def hit_nodes(nodes: DataFrame, edges: DataFrame, scenarios: DataFrame, fallback: bool = True) -> DataFrame:
    """blast_hits; scenarios with a radius of 0 or less take the 5 % of nodes with the largest betweenness instead."""
    blast = blast_hits(nodes, scenarios.filter("radius > 0"))
    rest = scenarios.filter("radius <= 0")
    if not fallback or rest.isEmpty():
        return blast
    own = nodes.join(rest.select(G).distinct(), G, "left_semi")
    top = top_fraction(node_betweenness(path_counts(own, edges)), G, "betweenness", 0.05, "node_id", digits=9)
    return blast.union(rest.select("scenario_id", G).join(top.select(G, "node_id"), G).select("scenario_id", G, "node_id"))


def rerouted(edges: DataFrame, hops: DataFrame, gone: DataFrame) -> DataFrame:
    """scenario_id, graph_id, src: surviving sources that are farther from some survivor, by hops, once gone(scenario_id, graph_id,
    node_id) are out. hops: hop_distances of the whole graphs.

    Of the survivors that move away from a source, one nearest to it has lost all the nodes before it on its shortest paths, so
    a source is affected if and only if there is such a survivor; only these neighbours of removed nodes are looked at.
    """
    x = hops.select(G, "src", F.col("dst").alias("x"), F.col("hops").alias("far"))
    p = hops.select(G, "src", F.col("dst").alias("p"), F.col("hops").alias("near"))
    adj = adjacency(edges.withColumn("w", F.lit(1))).select(G, F.col("u").alias("p"), F.col("v").alias("x"))
    before = kept(p.join(adj, [G, "p"]).join(x, [G, "src", "x"]).filter("near + 1 = far").select(G, "src", "x", "p"))
    had = before.groupBy(G, "src", "x").agg(F.count(F.lit(1)).alias("had"))
    lost = before.join(gone.select("scenario_id", G, F.col("node_id").alias("p")), [G, "p"]).groupBy("scenario_id", G, "src", "x").agg(F.count(F.lit(1)).alias("lost"))
    out = lambda name: gone.select("scenario_id", G, F.col("node_id").alias(name))
    cut = lost.join(had, [G, "src", "x"]).filter("lost = had").join(out("x"), ["scenario_id", G, "x"], "left_anti").select("scenario_id", G, "src").distinct()
    return cut.join(out("src"), ["scenario_id", G, "src"], "left_anti")


def _hops_after(n: DataFrame, e: DataFrame, edges: DataFrame, whole: Split, hits: DataFrame, scenarios: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs by hops (graph_id, hops, k) and components (graph_id, node_id, comp_id) of what survives, scenarios as graphs: n and e.
    Small graphs are searched anew, whole has them apart."""
    if whole.large is None:
        after = split(n, e, None)
        return hop_counts(n, e, after), components(n, e, after)
    scen = kept(scenarios.select("scenario_id", G))
    far = scen.join(whole.large, G, "left_semi")
    of = lambda df, how: df.join(far.select(F.col("scenario_id").alias(G)), G, how)
    hops = kept(hop_distances(*whole.others()))
    counts, comp = _hops_after_large(of(n, "left_semi"), of(e, "left_semi"), edges.join(whole.large, G, "left_semi"), hops, hits.join(far, ["scenario_id", G], "left_semi"), far)
    n, e = of(n, "left_anti"), of(e, "left_anti")
    after = split(n, e, None)
    return hop_counts(n, e, after).unionByName(counts), components(n, e, after).unionByName(comp)


def _hops_after_large(n: DataFrame, e: DataFrame, edges: DataFrame, hops: DataFrame, hits: DataFrame, scenarios: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Only sources whose distances change are searched from; the others keep their counts without the removed nodes."""
    again = kept(rerouted(edges, hops, hits))
    new = kept(hop_distances(n, e, again.select(F.col("scenario_id").alias(G), "src")))
    own = n.select(F.col(G).alias("scenario_id"), F.col("node_id").alias("src")).join(scenarios.select("scenario_id", G), "scenario_id")
    same = kept(own.join(again, ["scenario_id", G, "src"], "left_anti").select("scenario_id", G, "src"))
    had = same.join(hops.groupBy(G, "src", "hops").agg(F.count(F.lit(1)).alias("k")), [G, "src"])
    to_gone = hops.join(hits.select("scenario_id", G, F.col("node_id").alias("dst")), [G, "dst"]).groupBy("scenario_id", G, "src", "hops").agg((-F.count(F.lit(1))).alias("k"))
    lost = to_gone.join(same, ["scenario_id", G, "src"], "left_semi")
    pairs = had.select(F.col("scenario_id").alias(G), "hops", "k").union(lost.select(F.col("scenario_id").alias(G), "hops", "k")).union(new.groupBy(G, "hops").agg(F.count(F.lit(1)).alias("k")))
    by_hops = pairs.groupBy(G, "hops").agg(F.sum("k").alias("k"))
    # a source that is no farther from anything still reaches all that survives of its component
    whole = own.join(reachable_components(hops).withColumnRenamed("node_id", "src"), [G, "src"])
    first = whole.groupBy("scenario_id", G, "comp_id").agg(F.min("src").alias("first"))
    old = same.join(whole, ["scenario_id", G, "src"]).join(first, ["scenario_id", G, "comp_id"])
    comp = old.select(F.col("scenario_id").alias(G), F.col("src").alias("node_id"), F.col("first").alias("comp_id")).union(reachable_components(new))
    return by_hops, comp


def impact(nodes: DataFrame, edges: DataFrame, scenarios: DataFrame, fallback: bool = True) -> DataFrame:
    """One row per scenario: removed nodes and edges, efficiency before and after, resilience, drop and time penalty in percent,
    components and isolated nodes after. A small graph goes through its scenarios in one row. Of a large one distances before are
    computed once; after a removal only the sources that it affects are searched from again."""
    nodes, edges, scenarios = kept(nodes), kept(edges), kept(scenarios)
    hits = kept(hit_nodes(nodes, edges, scenarios, fallback))
    lines = edges.filter("u is not null and v is not null").groupBy(G, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count(F.lit(1)).alias("lines"))
    lines = kept(lines)
    whole = split(nodes, lines, "lines")
    if whole.rows is None:
        return _told(_losses_in_rounds(nodes, edges, scenarios, hits))
    rows = _losses_of_small(whole.rows, lines.filter("u = v"), scenarios, hits)
    if whole.large is not None:
        rows = rows.unionByName(_losses_in_rounds(*(df.join(whole.large, G, "left_semi") for df in (nodes, edges, scenarios, hits))))
    return _told(rows)


def _losses_of_small(rows: DataFrame, loops: DataFrame, scenarios: DataFrame, hits: DataFrame) -> DataFrame:
    """dense.losses, and edges from a removed node to itself, which a row of split has not."""
    lost = hits.groupBy("scenario_id", G).agg(F.collect_list(F.col("node_id").cast("long")).alias("gone"))
    each = scenarios.select("scenario_id", G).join(lost.hint("merge"), ["scenario_id", G], "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<bigint>")))
    found = losses(rows, kept(each))
    if loops.isEmpty():
        return found
    own = hits.select("scenario_id", G, F.col("node_id").alias("u")).distinct().join(loops.hint("merge"), [G, "u"]).groupBy("scenario_id", G).agg(F.sum("lines").alias("more"))
    return found.join(own.hint("merge"), ["scenario_id", G], "left").withColumn("cut", F.col("cut") + F.coalesce("more", F.lit(0))).drop("more")


def _losses_in_rounds(nodes: DataFrame, edges: DataFrame, scenarios: DataFrame, hits: DataFrame) -> DataFrame:
    """The same for graphs of any size."""
    gone = hits.select(F.col("scenario_id").alias(G), "node_id")
    all_n, all_e = _per_scenario(nodes, scenarios), kept(_per_scenario(edges, scenarios))
    n, e = (kept(x) for x in survivors(all_n, all_e, gone))
    whole = split(nodes, edges, None)
    pre = efficiency(nodes, edges, parts=whole).select(G, F.col("efficiency").alias("e_pre"), F.col("n").alias("n_pre"))
    by_hops, comp = _hops_after(n, e, edges, whole, hits, scenarios)
    post = efficiency_of(n, by_hops).select(F.col(G).alias("scenario_id"), F.col("efficiency").alias("post"))
    comp = kept(comp)
    shape = comp.groupBy(G).agg(F.count_distinct("comp_id").alias("nc"), F.count(F.lit(1)).alias("nn")).join(largest_component(comp).select(G, "size"), G)
    shape = shape.select(F.col(G).alias("scenario_id"), "nc", (F.col("nn") - F.col("size")).alias("iso"))
    n_edges = lambda df, name: df.groupBy(F.col(G).alias("scenario_id")).agg(F.count(F.lit(1)).alias(name))
    n_gone = hits.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("gone"))
    rows = scenarios.select("scenario_id", G).join(pre, G)
    for part in (post, shape, n_gone, n_edges(all_e, "had"), n_edges(e, "left")):
        rows = rows.join(part, "scenario_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        "scenario_id", G, zero("gone").alias("gone"), (zero("had") - zero("left")).alias("cut"), "e_pre", F.coalesce("post", F.lit(0.0)).alias("e_post"), "n_pre", zero("nc").alias("n_components"), zero("iso").alias("isolated"),
    )


def _told(rows: DataFrame) -> DataFrame:
    e_pre, e_post, small = F.col("e_pre"), F.col("e_post"), F.col("n_pre") < 2
    return rows.select(
        "scenario_id", G, F.col("gone").alias("removed_nodes"), F.col("cut").alias("removed_edges"), "e_pre", "e_post",
        F.when(small, 1.0).when(e_pre == 0, 0.0).otherwise(e_post / e_pre).alias("resilience"),
        F.when(small | (e_pre == 0), 0.0).otherwise((e_pre - e_post) / e_pre * 100).alias("drop_pct"),
        F.when(small, 0.0).when(e_post == 0, NO_PATH_PENALTY).otherwise((e_pre / e_post - 1) * 100).alias("time_penalty_pct"),
        "n_components", "isolated",
    )


def bottlenecks(nodes: DataFrame, edges: DataFrame, scenarios: DataFrame, fraction: float = 0.10) -> DataFrame:
    """scenario_id, u, v, betweenness of the most used edges of what survives each scenario."""
    gone = kept(hit_nodes(nodes, edges, scenarios)).select(F.col("scenario_id").alias(G), "node_id")
    n, e = (kept(x) for x in survivors(_per_scenario(nodes, scenarios), _per_scenario(edges, scenarios), gone))
    bc = edge_betweenness(path_counts(n, e), e)
    return top_fraction(bc, G, "betweenness", fraction, "u", "v", digits=9).withColumnRenamed(G, "scenario_id")


def point_failure(points: DataFrame, nodes: DataFrame, edges: DataFrame, reach: float = 20, radius: float = 5) -> DataFrame:
    """impact of losing the node nearest to each point, and what lies within radius of it. Points with no node in reach are left out."""
    points, nodes = kept(points), kept(nodes.select(G, "node_id", "pos_r", "pos_c"))
    at = nearest_node(points, nodes, reach, few=True).filter("node_id is not null").join(nodes.hint("merge"), [G, "node_id"])
    scen = at.select(F.col("point_id").alias("scenario_id"), G, F.col("pos_r").alias("epi_r"), F.col("pos_c").alias("epi_c"), F.lit(radius).alias("radius"))
    return impact(nodes, edges, scen, fallback=False)


def edge_pixels(edges: DataFrame, tiles: DataFrame) -> DataFrame:
    """graph_id, u, v, r, c: pixels of edges' paths that lie on the tile."""
    at = edges.select(G, "u", "v", F.explode("path").alias("p")).select(G, "u", "v", F.col("p.r").alias("r"), F.col("p.c").alias("c"))
    return at.join(tiles.select(F.col("tile_id").alias(G), "h", "w"), G).filter("r >= 0 and c >= 0 and r < h and c < w").drop("h", "w")


def straight_pixels(nodes: DataFrame, edges: DataFrame, tiles: DataFrame) -> DataFrame:
    """graph_id, u, v, r, c: edge_pixels of edges whose paths are straight_path between their nodes. Each segment is clipped to the
    tile first (Liang & Barsky 1984), with a pixel to spare for rounding, so that no other point is made."""
    at = lambda k: nodes.select(G, F.col("node_id").alias(k), F.col("pos_r").alias(f"r{k}"), F.col("pos_c").alias(f"c{k}"))
    own = edges.select(G, "u", "v").join(at("u"), [G, "u"]).join(at("v"), [G, "v"]).join(tiles.select(F.col("tile_id").alias(G), "h", "w"), G)
    low, high = [F.lit(0.0)], [F.lit(1.0)]
    for x, side in (("r", "h"), ("c", "w")):
        a, d = F.col(f"{x}u"), F.col(f"{x}v") - F.col(f"{x}u")
        ends = [F.when(d != 0, (b - a) / F.when(d != 0, d)) for b in (F.lit(-1), F.col(side))]
        inside = a.between(-1, F.col(side))
        low.append(F.when(d != 0, F.least(*ends)).when(inside, 0.0).otherwise(2.0))
        high.append(F.when(d != 0, F.greatest(*ends)).when(inside, 1.0).otherwise(-1.0))
    own = own.withColumns({"low": F.greatest(*low), "high": F.least(*high), "last": straight_points("ru", "cu", "rv", "cv") - 1}).filter("low <= high")
    first = F.greatest(F.lit(0), F.floor(F.col("low") * F.col("last")) - 1)
    upto = F.least(F.col("last"), F.ceil(F.col("high") * F.col("last")) + 1)
    points = own.withColumn("t", F.explode(F.sequence(first.cast("int"), upto.cast("int"))))
    r, c = (straight_point(F.col(f"{x}u"), F.col(f"{x}v"), F.col("t"), F.col("last")) for x in ("r", "c"))
    return points.select(G, "u", "v", r.alias("r"), c.alias("c"), "h", "w").filter("r >= 0 and c >= 0 and r < h and c < w").drop("h", "w")


def criticality_raster(pixels: DataFrame, edge_bc: DataFrame) -> DataFrame:
    """graph_id, r, c, crit: the largest share of the graph's top betweenness among the edges on a pixel; a top under 1e-10 counts as 1."""
    top = edge_bc.groupBy(G).agg(F.max("betweenness").alias("top"))
    share = edge_bc.join(top, G).select(G, "u", "v", (F.col("betweenness") / F.when(F.col("top") < 1e-10, 1.0).otherwise(F.col("top"))).alias("crit"))
    return pixels.join(share, [G, "u", "v"]).groupBy(G, "r", "c").agg(F.max("crit").alias("crit"))


def destroyed_raster(pixels: DataFrame, removed_edges: DataFrame) -> DataFrame:
    return pixels.join(removed_edges.select(G, "u", "v").distinct(), [G, "u", "v"], "left_semi").select(G, "r", "c").distinct()


def edge_class(edges: DataFrame, removed: DataFrame, bottleneck: DataFrame) -> DataFrame:
    """graph_id, u, v, class and style value: removed before bottleneck before normal; value 3 + 4 * criticality. Ends in any order."""
    k = lambda df: df.select(G, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    own = edges.select(G, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "criticality")
    both = own.join(k(removed).distinct().withColumn("gone", F.lit(True)), [G, "u", "v"], "left").join(k(bottleneck).distinct().withColumn("hot", F.lit(True)), [G, "u", "v"], "left")
    return both.select(G, "u", "v", F.when(F.col("gone"), "removed").when(F.col("hot"), "bottleneck").otherwise("normal").alias("class"), (3 + 4 * F.col("criticality")).alias("style"))


def connectivity_boost(before: DataFrame, after: DataFrame) -> DataFrame:
    """graph_id, boost in percent of the largest component's size; 0 if there was none. Both: (graph_id, size)."""
    b, a = before.select(G, F.col("size").alias("pre")), after.select(G, F.col("size").alias("post"))
    both = b.join(a, G, "full_outer").na.fill(0)
    return both.select(G, F.when(F.col("pre") == 0, 0.0).otherwise((F.col("post") - F.col("pre")) / F.col("pre") * 100).alias("boost"))


def network_stats(nodes: DataFrame, edges: DataFrame, mask: DataFrame | None = None, skel: DataFrame | None = None) -> DataFrame:
    """graph_id, n_nodes, n_edges, n_healed (edges marked synthetic), efficiency, and with the tables of pixels they came from
    road_px and skeleton_px; 0 where a graph has none."""
    healed = F.count_if("synthetic") if "synthetic" in edges.columns else F.lit(0).cast("long")
    e = edges.groupBy(G).agg(F.count(F.lit(1)).alias("n_edges"), healed.alias("n_healed"))
    out = efficiency(nodes, edges).join(e, G, "left").na.fill(0, ["n_edges", "n_healed"]).select(G, F.col("n").alias("n_nodes"), "n_edges", "n_healed", "efficiency")
    for name, px in (("road_px", mask), ("skeleton_px", skel)):
        if px is not None:
            out = out.join(px.groupBy(F.col("tile_id").alias(G)).agg(F.count(F.lit(1)).alias(name)), G, "left").na.fill(0, [name])
    return out


def path_error(truth: tuple[DataFrame, DataFrame], pred: tuple[DataFrame, DataFrame], pairs: DataFrame, reach: float = 50) -> DataFrame:
    """graph_id, path_error: mean relative difference of shortest paths for pairs (graph_id, a, b) of true nodes.

    Ends move to the nearest predicted node within reach; no such node, or no predicted path, counts 1. Pairs with a
    true length under 1e-5 are skipped; a graph without pairs has 0, one with fewer than two nodes on a side 1.
    """
    from roadgraph.operators.paths import pair_paths

    (tn, te), (pn, pe) = truth, pred
    p = kept(pairs.select(G, "a", "b").distinct().withColumn("pair", F.monotonically_increasing_id()))
    lg = pair_paths(tn, te, p).filter("dist >= 1e-5").select(G, "pair", F.col("dist").alias("lg"))
    ends = p.select(G, "pair", F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("a").alias("node_id")), F.struct(F.lit(1).alias("s"), F.col("b").alias("node_id")))).alias("e")).select(G, "pair", "e.*")
    at = ends.join(tn.select(G, "node_id", F.col("pos_r").alias("r"), F.col("pos_c").alias("c")), [G, "node_id"]).withColumn("point_id", F.col("pair") * 2 + F.col("s")).drop("node_id")
    near = nearest_node(at.select(G, "point_id", "r", "c"), pn, reach).filter("node_id is not null")
    side = lambda s, name: near.filter(F.col("point_id") % 2 == s).select(G, F.floor(F.col("point_id") / 2).cast("long").alias("pair"), F.col("node_id").alias(name))
    moved = kept(side(0, "a").join(side(1, "b"), [G, "pair"]))
    lp = pair_paths(pn, pe, moved).select(G, "pair", F.col("dist").alias("lp"))
    err = lg.join(lp, [G, "pair"], "left").select(G, F.when(F.col("lp").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.abs(F.col("lp") - F.col("lg")) / F.col("lg"))).alias("x"))
    size = lambda n, name: n.groupBy(G).agg(F.count(F.lit(1)).alias(name))
    all_ = size(tn, "nt").join(size(pn, "np"), G, "full_outer").na.fill(0).join(err.groupBy(G).agg(F.avg("x").alias("x")), G, "left")
    return all_.select(G, F.when((F.col("nt") < 2) | (F.col("np") < 2), 1.0).otherwise(F.coalesce("x", F.lit(0.0))).alias("path_error"))
