"""Closing gaps in a graph: a minimum spanning forest of short, straight bridges between components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadgraph.functions.columns import angular_cost
from roadgraph.operators.components import component_labels
from roadgraph.operators.dense import whole_numbers
from roadgraph.operators.impact import near_pairs
from roadgraph.operators.paths import G, components
from roadgraph.operators.skeleton import closing, skeleton_graph, thin
from roadgraph.operators.tiles import straight_path
from roadgraph.plans.loops import kept, sized

MAX_ROUNDS = 64
#: Most candidates of a graph whose forest is told from one row.
GAPS = 2048


def gap_candidates(nodes: DataFrame, comp: DataFrame, max_gap: float) -> DataFrame:
    """graph_id, a, b (a < b), dist: nodes of different components at most max_gap and at least 1e-8 apart.
    Graphs of one component drop out first; nodes meet in grid cells."""
    several = sized(kept(comp.groupBy(G).agg(F.min("comp_id").alias("low"), F.max("comp_id").alias("high")).filter("low < high").select(G)))
    own = nodes.join(comp.join(several, G, "left_semi").hint("merge"), [G, "node_id"])
    a = own.select(G, F.col("node_id").alias("a"), F.col("comp_id").alias("ca"), F.col("pos_r").alias("ar"), F.col("pos_c").alias("ac"))
    b = own.select(G, F.col("node_id").alias("b"), F.col("comp_id").alias("cb"), F.col("pos_r").alias("br"), F.col("pos_c").alias("bc"))
    met = near_pairs(a, b, [G], max_gap).filter("a < b and ca <> cb").withColumn("dist", F.sqrt("d2"))
    return met.filter("dist >= 1e-8").select(G, "a", "b", "dist", "ar", "ac", "br", "bc")


def tangents(nodes: DataFrame, edges: DataFrame, depth: int = 10, of: DataFrame | None = None, paths: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """graph_id, node_id, tangent (r, c) of length 1: the first depth steps from the node along its longest edge with a path
    of two points or more; ties by the other end. Nodes without such an edge have none. of(graph_id, node_id): for these nodes only.
    paths: adds path to edges that have none, and is asked only for edges that end at one of these nodes."""
    k = F.least(F.lit(depth + 1), F.size("path"))
    end = lambda own, other, at, far: F.struct(F.col(own).alias("node_id"), F.col(other).alias("other"), F.element_at("path", at).alias("at"), F.element_at("path", far).alias("far"))
    ends = F.when(F.size("path") >= 2, F.array(end("u", "v", F.lit(1), k), end("v", "u", F.lit(-1), -k)))
    if of is not None:
        asked = lambda k: of.withColumnRenamed("node_id", k)
        at_v = edges.join(asked("v"), [G, "v"], "left_semi").join(asked("u"), [G, "u"], "left_anti")
        edges = edges.join(asked("u"), [G, "u"], "left_semi").select(edges.columns).union(at_v.select(edges.columns))
    edges = edges if paths is None else paths(edges)
    # of a path only two points go on, so that none is shuffled
    both = edges.filter("u <> v").select(G, "w", F.explode(ends).alias("e")).select(G, "w", "e.*")
    both = both if of is None else both.join(of, [G, "node_id"], "left_semi")
    own = both.withColumn("k", F.row_number().over(Window.partitionBy(G, "node_id").orderBy(F.desc("w"), "other"))).filter("k = 1")
    dr, dc = (F.col("far")[x] - F.col("at")[x] for x in ("r", "c"))
    n = F.sqrt(dr * dr + dc * dc)
    return own.filter(n > 1e-8).select(G, "node_id", F.struct((dr / n).alias("r"), (dc / n).alias("c")).alias("tangent"))


def bridge_costs(cand: DataFrame, tangent: DataFrame, ang_w: float = 2.0) -> DataFrame:
    """Adds cost: dist + ang_w * the turns at both ends."""
    side = lambda k: tangent.select(G, F.col("node_id").alias(k), F.col("tangent").alias(f"t_{k}"))
    own = cand.join(side("a"), [G, "a"], "left").join(side("b"), [G, "b"], "left")
    line = F.struct(((F.col("br") - F.col("ar")) / F.col("dist")).alias("r"), ((F.col("bc") - F.col("ac")) / F.col("dist")).alias("c"))
    return own.withColumn("cost", F.col("dist") + ang_w * angular_cost(F.col("t_a"), F.col("t_b"), line)).drop("t_a", "t_b")


def costed_gaps(nodes: DataFrame, edges: DataFrame, comp: DataFrame, max_gap: float = 50, ang_w: float = 2.0, paths: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """gap_candidates with bridge_costs. Tangents are told once, and of the gaps' ends only."""
    cand = kept(gap_candidates(nodes, comp, max_gap))
    ends = sized(kept(cand.select(G, F.explode(F.array("a", "b")).alias("node_id")).distinct()))
    return bridge_costs(cand, sized(kept(tangents(nodes, edges, of=ends, paths=paths))), ang_w)


def spanning_forest(comp: DataFrame, cand: DataFrame) -> DataFrame:
    """The candidates of a minimum spanning forest over components, least by (cost, a, b). Graphs of up to GAPS candidates are
    answered from one row each, as all of a graph's few candidates decide together; larger ones go in rounds. The order is strict, so both find the same forest."""
    cand = kept(cand)
    ends = sized(kept(cand.select(G, F.explode(F.array("a", "b")).alias("node_id")).distinct()))
    own = sized(kept(comp.hint("merge").join(ends, [G, "node_id"], "left_semi")))
    side = lambda k: own.select(G, F.col("node_id").alias(k), F.col("comp_id").alias(f"l_{k}"))
    cand = kept(cand.join(side("a"), [G, "a"]).join(side("b"), [G, "b"]))
    if whole_numbers(cand, "a", "b", "l_a", "l_b"):
        many = sized(kept(cand.groupBy(G).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > GAPS).select(G)))
        far, near = cand.join(many, G, "left_semi"), cand.join(many, G, "left_anti")
        chosen = _from_rows(near)
        if not many.isEmpty():
            chosen = chosen.union(_in_rounds(far))
    else:
        chosen = _in_rounds(cand)
    return cand.drop("l_a", "l_b").join(sized(kept(chosen)), [G, "a", "b"])


def _from_rows(cand: DataFrame) -> DataFrame:
    """graph_id, a, b of the forests of graphs with few candidates (Kruskal 1956)."""
    item = F.struct("cost", *(F.col(x).cast("long").alias(x) for x in ("a", "b", "l_a", "l_b")))
    rows = cand.groupBy(G).agg(F.sort_array(F.collect_list(item)).alias("gaps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken: list[tuple[int, int, int]] = []
            for i, gaps in enumerate(batch.column(1).to_pylist()):
                up: dict[int, int] = {}

                def root(x: int) -> int:
                    while x in up:
                        x = up[x]
                    return x

                for gap in gaps:
                    x, y = root(gap["l_a"]), root(gap["l_b"])
                    if x != y:
                        up[x] = y
                        taken.append((i, gap["a"], gap["b"]))
            i, a, b = (pa.array([t[k] for t in taken], pa.int64()) for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(i), a, b], names=[G, "a", "b"])

    found = rows.mapInArrow(run, T.StructType([rows.schema[G], T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    return found.select(G, *(F.col(x).cast(cand.schema[x].dataType).alias(x) for x in ("a", "b")))


def _in_rounds(cand: DataFrame) -> DataFrame:
    """The same by rounds of Boruvka's algorithm: every component takes its least candidate; components that meet become one.
    At most log2 of their number of rounds; a round carries on only candidates between different components."""
    now = kept(cand.select(G, "a", "b", "cost", "l_a", "l_b").filter("l_a <> l_b"))
    chosen = now.select(G, "a", "b").limit(0)
    for _ in range(MAX_ROUNDS):
        ends = now.select(G, F.explode(F.array("l_a", "l_b")).alias("label"), F.struct("cost", "a", "b", "l_a", "l_b").alias("s"))
        best = kept(ends.groupBy(G, "label").agg(F.min("s").alias("s")).select(G, "s.*").distinct())
        if best.isEmpty():
            return chosen
        chosen = chosen.union(best.select(G, "a", "b"))
        merged = kept(component_labels(best.select(G, F.col("l_a").alias("u"), F.col("l_b").alias("v")), [G]))
        for k in ("l_a", "l_b"):
            new = sized(merged).select(G, F.col("node").alias(k), F.col("component").alias("new"))
            now = now.join(new, [G, k], "left").withColumn(k, F.coalesce("new", k)).drop("new")
        now = kept(now.filter("l_a <> l_b"))
    raise RuntimeError(f"bridges did not end in {MAX_ROUNDS} rounds")


def heal(nodes: DataFrame, edges: DataFrame, max_gap: float = 50, ang_w: float = 2.0, paths: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """edges and the bridges that join their components: w = dist, synthetic, healing_cost and a straight path. paths: as in tangents."""
    comp = kept(components(nodes, edges))
    forest = spanning_forest(comp, costed_gaps(nodes, edges, comp, max_gap, ang_w, paths))
    path = straight_path(F.col("ar"), F.col("ac"), F.col("br"), F.col("bc"))
    new = forest.select(G, F.col("a").alias("u"), F.col("b").alias("v"), F.col("dist").alias("w"), F.round(F.col("dist") * 1e6).cast("long").alias("w_q"), path.alias("path"), F.lit(True).alias("synthetic"), F.col("cost").alias("healing_cost"))
    return (edges if paths is None else paths(edges)).unionByName(new, allowMissingColumns=True)


def heal_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, n_healed_edges, n_components_post_heal."""
    comp = components(nodes, edges).groupBy(G).agg(F.count_distinct("comp_id").alias("n_components_post_heal"))
    new = edges.groupBy(G).agg(F.count_if("synthetic").alias("n_healed_edges"))
    return comp.join(new, G, "left").select(G, F.coalesce("n_healed_edges", F.lit(0)).alias("n_healed_edges"), "n_components_post_heal")


def mask_to_graph(mask: DataFrame, tiles: DataFrame, prune: float = 0, radius: int = 3, healed: bool = True, max_gap: float = 50, ang_w: float = 2.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and skeleton of road masks."""
    skel = thin(closing(mask, tiles, radius))
    nodes, edges = skeleton_graph(skel, prune)
    return nodes, kept(heal(nodes, edges, max_gap, ang_w)) if healed else edges, skel
