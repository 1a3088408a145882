"""From a road mask to a graph: closing, thinning, pixel classes, junction clusters, arcs, assembly.

All tiles go together; the number of rounds depends on the widest road, not on the number of tiles. What needs a pixel's neighbours
(classes, clusters, arcs) is told block by block (blocks.py).
A pixel's code is r * 2**20 + c, so codes order pixels row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadgraph.operators.blocks import WIDE, labelled, neighbour_counts, touching
from roadgraph.operators.quality import AROUND, K, near_mask
from roadgraph.operators.strips import WIDEST, closed, thinned
from roadgraph.plans.loops import kept, sized

DIAGONAL = 2.0**0.5


def code(r: str | Column = "r", c: str | Column = "c") -> Column:
    r, c = (F.col(x) if isinstance(x, str) else x for x in (r, c))
    return (r.cast("long") * WIDE + c.cast("long")).cast("long")


def _typed(px: DataFrame, like: DataFrame) -> DataFrame:
    return px.select("tile_id", *(F.col(x).cast(like.schema[x].dataType) for x in ("r", "c")))


def closing(mask: DataFrame, tiles: DataFrame, radius: float = 3) -> DataFrame:
    """Dilation by a disk, then erosion; what lies off the tile counts as road while eroding. Radius 0 changes nothing.
    Up to a radius of strips.WIDEST by strips of bits, beyond it by near masks over all pixels of the tiles."""
    if radius <= 0:
        return mask.select(*K).distinct()
    if radius >= WIDEST + 1:
        rows = tiles.select("tile_id", "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("r"))
        every = rows.select("tile_id", "r", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("c"))
        wide = kept(near_mask(every, mask, radius))
        return _typed(wide.join(near_mask(wide, every.join(wide, K, "left_anti"), radius), K, "left_anti"), mask)
    return _typed(closed(mask, tiles, radius), mask)


def thin(mask: DataFrame) -> DataFrame:
    """One-pixel centre lines, by strips of bits."""
    return kept(_typed(thinned(mask), mask))


def classify(skel: DataFrame) -> DataFrame:
    """tile_id, r, c, nb, class: junction (more than two neighbours), endpoint (one) or arc (two). Isolated pixels are dropped."""
    own = neighbour_counts(skel).filter("nb > 0").select(*(F.col(x).cast(skel.schema[x].dataType) for x in K), "nb")
    return own.withColumn("class", F.when(F.col("nb") > 2, "junction").when(F.col("nb") == 1, "endpoint").otherwise("arc"))


def _blobs(px: DataFrame) -> DataFrame:
    """tile_id, r, c, blob: 8-connected components, named by their first pixel's code."""
    return labelled(px).select("tile_id", *(F.col(x).cast(px.schema[x].dataType) for x in ("r", "c")), "blob")


def junction_clusters(cls: DataFrame) -> DataFrame:
    return _blobs(cls.filter("class = 'junction'"))


def representatives(clusters: DataFrame, skel: DataFrame, reach: int = 3) -> DataFrame:
    """tile_id, blob, pos_r, pos_c: the skeleton pixel nearest to the cluster's rounded centre, within reach; ties row by row.
    A cluster with no pixel within reach of its centre, such as a wide ring, keeps the centre itself. Centres and pixels meet in grid cells,
    of which a centre sees four at most."""
    mid = clusters.groupBy("tile_id", "blob").agg(F.bround(F.avg("r"), 0).cast("long").alias("r"), F.bround(F.avg("c"), 0).cast("long").alias("c"))
    side = max(16, 2 * reach)
    cell = lambda x, k=0: F.floor((F.col(x) + k) / side).cast("long")
    seen = lambda x: F.sequence(cell(x, -reach), cell(x, reach))
    spread = mid.select("tile_id", "blob", F.col("r").alias("mr"), F.col("c").alias("mc"), F.explode(seen("r")).alias("cr"), seen("c").alias("ccs"))
    spread = spread.select("tile_id", "blob", "mr", "mc", "cr", F.explode("ccs").alias("cc"))
    px = skel.select(*K, cell("r").alias("cr"), cell("c").alias("cc"))
    dr, dc = F.col("r") - F.col("mr"), F.col("c") - F.col("mc")
    near = spread.hint("merge").join(px, ["tile_id", "cr", "cc"]).filter((F.abs(dr) <= reach) & (F.abs(dc) <= reach))
    best = near.groupBy("tile_id", "blob").agg(F.min(F.struct((dr * dr + dc * dc).alias("d2"), "r", "c")).alias("b"))
    return mid.join(best.hint("merge"), ["tile_id", "blob"], "left").select("tile_id", "blob", F.coalesce("b.r", "r").alias("pos_r"), F.coalesce("b.c", "c").alias("pos_c"))


def graph_nodes(cls: DataFrame, clusters: DataFrame, skel: DataFrame) -> DataFrame:
    """graph_id, node_id, pos_r, pos_c, kind: junction clusters and endpoints; node_id is the code of a cluster's first pixel or of the endpoint."""
    j = representatives(clusters, skel).select(F.col("tile_id").alias("graph_id"), F.col("blob").alias("node_id"), "pos_r", "pos_c", F.lit("junction").alias("kind"))
    e = cls.filter("class = 'endpoint'").select(F.col("tile_id").alias("graph_id"), code().alias("node_id"), F.col("r").cast("long").alias("pos_r"), F.col("c").cast("long").alias("pos_c"), F.lit("endpoint").alias("kind"))
    return j.union(e)


def trace_arcs(cls: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arcs (tile_id, arc, u, v, n_card, n_diag) and their pixels (tile_id, arc, r, c).

    An arc is a chain of pixels with two neighbours between two nodes, or two touching nodes. Every arc is kept,
    whichever pixel of a cluster it leaves from; an arc back to its own node is a self-loop. A ring without a node is an arc
    with u = v = its first pixel.
    """
    arcs, pixels = _started_arcs(cls, clusters)
    return arcs.drop("start"), pixels


def _started_arcs(cls: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """trace_arcs, with start: the first of an arc's pixels that touch u; null for rings and arcs without pixels."""
    chain = kept(_blobs(cls.filter("class = 'arc'")))
    none = F.lit(None).cast("long")
    px = chain.select(*K, F.col("blob").alias("arc"), none.alias("node")).union(clusters.select(*K, none, "blob")).union(cls.filter("class = 'endpoint'").select(*K, none, code()))
    met = kept(touching(px, F.col("arc"), F.col("node")).filter("xp is not null and (xq is null or p < q) or yp < yq"))
    steps = met.filter("xp is not null").groupBy("tile_id", F.col("xp").alias("arc")).agg(
        F.count_if(~F.col("diagonal")).alias("n_card"), F.count_if("diagonal").alias("n_diag"), F.min("yq").alias("u"), F.max("yq").alias("v"),
        F.min(F.when(F.col("yq").isNotNull(), F.struct("yq", "p")))["p"].alias("start"),
    )
    arcs = steps.select("tile_id", "arc", F.coalesce("u", "arc").alias("u"), F.coalesce("v", "arc").alias("v"), "n_card", "n_diag", "start")
    short = met.filter("xp is null").groupBy("tile_id", F.col("yp").alias("u"), F.col("yq").alias("v")).agg(F.min(F.struct("diagonal", "p")).alias("s"))
    direct = short.select(
        "tile_id", (-F.col("s.p") - 1).alias("arc"), "u", "v", F.when(F.col("s.diagonal"), 0).otherwise(1).cast("long").alias("n_card"), F.when(F.col("s.diagonal"), 1).otherwise(0).cast("long").alias("n_diag"), none.alias("start")
    )
    return arcs.union(direct), chain.withColumnRenamed("blob", "arc")


def ring_anchor(cls: DataFrame) -> DataFrame:
    """graph_id, node_id, pos_r, pos_c, kind: the first pixel of every ring that has no node."""
    own = labelled(cls, F.when(F.col("class") == "arc", 1).otherwise(0))
    rings = own.groupBy("tile_id", "blob").agg(F.min("x").alias("bare"), F.min(F.struct("r", "c")).alias("f")).filter("bare = 1")
    return rings.select(F.col("tile_id").alias("graph_id"), F.col("blob").alias("node_id"), F.col("f.r").cast("long").alias("pos_r"), F.col("f.c").cast("long").alias("pos_c"), F.lit("junction").alias("kind"))


def arc_paths(arcs: DataFrame, pixels: DataFrame) -> DataFrame:
    """tile_id, arc, px: each started arc's pixels (r, c) in order from its start. A path is one row in any case, so an arc's pixels are
    gathered first and walked there, all arcs of a batch at the same time. arcs(tile_id, arc, start)."""
    own = pixels.select("tile_id", "arc", code().alias("p")).join(arcs.filter("start is not null").select("tile_id", "arc", "start"), ["tile_id", "arc"])
    rows = own.groupBy("tile_id", "arc").agg(F.first("start").alias("start"), F.collect_set("p").alias("ps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tile, arc, start, ps = batch.columns
            row = np.repeat(np.arange(len(ps)), ps.value_lengths().to_numpy(zero_copy_only=False))
            values, k = np.unique(ps.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            key = np.sort(row * len(values) + k)
            row, p = key // len(values), values[key % len(values)]

            def found(r: np.ndarray, x: np.ndarray) -> np.ndarray:
                """Place of pixel x of arc r, or -1."""
                i = np.minimum(np.searchsorted(values, x), len(values) - 1)
                j = np.minimum(np.searchsorted(key, r * len(values) + i), len(key) - 1)
                return np.where((p[j] == x) & (row[j] == r), j, -1)

            one, two = np.full(len(p), -1), np.full(len(p), -1)
            for i, j in AROUND:
                to = found(row, p + i * WIDE + j)
                two = np.where((one >= 0) & (to >= 0), to, two)
                one = np.where(one < 0, to, one)
            place = np.full(len(p), -1)
            at, before, n = found(np.arange(len(ps)), start.to_numpy(zero_copy_only=False)), np.full(len(ps), -1), 0
            while len(at):
                place[at] = n
                nxt = np.where((one[at] >= 0) & (one[at] != before), one[at], np.where(two[at] != before, two[at], -1))
                more = (nxt >= 0) & (place[nxt] < 0)
                at, before, n = nxt[more], at[more], n + 1
            order = np.lexsort((place, row))
            order = order[place[order] >= 0]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[order], minlength=len(ps)))])
            r, c = np.divmod(p[order], WIDE)
            px = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(r), pa.array(c)], names=["r", "c"]))
            yield pa.RecordBatch.from_arrays([tile, arc, px], names=["tile_id", "arc", "px"])

    kind = T.StructType([rows.schema["tile_id"], rows.schema["arc"], T.StructField("px", T._parse_datatype_string("array<struct<r:bigint,c:bigint>>"))])
    return rows.mapInArrow(run, kind)


def assemble(nodes: DataFrame, arcs: DataFrame, prune: float = 0.0) -> DataFrame:
    """graph_id, u, v, w, n_card, n_diag, arc: the shortest arc of every pair of nodes, ties by the first pixel; then edges
    shorter than prune go, and may leave nodes without edges."""
    w = F.col("n_card") + DIAGONAL * F.col("n_diag")
    first = F.row_number().over(Window.partitionBy("tile_id", "u", "v").orderBy("w", "arc"))
    one = arcs.withColumn("w", w).withColumn("place", first).filter("place = 1")
    return one.filter(F.col("w") >= prune).select(F.col("tile_id").alias("graph_id"), "u", "v", "w", "n_card", "n_diag", "arc")


def skeleton_graph(skel: DataFrame, prune: float = 0.0, paths: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of centre lines. Edges have w, w_q (w in millionths, for exact ties) and, if asked for, path."""
    skel = kept(skel.select(*K))
    cls = kept(classify(skel))
    clusters = kept(junction_clusters(cls))
    arcs, pixels = _started_arcs(cls, clusters)
    arcs = kept(arcs)
    nodes = kept(graph_nodes(cls, clusters, skel).union(ring_anchor(cls)))
    edges = assemble(nodes, arcs, prune).withColumn("w_q", F.round(F.col("w") * 1e6).cast("long"))
    if paths:
        own = arc_paths(arcs, pixels).withColumnRenamed("tile_id", "graph_id")
        places = sized(nodes)
        at = lambda k: places.select("graph_id", F.col("node_id").alias(k), F.struct(F.col("pos_r").alias("r"), F.col("pos_c").alias("c")).alias(f"at_{k}"))
        mid = F.coalesce("px", F.expr("cast(array() as array<struct<r:bigint,c:bigint>>)"))
        edges = edges.join(own, ["graph_id", "arc"], "left").join(at("u"), ["graph_id", "u"]).join(at("v"), ["graph_id", "v"]).withColumn("path", F.concat(F.array("at_u"), mid, F.array("at_v"))).drop("px", "at_u", "at_v")
    return nodes, kept(edges.withColumn("synthetic", F.lit(False)).withColumn("healing_cost", F.lit(None).cast("double")))
