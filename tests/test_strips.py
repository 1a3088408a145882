"""Closing, thinning and near masks on strips of bits, against plain Python; nearest nodes at any distance; the resumable sink."""

import random

import pytest
from pyspark.sql import functions as F
from test_chain import by_tile, thinned

from roadgraph.operators import impact, quality, skeleton
from roadgraph.sources import catalog as S

PX = "tile_id long, r int, c int"


def blobs(rnd, h, w, n):
    px = set()
    for _ in range(n):
        r, c, k, m = rnd.randrange(h), rnd.randrange(w), rnd.randrange(1, 25), rnd.randrange(1, 25)
        px |= {(i, j) for i in range(r, min(h, r + k)) for j in range(c, min(w, c + m))}
    return px


def closed(px, h, w, radius):
    n = int(radius)
    disk = [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1) if i * i + j * j <= radius * radius]
    on = lambda r, c: 0 <= r < h and 0 <= c < w
    wide = {(r + i, c + j) for r, c in px for i, j in disk if on(r + i, c + j)}
    return {(r, c) for r, c in wide if all((r + i, c + j) in wide or not on(r + i, c + j) for i, j in disk)}


def test_thinning_across_strips_and_blocks(spark):
    """Masks of several strips, and of more rows than one window sees."""
    rnd = random.Random(1)
    m = {1: blobs(rnd, 1100, 70, 60), 2: blobs(rnd, 30, 200, 15), 3: {(0, 0)}}
    df = spark.createDataFrame([(t, r, c) for t, px in m.items() for r, c in px] + [(2, *next(iter(m[2])))] + [(None, 1, 1), (1, None, 1)], PX)
    got = skeleton.thin(df)
    assert got.schema["r"].dataType == df.schema["r"].dataType
    assert by_tile(got.collect()) == {t: thinned(px) for t, px in m.items()}
    assert skeleton.thin(df.limit(0)).isEmpty()


@pytest.mark.parametrize("radius", [1, 2.5, 3, 21, 24])
def test_closing_at_borders(spark, radius):
    rnd = random.Random(2)
    size = {1: (40, 150), 2: (64, 64), 3: (5, 1)}
    m = {t: {(r, c) for r, c in ((rnd.randrange(h), rnd.randrange(w)) for _ in range(h * w // 25 + 1))} for t, (h, w) in size.items()}
    tiles = spark.createDataFrame([(t, h, w) for t, (h, w) in size.items()], "tile_id long, h int, w int")
    got = by_tile(skeleton.closing(spark.createDataFrame([(t, r, c) for t, px in m.items() for r, c in px], PX), tiles, radius).collect())
    assert got == {t: x for t, x in ((t, closed(px, *size[t], radius)) for t, px in m.items()) if x}


@pytest.mark.parametrize("b", [0, 1, 2.5, 4, 20])
def test_near_mask(spark, b):
    rnd = random.Random(3)
    p = [(t, rnd.randrange(-5, 60), rnd.randrange(-5, 60)) for t in (1, 2, 3) for _ in range(300)]
    q = [(t, rnd.randrange(60), rnd.randrange(60)) for t in (1, 2) for _ in range(20)]
    px = spark.createDataFrame([(*x, str(i)) for i, x in enumerate(p + p[:5])] + [(1, None, 3, "null")], PX + ", row string")
    got = quality.near_mask(px, spark.createDataFrame(q + [(None, 1, 1)], PX), b)
    assert got.columns == px.columns
    want = [(*x, str(i)) for i, x in enumerate(p + p[:5]) if any(x[0] == y[0] and (x[1] - y[1]) ** 2 + (x[2] - y[2]) ** 2 <= b * b for y in q)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert quality.near_mask(px, px.limit(0), b).isEmpty()


def test_nearest_node_at_any_distance(spark):
    """Far points, ties, points on a circle around a node, a graph without nodes, null places."""
    rnd = random.Random(4)
    nodes = [(g, i, rnd.randrange(-3000, 3000), rnd.randrange(-300, 300)) for g in (1, 2) for i in range(150)] + [(3, 1, 0, 5), (3, 2, 3, 4), (3, 3, 5, 0), (3, 4, -4, -3)]
    points = [(g, i, rnd.randrange(-90_000, 90_000), rnd.randrange(-500, 500)) for g in (1, 2, 4) for i in range(60)] + [(3, 0, 0, 0), (1, 98, None, 1), (1, 99, *nodes[7][2:])]
    n = spark.createDataFrame(nodes, "graph_id long, node_id long, pos_r long, pos_c long")
    p = spark.createDataFrame(points, "graph_id long, point_id long, r long, c long")

    def best(g, r, c):
        own = [((r - x) ** 2 + (c - y) ** 2, i) for h, i, x, y in nodes if h == g] if r is not None else []
        return min(own)[::-1] if own else (None, None)

    got = {(r.graph_id, r.point_id): (r.node_id, r.d2) for r in impact.nearest_node(p, n).collect()}
    assert got == {(g, i): best(g, r, c) for g, i, r, c in points}
    assert impact.nearest_node(p, n.limit(0)).filter("node_id is not null").isEmpty()


def test_many_nodes_and_points_at_one_place(spark):
    """Nodes that share a place meet a point once: their pairs with all points are not made. Repeated points stay; fine cells."""
    n = spark.range(1, 20_001).select(F.lit(1).cast("long").alias("graph_id"), F.col("id").alias("node_id"), (F.col("id") % 40).alias("pos_r"), (F.col("id") % 3).alias("pos_c"))
    p = spark.range(300).select(F.lit(1).cast("long").alias("graph_id"), (F.col("id") % 299).alias("point_id"), (F.col("id") % 299 % 50 - 3).alias("r"), (F.col("id") % 299 % 5).alias("c"))
    places = {}
    for i in range(1, 20_001):
        places.setdefault((i % 40, i % 3), i)
    best = lambda r, c: min(((r - x) ** 2 + (c - y) ** 2, i) for (x, y), i in places.items())
    got = [tuple(x) for x in impact.nearest_node(p, n).select("r", "c", "d2", "node_id").collect()]
    assert sorted(got) == sorted((k % 50 - 3, k % 5, *best(k % 50 - 3, k % 5)) for k in [*range(299), 0])
    ends = impact._nearest_cells(p.withColumnsRenamed({"r": "ar", "c": "ac"}), n.withColumnsRenamed({"pos_r": "br", "pos_c": "bc"}))
    assert ends.count() < 20_000  # 150 pairs of the nearest places, not 500 nodes for each


def test_tiles_are_added_and_replaced(spark):
    """Half of the tiles come again: they stay, or are replaced; the rest stays. Joins by tile need no exchange."""
    px = lambda lo, hi, v: spark.range(lo * 6, hi * 6).select(F.floor(F.col("id") / 6).alias("tile_id"), (F.col("id") % 6).cast("int").alias("r"), F.lit(v).alias("p"))
    count = lambda: {(r.p, r["count"]) for r in spark.table("px_tiles").groupBy("p").count().collect()}
    spark.sql("drop table if exists px_tiles")
    S.add_tiles(px(0, 40, 1), "px_tiles")
    S.add_tiles(px(20, 50, 2), "px_tiles")
    assert count() == {(1, 240), (2, 60)}
    S.add_tiles(px(30, 45, 3), "px_tiles", replace=True)
    assert count() == {(1, 180), (2, 30), (3, 90)}
    own, old = spark.table("px_tiles"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = own.groupBy("tile_id").agg(F.max("r").alias("most"))
        assert "Exchange" not in own.join(n, "tile_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("drop table px_tiles")
