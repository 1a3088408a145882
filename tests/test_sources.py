"""Readers and sinks on folders made here: what is written is read back."""

import json
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from roadgraph.operators import centrality as B
from roadgraph.operators import paths as P
from roadgraph.operators import tiles as T
from roadgraph.sources import catalog as S


def png(path, rows):
    """An 8-bit PNG of rows of pixels; a pixel is (grey,), (red, green, blue) or (red, green, blue, alpha)."""
    kind = {1: 0, 3: 2, 4: 6}[len(rows[0][0])]
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    raw = b"".join(b"\0" + bytes(v for px in row for v in px) for row in rows)
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, kind, 0, 0, 0)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_tiles_are_read_as_bands(spark, tmp_path):
    colour = [[(10 * r + c, 100 + r, 200 + c) for c in range(3)] for r in range(2)]
    grey = [[(r * 4 + c,) for c in range(4)] for r in range(3)]
    alpha = [[(1, 2, 3, 4)]]
    png(f"{tmp_path}/a/colour.png", colour)
    png(f"{tmp_path}/a/deep/grey.png", grey)
    png(f"{tmp_path}/alpha.png", alpha)
    with open(f"{tmp_path}/broken.png", "wb") as f:
        f.write(b"no image")
    got = {(r.tile_id, r.r, r.c, r.band): r.v for r in S.read_tiles(spark, str(tmp_path)).collect()}
    want = {("colour", r, c, b): colour[r][c][b] for r in range(2) for c in range(3) for b in range(3)}
    want |= {("grey", r, c, b): grey[r][c][0] for r in range(3) for c in range(4) for b in range(3)}
    want |= {("alpha", 0, 0, b): b + 1 for b in range(3)}
    assert got == want


def test_deep_rasters_enter_as_tables_and_are_stretched(spark):
    """Values beyond 8 bits, which image files can't give here, are stretched like any other table of pixels."""
    px = spark.createDataFrame([("t", 0, c, b, 1000 * c + b) for c in range(50) for b in range(3)], "tile_id string, r int, c int, band int, v int")
    v = [r.v for r in T.stretch_image(px).collect()]
    assert min(v) == 0 and max(v) == pytest.approx(255, abs=1)


def test_catalogue_lists_a_folder(spark, tmp_path):
    for name in ("x/SN3_roads_test_AOI_7_Harbour_PS-MS_img11.tif", "x/y/AOI_7_Harbour_img2.PNG", "z/note.txt"):
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        with open(f"{tmp_path}/{name}", "wb") as f:
            f.write(b"x")
    got = S.catalog(spark, str(tmp_path), (".TIF", ".png")).orderBy("image_id").collect()
    assert [(r.image_id, r.ext, os.path.basename(r.path)) for r in got] == [("aoi_7_harbour_img11", ".tif", "SN3_roads_test_AOI_7_Harbour_PS-MS_img11.tif"), ("aoi_7_harbour_img2", ".png", "AOI_7_Harbour_img2.PNG")]


def test_roads_are_read_from_files(spark, tmp_path):
    line = {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[1, 2], [3.5, 4]]}, "properties": {"road_type": "highway"}}
    parts = {"type": "Feature", "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[5, 5], [6, 6], [7, 7]]]}, "properties": {}}
    other = [{"type": "Feature", "geometry": g, "properties": {}} for g in ({"type": "Point", "coordinates": [9, 9]}, None, {"type": "LineString", "coordinates": []})]
    for name, text in (("a/one.geojson", json.dumps({"type": "FeatureCollection", "features": [other[0], line, parts, *other[1:]]}, indent=1)), ("none.geojson", json.dumps({"type": "FeatureCollection", "features": []})), ("empty.geojson", ""), ("bad.geojson", "{no json")):
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        with open(f"{tmp_path}/{name}", "w") as f:
            f.write(text)
    got = S.read_roads(spark, str(tmp_path)).orderBy("feature", "part", "place").collect()
    assert {os.path.basename(r.path) for r in got} == {"one.geojson"}
    assert [(r.feature, r.part, r.place, r.x, r.y) for r in got] == [(1, 0, 0, 1, 2), (1, 0, 1, 3.5, 4), (2, 0, 0, 0, 0), (2, 0, 1, 1, 1), (2, 1, 0, 5, 5), (2, 1, 1, 6, 6), (2, 1, 2, 7, 7)]
    assert got[0].properties == {"road_type": "highway"}
    # a file without lines gives a blank mask: no pixel, but its tile is still counted
    lines = S.read_roads(spark, str(tmp_path)).filter("path like '%none%'").select(F.lit("none").alias("tile_id"), F.lit(0).alias("line_id"), F.col("x").alias("c0"), F.col("y").alias("r0"), F.col("x").alias("c1"), F.col("y").alias("r1"))
    assert T.rasterize(lines, 4, 64).count() == 0


def test_report_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "a"), (2, 1 / 3, None), (3, None, 'x,"y"')], "tile_id long, iou double, note string")
    S.write_report(df, f"{tmp_path}/report")
    S.write_report(df, f"{tmp_path}/report")  # a second run replaces the first
    got = spark.read.option("header", True).csv(f"{tmp_path}/report").orderBy("tile_id").collect()
    assert [(r.tile_id, r.iou, r.note) for r in got] == [("1", "0.500000", "a"), ("2", "0.333333", None), ("3", None, 'x,"y"')]


def test_split_lists_round_trip(spark, tmp_path):
    rows = [(f"stem{i}", ("train", "val", "test")[i % 3]) for i in range(30)]
    S.write_splits(spark.createDataFrame(rows, "stem string, split string"), f"{tmp_path}/splits")
    for split in ("train", "val", "test"):
        assert sorted(r.value for r in spark.read.text(f"{tmp_path}/splits/split={split}").collect()) == sorted(s for s, k in rows if k == split)


def test_pixels_round_trip(spark, tmp_path):
    px = spark.range(2000).select((F.col("id") % 50).alias("tile_id"), (F.col("id") % 7).cast("int").alias("r"), F.col("id").cast("int").alias("c"), (F.col("id") / 3).alias("p"))
    S.write_pixels(px, f"{tmp_path}/px", buckets=8)
    back = spark.read.parquet(f"{tmp_path}/px")
    assert back.drop("bucket").exceptAll(px).isEmpty() and back.count() == 2000
    # all rows of a tile are in one folder
    assert back.groupBy("tile_id").agg(F.count_distinct("bucket").alias("n")).filter("n > 1").isEmpty() and back.select("bucket").distinct().count() <= 8


def test_estimates_from_some_sources(spark):
    """A ring of 40 nodes looks the same from each of them, so estimates from a few sources are exact; all sources give the whole."""
    n = spark.range(40).select(F.lit(1).cast("long").alias("graph_id"), F.col("id").alias("node_id"))
    e = spark.range(40).select(F.lit(1).cast("long").alias("graph_id"), F.col("id").alias("u"), ((F.col("id") + 1) % 40).alias("v"), F.lit(1).cast("long").alias("w"))
    whole, some = P.efficiency(n, e).first().efficiency, P.efficiency(n, e, sources=B.pivots(n, 5)).first().efficiency
    assert some == pytest.approx(whole) == pytest.approx((2 * sum(1 / k for k in range(1, 20)) + 1 / 20) / 39)
    exact = {r.node_id: r.betweenness for r in B.node_betweenness(P.path_counts(n, e)).collect()}
    few = [r.betweenness for r in B.node_betweenness(P.path_counts(n, e, B.pivots(n, 20)), k=20).collect()]
    assert sum(few) == pytest.approx(sum(exact.values()))
    assert max(abs(x - exact[0]) for x in few) < 0.35 * exact[0]


def test_cap(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(20)], "g int, x int")
    assert sorted(tuple(r) for r in B.cap(df, 2, ["x"], "g").collect()) == [(0, 0), (0, 3), (1, 1), (1, 4), (2, 2), (2, 5)]
    assert [r.x for r in B.cap(df, 3, ["x"]).collect()] == [0, 1, 2]
