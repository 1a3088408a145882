"""The blur of sparse tiles against plain Python, and what its tasks hold."""

import math
import random
import re

import pytest

from roadgraph.operators import quality, tiles


@pytest.mark.parametrize("most", [5, 250_000])
def test_blur_of_sparse_tiles(spark, monkeypatch, most):
    """Whatever the parts; pixels that are sent to their neighbours are summed in their task."""
    monkeypatch.setattr(tiles, "PIXELS", most)
    rng = random.Random(4)
    px = {(t, r, c): float(rng.randrange(256)) for t in (1, 2) for r in range(12) for c in range(20) if rng.random() < 0.5}
    df = spark.createDataFrame([(*k, v) for k, v in px.items()], "tile_id long, r int, c int, v double")
    blurred = tiles.blur(df, 2)
    plan = blurred._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and not re.search(r"Exchange hashpartitioning[^\n]*\n[^\n]*partial_sum", plan)
    parts = [int(x) for x in re.findall(r"Exchange hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert len(parts) == 2 and min(parts) >= len(px) / most
    got = {(x.tile_id, x.r, x.c): x.blur for x in blurred.collect()}
    near = lambda k: [(v, math.exp(-((r - k[1]) ** 2 + (c - k[2]) ** 2) / 8)) for (t, r, c), v in px.items() if t == k[0] and max(abs(r - k[1]), abs(c - k[2])) <= 6]
    assert got == {k: pytest.approx(sum(v * w for v, w in near(k)) / sum(w for _, w in near(k))) for k in px}


def test_soft_centre_lines_in_small_parts(spark, monkeypatch):
    """Parts hold about PIXELS pixels whatever the size, and windows share their sorts: no two sorts for each erosion."""
    px = spark.range(40 * 64).selectExpr("id div 64 AS tile_id", "int(id % 64 div 8) AS r", "int(id % 8) AS c", "id * 37 % 101 / 101D AS v")
    monkeypatch.setattr(quality, "PIXELS", 256)
    skel = quality._soft_skeleton(px, 3)
    assert skel.rdd.getNumPartitions() == 10
    plan = skel._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Sort [") <= 14
