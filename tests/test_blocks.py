"""Neighbours of pixels told block by block, against plain Python, on tiles of several blocks."""

import random

import pytest
from pyspark.sql import functions as F

from roadgraph.operators import blocks as B
from roadgraph.operators import skeleton as K

AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]


@pytest.fixture(scope="module")
def pixels():
    """A snake through four blocks, a ring around a corner of blocks, scattered pixels and one far left of the tile."""
    rng = random.Random(3)
    snake = {(r, c) for r in range(0, 130, 4) for c in range(130)} | {(r + k, 129 if r % 8 == 0 else 0) for r in range(0, 126, 4) for k in range(4)}
    ring = {(60 + i, 60) for i in range(9)} | {(60 + i, 68) for i in range(9)} | {(60, 60 + i) for i in range(9)} | {(68, 60 + i) for i in range(9)}
    some = {(rng.randrange(200), rng.randrange(200)) for _ in range(4000)}
    return {1: snake, 2: ring, 3: some | {(5, -1), (5, 0)}, **{t: {(0, t % 64), (1, t % 64)} for t in range(4, 1000)}}


def _blobs(px):
    out, left = {}, set(px)
    while left:
        todo = [min(left)]
        left.discard(todo[0])
        own = list(todo)
        while todo:
            r, c = todo.pop()
            for i, j in AROUND:
                if (r + i, c + j) in left:
                    left.discard((r + i, c + j))
                    todo.append((r + i, c + j))
                    own.append((r + i, c + j))
        name = min(r * 2**20 + c for r, c in own)
        out |= {p: name for p in own}
    return out


def test_counts_components_and_pairs_across_blocks(spark, pixels):
    rows = [(t, r, c) for t, px in pixels.items() for r, c in px]
    df = spark.createDataFrame(rows + rows[:50] + [(None, 1, 1), (1, None, 1)], "tile_id long, r long, c long").coalesce(1)
    nb = {(r.tile_id, r.r, r.c): r.nb for r in B.neighbour_counts(df).collect()}
    assert nb == {(t, r, c): sum((r + i, c + j) in pixels[t] for i, j in AROUND) for t, r, c in rows}
    got = {(r.tile_id, r.r, r.c): r.blob for r in B.labelled(df).collect()}
    assert got == {(t, *p): name for t, px in pixels.items() for p, name in _blobs(px).items()}
    pairs = B.touching(df, F.col("c"), F.when(F.col("c") % 2 == 0, F.col("r"))).collect()
    code = lambda r, c: r * 2**20 + c
    even = lambda r, c: r if c % 2 == 0 else None
    want = {(t, code(r, c), code(r + i, c + j), i * j != 0, c, even(r, c), c + j, even(r + i, c + j)) for t, r, c in rows for i, j in AROUND if (r + i, c + j) in pixels[t]}
    assert len(pairs) == len(want) and {tuple(r) for r in pairs} == want


def test_pixels_are_not_joined_with_eight_offsets(spark, pixels):
    df = spark.createDataFrame([(1, r, c) for r, c in pixels[1]], "tile_id long, r long, c long")
    plan = K.classify(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_arcs_are_walked_from_their_start(spark, pixels):
    order = [(r, c) for k, r in enumerate(range(0, 20, 2)) for c in (range(100) if k % 2 == 0 else range(99, -1, -1))]
    for k, r in enumerate(range(0, 18, 2)):  # steps between the rows
        order.insert(order.index((r, 99 if k % 2 == 0 else 0)) + 1, (r + 1, 100 if k % 2 == 0 else -1))
    order = [(r, c + 1) for r, c in order]
    px = spark.createDataFrame([(t, 7, r, c) for t in (1, 2) for r, c in order] + [(1, 8, 40, 1)], "tile_id long, arc long, r long, c long")
    arcs = spark.createDataFrame([(1, 7, order[0][0] * 2**20 + order[0][1]), (2, 7, order[-1][0] * 2**20 + order[-1][1]), (1, 8, 40 * 2**20 + 1)], "tile_id long, arc long, start long")
    got = {(r.tile_id, r.arc): [tuple(p) for p in r.px] for r in K.arc_paths(arcs, px).collect()}
    assert got == {(1, 7): order, (2, 7): order[::-1], (1, 8): [(40, 1)]}
