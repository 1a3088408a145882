"""The six-node graph, worked out by hand in exact fractions, and properties of masks and bridges."""

import pytest
from pyspark.sql import functions as F

from roadgraph.operators import centrality as B
from roadgraph.operators import healing as L
from roadgraph.operators import impact as I
from roadgraph.operators import paths as P
from roadgraph.operators import skeleton as K


# fixed values: the six-node graph for which results are known
@pytest.fixture(scope="module")
def six(spark):
    nodes = [(0, 0, 0, "endpoint"), (1, 0, 100, "junction"), (2, 0, 200, "endpoint"), (3, 100, 50, "endpoint"), (4, 100, 150, "junction"), (5, 100, 250, "endpoint")]
    edges = [(0, 1, 100), (1, 2, 100), (0, 3, 112), (1, 3, 112), (1, 4, 112), (2, 4, 112), (3, 4, 100), (4, 5, 100)]
    n = spark.createDataFrame([(1, *x) for x in nodes], "graph_id long, node_id long, pos_r long, pos_c long, kind string")
    e = spark.createDataFrame([(1, *x) for x in edges], "graph_id long, u long, v long, w long")
    return n, e


def test_centrality(six):
    n, e = six
    paths = P.path_counts(n, e)
    bc = {r.node_id: r.betweenness for r in B.node_betweenness(paths).collect()}
    assert bc == pytest.approx({0: 0, 1: 0.25, 2: 0, 3: 0.1, 4: 0.45, 5: 0})
    crit = {(r.u, r.v): (r.betweenness, r.criticality) for r in B.edge_criticality(B.edge_betweenness(paths, e)).collect()}
    want = {(4, 5): 1 / 3, (3, 4): 7 / 30, (0, 1): 1 / 5, (1, 4): 1 / 5, (1, 2): 1 / 6, (2, 4): 1 / 6, (0, 3): 2 / 15, (1, 3): 1 / 10}
    assert {k: v[0] for k, v in crit.items()} == pytest.approx(want)
    assert crit[(3, 4)][1] == pytest.approx(0.7)
    top = B.gatekeepers(B.node_betweenness(paths), n, e).orderBy("rank").collect()
    assert [(r.node_id, r.degree) for r in top] == [(4, 4), (1, 4), (3, 3), (0, 2), (2, 2), (5, 1)]


def test_removal_curve(six):
    got = B.removal_curve(*six, n_steps=3).orderBy("step").collect()
    assert [r.removed_node for r in got] == [None, 4, 1, 0]
    assert [r.efficiency for r in got] == pytest.approx([34 / 45, 1 / 2, 1 / 6, 0])
    assert [r.resilience for r in got] == pytest.approx([1, 45 / 68, 15 / 68, 0])
    assert [(r.n_components, r.largest, r.isolated) for r in got] == [(1, 6, 0), (2, 4, 1), (3, 2, 2), (3, 1, 2)]
    assert [r.avg_path for r in got] == [pytest.approx(2408 / 15), pytest.approx(418 / 3), 112, None]


def test_blast(spark, six):
    n, e = six
    s = spark.createDataFrame([(7, 1, 50, 100, 60)], "scenario_id long, graph_id long, epi_r long, epi_c long, radius long")
    r = I.impact(n, e, s).first()
    assert (r.removed_nodes, r.removed_edges, r.n_components, r.isolated) == (1, 4, 1, 0)
    assert (r.e_pre, r.e_post, r.resilience, r.drop_pct, r.time_penalty_pct) == pytest.approx((34 / 45, 2 / 3, 15 / 17, 100 * 2 / 17, 40 / 3))
    b = I.bottlenecks(n, e, s).collect()
    assert [(x.u, x.v, x.betweenness) for x in b] == [(3, 4, pytest.approx(3 / 5))]


def test_empty_graph(spark, six):
    n, e = (x.limit(0) for x in six)
    assert P.efficiency(n, e).count() == 0
    assert B.node_betweenness(P.path_counts(n, e)).count() == 0


def test_fragmented_mask_is_joined(spark):
    px = {(r, c) for r in range(125, 131) for c in [*range(20, 110), *range(140, 236)]} | {(r, c) for r in [*range(20, 100), *range(130, 236)] for c in range(125, 131)} | {(r, c) for r in range(30, 90) for c in range(198, 203)}
    mask = spark.createDataFrame([(1, *x) for x in px], "tile_id long, r long, c long")
    tiles = spark.createDataFrame([(1, 256, 256)], "tile_id long, h int, w int")
    skel = K.thin(K.closing(mask, tiles))
    assert K.thin(skel).exceptAll(skel).count() == 0
    nodes, raw = K.skeleton_graph(skel, 5)
    healed = L.heal(nodes, raw, 60)
    before, after = (P.components(nodes, x).select("comp_id").distinct().count() for x in (raw, healed))
    new = healed.filter("synthetic")
    assert after == 1 and new.count() == before - after
    assert new.agg(F.max("w")).first()[0] <= 60
    ends = raw.filter("u <> v").select(F.col("path")[0]["r"].alias("a"), F.size("path").alias("k"), "n_card", "n_diag")
    assert ends.filter("k <> n_card + n_diag + 1 and k < n_card + n_diag").count() == 0
