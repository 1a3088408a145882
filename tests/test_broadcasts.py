"""Tables that grow with the input are not sent whole to every executor, however small their files are."""

import pytest

from roadgraph.operators import healing as L
from roadgraph.operators import skeleton as K
from roadgraph.plans import loops


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def graphs(spark, monkeypatch):
    """Nodes 3 apart, each a component of its own, stored, in more graphs than may be sent whole; and no edges."""
    monkeypatch.setattr(loops, "WHOLE", 20)
    nodes = loops.kept(spark.range(90).selectExpr("id div 3 as graph_id", "id % 3 as node_id", "id % 3 * 3 as pos_r", "0L as pos_c"))
    return nodes, loops.kept(nodes.selectExpr("graph_id", "node_id", "node_id as comp_id"))


def test_components_meet_nodes_by_sorting(graphs):
    found = L.gap_candidates(*graphs, 4)
    assert "BroadcastHashJoin" not in plan(found)
    assert {(r.graph_id, r.a, r.b) for r in found.collect()} == {(g, a, a + 1) for g in range(30) for a in (0, 1)}


def test_sized_goes_by_rows(spark, monkeypatch):
    monkeypatch.setattr(loops, "WHOLE", 20)
    one, many = (loops.kept(spark.range(k).selectExpr("id", "0L as x")) for k in (20, 21))
    joins = {(a, b): plan(loops.sized(x).join(loops.sized(y), "id")) for a, x in (("one", one), ("many", many)) for b, y in (("one", one), ("many", many.withColumnRenamed("x", "y")))}
    assert all(("BroadcastHashJoin" in p) == ("one" in k) and ("SortMergeJoin" in p) == ("one" not in k) for k, p in joins.items())


def test_paths_are_made_of_edges_at_gaps_only(spark):
    edges = spark.createDataFrame([(1, k, k + 1, k + 1) for k in range(9)], "graph_id long, u long, v long, w long")
    of = spark.createDataFrame([(1, 3), (1, 9), (2, 5)], "graph_id long, node_id long")
    given = []

    def paths(some):
        given.append(sorted((r.u, r.v) for r in some.collect()))
        return some.selectExpr("*", "transform(sequence(0L, 30L), t -> named_struct('r', t * u, 'c', t * 2)) AS path")

    got = sorted(map(tuple, L.tangents(None, edges, of=of, paths=paths).collect()))
    assert got == sorted(tuple(r) for r in L.tangents(None, paths(edges)).collect() if r.node_id in (3, 9))
    assert given[0] == [(2, 3), (3, 4), (8, 9)]


def test_forests_meet_components_by_sorting(spark, graphs, monkeypatch):
    plans, keep = [], loops.kept
    monkeypatch.setattr(L, "kept", lambda df: plans.append(plan(df)) or keep(df))
    cand = loops.kept(graphs[1].filter("node_id < 2").selectExpr("graph_id", "node_id as a", "node_id + 1 as b", "1.5D as cost"))
    found = L.spanning_forest(graphs[1], cand)
    sent = [x for p in [*plans, plan(found)] for x in p.splitlines() if "BroadcastHashJoin" in x and ("Inner" in x or "node_id" in x)]
    assert found.count() == 60 and not sent


def test_clusters_meet_pixels_in_cells(spark):
    skel = loops.kept(spark.createDataFrame([(1, 20 + t, 20) for t in range(-5, 6)] + [(1, 20, 20 + t) for t in range(-5, 6) if t], "tile_id long, r long, c long"))
    found = K.representatives(loops.kept(K.junction_clusters(K.classify(skel))), skel)
    assert "BroadcastHashJoin" not in plan(found) and [r[2:] for r in found.collect()] == [(20, 20)]
