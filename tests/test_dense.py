"""Small graphs answered from one row each against the joins that large graphs take."""

import random

import pytest

from roadgraph.operators import centrality as B
from roadgraph.operators import dense
from roadgraph.operators import impact as I
from roadgraph.operators import labels as L
from roadgraph.operators import paths as P


def tables(spark, sizes, seed=5):
    rnd = random.Random(seed)
    nodes, edges = [], []
    for g, n in enumerate(sizes):
        nodes += [(g, 3 * k - 5, k, k) for k in range(n)]
        edges += [(g, 3 * rnd.randrange(n) - 5, 3 * rnd.randrange(n) - 5, rnd.randint(1, 4)) for _ in range(int(n * 1.3))]
    e = spark.createDataFrame(edges, "graph_id long, u long, v long, w long")
    return spark.createDataFrame(nodes, "graph_id long, node_id long, pos_r long, pos_c long"), e


def rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_answers_equal_the_joins(spark, monkeypatch):
    """Graphs of 12 nodes by joins, beside small ones, then all of them as small ones."""
    n, e = tables(spark, [1, 2, 7, 12, 12, 3])
    odd = spark.createDataFrame([(0, -5, 99, 2), (2, 99, 98, 1)], "graph_id long, u long, v long, w long")  # ends that are no nodes
    some = spark.createDataFrame([(2, -5), (2, 1), (3, 4), (4, 4), (4, 777)], "graph_id long, src long")
    pairs = spark.createDataFrame([(2, -5, 1), (2, 1, -2), (3, 4, 10), (4, 4, 4), (4, 777, 1), (9, 1, 1)], "graph_id long, a long, b long")

    def answers():
        paths = P.path_counts(n, e)
        few = P.path_counts(n, e, some)
        return [rows(x) for x in (
            P.hop_distances(n, e.union(odd)), P.hop_distances(n, e, some), P.pair_paths(n, e, pairs), paths.dist, paths.dag, B.node_betweenness(paths),
            B.edge_betweenness(paths, e), B.node_betweenness(few), B.snapshot(n, e),
        )]

    got = answers()
    monkeypatch.setattr(dense, "NODES", 9)
    for k, (a, b) in enumerate(zip(got, answers())):
        assert a == b and a, k


def test_impact_of_small_and_large_graphs(spark, monkeypatch):
    n, e = tables(spark, [5, 12, 12], 8)
    scen = spark.createDataFrame([(10, 0, 1, 1, 2), (11, 1, 3, 3, 3), (12, 1, 8, 8, 2), (13, 2, 0, 0, 50), (14, 2, 6, 6, 1)], "scenario_id long, graph_id long, epi_r long, epi_c long, radius long")
    monkeypatch.setattr(dense, "NODES", 9)
    mixed = rows(I.impact(n, e, scen))
    monkeypatch.setattr(dense, "NODES", 64)
    small = rows(I.impact(n, e, scen))
    assert mixed == small and len(small) == 5


def test_ids_that_are_no_numbers(spark):
    n = spark.createDataFrame([(0, "a"), (0, "b"), (0, "c")], "graph_id long, node_id string")
    e = spark.createDataFrame([(0, "a", "b", 3)], "graph_id long, u string, v string, w long")
    assert rows(P.hop_distances(n, e).filter("src <> dst")) == [(0, "a", "b", 1), (0, "b", "a", 1)]


@pytest.mark.parametrize("ask", [lambda n, e: P.hop_distances(n, e), lambda n, e: P.distances(n, e), lambda n, e: P.efficiency(n, e), lambda n, e: B.node_betweenness(P.path_counts(n, e))])
def test_pairs_of_small_graphs_are_not_stored(spark, monkeypatch, ask):
    """Paths of 40 nodes: what is written is about as large as the graphs, not as their pairs."""
    n = spark.range(20 * 40).selectExpr("id div 40 AS graph_id", "id % 40 AS node_id")
    e = n.filter("node_id > 0").selectExpr("graph_id", "node_id - 1 AS u", "node_id AS v", "1L AS w")
    written = []
    for module in (P, dense, B):
        monkeypatch.setattr(module, "kept", lambda df, own=module.kept: written.append(own(df)) or written[-1])
    assert ask(n, e).count() > 0
    assert sum(df.count() for df in written) < 4 * 20 * 40


def test_labels_of_small_graphs(spark, monkeypatch):
    """Labels tell every distance, are pruned, and take no rounds of joins."""
    n, e = tables(spark, [1, 2, 7, 12, 30])
    rounds = []
    monkeypatch.setattr(L, "kept", lambda df: rounds.append(df) or df)
    labels = L.hub_labels(n, e)
    assert not rounds
    pairs = n.selectExpr("graph_id", "node_id AS a").join(n.selectExpr("graph_id", "node_id AS b"), "graph_id")
    assert rows(L.labelled_pair_paths(labels, pairs).filter("dist is not null")) == rows(P.distances(n, e))
    assert labels.count() < P.distances(n, e).count() / 2


def test_removal_curves_equal_the_joins(spark, monkeypatch):
    """Small graphs go through all steps in one row, without a stored table a step."""
    n, e = tables(spark, [1, 2, 3, 9])
    rounds = []
    monkeypatch.setattr(B, "kept", lambda df, own=B.kept: rounds.append(df) or own(df))
    key = lambda df: sorted(rows(df.na.fill(-1).na.fill(-1.0)))
    small = key(B.removal_curve(n, e, 0.2))
    assert not rounds
    monkeypatch.setattr(dense, "NODES", 2)
    assert small == key(B.removal_curve(n, e, 0.2)) and rounds
