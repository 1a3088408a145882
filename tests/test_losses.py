"""Scenarios of small graphs from one row each, against the rounds that large graphs take."""

import random

from roadgraph.operators import dense, impact


def test_small_graphs_lose_in_one_row_what_they_lose_in_rounds(spark, monkeypatch):
    """Repeated edges, self-loops, ends that are no nodes, graphs of one node or without edges, scenarios that hit all or nothing."""
    rng = random.Random(3)
    nodes = [(g, x, 5 * (x // 4), 5 * (x % 4)) for g in range(6) for x in range(1 if g == 4 else 14)]
    edges = [(g, rng.randrange(14), rng.randrange(16), rng.randrange(1, 9)) for g in range(4) for _ in range(26)] + [(4, 0, 0, 1), (0, 1, 2, 1), (0, 2, 1, 1), (1, 3, 3, 1)]
    scen = [(g * 10 + s, g, rng.randrange(16), rng.randrange(16), r) for g in range(7) for s, r in enumerate((0, -1, 3, 6, 99))]
    nodes = spark.createDataFrame(nodes, "graph_id long, node_id long, pos_r long, pos_c long")
    edges = spark.createDataFrame(edges, "graph_id long, u long, v long, w long")
    scen = spark.createDataFrame(scen, "scenario_id long, graph_id long, epi_r long, epi_c long, radius long")
    told = lambda: sorted(map(tuple, impact.impact(nodes, edges, scen).collect()))
    with monkeypatch.context() as m:
        m.setattr(impact, "survivors", None)  # no graph is copied for a scenario
        got = told()
        m.setattr(dense, "SCENARIOS", 2)
        assert told() == got
    monkeypatch.setattr(dense, "NODES", 12)  # now only the graph of one node is small
    assert told() == got and len(got) == 30 and len({r[:4] for r in got}) == 30
