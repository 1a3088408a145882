"""Sketches, two-hop labels and rerouted sources against plain searches; sums and ties that don't depend on partitioning."""

import heapq
import random
from collections import defaultdict, deque

import pytest
from conftest import DATA
from test_queries import duck, rows  # noqa: F401

from roadgraph.fixtures import fixture
from roadgraph.operators import centrality, impact, labels, paths, sketches
from roadgraph.queries import ORACLE_SQL, QUERIES

NODES = "graph_id long, node_id long, pos_r long, pos_c long, kind string"


def neighbours(edges):
    out = defaultdict(lambda: defaultdict(dict))
    for r in edges:
        if r.u != r.v:
            for a, b in ((r.u, r.v), (r.v, r.u)):
                out[r.graph_id][a][b] = min(r.w, out[r.graph_id][a].get(b, r.w))
    return out


def hops_from(near, s):
    found, todo = {s: 0}, deque([s])
    while todo:
        x = todo.popleft()
        for y in near[x]:
            if y not in found:
                found[y] = found[x] + 1
                todo.append(y)
    return found


def dist_from(near, s):
    found, todo = {}, [(0, s)]
    while todo:
        d, x = heapq.heappop(todo)
        if x not in found:
            found[x] = d
            for y, w in near[x].items():
                heapq.heappush(todo, (d + w, y))
    return found


def test_sketches_of_an_irregular_graph(spark):
    """Hop counts within 6 %, efficiency within 3 % of the exact ones, on the large graph of the smallest tables."""
    n, e = fixture(spark, DATA, "fx_big_nodes"), fixture(spark, DATA, "fx_big_edges")
    near, ids = neighbours(e.collect())[0], [r.node_id for r in n.collect()]
    exact, total = defaultdict(int), 0.0
    for s in ids:
        for t, d in hops_from(near, s).items():
            if t != s:
                exact[d] += 1
                total += 1 / d
    own, pairs = sketches.sketched_hops(n, e)
    got = {r.hops: r.pairs for r in pairs.collect()}
    assert sum(r.reached for r in own.collect()) == pytest.approx(sum(exact.values()) + len(ids), rel=0.03)
    for d, k in exact.items():
        assert abs(got.get(d, 0) - k) <= 0.06 * sum(exact.values()) / 4 + 0.06 * k
    found = sketches.estimated_efficiency(n, e).first()
    assert found.n == len(ids) and found.efficiency == pytest.approx(total / (len(ids) * (len(ids) - 1)), rel=0.03)


def test_sketches_of_small_and_odd_graphs(spark):
    nodes = spark.createDataFrame([(g, i, 0, 0, "x") for g, k in ((1, 5), (2, 1), (3, 4)) for i in range(k)], NODES)
    edges = spark.createDataFrame([(1, 0, 1, 1), (1, 1, 2, 1), (1, 1, 2, 7), (1, 2, 2, 1), (1, 2, 3, 1), (1, 3, 99, 1), (3, 0, 1, 1)], "graph_id long, u long, v long, w long")
    exact = {r.graph_id: r.efficiency for r in paths.efficiency(nodes, edges.filter("v <> 99")).collect()}
    assert {r.graph_id: pytest.approx(r.efficiency) for r in sketches.estimated_efficiency(nodes, edges).collect()} == exact
    assert sketches.estimated_efficiency(nodes.limit(0), edges).count() == 0


def test_labels_answer_every_pair(spark, monkeypatch):
    """All pairs of random graphs, several batches, unlike weights; and the labels are far fewer than pairs on a long road."""
    monkeypatch.setattr(labels, "MERGED", 2)
    rng = random.Random(2)
    nodes = spark.createDataFrame([(g, i, 0, 0, "x") for g in range(3) for i in range(40)] + [(9, i, 0, 0, "x") for i in range(200)], NODES)
    edges = [(g, rng.randrange(40), rng.randrange(40), rng.randrange(1, 9)) for g in range(3) for _ in range(50)] + [(9, i, i // 3, 1 + i % 5) for i in range(1, 200)]
    edges = spark.createDataFrame(edges, "graph_id long, u long, v long, w long")
    near = neighbours(edges.collect())
    found = labels.hub_labels(nodes, edges)
    pairs = nodes.selectExpr("graph_id", "node_id as a").join(nodes.selectExpr("graph_id", "node_id as b"), "graph_id").filter("graph_id < 9 or a % 20 = 3")
    for r in labels.labelled_pair_paths(found, pairs).collect():
        near[r.graph_id].setdefault(r.a, {})
    known = {}
    for r in labels.labelled_pair_paths(found, pairs).collect():
        if (r.graph_id, r.a) not in known:
            known[r.graph_id, r.a] = dist_from(near[r.graph_id], r.a)
        assert r.dist == known[r.graph_id, r.a].get(r.b), r
    assert found.filter("graph_id = 9").count() < 200 * 200 / 4


def test_rerouted_sources_are_those_that_lose_a_path(spark):
    n, e, s = (fixture(spark, DATA, x) for x in ("fx_nodes", "fx_edges", "fx_scen"))
    hops = paths.hop_distances(n, e)
    hits = impact.blast_hits(n, s)
    got = {(r.scenario_id, r.src) for r in impact.rerouted(e, hops, hits).collect()}
    near, ids, want, alive = neighbours(e.collect()), defaultdict(list), set(), 0
    for r in n.collect():
        ids[r.graph_id].append(r.node_id)
    gone = defaultdict(set)
    for r in hits.collect():
        gone[r.scenario_id].add(r.node_id)
    for r in s.collect():
        out = gone[r.scenario_id]
        left = {x: {y: 1 for y in near[r.graph_id][x] if y not in out} for x in ids[r.graph_id] if x not in out}
        for x in left:
            alive += 1
            before = {t: d for t, d in hops_from(near[r.graph_id], x).items() if t not in out}
            if hops_from(left, x) != before:
                want.add((r.scenario_id, x))
    assert got == want and 0 < len(want) < alive


def test_clipped_segments_give_all_pixels_on_the_tile(spark):
    """Also segments along a border, of no length, and beside the tile."""
    from roadgraph.queries import _with_paths

    n, e = fixture(spark, DATA, "fx_nodes"), fixture(spark, DATA, "fx_edges")
    odd = [(99, 0, 0, 0), (99, 1, 0, 63), (99, 2, 64, -1), (99, 3, 64, 200), (99, 4, -5, -5), (99, 5, 70, 70), (99, 6, 0, 0), (99, 7, -1, 64), (99, 8, 63, 1)]
    n = n.select("graph_id", "node_id", "pos_r", "pos_c").union(spark.createDataFrame(odd, "graph_id long, node_id long, pos_r long, pos_c long"))
    e = e.union(spark.createDataFrame([(99, a, b, 1) for a in range(9) for b in range(a + 1, 9)], "graph_id long, u long, v long, w long"))
    tiles = n.selectExpr("graph_id as tile_id", "64 as h", "65 as w").distinct()
    want = sorted(map(tuple, impact.edge_pixels(_with_paths(n, e), tiles).collect()))
    assert sorted(map(tuple, impact.straight_pixels(n, e, tiles).collect())) == want and len(want) > 500


def test_ties_don_t_depend_on_partitioning(spark):
    """One value summed in many orders: the answers are equal, and ties go by name."""
    n, e, s = (fixture(spark, DATA, x) for x in ("fx_nodes", "fx_edges", "fx_scen"))
    found = []
    for parts in (3, 8):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append((sorted((r.scenario_id, r.u, r.v) for r in impact.bottlenecks(n.repartition(parts), e.repartition(parts), s).collect()), sorted(map(tuple, paths.efficiency(n, e.repartition(parts)).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1]
    df = spark.createDataFrame([(1, 0.1 + 0.2, "b"), (1, 0.3, "a"), (1, 0.1, "c")], "g int, x double, name string")
    assert [r.name for r in centrality.top_fraction(df, "g", "x", 0.3, "name", digits=9).collect()] == ["a"]


@pytest.mark.parametrize("name", ["H5_avg_path", "H10_snapshot", "H13_bottlenecks", "H14_point_failure", "H16_network_stats", "H17_pair_labels"])
def test_graph_queries_match_sql(spark, duck, name):  # noqa: F811
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(ORACLE_SQL[name]).df())
