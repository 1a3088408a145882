"""Masks to graphs, bridges and removal curves against plain Python on the derived inputs of the smallest tables."""

import math
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from conftest import DATA

from roadgraph.fixtures import fixture
from roadgraph.queries import QUERIES

AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
SIDE = 64
WIDE = 2**20


def by_tile(rows):
    out = defaultdict(set)
    for r in rows:
        out[r[0]].add((r[1], r[2]))
    return out


def closed(px):
    disk = [(i, j) for i in range(-3, 4) for j in range(-3, 4) if i * i + j * j <= 9]
    on = lambda r, c: 0 <= r < SIDE and 0 <= c < SIDE
    wide = {(r + i, c + j) for r, c in px for i, j in disk if on(r + i, c + j)}
    return {(r, c) for r, c in wide if all((r + i, c + j) in wide or not on(r + i, c + j) for i, j in disk)}


def thinned(px):
    px, ring = set(px), [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    changed = True
    while changed:
        changed = False
        for first in (True, False):
            gone = set()
            for r, c in px:
                p = [(r + i, c + j) in px for i, j in ring]
                rises = sum(not p[k] and p[(k + 1) % 8] for k in range(8))
                n, e, s, w = p[0], p[2], p[4], p[6]
                if 2 <= sum(p) <= 6 and rises == 1 and (not (n and e and s) and not (e and s and w) if first else not (n and e and w) and not (n and s and w)):
                    gone.add((r, c))
            px -= gone
            changed = changed or bool(gone)
    return px


def near(p, px):
    return [(p[0] + i, p[1] + j) for i, j in AROUND if (p[0] + i, p[1] + j) in px]


def code(p):
    return p[0] * WIDE + p[1]


def floods(px):
    left, out = set(px), []
    while left:
        todo, own = [left.pop()], set()
        while todo:
            p = todo.pop()
            own.add(p)
            for q in near(p, left):
                left.discard(q)
                todo.append(q)
        out.append(own)
    return out


def half_even(values):
    return round(Fraction(sum(values), len(values)))


class Traced:
    """Nodes and arcs of one skeleton, by walking it pixel by pixel."""

    def __init__(self, skel):
        n = {p: len(near(p, skel)) for p in skel}
        self.node, self.at = {}, {}
        for blob in floods({p for p in skel if n[p] > 2}):
            name = min(map(code, blob))
            mid = half_even([r for r, _ in blob]), half_even([c for _, c in blob])
            self.at[name] = min((p for p in skel if abs(p[0] - mid[0]) <= 3 and abs(p[1] - mid[1]) <= 3), key=lambda p: ((p[0] - mid[0]) ** 2 + (p[1] - mid[1]) ** 2, p))
            self.node.update(dict.fromkeys(blob, name))
        for p in skel:
            if n[p] == 1:
                self.node[p], self.at[code(p)] = code(p), p
        chain = {p for p in skel if n[p] == 2}
        self.arcs = []  # (arc, u, v, straight steps, diagonal steps, pixels between)
        seen = set()
        for p in sorted(self.node):
            for q in near(p, chain):
                walk, last = [p, q], p
                while walk[-1] not in self.node:
                    here = walk[-1]
                    ahead = [x for x in near(here, skel) if x != last]
                    last = here
                    walk.append(ahead[0])
                inner = walk[1:-1]
                if min(inner) in seen:
                    continue
                seen |= set(inner)
                self.add(min(map(code, inner)), walk, inner)
        for ring in floods(chain - seen):
            if not any(near(p, set(self.node)) for p in ring):
                start = min(ring)
                walk = [start, min(near(start, ring))]
                while walk[-1] != start:
                    walk.append(next(x for x in near(walk[-1], ring) if x != walk[-2]))
                self.node[start], self.at[code(start)] = code(start), start
                self.add(code(start), walk, sorted(ring))
        touching = defaultdict(list)
        for p, u in self.node.items():
            for q in near(p, set(self.node)):
                v = self.node[q]
                if u < v:
                    touching[u, v].append((p[0] != q[0] and p[1] != q[1], code(p)))
        for (u, v), steps in touching.items():
            diagonal, p = min(steps)
            self.arcs.append((-p - 1, u, v, int(not diagonal), int(diagonal), []))

    def add(self, name, walk, inner):
        diagonal = sum(a[0] != b[0] and a[1] != b[1] for a, b in zip(walk, walk[1:]))
        u, v = self.node[walk[0]], self.node[walk[-1]]
        if u > v:
            u, v, inner = v, u, inner[::-1]
        self.arcs.append((name, u, v, len(walk) - 1 - diagonal, diagonal, inner))

    def edges(self, prune):
        """(u, v) -> (w, path) of the shortest arcs that are long enough."""
        best = {}
        for name, u, v, card, diag, inner in self.arcs:
            best[u, v] = min(best.get((u, v), (math.inf,)), (card + math.sqrt(2) * diag, name, inner))
        return {k: (w, [self.at[k[0]], *inner, self.at[k[1]]]) for k, (w, _, inner) in best.items() if w >= prune}


def directions(at, edges):
    """Unit vectors of the first ten steps along every node's longest edge."""
    best = {}
    for (u, v), (w, path) in edges.items():
        if u != v and len(path) >= 2:
            for a, b, way in ((u, v, path), (v, u, path[::-1])):
                best[a] = min(best.get(a, (0, 0, None)), (-w, b, way))
    out = {}
    for a, (_, _, way) in best.items():
        far = way[min(10, len(way) - 1)]
        d = far[0] - way[0][0], far[1] - way[0][1]
        n = math.hypot(*d)
        if n > 1e-8:
            out[a] = d[0] / n, d[1] / n
    return out


def bridges(at, edges, most):
    """Candidates (cost, a, b, dist), and those that Kruskal's algorithm takes."""
    label = {a: a for a in at}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for u, v in edges:
        u, v = find(u), find(v)
        label[max(u, v)] = min(u, v)
    way, cands = directions(at, edges), []
    for a in at:
        for b in at:
            d = math.dist(at[a], at[b])
            if a < b and 1e-8 <= d <= most and find(a) != find(b):
                line = (at[b][0] - at[a][0]) / d, (at[b][1] - at[a][1]) / d
                turn = sum(math.acos(min(1, abs(way[x][0] * line[0] + way[x][1] * line[1]))) for x in (a, b) if x in way)
                cands.append((d + 2 * turn, a, b, d))
    taken = []
    for cost, a, b, d in sorted(cands):
        u, v = find(a), find(b)
        if u != v:
            label[max(u, v)] = min(u, v)
            taken.append((cost, a, b, d))
    return cands, taken, len({find(a) for a in at})


def answers(spark, name):
    return QUERIES[name](spark, DATA).collect()


@pytest.fixture(scope="module")
def skels(spark):
    return by_tile(fixture(spark, DATA, "fx_skel").select("tile_id", "r", "c").collect())


@pytest.fixture(scope="module")
def graphs(spark):
    """graph_id -> positions, and edges with straight paths."""
    at, edges = defaultdict(dict), defaultdict(dict)
    for r in fixture(spark, DATA, "fx_nodes").collect():
        at[r.graph_id][r.node_id] = r.pos_r, r.pos_c
    for r in fixture(spark, DATA, "fx_edges").collect():
        a, b = at[r.graph_id][r.u], at[r.graph_id][r.v]
        n = max(2, math.ceil(math.dist(a, b)))
        edges[r.graph_id][r.u, r.v] = r.w, [tuple(round(Fraction(x + Fraction((y - x) * t, n - 1))) for x, y in zip(a, b)) for t in range(n)]
    return at, edges


def test_thinning(spark, skels):
    assert by_tile(answers(spark, "G2_thinning")) == {t: thinned(closed(px)) for t, px in skels.items()}


def test_arcs_and_edges(spark, skels):
    traced = {t: Traced(px) for t, px in skels.items()}
    want = Counter((t, u, v, card, diag) for t, x in traced.items() for _, u, v, card, diag, _ in x.arcs)
    assert Counter((r.tile_id, r.u, r.v, r.n_card, r.n_diag) for r in answers(spark, "G6_trace_arcs")) == want
    got = {(r.graph_id, r.u, r.v): r.w for r in answers(spark, "G7_assemble")}
    assert got == pytest.approx({(t, *k): w for t, x in traced.items() for k, (w, _) in x.edges(3).items()}, abs=1e-5)


def test_tangents_costs_and_bridges(spark, graphs):
    at, edges = graphs
    got = {(r.graph_id, r.node_id): (r.r, r.c) for r in answers(spark, "G9_tangents")}
    want = {(g, a): d for g in at for a, d in directions(at[g], edges[g]).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    found = {g: bridges(at[g], edges[g], 50) for g in at}
    got = {(r.graph_id, r.a, r.b): (r.dist, r.cost) for r in answers(spark, "G10_bridge_costs")}
    want = {(g, a, b): (d, cost) for g, (cands, _, _) in found.items() for cost, a, b, d in cands}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    got = {(r.graph_id, r.u, r.v): (r.w, r.healing_cost) for r in answers(spark, "G11_heal")}
    want = {(g, a, b): (d, cost) for g, (_, taken, _) in found.items() for cost, a, b, d in taken}
    assert want and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    got = {r.graph_id: (r.n_healed_edges, r.n_components_post_heal) for r in answers(spark, "G12_heal_stats")}
    assert got == {g: (len(taken), n) for g, (_, taken, n) in found.items()}


def test_mask_to_graph(spark):
    from roadgraph.operators.tiles import rasterize
    from roadgraph.queries import _segments

    masks = by_tile(rasterize(_segments(fixture(spark, DATA, "fx_lines")), 2, SIDE).select("tile_id", "r", "c").collect())
    want = {}
    for t, px in masks.items():
        x = Traced(thinned(closed(px)))
        own = x.edges(3)
        want.update({(t, *k, False): (w, None, len(path)) for k, (w, path) in own.items() if k[0] != k[1]})
        want.update({(t, *k, False): (w, None, None) for k, (w, path) in own.items() if k[0] == k[1]})
        for cost, a, b, d in bridges(x.at, own, 10)[1]:
            want[t, a, b, True] = d, cost, max(2, math.ceil(d))
    got = {(r.graph_id, r.u, r.v, r.synthetic): (r.w, r.healing_cost, r.n_path) for r in answers(spark, "G13_mask_to_graph")}
    assert got.keys() == want.keys() and any(k[3] for k in want)
    for k, (w, cost, n) in want.items():
        assert got[k][:2] == pytest.approx((w, cost), abs=1e-5) and (n is None or got[k][2] == n), k


def shortest(nodes, near_):
    """From each node: distances and numbers of shortest paths by weight, and distances in steps."""
    dist = {}
    for s in nodes:
        d = dict.fromkeys(nodes, math.inf)
        d[s], todo = 0, set(nodes)
        while todo:
            u = min(todo, key=lambda x: d[x])
            todo.discard(u)
            for v, w in near_[u].items():
                d[v] = min(d[v], d[u] + w)
        dist[s] = d
    return dist


def betweenness(nodes, near_):
    """By the definition: over all pairs and nodes, the share of shortest paths that run through it."""
    d = shortest(nodes, near_)
    count = {s: {s: 1} for s in nodes}
    for s in nodes:
        for v in sorted((x for x in nodes if 0 < d[s][x] < math.inf), key=lambda x: d[s][x]):
            count[s][v] = sum(count[s][u] for u, w in near_[v].items() if d[s][u] + w == d[s][v])
    out, n = {}, len(nodes)
    for v in nodes:
        total = sum(Fraction(count[s][v] * count[v][t], count[s][t]) for s in nodes for t in nodes if s < t and v not in (s, t) and d[s][v] + d[v][t] == d[s][t] < math.inf)
        out[v] = total * Fraction(2, (n - 1) * (n - 2)) if n > 2 else total
    return out


def health(nodes, near_):
    d, hops = shortest(nodes, near_), shortest(nodes, {u: dict.fromkeys(x, 1) for u, x in near_.items()})
    n = len(nodes)
    groups = {frozenset(t for t in nodes if d[s][t] < math.inf) for s in nodes}
    big = min(groups, key=lambda g: (-len(g), min(g)))
    pairs = [d[s][t] for s in big for t in big if s != t]
    e = sum(Fraction(1, hops[s][t]) for s in nodes for t in nodes if s != t and hops[s][t] < math.inf) / (n * (n - 1)) if n > 1 else Fraction(0)
    return e, len(groups), len(big), n - len(big), sum(pairs) / len(pairs) if pairs else None


def curve(nodes, near_, adaptive):
    nodes, near_ = set(nodes), {u: dict(near_[u]) for u in nodes}
    ranked = lambda: sorted(nodes, key=lambda v: (-betweenness(nodes, near_)[v], v)) if not adaptive else None
    first = ranked()
    e0, *rest = health(nodes, near_)
    out = [(0, None, e0, Fraction(int(e0 > 0)), *rest)]
    for k in range(1, min(len(nodes) - 1, max(1, math.ceil(len(nodes) * 0.2))) + 1):
        bc = betweenness(nodes, near_) if adaptive else None
        top = min(nodes, key=lambda v: (-bc[v], v)) if adaptive else first[k - 1]
        nodes.discard(top)
        near_ = {u: {v: w for v, w in near_[u].items() if v != top} for u in nodes}
        e, *rest = health(nodes, near_)
        out.append((k, top, e, e / e0 if e0 else 0, *rest))
    return out


@pytest.fixture(scope="module")
def roads(spark):
    near_ = defaultdict(lambda: defaultdict(dict))
    for r in fixture(spark, DATA, "fx_nodes").collect():
        near_[r.graph_id][r.node_id] = {}
    for r in fixture(spark, DATA, "fx_edges").collect():
        near_[r.graph_id][r.u][r.v] = near_[r.graph_id][r.v][r.u] = r.w
    return near_


@pytest.mark.parametrize("name", ["H11_removal_curve", "H11_removal_static"])
def test_removal_curves(spark, roads, name):
    got = {(r.graph_id, r.step): tuple(r)[2:] for r in answers(spark, name)}
    want = {(g, x[0]): x[1:] for g in roads for x in curve(roads[g], roads[g], name == "H11_removal_curve")}
    assert got.keys() == want.keys()
    for k, (top, e, res, n, big, alone, avg) in want.items():
        assert got[k] == (top, pytest.approx(float(e), abs=1e-5), pytest.approx(float(res), abs=1e-5), n, big, alone, avg if avg is None else pytest.approx(avg, abs=1e-5)), k


def test_full_report(spark, roads):
    got = {(r.graph_id, r.place): tuple(r)[2:] for r in answers(spark, "H15_full_report")}
    want = {}
    for g, x in roads.items():
        bc = betweenness(x, x)
        top = sorted(x, key=lambda v: (-bc[v], v))[:10]
        steps = {s[0]: s for s in curve(x, x, True)}
        for k in {*steps, *range(1, len(top) + 1)}:
            left = (top[k - 1], pytest.approx(float(bc[top[k - 1]]), abs=1e-5), len(x[top[k - 1]])) if 1 <= k <= len(top) else (None,) * 3
            s = steps.get(k)
            want[g, k] = left + ((s[1], pytest.approx(float(s[2]), abs=1e-5), pytest.approx(float(s[3]), abs=1e-5), s[5], s[6]) if s else (None,) * 5)
    assert got == want
