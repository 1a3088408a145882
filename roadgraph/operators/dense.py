"""All-pairs answers of many small graphs.

Tables of sources x nodes grow by a shuffle of all pairs in every round. A graph of up to NODES nodes fits one row instead: split
groups nodes and edges by graph, once, and answered lets each task turn its rows into arrays (graphs, sources, nodes) for many
graphs at a time. Nothing but the answers leaves a task. Larger graphs are told by counts before anything is grouped; they
stay with the joins of paths.py and centrality.py.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadgraph.plans.loops import kept

G = "graph_id"
#: Most nodes of a graph that is answered from one row; and most edges between different nodes, one a pair.
NODES = 64
EDGES = NODES * (NODES - 1) // 2
#: Most entries of the largest array that a task makes at once.
CELLS = 1 << 21
#: Stands for no path; twice that is still a long.
FAR = 2**61
ASKED = "array<struct<src:bigint,dst:bigint>>"


@dataclass
class Split:
    """rows (graph_id, ids, own, es, starts): small graphs, with the ids of all nodes in order, which of them are in the table of
    nodes, edges (u, v, w) and the pairs (src, dst) asked for, without dst all of a source, null for all; None without any whole numbers as ids. large: graph_id of all others, or None if there are none."""

    rows: DataFrame | None
    large: DataFrame | None
    nodes: DataFrame
    edges: DataFrame

    def others(self) -> tuple[DataFrame, DataFrame] | None:
        """Nodes and edges of the large graphs."""
        if self.large is None:
            return None
        return self.nodes.join(self.large, G, "left_semi"), self.edges.join(self.large, G, "left_semi")


def whole_numbers(df: DataFrame, *names: str) -> bool:
    return all(isinstance(df.schema[n].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for n in names)


def split(nodes: DataFrame, edges: DataFrame, weight: str | None = "w", sources: DataFrame | None = None) -> Split:
    """Parts the graphs by size. weight None: every edge counts 1. Ids and weights that are no whole numbers make a graph a large one.
    sources: (graph_id, src), or (graph_id, src, dst), to be asked for; large graphs are left to the caller."""
    w = F.col(weight) if weight else F.lit(1).cast("long")
    nodes = kept(nodes.select(G, "node_id"))
    pair = edges.filter("u <> v").select(G, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), w.alias("w"))
    pair = kept(pair.groupBy(G, "u", "v").agg(F.min("w").alias("w")))
    if not (whole_numbers(nodes, "node_id") and whole_numbers(pair, "u", "v", "w")):
        return Split(None, kept(nodes.select(G).distinct()), nodes, pair)
    many = lambda df, most: df.groupBy(G).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > most).select(G)
    large = kept(many(nodes, NODES).union(many(pair, EDGES)).distinct())
    some = not large.isEmpty()
    n, e = (df.join(large, G, "left_anti") if some else df for df in (nodes, pair))
    n = n.groupBy(G).agg(F.sort_array(F.collect_list(F.col("node_id").cast("long"))).alias("own"))
    end = lambda x: F.col(x).cast("long").alias(x)
    e = e.groupBy(G).agg(F.collect_list(F.struct(end("u"), end("v"), end("w"))).alias("es"))
    rows = n.join(e.hint("merge"), G, "left")
    if sources is None:
        rows = rows.withColumn("starts", F.lit(None).cast(ASKED))
    else:
        of = sources.join(large, G, "left_anti") if some else sources
        dst = F.col("dst") if "dst" in sources.columns else F.lit(None)
        asked = of.groupBy(G).agg(F.collect_set(F.struct(F.col("src").cast("long").alias("src"), dst.cast("long").alias("dst"))).alias("starts"))
        rows = rows.join(asked.hint("merge"), G, "left").withColumn("starts", F.coalesce("starts", F.array().cast(ASKED)))
    ends = F.array_union(F.col("es")["u"], F.col("es")["v"])
    rows = kept(rows.withColumn("ids", F.sort_array(F.array_union("own", F.coalesce(ends, F.array().cast("array<bigint>"))))))
    odd = rows.filter(F.size("ids") > NODES)  # ends of edges that are no nodes
    if not odd.isEmpty():
        large, some = kept(large.union(odd.select(G))), True
        rows = rows.filter(F.size("ids") <= NODES)
    return Split(rows, large if some else None, nodes, pair)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Row of every item, and the items."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), size), column.flatten()


def _weights(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids and known (graphs, nodes), asked (graphs, sources, nodes), weights (graphs, nodes, nodes) with FAR where there is no edge, and sizes."""
    b = batch.num_rows
    col = lambda name: batch.column(batch.schema.get_field_index(name))
    row, ids = _lists(col("ids"))
    ids = ids.to_numpy(zero_copy_only=False)
    size = np.bincount(row, minlength=b)
    first = np.cumsum(size) - size
    n = max(1, int(size.max(initial=0)))
    values, code = np.unique(ids, return_inverse=True)
    key = row * (len(values) + 1) + code  # rises from item to item, as ids are in order

    def place(r: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(key, r * (len(values) + 1) + np.searchsorted(values, x)) - first[r]

    def found(r: np.ndarray, x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places, and whether there is such a node."""
        x = x.fill_null(0).to_numpy(zero_copy_only=False)
        if not len(key):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        i = np.minimum(np.searchsorted(values, x), len(values) - 1)
        k = r * (len(values) + 1) + i
        j = np.minimum(np.searchsorted(key, k), len(key) - 1)
        hit = (values[i] == x) & (key[j] == k)
        return np.where(hit, j - first[r], 0), hit

    at = np.zeros((b, n), np.int64)
    at[row, np.arange(len(row)) - first[row]] = ids
    known = np.zeros((b, n), bool)
    r, own = _lists(col("own"))
    known[r, place(r, own.to_numpy(zero_copy_only=False))] = True
    asked = np.repeat(known[:, :, None], n, axis=2)
    starts = col("starts")
    if starts.null_count < b:
        r, x = _lists(starts)
        src, dst = (x.field(k) for k in range(2))
        whole = dst.is_null().to_numpy(zero_copy_only=False)
        (i, hit), (j, also) = found(r, src), found(r, dst.fill_null(0))
        only = np.zeros((b, n, n), bool)
        only[r[hit & whole], i[hit & whole]] = True
        some = hit & also & ~whole
        only[r[some], i[some], j[some]] = True
        asked &= only | starts.is_null().to_numpy(zero_copy_only=False)[:, None, None]
    w = np.full((b, n, n), FAR, np.int64)
    r, es = _lists(col("es"))
    u, v, x = (es.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    u, v = place(r, u), place(r, v)
    w[r, u, v] = w[r, v, u] = x
    return at, known, asked, w, size


def _closest(w: np.ndarray) -> np.ndarray:
    """Distances of all pairs (Floyd 1962)."""
    d = w.copy()
    n = d.shape[1]
    d[:, np.arange(n), np.arange(n)] = 0
    for k in range(n):
        np.minimum(d, d[:, :, k : k + 1] + d[:, k : k + 1, :], out=d)
    return np.minimum(d, FAR)


def _counted(w: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of shortest paths (graphs, sources, nodes), and sigma(u) / sigma(v) of edges on them (graphs, sources, u, v)."""
    dag = ((d[:, :, :, None] + w[:, None] == d[:, :, None, :]) & (w < FAR)[:, None] & (d < FAR)[:, :, :, None]).astype(np.float64)
    c = np.broadcast_to(np.eye(d.shape[1]), d.shape)
    sigma = np.zeros(d.shape)
    while c.any():
        sigma += c
        c = np.matmul(c[:, :, None, :], dag)[:, :, 0, :]
    dag *= sigma[:, :, :, None]
    dag /= np.where(sigma > 0, sigma, 1.0)[:, :, None, :]
    return sigma, dag


def _run(d: np.ndarray, share: np.ndarray) -> np.ndarray:
    """How much of the shortest paths from a source runs through each node (Brandes 2001)."""
    c = (d < FAR).astype(np.float64)
    delta = np.zeros(d.shape)
    while True:
        c = np.matmul(share, c[:, :, :, None])[:, :, :, 0]
        if not c.any():
            return delta
        delta += c


def _hops(at, known, asked, w):
    d = _closest(np.where(w < FAR, 1, FAR))
    b, s, x = np.nonzero((d < FAR) & asked)
    return b, at[b, s], at[b, x], d[b, s, x].astype(np.int32)


def _dist(at, known, asked, w):
    d = _closest(w)
    b, s, x = np.nonzero((d < FAR) & asked)
    return b, at[b, s], at[b, x], d[b, s, x]


def _components(at, known, asked, w):
    least = np.argmax(_closest(np.where(w < FAR, 1, FAR)) < FAR, axis=2)  # ids are in order
    b, s = np.nonzero(known)
    return b, at[b, s], at[b, least[b, s]]


def _by_hops(at, known, asked, w):
    d = _closest(np.where(w < FAR, 1, FAR))
    b, s, x = np.nonzero((d < FAR) & asked)
    n = d.shape[1]
    k = np.bincount(b * n + d[b, s, x], minlength=len(d) * n)
    at_ = np.nonzero(k)[0]
    return at_ // n, (at_ % n).astype(np.int32), k[at_]


def _average(at, known, asked, w):
    d = _closest(w)
    near = (d < FAR) & known[:, :, None] & known[:, None, :]
    size = near.sum(axis=2)
    big = np.take_along_axis(near, np.argmax(size, axis=1)[:, None, None], axis=1)[:, 0]  # of equal ones that of the least node
    n = big.sum(axis=1)
    total = np.where(big[:, :, None] & big[:, None, :], d, 0).sum(axis=(1, 2))
    b = np.nonzero(n > 1)[0]
    return b, total[b] / (n[b] * (n[b] - 1))


def _sigma(at, known, asked, w):
    d = _closest(w)
    sigma, _ = _counted(w, d)
    b, s, x = np.nonzero((d < FAR) & asked)
    return b, at[b, s], at[b, x], d[b, s, x], sigma[b, s, x]


def _dag(at, known, asked, w):
    _, share = _counted(w, _closest(w))
    b, s, u, v = np.nonzero((share > 0) & asked.any(axis=2)[:, :, None, None])
    return b, at[b, s], at[b, u], at[b, v], share[b, s, u, v]


def _nodes(at, known, asked, w):
    d = _closest(w)
    delta = _run(d, _counted(w, d)[1]) * asked.any(axis=2)[:, :, None] * (1 - np.eye(d.shape[1]))
    b, x = np.nonzero(known)
    return b, at[b, x], delta.sum(axis=1)[b, x]


def _edges(at, known, asked, w):
    d = _closest(w)
    share = _counted(w, d)[1]
    flow = np.einsum("bsuv,bsv->buv", share * asked.any(axis=2)[:, :, None, None], 1 + _run(d, share))
    flow += flow.transpose(0, 2, 1)
    b, u, v = np.nonzero((w < FAR) & np.triu(np.ones(w.shape[1:], bool), 1))
    return b, at[b, u], at[b, v], flow[b, u, v]


def _labels(at, known, asked, w):
    """Hubs in order of falling degree, one after the other, so that each is pruned by all before it."""
    d = _closest(w)
    degree = (w < FAR).sum(axis=2)
    order = np.argsort(np.where(known, -degree, 1), axis=1, kind="stable")
    told = np.full(d.shape, FAR)  # told[b, s, x]: what hubs so far tell of s and x
    held = np.zeros(d.shape, bool)
    each = np.arange(len(d))
    for k in range(d.shape[1]):
        h = order[:, k]
        far = d[each, h]
        new = (far < FAR) & (far < told[each, h]) & known[each, h][:, None]
        held[each, :, h] = new
        far = np.where(new, far, FAR)
        np.minimum(told, far[:, :, None] + far[:, None, :], out=told)
    b, x, h = np.nonzero(held)
    return b, at[b, x], at[b, h], d[b, h, x]


def _shape(known, w):
    """Sum of 1 / hops over pairs, n_components and largest of every graph."""
    b, n = known.shape
    d = _closest(np.where(w < FAR, 1, FAR))
    near = d < FAR
    of, s, x = np.nonzero(near & known[:, :, None])
    k = np.bincount(of * n + d[of, s, x], minlength=b * n).reshape(b, n)
    total = np.zeros(b)
    for far in range(1, n):  # in the order of hops, as paths.efficiency_of
        total += k[:, far] / far
    of, s = np.nonzero(known)
    firsts = np.zeros((b, n), bool)
    firsts[of, np.argmax(near, axis=2)[of, s]] = True
    return total, firsts.sum(axis=1), ((near & known[:, None, :]).sum(axis=2) * known).max(axis=1)


def _mean(total, size):
    return np.where(size < 2, 0.0, total / np.maximum(1, size * (size - 1)))


def _health(at, known, w):
    """efficiency, n_components, largest and avg_path (NaN for one node) of every graph."""
    total, parts, largest = _shape(known, w)
    average = np.full(len(known), np.nan)
    some, value = _average(at, known, None, w)
    average[some] = value
    return _mean(total, known.sum(axis=1)), parts, largest, average


def _curve(at, known, asked, w, fraction, n_steps):
    """The graph and what is left of it after each removal of the node with the largest betweenness, to nine decimals; of equal ones the least."""
    size = known.sum(axis=1)
    steps = np.minimum(n_steps or np.maximum(1, np.ceil(size * fraction)), size - 1)
    graph, known, w = np.arange(len(size)), known.copy(), w.copy()
    shots, gone = [], np.zeros(len(size), np.int64)
    for k in range(int(steps.max(initial=0)) + 1):
        if k:
            go = steps[graph] >= k
            graph, known, w = graph[go], known[go], w[go]
            d = _closest(w)
            delta = _run(d, _counted(w, d)[1]) * known[:, :, None] * (1 - np.eye(d.shape[1]))
            n = known.sum(axis=1)
            scale = np.where(n > 2, 1.0 / np.maximum(1, (n - 1) * (n - 2)), 0.5)
            through = np.floor(delta.sum(axis=1) * scale[:, None] * 1e9 + 0.5)
            each, top = np.arange(len(graph)), np.argmax(np.where(known, through, -1.0), axis=1)  # ids are in order
            known[each, top] = False
            w[each, top, :] = w[each, :, top] = FAR
            gone = at[graph, top]
        efficiency, parts, largest, average = _health(at[graph], known, w)
        if not k:
            e0 = efficiency
        share = np.where(e0[graph] == 0, 0.0, efficiency / np.where(e0[graph] == 0, 1.0, e0[graph]))
        shots.append((graph, np.full(len(graph), k, np.int32), gone, efficiency, share, parts, largest, known.sum(axis=1) - largest, average))
    row, step, gone, *values, average = (np.concatenate(x) for x in zip(*shots))
    return row, step, pa.array(gone, mask=step == 0), *values, pa.array(average, mask=np.isnan(average))


#: What can be asked of small graphs: columns beside graph_id, and whether arrays have a fourth axis.
ANSWERS: dict[str, tuple[Callable, str, bool]] = {
    "hops": (_hops, "src long, dst long, hops int", False),
    "by_hops": (_by_hops, "hops int, k long", False),
    "average": (_average, "avg_path double", False),
    "dist": (_dist, "src long, dst long, dist long", False),
    "labels": (_labels, "node_id long, hub long, dist long", False),
    "components": (_components, "node_id long, comp_id long", False),
    "sigma": (_sigma, "src long, dst long, dist long, sigma double", True),
    "dag": (_dag, "src long, u long, v long, share double", True),
    "nodes": (_nodes, "node_id long, s double", True),
    "edges": (_edges, "u long, v long, s double", True),
    "curve": (_curve, "step int, removed_node long, efficiency double, resilience double, n_components long, largest long, isolated long, avg_path double", True),
}


def both(parts: Split, what: str, other: Callable[[DataFrame, DataFrame], DataFrame], *values) -> DataFrame:
    """An answer for small graphs, with values as further arguments, and other(nodes, edges) for large ones, with the same columns."""
    large = parts.others()
    if parts.rows is None:
        return other(*large)
    small = answered(parts.rows, what, *values)
    if large is None:
        return small
    far = other(*large)
    return small.select(*(F.col(c).cast(far.schema[c].dataType).alias(c) for c in far.columns)).union(far)


def answered(rows: DataFrame, what: str, *values) -> DataFrame:
    """graph_id and the columns of an answer. A batch is done in order of size and in runs of at most CELLS entries."""
    fn, columns, fourth = ANSWERS[what]
    own = T._parse_datatype_string(columns)
    names = own.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(batch.schema.get_field_index("ids")).value_lengths().to_numpy(zero_copy_only=False)
            order = np.argsort(size, kind="stable")
            end = len(order)
            while end:
                n = max(1, int(size[order[end - 1]]))
                start = max(0, end - max(1, CELLS // n ** (3 if fourth else 2)))
                some = batch.take(pa.array(order[start:end]))
                at, known, asked, w, _ = _weights(some)
                row, *out = fn(at, known, asked, w, *values)
                graph = some.column(some.schema.get_field_index(G)).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([graph, *(x if isinstance(x, pa.Array) else pa.array(x) for x in out)], names=[G, *names])
                end = start

    kind = T.StructType([rows.schema[G], *own.fields])
    return rows.select(G, "ids", "own", "es", "starts").mapInArrow(run, kind)


def _losses(batch: pa.RecordBatch) -> pa.RecordBatch:
    """What every scenario of these graphs leaves; w is the number of edges between two nodes."""
    at, known, _, w, _ = _weights(batch)
    col = lambda name: batch.column(batch.schema.get_field_index(name))
    graph, scenarios = _lists(col("scenarios"))

    def places(row: np.ndarray, x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero((at[row] == x.to_numpy(zero_copy_only=False)[:, None]) & known[row])

    repeats = np.zeros(known.shape, np.int64)
    row, own = _lists(col("own"))
    k, place = places(row, own)
    np.add.at(repeats, (row[k], place), 1)
    n_pre = repeats.sum(axis=1)
    e_pre = _mean(_shape(known, w)[0], n_pre)
    gone = np.zeros((len(graph), known.shape[1]), bool)
    of, ids = _lists(scenarios.field(1))
    k, place = places(graph[of], ids)
    gone[of[k], place] = True
    out = gone[:, :, None] | gone[:, None, :]
    had = np.where(np.triu(w < FAR, 1), w, 0)[graph]
    left = known[graph] & ~gone
    total, parts, largest = _shape(left, np.where(out, FAR, w[graph]))
    found = [
        np.bincount(of, minlength=len(graph)), (had * out).sum(axis=(1, 2)), e_pre[graph], _mean(total, (repeats[graph] * left).sum(axis=1)), n_pre[graph], parts, left.sum(axis=1) - largest,
    ]
    columns = [scenarios.field(0), col(G).take(pa.array(graph)), *map(pa.array, found)]
    return pa.RecordBatch.from_arrays(columns, names=["scenario_id", G, *(x.split()[0] for x in LOSSES.split(", "))])


LOSSES = "gone long, cut long, e_pre double, e_post double, n_pre long, n_components long, isolated long"
#: Scenarios of a graph in one row, about; more are dealt to several.
SCENARIOS = 512


def losses(rows: DataFrame, scenarios: DataFrame) -> DataFrame:
    """scenario_id, graph_id and LOSSES: nodes and edges that a scenario takes from a small graph, efficiency before and after, nodes
    before, components and nodes outside the largest after. rows: of split, with numbers of edges as weights. scenarios(scenario_id, graph_id,
    gone): nodes as a list."""
    most = scenarios.groupBy(G).agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 1
    deal = F.pmod(F.xxhash64("scenario_id"), F.lit(-(-most // SCENARIOS)))
    own = scenarios.groupBy(G, deal.alias("deal")).agg(F.collect_list(F.struct("scenario_id", "gone")).alias("scenarios"))
    both = rows.select(G, "ids", "own", "es", "starts").join(own.drop("deal").hint("merge"), G)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = batch.column(batch.schema.get_field_index("scenarios")).value_lengths().to_numpy(zero_copy_only=False)
            size = batch.column(batch.schema.get_field_index("ids")).value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum((many + 1) * int(size.max(initial=1)) ** 2)
            start = 0
            while start < len(ends):
                end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CELLS, "right")))
                yield _losses(batch.slice(start, end - start))
                start = end

    return both.mapInArrow(run, T.StructType([scenarios.schema["scenario_id"], rows.schema[G], *T._parse_datatype_string(LOSSES).fields]))
