"""Spanning forests of bridges from one row and in rounds; tangents without paths in a shuffle."""

import random
from collections import Counter

from pyspark.sql import functions as F

from roadgraph.operators import healing as L


def test_forests_from_rows_and_rounds_agree(spark, monkeypatch):
    rng = random.Random(5)
    comp = [(g, x, x - x % 3) for g in range(6) for x in range(60)]
    cand = {(g, min(a, b), max(a, b)): float(rng.randrange(9)) for g in range(6) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(200 if g else 20)) if a // 3 != b // 3}
    comp = spark.createDataFrame(comp, "graph_id long, node_id long, comp_id long")
    cand = spark.createDataFrame([(*k, c, k[1] * 1.5) for k, c in cand.items()], "graph_id long, a long, b long, cost double, dist double")
    got = {}
    for most in (0, 100, 10**6):
        monkeypatch.setattr(L, "GAPS", most)
        out = L.spanning_forest(comp, cand)
        assert out.columns == cand.columns
        got[most] = Counter(tuple(r) for r in out.collect())
    assert got[0] == got[100] == got[10**6] and max(got[0].values()) == 1
    assert Counter(k[0] for k in got[0])[3] == 19


def test_no_path_is_shuffled(spark):
    path = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda t: F.struct((t * F.col("u")).alias("r"), (t * 2).alias("c")))
    edges = spark.createDataFrame([(1, 1, 2, 5), (1, 2, 3, 9), (1, 4, 4, 99), (2, 7, 8, 1)], "graph_id long, u long, v long, w long").withColumn("path", F.when(F.col("graph_id") == 2, F.slice(path, 1, 1)).otherwise(path))
    out = L.tangents(None, edges)
    got = {(r.graph_id, r.node_id): (round(r.tangent.r, 6), round(r.tangent.c, 6)) for r in out.collect()}
    half = round(0.5**0.5, 6)
    assert got == {(1, 1): (round(5**-0.5, 6), round(2 * 5**-0.5, 6)), (1, 2): (half, half), (1, 3): (-half, -half)}
    exchange = out._jdf.queryExecution().optimizedPlan().toString().split("Window", 1)[1].splitlines()[1]
    assert "path" not in exchange
