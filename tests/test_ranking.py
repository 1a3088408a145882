"""Places in groups against plain sorting, however a group is dealt."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from roadgraph.operators import centrality, ranking, sampling
from roadgraph.operators.paths import largest_component

ROWS = "g long, x double, name long, place string"


@pytest.fixture
def wide(spark):
    """Small tables stay in as many parts as there are."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield spark
    spark.conf.set(name, old)


def table(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, 0.0, 0.5, rng.random()]), i, "a column of that name") for i in range(3000)]
    return rows, spark.createDataFrame(rows, ROWS)


@pytest.mark.parametrize("parts", [1, 7])
def test_places_are_those_of_a_sort(wide, parts):
    rows, df = table(wide)
    got = ranking.ranked(df.repartition(parts), "g", [F.desc("x"), F.asc("name")], "at", "n").collect()
    groups = defaultdict(list)
    for g, x, i, _ in rows:
        groups[g].append((x is None, -(x or 0), i))
    want = {(g, i): (k, len(some)) for g, some in groups.items() for k, (_, _, i) in enumerate(sorted(some), 1)}
    assert {(r.g, r.name): (r["at"], r.n) for r in got} == want and len(got) == len(rows)
    assert ranking.ranked(df.limit(0), "g", [F.desc("x")], "at").count() == 0


def test_no_task_sees_a_whole_group(wide, monkeypatch):
    """The rows that are numbered together are a part of the large group; only counts of parts meet."""
    seen = []
    kept = ranking.kept
    monkeypatch.setattr(ranking, "kept", lambda df: seen.append(kept(df)) or seen[-1])
    df = wide.range(20_000).select(F.lit(7).cast("long").alias("g"), F.xxhash64("id").cast("double").alias("x"), F.col("id").alias("name"))
    assert ranking.ranked(df, "g", [F.desc("x"), F.asc("name")], "at").agg(F.count_distinct("at"), F.max("at")).first()[:] == (20_000, 20_000)
    parts = Counter(r.part_of_rank for r in seen[0].collect())
    assert len(parts) == 4 and max(parts.values()) < 8_000


@pytest.mark.parametrize("fraction", [0.001, 0.1, 1.0])
def test_top_fraction_of_groups(wide, fraction):
    rows, df = table(wide)
    got = centrality.top_fraction(df, "g", "x", fraction, "name")
    assert got.columns == df.columns
    want = set()
    for g in (1, 2, 3):
        own = sorted((x is None, -(x or 0), i) for h, x, i, _ in rows if h == g)
        want |= {(g, i) for _, _, i in own[: max(1, -(-len(own) * fraction // 1).__int__())]}
    assert {(r.g, r.name) for r in got.collect()} == want


def test_largest_component_and_its_ties(wide):
    comp = wide.createDataFrame([(1, n, c) for n, c in ((5, 5), (6, 5), (1, 1), (2, 1), (9, 9))] + [(2, 4, 4)], "graph_id long, node_id long, comp_id long")
    assert sorted(map(tuple, largest_component(comp).collect())) == [(1, 1, 2), (2, 4, 1)]


def test_pairs_of_listed_and_ranked_groups(spark, monkeypatch):
    """Groups of one row draw what ranks draw; groups of one, null groups and null nodes."""
    n = spark.createDataFrame([(g, f"n{i * 7 % 23}") for g, k in ((1, 1), (2, 2), (3, 9), (4, 23)) for i in range(k)] + [(3, None), (None, "a"), (None, "b")], "g long, node string")
    pairs = lambda: sorted(tuple(map(str, r)) for r in sampling.sample_pairs(n, "g", "node", 6).collect())
    listed = pairs()
    assert len(listed) == 18 and not any(a == b for _, _, a, b in listed)
    monkeypatch.setattr(sampling, "LISTED", 5)
    assert pairs() == listed
    monkeypatch.setattr(sampling, "LISTED", 0)
    assert pairs() == listed
