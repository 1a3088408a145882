"""Splits and samples that are the same on every run: rows are ordered by md5 of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadgraph.operators.ranking import ranked
from roadgraph.plans.loops import kept

#: Leading hex digits of the hash by which rows are put into ranges for a global order.
DIGITS = 3
#: Draws of a weighted sample that meet in one bucket.
BUCKET_DRAWS = 64
#: Most nodes of a group that draws its pairs from one row, and nodes of a part, about.
LISTED = 1000
ROWS = 500_000


def hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def globally_numbered(df: DataFrame, order: Column, tie: str) -> DataFrame:
    """Adds place, from 1, by order. Rows are numbered inside ranges of the hash and ranges get offsets, so no task sees all rows."""
    own = df.withColumn("h", order).withColumn("range", F.substring("h", 1, DIGITS))
    sizes = own.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # 16 ** DIGITS rows
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("range").orderBy("h", tie))
    return own.withColumn("at", at).join(F.broadcast(before), "range").withColumn("place", F.col("at") + F.col("before")).drop("h", "range", "at", "before")


def split3(df: DataFrame, key: str, seed: int = 42, test: float = 0.05, val: float = 0.15) -> DataFrame:
    """Adds split: train first, then val (int(n * val) rows), then test (int(n * test) rows)."""
    total = df.agg(F.count(F.lit(1)).alias("n"))
    n_test, n_val = (F.col("n") * test).cast("int"), (F.col("n") * val).cast("int")
    rows = globally_numbered(df, hash_order(key, seed), key).join(F.broadcast(total))
    name = F.when(F.col("place") <= F.col("n") - n_val - n_test, "train").when(F.col("place") <= F.col("n") - n_test, "val").otherwise("test")
    return rows.withColumn("split", name).drop("place", "n")


def split2(df: DataFrame, key: str, seed: int = 42, val: float = 0.2) -> DataFrame:
    """Adds split: max(1, int(n * val)) rows are val, the rest train."""
    total = df.agg(F.greatest(F.lit(1), (F.count(F.lit(1)) * val).cast("int")).alias("n_val"))
    rows = globally_numbered(df, hash_order(key, seed), key).join(F.broadcast(total))
    return rows.withColumn("split", F.when(F.col("place") <= F.col("n_val"), "val").otherwise("train")).drop("place", "n_val")


def subsample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by hash order."""
    return df.withColumn("h", hash_order(key, seed)).orderBy("h", key).limit(n).drop("h")


def unit(x: Column) -> Column:
    """A number in [0, 1) from the first eight hex digits of a hash."""
    return F.conv(F.substring(x, 1, 8), 16, 10).cast("double") / float(2**32)


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: int = 42, buckets: int | None = None) -> DataFrame:
    """(draw, key): n draws with replacement, each row by its weight.

    Rows lie side by side on a line, each as long as its weight; draw i falls on a point of it. Rows and points meet in
    buckets of the line, by default so many that one holds about BUCKET_DRAWS draws. Rows are summed up inside ranges of the hash, so no task sees all of them.
    """
    buckets = buckets or max(256, n // BUCKET_DRAWS)
    own = df.select(key, weight).withColumn("h", hash_order(key, seed)).withColumn("range", F.substring("h", 1, DIGITS))
    sums = own.groupBy("range").agg(F.sum(weight).alias("s"))
    past = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("range", F.coalesce(F.sum("s").over(past), F.lit(0.0)).alias("start"))
    inner = F.sum(weight).over(Window.partitionBy("range").orderBy("h", key))
    total = sums.agg(F.sum("s").alias("total"))
    line = own.withColumn("hi", inner).join(F.broadcast(starts), "range").join(F.broadcast(total)).select(
        key, ((F.col("start") + F.col("hi") - F.col(weight)) / F.col("total")).alias("lo"), ((F.col("start") + F.col("hi")) / F.col("total")).alias("hi")
    )
    spread = line.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") * buckets), F.floor(F.col("hi") * buckets))))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), unit(F.md5(F.concat(F.lit(f"{seed}#"), F.col("id").cast("string")).cast("binary"))).alias("x"))
    return draws.withColumn("bucket", F.floor(F.col("x") * buckets)).join(spread, "bucket").filter("x >= lo and x < hi").select("draw", key)


def sample_pairs(nodes: DataFrame, group: str, node: str, n: int, seed: int = 42) -> DataFrame:
    """(group, slot, a, b): n pairs of different nodes per group, by hash; pairs may repeat, nodes within a pair don't. Groups of one give none.

    Groups of up to LISTED nodes draw from one row, in parts of about ROWS nodes; larger ones, told by counts, from ranks."""
    nodes = kept(nodes.select(group, node).filter(F.col(group).isNotNull()))
    large = kept(nodes.groupBy(group).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > LISTED).select(group))
    some = not large.isEmpty()
    few = nodes.join(large, group, "left_anti") if some else nodes
    parts = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-nodes.count() // ROWS))
    own = few.repartition(parts, group).groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(node).alias("x")))).alias("own"))
    two = _drawn(own.withColumn("size", F.size("own").cast("long")).filter("size > 1"), group, n, seed)
    at = lambda i: F.element_at("own", (F.col(i) + 1).cast("int"))["x"]
    pairs = two.select(group, "slot", at("i").alias("a"), at("j").alias("b"))
    return pairs.union(_ranked_pairs(nodes.join(large, group, "left_semi"), group, node, n, seed)) if some else pairs


def _drawn(sizes: DataFrame, group: str, n: int, seed: int) -> DataFrame:
    """Groups with their size once for each slot, and the places i and j, from 0, that it draws."""
    draw = lambda k, m: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}{k}"), F.col(group).cast("string"), F.col("slot").cast("string")).cast("binary")), 1, 7), 16, 10).cast("long") % m
    slots = sizes.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return slots.withColumn("i", draw("a", F.col("size"))).withColumn("j", (F.col("i") + 1 + draw("b", F.col("size") - 1)) % F.col("size"))


def _ranked_pairs(nodes: DataFrame, group: str, node: str, n: int, seed: int) -> DataFrame:
    placed = ranked(nodes, group, [F.asc(node)], "place_of_node").withColumn("at", F.col("place_of_node") - 1)
    two = _drawn(placed.groupBy(group).agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), group, n, seed)
    side = lambda name, at: placed.select(group, F.col("at").alias(at), F.col(node).alias(name))
    return two.join(side("a", "i"), [group, "i"]).join(side("b", "j"), [group, "j"]).select(group, "slot", "a", "b")
