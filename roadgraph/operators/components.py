"""Connected components by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgraph.plans.loops import kept

MAX_ROUNDS = 60


def _either_way():
    """Both directions of an edge, as structs e(u, v)."""
    return F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")


def _stars(edges: DataFrame, keys: list[str], large: bool) -> DataFrame:
    """One round: every node's neighbours (larger ones, or smaller ones) are tied to the least of them all."""
    if large:
        both = edges.select(*keys, _either_way()).select(*keys, "e.u", "e.v")
    else:
        both = edges.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    tied = both.join(least.hint("merge"), [*keys, "u"])
    if large:
        out = tied.filter("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # the node itself is tied to the least as well
        ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")
        out = tied.select(*keys, ends).select(*keys, "e.u", "e.v")
    return out.filter("u <> v").distinct()


def component_labels(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, node, component): component is the least node that node reaches. Only nodes with an edge to
    another node appear. edges has keys, u and v; direction, repeats, self-loops and nulls don't matter.
    """
    keys = keys or []
    now = kept(edges.filter("u <> v").select(*keys, "u", "v").distinct())
    sign = None
    for _ in range(MAX_ROUNDS):
        now = kept(_stars(_stars(now, keys, True), keys, False))
        got = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
        if tuple(got) == sign:
            break
        sign = tuple(got)
    else:
        raise RuntimeError(f"components need more than {MAX_ROUNDS} rounds")
    return now.select(*keys, F.explode(F.array("u", "v")).alias("node"), F.col("v").alias("component")).distinct()
