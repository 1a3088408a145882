"""K-d tree sharding: split at weighted medians along the widest metadata dimension until leaves are small enough.

The unit that is placed is a group of equal texts, so copies stay in one shard; a group that is larger than a
hundredth of a shard is cut into chunks that lie side by side. All nodes of one depth are split in the same
jobs. A weighted median is found by refining a histogram of a 62-bit key (dimension value, then hash): every
round is one partial aggregation over narrow rows, and only the histogram cell that holds the median goes on.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_parts, stored, text_of

#: Bits of the key that one histogram round resolves.
STEP_BITS = 12
KEY_BITS = 60
#: A cell of at most this share of a shard is not refined further.
TOLERANCE = 1e-4
#: Hot groups that are sent to every task; more are joined by sorting.
FEW = 100_000
DIMENSIONS = ("d_id", "d_size", "d_lang", "d_source")


def kd_shards(
    docs: DataFrame,
    target_bytes: int | None = None,
    n_shards: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard, slot, and the unit's place in the tree.

    Give target_bytes (leaves are split until they hold at most about that much) or the number of leaves.
    size is the UTF-8 length plus 8; a null text has none. Null metadata is a value of its own. Sizes of
    shards differ by about the largest unit at a cut. Repeated rows, rows that repeat an id and rows with null ids are
    placed one by one: chunks of large groups and slots go by the place of a row in the stored table, not by its id.
    Ids are cast to long; text that is no number raises an error in ANSI mode. Of other columns only lang and source are
    read. With fewer units than shards some shards stay empty. An empty table gives an empty result.
    """
    has = set(docs.columns)
    meta = {c: (F.col(c).cast("string") if c in has else F.lit(None).cast("string")) for c in ("lang", "source")}
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"), *(v.alias(k) for k, v in meta.items()))
    t = text_of("t").cast("binary")
    rows = raw.select(
        "doc_id",
        (F.octet_length(t) + F.lit(8)).cast("long").alias("size"),
        F.crc32(t).alias("text_crc32"),
        F.unhex(F.md5(t)).alias("h"),
        "lang",
        "source",
    )
    rows = stored(rows.withColumn("place", F.monotonically_increasing_id()), "kd-rows")
    total = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    total_bytes, n_rows = total[0] or 0, total[1]
    leaves = n_shards or max(1, math.ceil(total_bytes / target_bytes))
    share = max(1, total_bytes // leaves)
    cap = max(1, share // 100)

    # at most 100 * leaves groups weigh more than cap, so the hot list is bounded by the number of shards; beyond FEW it is joined by sorting
    hot = rows.groupBy("h").agg(
        F.sum("size").alias("g_bytes"), F.count(F.lit(1)).alias("g_rows"), F.min("doc_id").alias("g_id"),
        F.min("lang").alias("g_lang"), F.min("source").alias("g_source"),
    ).filter((F.col("g_bytes") > cap) & (F.col("g_rows") > 1))
    chunks = F.ceil(F.col("g_bytes") / cap)
    hot = F.broadcast(hot) if 100 * leaves <= FEW else hot.hint("merge")
    rows = rows.join(hot, "h", "left").withColumn(
        "chunk", F.when(F.col("g_bytes").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("place"), chunks)).cast("int")
    )
    units = rows.groupBy("h", "chunk").agg(
        F.sum("size").alias("w"),
        F.max("size").alias("size"),
        F.coalesce(F.min("g_id"), F.min("doc_id"), F.lit(0)).alias("id"),
        F.coalesce(F.min("g_lang"), F.min("lang"), F.lit("")).alias("lang"),
        F.coalesce(F.min("g_source"), F.min("source"), F.lit("")).alias("source"),
    )
    units = stored(_placed(units), "kd-units")
    leaf = _split_all(units, leaves, share)
    shards = rows.select("doc_id", "place", "size", "text_crc32", "h", "chunk").join(leaf, ["h", "chunk"])
    return _with_slots(shards, leaves, n_rows)


def _placed(units: DataFrame) -> DataFrame:
    """Dimensions as numbers from 0 to 2**30 - 1, and a hash that keeps chunks of a group side by side."""
    top = 2**30 - 1
    span = units.agg(F.min("id"), F.max("id")).first()
    low, wide = (span[0] or 0), max(1, (span[1] or 0) - (span[0] or 0))
    by_name = lambda c: F.pmod(F.xxhash64(c), F.lit(2**30))
    return units.select(
        "h", "chunk", "w",
        ((F.col("id") - low).cast("double") / wide * top).cast("long").alias("d_id"),
        F.least(F.lit(top), (F.log2(F.col("size")) / 40 * top).cast("long")).alias("d_size"),
        by_name("lang").alias("d_lang"),
        by_name("source").alias("d_source"),
        # the low half of the key: 20 bits of the text's hash, then 10 bits of the chunk
        (F.pmod(F.xxhash64("h"), F.lit(2**20)) * 1024 + F.pmod(F.col("chunk"), F.lit(1024))).alias("tie"),
    )


def _split_all(units: DataFrame, leaves: int, share: int) -> DataFrame:
    """(h, chunk, leaf): the tree, one depth at a time."""
    spark = units.sparkSession
    world = units.agg(*(f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max)))).first()
    # node -> (first leaf, number of leaves); the driver holds the tree, whose size is the number of shards
    nodes = {0: (0, leaves)}
    placed = units.withColumn("node", F.lit(0))
    depth = 0
    while any(n > 1 for _, n in nodes.values()):
        open_nodes = {k: v for k, v in nodes.items() if v[1] > 1}
        todo = F.broadcast(spark.createDataFrame([(k,) for k in open_nodes], "node int"))
        stats = placed.join(todo, "node", "left_semi").groupBy("node").agg(
            F.sum("w").alias("w"), *(f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max)))
        ).collect()
        plan = {}
        for r in stats:
            first, n = open_nodes[r["node"]]
            wide = {d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / max(1, world[f"hi_{d}"] - world[f"lo_{d}"]) for d in DIMENSIONS}
            dim = max(DIMENSIONS, key=lambda d: (wide[d], -DIMENSIONS.index(d)))
            plan[r["node"]] = {"dim": dim, "want": r["w"] * (n // 2) / n, "lo": 0, "bits": KEY_BITS, "below": 0}
        dims = F.broadcast(spark.createDataFrame([(k, DIMENSIONS.index(v["dim"]) + 1) for k, v in plan.items()], "node int, dim int"))
        keyed = placed.join(dims, "node", "left").withColumn("key", _key()).drop("dim")
        cuts = _medians(keyed, plan, max(1.0, share * TOLERANCE))
        after, moves = {}, []
        for k, (first, n) in nodes.items():
            if n == 1 or k not in cuts:
                after[len(after)] = (first, 1 if k not in cuts else n)
                moves.append((k, 2**62, len(after) - 1, len(after) - 1))
            else:
                left = n // 2
                after[len(after)] = (first, left)
                after[len(after)] = (first + left, n - left)
                moves.append((k, cuts[k], len(after) - 2, len(after) - 1))
        tree = F.broadcast(spark.createDataFrame(moves, "node int, cut long, l int, r int"))
        placed = keyed.join(tree, "node").select(
            *units.columns, F.when(F.coalesce("key", F.lit(0)) < F.col("cut"), F.col("l")).otherwise(F.col("r")).alias("node")
        )
        depth += 1
        if depth % 2 == 0:
            placed = stored(placed, "kd-placed")
        nodes = after
    names = F.broadcast(spark.createDataFrame([(k, first) for k, (first, _) in nodes.items()], "node int, shard int"))
    return placed.join(names, "node").select("h", "chunk", "d_id", "shard")


def _key():
    """The 60-bit sort key of a unit in its node: the node's dimension number dim, then the tie hash. Null where the node stays."""
    return F.get(F.array(*DIMENSIONS), F.col("dim") - 1) * 2**30 + F.col("tie")


def _medians(keyed: DataFrame, plan: dict, enough: float) -> dict[int, int]:
    """node -> the key at which its right part begins. Refines one histogram cell per node and round."""
    spark = keyed.sparkSession
    cuts: dict[int, int] = {}
    todo = {k: dict(v) for k, v in plan.items()}
    while todo:
        cells = F.broadcast(spark.createDataFrame(
            [(k, v["lo"], v["lo"] + 2 ** v["bits"], max(0, v["bits"] - STEP_BITS), float(v["want"] - v["below"])) for k, v in todo.items()],
            "node int, lo long, hi long, shift int, want double",
        ))
        cell = F.expr("shiftright(key - lo, shift)")
        hist = keyed.join(cells, "node").filter("key >= lo and key < hi").groupBy("node", "want", cell.alias("cell")).agg(
            F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")
        )
        run = F.sum("w").over(Window.partitionBy("node").orderBy("cell"))
        # the histogram has at most 2**STEP_BITS cells a node
        found = (
            hist.withColumn("upto", run).withColumn("over", F.col("upto") >= F.col("want"))
            .groupBy("node").agg(F.min(F.when(F.col("over"), F.struct("cell", "w", "n", "upto"))).alias("c"), F.max("cell").alias("last"))
            .collect()
        )
        left = {}
        for r in found:
            v = todo[r["node"]]
            shift = max(0, v["bits"] - STEP_BITS)
            if r["c"] is None:
                cuts[r["node"]] = v["lo"] + ((r["last"] + 1) << shift)
                continue
            start = v["lo"] + (r["c"]["cell"] << shift)
            below = v["below"] + r["c"]["upto"] - r["c"]["w"]
            if shift == 0 or r["c"]["n"] == 1 or r["c"]["w"] <= enough:
                near = v["want"] - below > r["c"]["w"] / 2  # the cell goes to the side that it fits better
                cuts[r["node"]] = start + (1 << shift) if near else start
            else:
                left[r["node"]] = v | {"lo": start, "bits": shift, "below": below}
        todo = left
    return cuts


def _with_slots(rows: DataFrame, leaves: int, n_rows: int) -> DataFrame:
    """slot: gapless from 0 in each shard. Rows are numbered in parts of bounded size, with offsets by part."""
    parts = row_parts(n_rows, 100_000)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("place"), F.lit(parts)))
    offsets = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = offsets.select("shard", "part", F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy("place"))
    return rows.withColumn("nth", nth).join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int"), (F.col("before") + F.col("nth") - 1).cast("long").alias("slot")
    )
