"""Exact dedup: group by a 128-bit content hash, keep one row by a stable rule, compare bytes inside groups.

1. One scan makes narrow rows: id, length, MD5 and SHA-256 of the normalised text.
2. Groups are counted by MD5 with map-side partial sums, so a hot text never meets in one task as rows.
3. The texts of groups with more than one row are compared byte by byte: least and greatest text per salted
   slice of a group, then per group. They differ only if two texts share a hash. Groups with more than a
   thousandth of all rows, of which there are less than a thousand, are dealt to several tasks.
4. Groups with such a collision (none expected) are formed again by hash and text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, row_key, stored, text_of

#: A group with more rows than this, and more than this share of all rows, is parted into SLICES for the byte comparison.
SLICE_ROWS = 1000
HOT_SHARE = 1 / 1000
SLICES = 64


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(text, f"[{BLANKS}]+", "")


def md5_bits(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = without_blanks,
    content_hash: Callable[[Column], Column] = md5_bits,
    keyed: bool = False,
) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256; keyed adds row_key (see common.row_key).

    Of rows with equal normalised text the one with the most code points in its original text stays, then the
    one with the smallest id; ids may be of any type that has an order. Null text counts as empty, and empty texts
    are equal to each other. Rows that repeat an id are members of their groups one by one; all with the id that
    stays are marked kept, unless keyed: then the one of the least row_key stays, with rows equal to it in id and
    text. A null id counts as larger than every other. An empty table gives an empty result. Other columns are ignored.
    """
    key = row_key(F.col(id_col), F.col(text_col)) if keyed else F.lit(None).cast("binary")
    src = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"), key.alias("row_key")).select(
        "doc_id", "row_key", F.char_length("t").alias("len"), normalise(F.col("t")).alias("norm")
    )
    hashed = src.withColumn("h", content_hash(F.col("norm")))
    narrow = stored(hashed.select("doc_id", "row_key", "len", "h", F.sha2(F.col("norm").cast("binary"), 256).alias("sha")), "dedup-narrow")
    groups = stored(_best(narrow, "h").filter("n > 1"), "dedup-groups")

    # by sorting at every size: at scale the groups are too many to broadcast. Hot ones are few by their definition
    hot = F.col("n") > max(SLICE_ROWS, int(narrow.count() * HOT_SHARE))
    slices = groups.select("h", F.explode(F.sequence(F.lit(0), F.when(hot, SLICES - 1).otherwise(0))).alias("salt"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "len"), F.lit(SLICES)).cast("int")).otherwise(0)
    marked = hashed.join(F.broadcast(groups.filter(hot).select("h", F.lit(True).alias("hot"))), "h", "left").withColumn("salt", salt)
    members = marked.join(slices.hint("merge"), ["h", "salt"])
    ends = members.groupBy("h", "salt").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
    differ = stored(ends.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("h"), "dedup-collisions")

    if differ.isEmpty():
        return _answer(narrow.join(groups, "h", "left"), keyed)
    apart = hashed.join(differ, "h")
    again = apart.select("doc_id", "row_key", "len", "h", "norm", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"))
    return _answer(narrow.join(differ, "h", "left_anti").join(groups, "h", "left"), keyed).unionByName(
        _answer(again.join(_best(again, "h", "norm"), ["h", "norm"]), keyed)
    )


def _best(rows: DataFrame, *keys: str) -> DataFrame:
    first = F.min(F.struct((-F.col("len")).alias("shorter"), F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_key"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), first.alias("best"))


def _answer(rows: DataFrame, keyed: bool) -> DataFrame:
    alone = F.col("n").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id"))
    kept = alone | (F.col("row_key") == F.col("best.row_key")) if keyed else F.col("doc_id").eqNullSafe(keep)
    return rows.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        kept.alias("kept"),
        F.col("sha").alias("text_sha256"),
        *(["row_key"] if keyed else []),
    )
