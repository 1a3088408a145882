"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A short item inside a long text has a tiny Jaccard similarity with it, so one signature size for all texts
cannot find it. Texts are partitioned by the number of their shingles (powers of two), and the partition sets
the number of bins of a one-permutation MinHash, so that a bin holds two to four shingles of any text. The upper
bits of a shingle's hash are its bin; the bin's minimum is kept. An item's signature is made for every partition
that occurs. A text is a candidate if it shares a bin minimum with an item. A shingle is its bin's minimum with a
chance of at least 0.24, so an item of q shingles of which 0.8 q are in a text is missed with a chance of about
0.76 ** (0.8 q), below 0.00003 from SHORT_ITEM on. Items with fewer shingles are looked up by all shingles of the
texts, minima or not, which leaves no chance.

Candidates are then checked exactly: the text's distinct shingles against the item's.

Only Spark functions are used. A text's signature is made inside its row; only matches leave the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, stored, table

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
#: Items with fewer shingles than this are looked up by every shingle.
SHORT_ITEM = 48
#: Signature rows of all items up to which they are sent to every task; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Shingles of a text for each bin of its signature, at least; at most twice as many.
BIN_BITS = 1
#: Candidate texts whose keys of 16 bytes are sent to every task; more are joined by sorting.
BROADCAST_TEXTS = 200_000
#: Stands in a key for the partition where a shingle is not its bin's minimum; no text has so many shingles.
NO_MINIMUM = 63


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def with_shingles(rows: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """Replaces the column text by s: sorted distinct 64-bit hashes of k consecutive words, none with fewer words.

    In steps, so that the words are a column and not computed again for every shingle."""
    keep = [c for c in rows.columns if c != "text"]
    split = rows.select(*keep, words(F.col("text")).alias("w"))
    n = F.size("w") - k
    made = F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(*(F.col("w")[i + j] for j in range(k))))
    return split.select(*keep, F.when(n >= 0, F.sort_array(F.array_distinct(made))).otherwise(F.expr("cast(array() as array<bigint>)")).alias("s"))


def partition_bits(n: Column) -> Column:
    """The size partition of a text with n shingles, which has 2 ** bits bins."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)))) - 1 - BIN_BITS).cast("int")


def _is_minimum(x: Column, i: Column) -> Column:
    """Whether place i of the column s, which is sorted and so in order of bin, then value, starts one of 2 ** bits bins."""
    s, bits = F.col("s"), F.col("bits")
    by = lambda x: F.call_function("shiftright", x, F.lit(64) - bits)
    return (i == 0) | (bits > 0) & (by(x) != by(F.get(s, i - 1)))


def signature() -> Column:
    """Minima of 2 ** bits bins of the columns s and bits."""
    return F.filter("s", _is_minimum)


def _key(x: Column, bits: Column) -> Column:
    """The hash with the partition in place of its lowest six bits."""
    return x.bitwiseAND(F.lit(-64)).bitwiseOR(bits.cast("long"))


def _keyed(hashes: Column) -> Column:
    """One join key for each hash, made by the generator, so that no filter on it can be pushed below the shingling
    and repeat that work."""
    return F.transform(hashes, lambda x: _key(x, F.col("bits")))


def _all_keyed() -> Column:
    """Keys of all of s: a bin's minimum has its partition, any other shingle NO_MINIMUM."""
    return F.transform("s", lambda x, i: _key(x, F.when(_is_minimum(x, i), F.col("bits")).otherwise(F.lit(NO_MINIMUM))))


def _each(array: str) -> Column:
    """explode, through a filter for the same reason."""
    return F.explode(F.filter(array, lambda x: x.isNotNull()))


def contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False,
    broadcast_rows: int = BROADCAST_ROWS, broadcast_texts: int = BROADCAST_TEXTS,
) -> DataFrame:
    """One row per document and item of which the document holds at least threshold of the distinct shingles:
    doc_id, item_id, n_item (shingles of the item), n_shared, containment; keyed adds row_key (see common.row_key).

    Null texts, and texts or items with fewer than five words, have no shingle and match nothing. Items with
    equal text are answered one by one, rows that repeat an item once. Rows that repeat a document id with another
    text, and rows with a null id, are documents of their own; rows equal in id and text are answered once. Other
    columns are ignored.
    """
    hashed = with_shingles(items.select("item_id", "text")).select("item_id", _each("s").alias("h")).distinct()
    item_set = hashed.groupBy("item_id").agg(F.sort_array(F.collect_set("h")).alias("s"))  # as long as an item
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"))
    sizes = F.size("s")
    ones = with_shingles(own).select("doc_id", "row_key", "s", partition_bits(sizes).alias("bits"))
    short = sizes < SHORT_ITEM
    any_short = not item_set.filter(short).isEmpty()
    sketch = ones.select("doc_id", "row_key", F.explode(_all_keyed() if any_short else _keyed(signature())).alias("key"))

    # every partition from 2 ** 0 to 2 ** 40 bins; long items only need their minima, short ones also meet what is none
    every = F.sequence(F.lit(0), F.lit(40))
    wanted = item_set.select("item_id", "s", F.explode(F.when(short, F.concat(every, F.array(F.lit(NO_MINIMUM)))).otherwise(every)).alias("bits")).select(
        "item_id", F.explode(_keyed(F.when(short, F.col("s")).otherwise(signature()))).alias("key")
    )
    small = hashed.count() * 42 <= broadcast_rows
    wanted = F.broadcast(wanted) if small else wanted.hint("merge")
    pairs = stored(sketch.join(wanted, "key").select("doc_id", "row_key", "item_id").distinct(), "contamination-pairs")
    return _verified(own, pairs, hashed, threshold, small, broadcast_texts, keyed)


def _verified(own: DataFrame, pairs: DataFrame, hashed: DataFrame, threshold: float, small: bool, broadcast_texts: int, keyed: bool) -> DataFrame:
    """Exact containment of the candidate pairs; only the candidates' texts are shingled again. Where their keys are few
    they go to the texts, which then need no shuffle."""
    ids = stored(pairs.select("row_key").distinct(), "contamination-texts")
    ids = F.broadcast(ids) if ids.count() <= broadcast_texts else ids.hint("merge")
    again = with_shingles(own.join(ids, "row_key", "left_semi").select("row_key", "text")).select("row_key", _each("s").alias("h"))
    total = hashed.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    if small:
        hashed, total = F.broadcast(hashed), F.broadcast(total)
    shared = again.join(hashed, "h").groupBy("row_key", "item_id").agg(F.count_distinct("h").alias("n_shared"))
    share = F.col("n_shared") / F.col("n_item")
    return shared.join(pairs, ["row_key", "item_id"]).join(total, "item_id").filter(share >= threshold).select(
        "doc_id", "item_id", F.col("n_item").cast("long"), F.col("n_shared").cast("long"), share.alias("containment"), *(["row_key"] if keyed else [])
    )


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_W = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_S = "unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))))"
OP8_SQL = f"""
    WITH i AS (SELECT DISTINCT item_id, {_S} AS s FROM (SELECT item_id, {_W} AS w FROM benchmark) WHERE len(w) >= 5),
         d AS (SELECT DISTINCT doc_id, {_S} AS s FROM (SELECT doc_id, {_W} AS w FROM documents) WHERE len(w) >= 5),
         n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id)
    SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
    FROM d JOIN i USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) >= {CONTAINMENT} * n_item"""
