"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgraph.plans.loops import shared_dir

#: A word is a run of characters other than these six.
BLANKS = r"\x20\x09-\x0D"
#: Rows and bytes that one Arrow batch hands to Python, whichever limit is met first; one longer row is a batch of its own.
ARROW_ROWS = 1000
ARROW_BYTES = 16 << 20
#: Tables of one row for each group are broadcast up to this many rows; more are joined by sorting, with salts.
GROUP_ROWS = 100_000
SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session where nobody has set them. The setting stays, as plans read it when they run."""
    limits = {"maxRecordsPerBatch": ("10000", ARROW_ROWS), "maxBytesPerBatch": ("67108864b", ARROW_BYTES)}
    for name, (usual, ours) in limits.items():
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", usual) == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(ours))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as a table in the shared folder and reads it back, so later jobs don't compute it again
    and a lost executor costs nothing. Whoever owns the folder clears it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least so many; for narrow rows, whose batches are sized for texts."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def blocks(batches: Iterator[pa.RecordBatch], text: int, size: int, rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in blocks of about size bytes of text (the column of that number) or of so many rows, whichever is met
    first. A longer text is a block of its own."""
    held: list[pa.RecordBatch] = []
    full, n = 0, 0
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(text)), 0).to_pylist()
        start = 0
        for i, own in enumerate(lengths):
            if n and (full + own > size or n == rows):
                held.append(b.slice(start, i - start))
                yield pa.concat_batches(held)
                held, start, full, n = [], i, 0, 0
            full, n = full + own, n + 1
        held.append(b.slice(start))
    if n:
        yield pa.concat_batches(held)


def with_groups(df: DataFrame, groups: DataFrame, keys: list[str], n_groups: int) -> DataFrame:
    """df with the columns of its row in groups, which has n_groups rows, one for each key; keys are never null. Up to
    GROUP_ROWS groups are broadcast; beyond, every group is there once for each salt, and rows of a hot key are shared."""
    if n_groups <= GROUP_ROWS:
        return df.join(F.broadcast(groups), keys)
    salted = groups.withColumn("salt_of_row", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = df.withColumn("salt_of_row", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    return own.join(salted.hint("merge"), [*keys, "salt_of_row"]).drop("salt_of_row")


def text_of(col: str | Column) -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def row_key(id_: Column, text: Column) -> Column:
    """16 bytes that tell rows apart by id and text; null ids and null texts have keys as well. Rows with equal keys are
    the same document for every operator here: they differ in other columns at most."""
    known = F.when(id_.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), id_.cast("string"), F.lit(" ")))
    return F.unhex(F.md5(F.concat(known, text_of(text)).cast("binary")))


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id written as text, as the folds use it."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def row_parts(n_rows: int, per_part: int) -> int:
    """Parts of at most about per_part rows."""
    return max(1, -(-n_rows // per_part))


def drawn(u: str | Column, most: int, n: int) -> Column:
    """Whether the 64-bit hash u is among the share most / n of all hashes; as fine as the hash, so no n is too large."""
    return F.shiftrightunsigned(u, 1) < F.lit(int(most * 2**63 // max(n, most, 1)) - 1)
