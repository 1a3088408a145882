"""What loops to a fixpoint need: cut lineage into the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Most rows of a stored table that a join may send whole to every executor.
WHOLE = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may leave that unset."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="roadgraph-"))
        found = context.getCheckpointDir()
    return found


def kept(df: DataFrame) -> DataFrame:
    """df, computed once, written as a table in the shared folder and read back; a lost executor costs nothing. Whoever owns
    the folder clears it."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame) -> DataFrame:
    """A stored table of few columns, marked for joins by its number of rows. Spark goes by the size of its files, in which graph_id
    and small numbers take a few bits each, and would gather millions of rows in the driver to send them out. Of two
    marked tables the small one is sent; two large ones are sorted."""
    return df.hint("merge" if df.count() > WHOLE else "broadcast")
