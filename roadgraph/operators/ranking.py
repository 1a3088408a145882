"""Places of rows in their groups without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadgraph.plans.loops import kept


def ranked(df: DataFrame, group: str, order: list[Column], place: str, size: str | None = None) -> DataFrame:
    """Adds place, the number of a row in its group from 1 by order, and size, how many rows the group has.

    Rows are dealt by ranges of group and order, so a large group lies in many parts. Each part numbers its own rows of a group and
    adds what earlier parts hold of it; these counts are all that is gathered, a row for each group and part. Null groups are a
    group, null values come where order puts them, and rows that order does not tell apart are numbered in any order.
    """
    dealt = kept(df.repartitionByRange(F.col(group), *order).withColumn("part_of_rank", F.spark_partition_id()))
    counts = dealt.groupBy(F.col(group).alias("group_of_run"), F.col("part_of_rank").alias("run")).agg(F.count(F.lit(1)).alias("n_of_run"))
    own = Window.partitionBy("group_of_run")
    earlier = F.sum("n_of_run").over(own.orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    runs = counts.select("group_of_run", "run", F.coalesce(earlier, F.lit(0)).alias("before_run"), F.sum("n_of_run").over(own).alias("size_of_group"))
    nth = F.row_number().over(Window.partitionBy(group, "part_of_rank").orderBy(*order))
    met = dealt.withColumn("nth_of_run", nth).join(runs, F.col(group).eqNullSafe(F.col("group_of_run")) & (F.col("part_of_rank") == F.col("run")))
    return met.select(*df.columns, (F.col("before_run") + F.col("nth_of_run")).alias(place), *([F.col("size_of_group").alias(size)] if size else []))
