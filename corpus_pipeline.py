"""From raw documents to packed training sequences: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir); all but the last return rows of docs with all their columns, whatever these
are called. Stages tell rows apart by id and text (row_key), so rows with a null id, and rows that repeat an id with
another text, are documents of their own. Of rows with equal id and text the first two copies' stages keep one (they
differ in other columns at most, and any one stays); the stages before and after keep or drop them all. A null text
counts as empty. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadgraph.llm import decontamination, exact_dedup, packing, quality, set_join
from roadgraph.llm.common import free_name, row_key, stored, table


def _rows(docs: DataFrame, keys: DataFrame, how: str, once: bool = False) -> DataFrame:
    """Rows of docs whose row_key is (left_semi) or is not (left_anti) in keys; by sorting, as keys may be many.
    once: of rows with one key only one."""
    key, at = free_name(docs, "key_of_row"), free_name(docs, "place_of_row")
    found = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))).join(keys.select(F.col("row_key").alias(key)).distinct().hint("merge"), key, how)
    if once:
        found = found.withColumn(at, F.row_number().over(Window.partitionBy(key).orderBy(key))).filter(F.col(at) == 1)
    return found.select(docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Every row is judged by its text alone."""
    return quality.keep_good(docs, quality.fitted(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays, then the smallest id (a null id last), then the least row_key."""
    return _rows(docs, exact_dedup.exact_dedup(docs, keyed=True).filter("kept"), "left_semi", once=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays (a null id last), then the least row_key.
    Texts without words are linked with nothing and stay."""
    groups = set_join.similar_groups(docs, keyed=True)
    return _rows(docs, groups.filter("first"), "left_semi", once=True)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _rows(docs, decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"), keyed=True), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset; every row of docs is packed."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: SQL can't express the classifier, the tokenizer and the packing; tests/llm compare all stages with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's rows are written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs
