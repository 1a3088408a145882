"""One query per training-data operator over its whole table, and the SQL that the driver compares it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import op11_alignment
from .common import table
from .decontamination import OP8_SQL, op8_decontamination
from .divergence import OP12_SQL, op12_divergence
from .exact_dedup import exact_dedup
from .html_text import op3_html_text
from .kd_sharding import kd_shards
from .language_id import op1_language_id
from .mixing import OP13_SQL, op13_mixing
from .packing import pack_documents
from .pii import OP7_SQL, op7_pii
from .quality import op4_quality
from .set_join import op10_set_join
from .substring_dedup import op6_substring_dedup

SHARDS = 24


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards(table(spark, sf_dir, "documents"), n_shards=SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_kd_sharding": op2_kd_sharding,
    "op3_html_text": op3_html_text,
    "op4_quality": op4_quality,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_pii": op7_pii,
    "op8_decontamination": op8_decontamination,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_set_join": op10_set_join,
    "op11_alignment": op11_alignment,
    "op12_divergence": op12_divergence,
    "op13_mixing": op13_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op7_pii": OP7_SQL,
    "op8_decontamination": OP8_SQL,
    "op12_divergence": OP12_SQL,
    "op13_mixing": OP13_SQL,
    "op9_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS kept,
               sha256(norm) AS text_sha256
        FROM n""",
}
