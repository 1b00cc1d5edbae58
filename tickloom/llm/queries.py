"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, flat_ids, language_id, line_dedup, line_rules, lm_score, merkle, multiset_hash, near_dup, packing, spelling, warc, wrappers
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_context_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return lm_score.scored(table(spark, sf, "documents"))


def op2_wrappers(spark: SparkSession, sf: str) -> DataFrame:
    return wrappers.digest(table(spark, sf, "pages"))


def op3_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf, "documents"))


def op4_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf, "documents"), words=4)


def op5_warc_index(spark: SparkSession, sf: str) -> DataFrame:
    return warc.digest(table(spark, sf, "pages"))


def op6_multiset_hash(spark: SparkSession, sf: str) -> DataFrame:
    return multiset_hash.digest(table(spark, sf, "documents"))


def op7_flat_ids(spark: SparkSession, sf: str) -> DataFrame:
    return flat_ids.stored(table(spark, sf, "documents"))


def op8_line_rules(spark: SparkSession, sf: str) -> DataFrame:
    return line_rules.judged(table(spark, sf, "documents")).select("doc_id", *line_rules.COLUMNS)


def op9_site_lines(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf, "documents"))


def op10_retrieval_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.digest(table(spark, sf, "documents"))


def op11_variable_grams(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.grouped(table(spark, sf, "documents"))


def op12_output_codes(spark: SparkSession, sf: str) -> DataFrame:
    return language_id.digest(table(spark, sf, "documents"))


def op13_merkle_versions(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.audited(table(spark, sf, "documents"))


QUERIES: dict[str, Query] = {
    "op1_context_mixing": op1_context_mixing,
    "op2_wrappers": op2_wrappers,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_warc_index": op5_warc_index,
    "op6_multiset_hash": op6_multiset_hash,
    "op7_flat_ids": op7_flat_ids,
    "op8_line_rules": op8_line_rules,
    "op9_site_lines": op9_site_lines,
    "op10_retrieval_packing": op10_retrieval_packing,
    "op11_variable_grams": op11_variable_grams,
    "op12_output_codes": op12_output_codes,
    "op13_merkle_versions": op13_merkle_versions,
}

#: DuckDB SQL for the queries that SQL can express; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op5_warc_index": warc.DIGEST_SQL,
    "op8_line_rules": line_rules.judged_sql("documents"),
    "op9_site_lines": line_dedup.DIGEST_SQL,
    "op11_variable_grams": spelling.grouped_sql("documents"),
    "op13_merkle_versions": merkle.audit_sql("documents"),
}
