"""The corpus pipeline: quality rules, line dedup, near copies, packing.

Each stage takes the documents that the one before it wrote. Cleaned texts replace the texts, and
``n_chars`` follows. Rejected documents and the copies of a document go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import line_dedup, line_rules, near_dup, packing
from tickloom.llm.common import run_folder, table


def _bare(docs: DataFrame) -> DataFrame:
    """The columns that a stage reads, and all others in one struct, so that no name clashes with the stage's own."""
    read = [c for c in ("text", "source") if c in docs.columns]
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    return docs.select(*read, F.struct(*rest).alias("__rest"))


def _with_text(docs: DataFrame, cleaned: DataFrame) -> DataFrame:
    """The columns of ``docs``, with the clean text as the text (a NULL text stays NULL)."""
    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("clean_text"))
    columns = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return cleaned.select(*[(columns[c] if c in columns else F.col("__rest")[c]).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(docs, line_rules.kept(_bare(docs)))


def site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(docs, line_dedup.dedup(_bare(docs)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(docs, cache_share=0.3)  # workers of the earlier stages are still there


STAGES = [("quality_rules", quality), ("line_dedup", site_lines), ("near_duplicates", near_copies), ("packing", packed)]

#: Neither near copies over MinHash nor packing can be said in SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = run_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
