"""Small helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Words are runs of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def run_folder(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared checkpoint folder; nothing is created yet."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows written once to the shared folder and read again: later steps survive lost executors."""
    folder = run_folder(df.sparkSession, what)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def mounted(uri: str) -> str:
    """The path of a folder that driver and executors all mount, for files that are memory-mapped."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"memory-mapped files need a shared folder that is mounted on every host, not {uri}")
    return uri


def slices(texts: Iterable[str], limit: int = 4_000_000) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` characters together, so that lists of their words stay small."""
    held: list[str] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def text_rows(batch: pa.RecordBatch, keep: list[str], text: str, limit: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch in runs of about ``limit`` characters: the kept columns and the texts (NULL: empty)."""
    texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
    kept = batch.select(keep)
    at = 0
    for part in slices(texts, limit):
        yield kept.slice(at, len(part)), part
        at += len(part)


def taken(it: Iterator, n: int) -> list:
    return list(islice(it, n))
