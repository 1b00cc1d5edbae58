"""Token ids as flat unsigned integer files with 64-bit document offsets, memory-mapped when read.

The documents are range-partitioned by key once; every partition writes one shard: ``ids-N`` (the
ids, 16 bits if the vocabulary allows, else 32), ``ends-N`` (int64, the end of each document within
the shard) and ``keys-N`` (Arrow, the keys in the same order). A shard's place in the whole is the
sum of the ids of the shards before it. Files are written under a private name and renamed, so a
task that runs again leaves the same shard.
"""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mounted, or_empty, run_folder, text_rows
from .tokens import DEFAULT_VOCABULARY, word_bpe

ROWS_READ = 512


def _id_type(vocabulary: str) -> str:
    return "<u2" if word_bpe(vocabulary).library.get_vocab_size() <= 1 << 16 else "<u4"


def write(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", end_id: int = 2, vocabulary: str = DEFAULT_VOCABULARY, shards: int | None = None) -> DataFrame:
    """Write the shards below ``folder``; the manifest: ``shard``, ``n_docs``, ``n_ids``.

    Documents are in ascending order of key, NULL keys first, those with equal keys ordered by a
    hash of their text. Every row is a document; NULL and empty texts are the end id alone. An
    empty table writes no shard and gives an empty manifest. ``shards`` defaults to the number of
    shuffle partitions.
    """
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = mounted(folder)
    rows = docs.select(F.col(key).alias("key"), or_empty(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, own = context.partitionId(), f".{context.taskAttemptId()}"
        bpe, end, kind = word_bpe(vocabulary), np.array([end_id], "<u4").tobytes(), _id_type(vocabulary)
        gc.disable()
        os.makedirs(path, exist_ok=True)
        names = {what: f"{path}/{what}-{shard:05d}" for what in ("ids", "ends", "keys")}
        done, docs_done, keys = 0, 0, None
        with open(names["ids"] + own, "wb") as ids_file, open(names["ends"] + own, "wb") as ends_file:
            for batch in batches:
                for kept, texts in text_rows(batch, ["key"], "text"):
                    if keys is None:
                        keys = pa.ipc.new_file(names["keys"] + own, kept.schema)
                    keys.write_batch(kept)
                    raw = [bpe.encode(t) + end for t in texts]
                    ends = done + np.cumsum([len(r) // 4 for r in raw], dtype="<i8")
                    ids_file.write(np.frombuffer(b"".join(raw), "<u4").astype(kind).tobytes())
                    ends_file.write(ends.tobytes())
                    done, docs_done = int(ends[-1]), docs_done + len(texts)
        if keys is not None:
            keys.close()
            for name in names.values():
                os.replace(name + own, name)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": [docs_done], "n_ids": [done]})
        else:
            os.remove(names["ids"] + own)
            os.remove(names["ends"] + own)

    manifest = f"{folder}/manifest"
    dealt.mapInArrow(run, schema).write.parquet(manifest)
    return spark.read.schema(schema).parquet(manifest)


def read(spark: SparkSession, folder: str, key_type: T.DataType = T.LongType(), vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The documents of a folder: ``key``, ``start`` (ids before it over all shards), ``ids`` (unsigned 32-bit, little-endian)."""
    path, kind = mounted(folder), _id_type(vocabulary)
    manifest = spark.read.parquet(f"{folder}/manifest")
    # One row per shard: the running sum is over as many rows as there are files.
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    based = manifest.withColumn("base", F.coalesce(before, F.lit(0))).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard")
    schema = T.StructType([T.StructField("key", key_type), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if not row["n_docs"]:
                    continue
                ids = np.memmap(f"{path}/ids-{row['shard']:05d}", kind, "r")
                ends = np.memmap(f"{path}/ends-{row['shard']:05d}", "<i8", "r")
                with pa.memory_map(f"{path}/keys-{row['shard']:05d}") as source:
                    keys = pa.ipc.open_file(source).read_all().column(0).combine_chunks()
                    for a in range(0, len(ends), ROWS_READ):
                        stop = ends[a : a + ROWS_READ]
                        first = np.concatenate([ends[a - 1 : a] if a else np.zeros(1, "<i8"), stop[:-1]])
                        raw = [ids[x:y].astype("<u4").tobytes() for x, y in zip(first.tolist(), stop.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([keys.slice(a, len(raw)).cast(pa.int64()) if key_type == T.LongType() else keys.slice(a, len(raw)), pa.array(first + row["base"], pa.int64()), pa.array(raw, pa.binary())], ["key", "start", "ids"])

    return based.mapInArrow(run, schema)


def stored(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the shards and read them back: place, length and checksum of every document."""
    spark = docs.sparkSession
    folder = folder or run_folder(spark, "flat-ids")
    write(docs, folder)
    back = read(spark, folder, docs.schema["doc_id"].dataType)
    return back.select(F.col("key").alias("doc_id"), "start", F.expr("CAST(octet_length(ids) / 4 AS BIGINT)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
