"""JSON messages on a broker: reading, routing, writing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TICK = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("timestamp", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in ("open", "high", "low", "close")]
    + [T.StructField("volume", T.LongType()), T.StructField("source", T.StringType())]
)
PREDICTION = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("timestamp", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in ("prediction", "confidence")]
    + [T.StructField("signal", T.StringType())]
)


def kafka_source(
    spark: SparkSession, servers: str, topics: Sequence[str], starting: str = "latest", max_offsets: int | None = None
) -> DataFrame:
    """Raw messages of several topics. ``max_offsets``, if given, bounds a micro-batch; what does
    not fit waits in the broker, nothing is dropped. Offsets live in the query's checkpoint."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", starting)
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load()


def parse_messages(raw: DataFrame, schema: T.StructType = TICK, topic: str | None = None) -> DataFrame:
    """Messages of one topic as rows, with ``ts`` as event time."""
    if topic is not None:
        raw = raw.where(F.col("topic") == topic)
    rows = raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")
    return rows.withColumn("ts", F.to_timestamp("timestamp")).drop("timestamp")


def to_messages(rows: DataFrame) -> DataFrame:
    """``key`` is the symbol, ``value`` the row as JSON."""
    return rows.select(F.col("symbol").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))


def kafka_sink(rows: DataFrame, servers: str, topic: str, checkpoint: str, every: str = "1 second"):
    return (
        to_messages(rows)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.acks", "all")
        .option("kafka.retries", 3)
        .option("kafka.batch.size", 1000)
        .option("kafka.linger.ms", 100)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .start()
    )


def processors(*callbacks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Several callbacks over one micro-batch; the rows are read from the source once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for call in callbacks:
                call(batch, batch_id)
        finally:
            batch.unpersist()

    return run
