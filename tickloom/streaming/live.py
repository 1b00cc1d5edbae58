"""Bars, scores, latest predictions and accuracy over streams."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.scalars import flag, truth
from ..operators.catalogue import build_features
from ..operators.monitor import signal_record
from ..session import shared_dir
from ..sources.bars import last_n_per_symbol, unique_bars

LATE = "10 minutes"


def workspace(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, folder: str, name: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A table file (or folder of files) as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def land_in_order(rows: DataFrame, folder: str, order: str, files: int) -> None:
    """Rows as several files, one written after the other in event-time order, as a collector lands them.

    A file stream takes files by the time they were written, and a watermark drops what comes too
    late behind it. A backlog that is read in several triggers must therefore have been landed in
    order; files written in parallel have no order.
    """
    at = F.col(order).cast("timestamp").cast("double")
    borders = rows.select(F.percentile_approx(at, [k / files for k in range(1, files)], 10_000)).first()[0] if files > 1 else []
    for low, high in zip([None, *borders], [*borders, None], strict=True):
        part = rows if low is None else rows.where(at > low)
        part = part if high is None else part.where(at <= high)
        part.coalesce(1).sortWithinPartitions(order).write.mode("append").parquet(folder)


def stream_bars(ticks: DataFrame, interval: str = "1 hour", late: str = LATE) -> DataFrame:
    """Ticks ``(symbol, ts, price, qty, seq)`` to bars per window; rows later than ``late`` are dropped."""
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", interval).alias("w"))
        .agg(
            F.min_by("price", "seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"),
            F.sum("qty").alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def latest_prediction(predictions: DataFrame) -> DataFrame:
    """Latest record per symbol; the state is one row per symbol."""
    return predictions.groupBy("symbol").agg(
        F.max_by(F.struct("ts", "prediction", "confidence", "signal"), "ts").alias("r")
    ).select("symbol", "r.ts", "r.prediction", "r.confidence", "r.signal")


def live(latest: DataFrame, as_of, ttl_seconds: int = 300) -> DataFrame:
    """Entries that have not expired."""
    return latest.where(F.col("ts") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_seconds)))


LATEST = "symbol string, ts timestamp, prediction double, confidence double, signal string"


def latest_expiring(predictions: DataFrame, ttl_seconds: int = 300) -> DataFrame:
    """Latest record per symbol with its expiry in the state: an update when it changes, and one
    with ``live`` false when event time has passed it by ``ttl_seconds``, after which the symbol
    holds no state."""

    def follow(key, frames, state):
        names = ["ts", "prediction", "confidence", "signal"]
        if state.hasTimedOut:
            ts, *rest = state.get
            state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(ts, unit="us"), *rest, False)], columns=["symbol", *names, "live"])
            return
        newest = state.get if state.exists else None
        for frame in frames:
            row = frame.loc[frame["ts"].idxmax(), names]
            at = row["ts"].value // 1000
            if newest is None or at >= newest[0]:
                newest = (at, float(row["prediction"]), float(row["confidence"]), str(row["signal"]))
        ends = newest[0] // 1000 + ttl_seconds * 1000
        live = ends > state.getCurrentWatermarkMs()
        if live:
            state.update(newest)
            state.setTimeoutTimestamp(ends)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], pd.Timestamp(newest[0], unit="us"), *newest[1:], live)], columns=["symbol", *names, "live"])

    rows = predictions.select("symbol", "ts", "prediction", "confidence", "signal").withWatermark("ts", "0 seconds")
    state = "ts long, prediction double, confidence double, signal string"
    return rows.groupBy("symbol").applyInPandasWithState(follow, f"{LATEST}, live boolean", state, "update", GroupStateTimeout.EventTimeTimeout)


def run_updates(df: DataFrame, label: str, key: str = "symbol") -> DataFrame:
    """Run an update-mode stream over what is there now; the last row of each key."""
    out = workspace(df.sparkSession, label)
    run_batches(df, label, lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/v={i}"), mode="update")
    rest = [n for n in df.columns if n != key]
    rows = df.sparkSession.read.schema(df.schema.add("v", "long")).parquet(out)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "v").alias("_r"))
    return last.select(key, *[F.col("_r")[n].alias(n) for n in rest])


def stream_accuracy(history: DataFrame, size: str = "1 day", slide: str = "1 hour", late: str = LATE) -> DataFrame:
    """Share of right directions per symbol in sliding windows of event time.

    Rows are counted once, in panes as long as the slide; a window merges its panes. So a row is not
    copied into every window it lies in, only a pane is. ``size`` is a multiple of ``slide``.
    """
    right = truth(F.col("prediction") > 0.5) == truth(F.col("actual_return") > 0)
    panes = (
        history.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", slide).alias("pane"))
        .agg(F.sum(flag(right)).alias("rights"), F.count(F.lit(1)).alias("n"))
    )
    return (
        panes.groupBy("symbol", F.window(F.window_time("pane"), size, slide).alias("w"))
        .agg(F.sum("rights").alias("rights"), F.sum("n").alias("total_predictions"))
        .select("symbol", F.col("w.end").alias("window_end"), (F.col("rights") / F.col("total_predictions")).alias("accuracy"), "total_predictions")
    )


def run_append(df: DataFrame, label: str) -> DataFrame:
    """Run an append-mode stream over what is there now; returns the written rows."""
    spark = df.sparkSession
    out, checkpoint = workspace(spark, label), workspace(spark, f"{label}-checkpoint")
    query = (
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if lost := dropped_late(query):
        warnings.warn(f"{label}: {lost} rows came later than the watermark allows and were dropped", stacklevel=2)
    return spark.read.schema(df.schema).parquet(out)


def dropped_late(query) -> int:
    """Rows that a finished query dropped as late, as its progress reports count them."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


def run_batches(df: DataFrame, label: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run a stream through a batch handler over what is there now."""
    checkpoint = workspace(df.sparkSession, f"{label}-checkpoint")
    query = (
        df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_complete(df: DataFrame, label: str) -> DataFrame:
    """Run a complete-mode aggregation; the last table is returned."""
    spark = df.sparkSession
    out = workspace(spark, label)
    run_batches(df, label, lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/v={i}"), mode="complete")
    versions = spark.read.schema(df.schema.add("v", "long")).parquet(out)
    newest = versions.agg(F.max("v").alias("v"))
    return versions.join(newest, "v", "left_semi").select(*df.columns)


BUCKETS = 32


class StreamScorer:
    """Scores the newest bar that a micro-batch brings for each symbol.

    The last ``buffer`` bars of each symbol are kept in buckets of symbols; a batch writes a new
    version of the buckets it touches, from the version before it, and removes older ones. A batch
    that runs again reads and writes the same versions. Of repeated bars the batch's own one holds.
    The features come from the batch builder, the score from a function over feature rows, such as
    that of a fitted model.
    """

    def __init__(self, path: str, score: Callable[[DataFrame], DataFrame], columns: Sequence[str], buffer: int = 1000, minimum: int = 50):
        self.path, self.score, self.columns = path, score, list(columns)
        self.buffer, self.minimum = buffer, minimum

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.expr(f"pmod(xxhash64(symbol), {BUCKETS})").cast("int").alias("bucket")
        new = unique_bars(batch.select("symbol", "ts", "open", "high", "low", "close", "volume")).select("*", bucket)
        new.persist()
        try:
            touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most BUCKETS numbers
            before = {b: self._newest(spark, b, batch_id) for b in touched}
            rows = new
            if old := [self._folder(v, b) for b, v in before.items() if v is not None]:
                kept = spark.read.schema(new.drop("bucket").schema).parquet(*old).select("*", bucket)
                rows = new.unionByName(kept.join(new.select("symbol", "ts"), ["symbol", "ts"], "left_anti"))
            last_n_per_symbol(rows, self.buffer).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/state/v={batch_id}")
            state = spark.read.schema(new.schema).parquet(f"{self.path}/state/v={batch_id}").drop("bucket")
            newest = new.groupBy("symbol").agg(F.max("ts").alias("ts"))
            ready = state.groupBy("symbol").count().where(F.col("count") >= self.minimum).select("symbol")
            history = state.join(newest.join(ready, "symbol").select("symbol"), "symbol", "left_semi")
            features = build_features(history, columns=self.columns, group_rows=self.buffer)
            scored = self.score(features.join(newest, ["symbol", "ts"], "left_semi"))
            signal_record(scored).write.mode("overwrite").parquet(f"{self.path}/signals/v={batch_id}")
        finally:
            new.unpersist()
        for b, v in before.items():
            self._remove_before(spark, b, v)

    def _folder(self, version: int, bucket: int) -> str:
        return f"{self.path}/state/v={version}/bucket={bucket}"

    def _versions(self, spark: SparkSession, bucket: int) -> list[int]:
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state/v=*/bucket={bucket}")
        found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root)
        return sorted(int(f.getPath().getParent().getName()[2:]) for f in found or [])

    def _newest(self, spark: SparkSession, bucket: int, batch_id: int) -> int | None:
        return max((v for v in self._versions(spark, bucket) if v < batch_id), default=None)

    def _remove_before(self, spark: SparkSession, bucket: int, version: int | None) -> None:
        """The version that a batch was made from stays, in case the batch runs again."""
        for v in self._versions(spark, bucket):
            if version is not None and v < version:
                path = spark._jvm.org.apache.hadoop.fs.Path(self._folder(v, bucket))
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def signals(self, spark: SparkSession) -> DataFrame:
        schema = "symbol string, ts timestamp, prediction double, confidence double, signal string, v long"
        return spark.read.schema(schema).parquet(f"{self.path}/signals")
