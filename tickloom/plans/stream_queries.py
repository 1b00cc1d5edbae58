"""Streaming queries: file streams over the given tables, run until they have caught up."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import grid
from ..functions.series import as_series
from ..operators import ensemble as E
from ..operators.catalogue import build_features
from ..operators.monitor import signal_record
from ..operators.targets import add_target
from ..streaming import live as L
from ..streaming.keyed import Position, Return, Rsi, keyed_scores
from ..streaming.messages import PREDICTION, TICK, parse_messages, processors, to_messages
from . import datasets as D
from .oracles.base import rnd
from .registry import ORACLES, query, rounded

TICKS = "tk AS (SELECT event_type AS symbol, ts, round(value * 100) AS price, event_id AS seq FROM events)"
CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


def minute(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = D.table(spark, sf, "events").schema
    raw = L.stream_table(spark, sf, "events.parquet", schema)
    return raw.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
        F.round(F.col("value") * 100).alias("price"), F.lit(1.0).alias("qty"), F.col("event_id").alias("seq"),
    )


@query(
    "stream_bars",
    f"""WITH {TICKS}, hb AS (SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts) AS hour, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, seq) AS close, CAST(count(*) AS DOUBLE) AS volume FROM tk GROUP BY 1, 2)
    SELECT symbol, strftime(hour, '%Y-%m-%d %H:%M:%S') AS ts, open, high, low, close, volume FROM hb WHERE hour + INTERVAL 1 HOUR <= {CLOSED}""",
)
def stream_bars(spark: SparkSession, sf: str) -> DataFrame:
    out = L.run_append(L.stream_bars(event_stream(spark, sf)), "stream-bars")
    return out.select("symbol", minute("ts"), "open", "high", "low", "close", "volume")


def parted(spark: SparkSession, sf: str, files: int) -> str:
    """The ticks as several files in event-time order, as a collector would land them."""
    path = L.workspace(spark, "ticks")
    L.land_in_order(D.ticks(spark, sf), path, "ts", files)
    return path


def file_by_file(spark: SparkSession, sf: str) -> DataFrame:
    """The ticks as a backlog of files, one per trigger."""
    return L.stream_table(spark, parted(spark, sf, 4), "*.parquet", D.ticks(spark, sf).schema, files_per_trigger=1)


FEED = f"""{TICKS}, fd AS (SELECT symbol, ts, (CAST(price AS BIGINT) % 1000) / 1000.0 AS prediction, CAST(price AS BIGINT) % 7 - 3 AS actual_return FROM tk)"""


def prediction_feed(ticks: DataFrame) -> DataFrame:
    p = F.col("price").cast("bigint")
    return ticks.select("symbol", "ts", (p % 1000 / F.lit(1000.0)).alias("prediction"), (p % 7 - 3).cast("double").alias("actual_return"))


@query(
    "stream_latest_prediction",
    f"""WITH {FEED}, la AS (SELECT symbol, max(ts) AS ts, arg_max(prediction, ts) AS prediction FROM fd GROUP BY symbol)
    SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, prediction, {rnd('abs(prediction - 0.5) * 2', 6)} AS confidence,
    CASE WHEN prediction > 0.6 THEN 'BUY' WHEN prediction < 0.4 THEN 'SELL' ELSE 'HOLD' END AS signal FROM la
    WHERE ts >= TIMESTAMP '2024-01-30 23:59:00' - INTERVAL 300 SECOND""",
)
def stream_latest_prediction(spark: SparkSession, sf: str) -> DataFrame:
    records = signal_record(prediction_feed(event_stream(spark, sf)))
    latest = L.live(L.run_complete(L.latest_prediction(records), "latest"), "2024-01-30 23:59:00", 300)
    return rounded(latest, {"confidence": 6}, ["symbol", minute("ts"), "prediction", "signal"])


@query(
    "stream_latest_expiring",
    f"""WITH {FEED}, la AS (SELECT symbol, max(ts) AS ts, arg_max(prediction, ts) AS prediction FROM fd GROUP BY symbol)
    SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, prediction, {rnd('abs(prediction - 0.5) * 2', 6)} AS confidence,
    CASE WHEN prediction > 0.6 THEN 'BUY' WHEN prediction < 0.4 THEN 'SELL' ELSE 'HOLD' END AS signal,
    epoch_ms(ts) + 600000 > (SELECT max(epoch_ms(ts)) FROM fd) AS live FROM la""",
)
def stream_latest_expiring(spark: SparkSession, sf: str) -> DataFrame:
    """The latest records of all symbols, those that have expired marked by the state's own timeout."""
    records = signal_record(prediction_feed(file_by_file(spark, sf)))
    latest = L.run_updates(L.latest_expiring(records, 600), "latest-expiring")
    return rounded(latest, {"confidence": 6}, ["symbol", minute("ts"), "prediction", "signal", "live"])


@query(
    "stream_accuracy",
    f"""WITH {FEED}, ex AS (SELECT symbol, prediction, actual_return, unnest(generate_series(time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR,
      time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS window_end FROM fd)
    SELECT symbol, strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end, {rnd('avg(CAST((prediction > 0.5) = (actual_return > 0) AS DOUBLE))', 6)} AS accuracy,
    count(*) AS total_predictions FROM ex WHERE window_end <= {CLOSED} GROUP BY 1, 2""",
)
def stream_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    out = L.run_append(L.stream_accuracy(prediction_feed(event_stream(spark, sf))), "accuracy")
    return rounded(out, {"accuracy": 6}, ["symbol", minute("window_end"), "total_predictions"])


def two_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks and predictions as messages of two topics in one stream."""
    ticks = event_stream(spark, sf)
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")
    p = F.col("price")
    market = to_messages(ticks.select("symbol", iso, *[p.alias(n) for n in ("open", "high", "low", "close")], F.lit(1).cast("bigint").alias("volume"), F.lit("events").alias("source")))
    scored = signal_record(prediction_feed(ticks)).select("symbol", iso, "prediction", "confidence", "signal")
    return market.withColumn("topic", F.lit("market_data")).unionByName(to_messages(scored).withColumn("topic", F.lit("predictions")))


@query(
    "stream_multi_topic",
    f"""WITH {FEED} SELECT 'market_data' AS topic, symbol, count(*) AS messages, sum(price) AS total FROM tk GROUP BY symbol
    UNION ALL SELECT 'predictions', symbol, count(*), {rnd('sum(prediction)', 3)} FROM fd GROUP BY symbol""",
)
def stream_multi_topic(spark: SparkSession, sf: str) -> DataFrame:
    """One stream, two topics, each parsed with its own schema."""
    raw = two_topics(spark, sf)
    market = parse_messages(raw, TICK, "market_data").select(F.lit("market_data").alias("topic"), "symbol", F.col("close").alias("value"))
    scored = parse_messages(raw, PREDICTION, "predictions").select(F.lit("predictions").alias("topic"), "symbol", F.col("prediction").alias("value"))
    out = L.run_append(market.unionByName(scored), "topics")
    return out.groupBy("topic", "symbol").agg(F.count(F.lit(1)).alias("messages"), grid(F.sum("value"), 3).alias("total"))


@query("kafka_source", f"WITH {TICKS} SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, price AS close, CAST(1 AS BIGINT) AS volume FROM tk")
def kafka_source(spark: SparkSession, sf: str) -> DataFrame:
    """The consumer's parser over a stream of JSON messages (a file stream stands in for the broker)."""
    out = L.run_append(parse_messages(two_topics(spark, sf), TICK, "market_data"), "consumer")
    return out.select("symbol", minute("ts"), "close", "volume")


@query(
    "foreach_processor",
    f"WITH {TICKS} SELECT 'count' AS processor, symbol, CAST(count(*) AS DOUBLE) AS value FROM tk GROUP BY symbol UNION ALL SELECT 'turnover', symbol, sum(price) FROM tk GROUP BY symbol",
)
def foreach_processor(spark: SparkSession, sf: str) -> DataFrame:
    """Two callbacks over the same micro-batches."""
    path = L.workspace(spark, "processors")

    def into(name: str, agg):
        def call(batch: DataFrame, batch_id: int) -> None:
            batch.groupBy("symbol").agg(agg.cast("double").alias("value")).write.mode("overwrite").parquet(f"{path}/processor={name}/v={batch_id}")

        return call

    handle = processors(into("count", F.count(F.lit(1))), into("turnover", F.sum("price")))
    L.run_batches(event_stream(spark, sf), "processors", handle)
    rows = spark.read.schema("symbol string, value double, processor string, v long").parquet(path)
    return rows.groupBy("processor", "symbol").agg(F.sum("value").alias("value"))


@query("stream_bars_files", ORACLES["stream_bars"])
def stream_bars_files(spark: SparkSession, sf: str) -> DataFrame:
    out = L.run_append(L.stream_bars(file_by_file(spark, sf)), "stream-bars-files")
    return out.select("symbol", minute("ts"), "open", "high", "low", "close", "volume")


@query("stream_accuracy_files", ORACLES["stream_accuracy"])
def stream_accuracy_files(spark: SparkSession, sf: str) -> DataFrame:
    out = L.run_append(L.stream_accuracy(prediction_feed(file_by_file(spark, sf))), "accuracy-files")
    return rounded(out, {"accuracy": 6}, ["symbol", minute("window_end"), "total_predictions"])


@query("bounded_ingest", f"WITH {TICKS} SELECT symbol, count(*) AS ticks, CAST(sum(price) AS DOUBLE) AS turnover FROM tk GROUP BY symbol")
def bounded_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """At most one file per micro-batch; the rest waits, nothing is dropped."""
    path, out = parted(spark, sf, 4), L.workspace(spark, "bounded")
    ticks = L.stream_table(spark, path, "*.parquet", D.ticks(spark, sf).schema, files_per_trigger=1)
    L.run_batches(ticks, "bounded", lambda b, i: b.write.mode("overwrite").parquet(f"{out}/v={i}"))
    rows = spark.read.parquet(out)
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("ticks"), F.sum("price").alias("turnover"))


SCORE_COLUMNS = ("return_5d", "rsi_14", "price_position")


def score_model(bars: DataFrame):
    """A logistic model of the direction of the next bar, fitted on the features of given bars."""
    rows = build_features(bars, columns=list(SCORE_COLUMNS), group_rows=L.BUCKETS * 1000)
    s = add_target(as_series(rows, ahead=1, group_rows=L.BUCKETS * 1000), drop_unlabelled=True)
    return E.fit(E.model_input(s.tidy(), SCORE_COLUMNS), SCORE_COLUMNS, E.logistic())


HOURLY = f"""{TICKS}, hb AS (SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts) AS hour FROM tk GROUP BY 1, 2),
nb AS (SELECT symbol, hour, row_number() OVER (PARTITION BY symbol ORDER BY hour) AS n FROM hb WHERE hour + INTERVAL 1 HOUR <= {CLOSED})"""


@query("stream_score", f"WITH {HOURLY} SELECT symbol, strftime(hour, '%Y-%m-%d %H:%M:%S') AS ts, n, true AS same_features, true AS same_score FROM nb WHERE n >= 50")
def stream_score(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars stream in, file by file; every bar is scored from its symbol's state. The indicators and
    the score of each bar must be those of the batch builder and the fitted model."""
    path = L.workspace(spark, "bars")
    bars = L.run_append(L.stream_bars(event_stream(spark, sf)), "score-bars")
    L.land_in_order(bars, path, "ts", 3)
    model = score_model(bars)
    fitted = model.stages[-1]
    weights, base = fitted.coefficients.toArray(), float(fitted.intercept)
    source = L.stream_table(spark, path, "*.parquet", bars.schema, files_per_trigger=1)
    live = keyed_scores(source, {"return_5d": Return(5), "rsi_14": Rsi(14), "price_position": Position()}, lambda x: 1 / (1 + np.exp(-(x @ weights + base))))
    scored = L.run_append(live, "score")
    features = build_features(bars, columns=list(SCORE_COLUMNS), group_rows=L.BUCKETS * 1000)
    batch = E.up_probability(model, E.model_input(features, SCORE_COLUMNS), "batch")
    near = lambda a, b: F.abs(F.coalesce(a, F.lit(0.0)) - b) < 1e-9
    same = F.lit(True)
    for n in SCORE_COLUMNS:
        same = same & near(F.nanvl(F.col(f"l.{n}"), F.lit(0.0)), F.col(f"b.{n}"))
    both = scored.alias("l").join(batch.alias("b"), ["symbol", "ts"])
    return both.select("symbol", minute("ts"), "n", same.alias("same_features"), near(F.col("prediction"), F.col("batch")).alias("same_score"))


@query("stream_score_batches")
def stream_score_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars stream in; every batch scores the newest bar of each symbol with a fitted model, from its last 1000 bars."""
    path = L.workspace(spark, "bars")
    bars = L.run_append(L.stream_bars(event_stream(spark, sf)), "score-bars")
    L.land_in_order(bars, path, "ts", 3)
    model = score_model(bars)
    source = L.stream_table(spark, path, "*.parquet", bars.schema, files_per_trigger=1)
    scorer = L.StreamScorer(L.workspace(spark, "scorer"), lambda rows: E.up_probability(model, E.model_input(rows, SCORE_COLUMNS), "prediction"), SCORE_COLUMNS)
    L.run_batches(source, "score", scorer)
    return scorer.signals(spark).select("v", "symbol", minute("ts"), grid("prediction", 9).alias("prediction"), grid("confidence", 9).alias("confidence"), "signal")
