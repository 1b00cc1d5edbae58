from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import walk
from tickloom.operators.catalogue import build_features
from tickloom.sources.bars import bars_from_trades
from tickloom.streaming import live as L
from tickloom.streaming.keyed import Position, Return, Rsi, keyed_scores
from tickloom.streaming.messages import TICK, parse_messages, to_messages

SCHEMA = "symbol string, ts timestamp, price double, qty double, seq bigint"


def rows(n, start=datetime(2024, 1, 1), step=7):
    return [("AB"[i % 2], start + timedelta(minutes=step * i), float(100 + i * 13 % 17), 1.0, i) for i in range(n)]


def test_stream_bars_equal_batch_bars(spark, tmp_path):
    path = str(tmp_path / "ticks")
    ticks = spark.createDataFrame(rows(300), SCHEMA)
    L.land_in_order(ticks, path, "ts", 4)
    stream = L.stream_table(spark, path, "*.parquet", ticks.schema, files_per_trigger=1)
    got = L.run_append(L.stream_bars(stream), "bars")
    end = ticks.agg(F.max("ts")).first()[0] - timedelta(minutes=10)
    want = bars_from_trades(ticks, F.date_trunc("hour", "ts"), F.col("seq")).where(F.expr("ts + interval 1 hour") <= F.lit(end))
    assert got.count() == want.count() > 0
    assert got.exceptAll(want.select(*got.columns)).isEmpty()


def test_late_rows_are_dropped(spark, tmp_path):
    path = str(tmp_path / "ticks")
    early = spark.createDataFrame(rows(50), SCHEMA).coalesce(1)
    late = spark.createDataFrame([("A", datetime(2024, 1, 1, 0, 1), 1e6, 1.0, 999), ("A", datetime(2024, 1, 1, 7, 0), 5.0, 1.0, 1000)], SCHEMA).coalesce(1)
    early.write.parquet(path)
    stream = L.stream_table(spark, path, "*.parquet", early.schema, files_per_trigger=1)
    checkpoint, out = str(tmp_path / "cp"), str(tmp_path / "out")

    def go():
        q = L.stream_bars(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()

    go()
    late.write.mode("append").parquet(path)
    go()
    assert spark.read.parquet(out).agg(F.max("high")).first()[0] < 1e6


def test_messages_round_trip(spark):
    df = spark.createDataFrame([("A", "2024-01-02T03:04:05", 1.0, 2.0, 0.5, 1.5, 10, "x")], TICK)
    back = parse_messages(to_messages(df)).first()
    assert back["symbol"] == "A" and back["ts"] == datetime(2024, 1, 2, 3, 4, 5) and back["volume"] == 10
    other = to_messages(df).withColumn("topic", F.lit("t2"))
    assert parse_messages(other, topic="t1").isEmpty()


def test_expiry(spark):
    df = spark.createDataFrame([("A", datetime(2024, 1, 1, 0, 0)), ("B", datetime(2024, 1, 1, 0, 4))], "symbol string, ts timestamp")
    assert [r[0] for r in L.live(df, "2024-01-01 00:06:00", 300).collect()] == ["B"]


def test_scorer_keeps_a_bounded_history(spark, tmp_path, bars):
    path = str(tmp_path / "bars")
    early = bars.where("ts < '2020-06-01'")
    L.land_in_order(early, path, "ts", 3)
    stream = L.stream_table(spark, path, "*.parquet", bars.schema, files_per_trigger=1)
    scorer = L.StreamScorer(str(tmp_path / "s"), lambda f: f.select("symbol", "ts", F.col("return_1d").alias("prediction")), ["return_1d"], buffer=60, minimum=50)
    L.run_batches(stream, "scorer", scorer)
    out = scorer.signals(spark)
    newest = out.groupBy("symbol").agg(F.max("ts").alias("t")).collect()
    assert {r["t"] for r in newest} == {early.agg(F.max("ts")).first()[0]}
    # every score is that of the batch features of the same bar
    want = {(r["symbol"], r["ts"]): r["return_1d"] for r in build_features(early, columns=["return_1d"]).collect()}
    assert all(abs(r["prediction"] - want[r["symbol"], r["ts"]]) < 1e-12 for r in out.collect())
    last = out.agg(F.max("v")).first()[0]
    state = spark.read.parquet(f"{tmp_path}/s/state/v={last}")
    assert state.groupBy("symbol").count().agg(F.max("count")).first()[0] == 60
    # a batch that runs again leaves the same
    before = sorted(out.where(f"v = {last}").collect())
    scorer(early.where(F.col("ts") > early.agg(F.expr("percentile_approx(ts, 0.7)")).first()[0]), last)
    assert sorted(r[:2] for r in scorer.signals(spark).where(f"v = {last}").collect()) == [r[:2] for r in before]


@pytest.mark.parametrize("mode", ["complete"])
def test_latest_prediction(spark, tmp_path, mode):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([("A", datetime(2024, 1, 1, i), i / 10, 0.1, "HOLD") for i in range(8)], "symbol string, ts timestamp, prediction double, confidence double, signal string")
    df.write.parquet(path)
    stream = L.stream_table(spark, path, "*.parquet", df.schema)
    got = L.run_complete(L.latest_prediction(stream), "latest").collect()
    assert len(got) == 1 and got[0]["prediction"] == 0.7


def test_keyed_indicators_equal_the_batch(spark, tmp_path):
    names = ["return_5d", "rsi_14", "price_position"]
    rows = pd.concat([walk(230, 4, "A"), walk(120, 5, "B")])
    rows.loc[rows.index[20:60], "close"] = rows["close"].iloc[20]  # a flat run, across files
    rows["high"], rows["low"] = rows[["high", "close"]].max(axis=1), rows[["low", "close"]].min(axis=1)
    bars = spark.createDataFrame(rows)
    path = str(tmp_path / "bars")
    L.land_in_order(bars, path, "ts", 4)
    extra = bars.where("ts < '2020-03-01'").coalesce(1)  # bars that come again
    extra.write.mode("append").parquet(path)
    stream = L.stream_table(spark, path, "*.parquet", bars.schema, files_per_trigger=1)
    live = keyed_scores(stream, {"return_5d": Return(5), "rsi_14": Rsi(14), "price_position": Position()}, lambda x: x.sum(axis=1), minimum=3, late="900 days")
    got = L.run_append(live, "keyed").toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    want = build_features(bars, columns=names).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    want = want[want.groupby("symbol").cumcount() >= 2].reset_index(drop=True)
    assert len(got) == len(want) == 230 + 120 - 4
    for n in names:
        np.testing.assert_allclose(got[n].to_numpy(float), want[n].to_numpy(float), atol=1e-9)
    np.testing.assert_allclose(got["prediction"], got[names].fillna(0).sum(axis=1))


def test_accuracy_from_panes_equals_plain_windows(spark, tmp_path):
    rows = [("AB"[i % 2], datetime(2024, 1, 1) + timedelta(minutes=11 * i), (i * 37 % 100) / 100, float(i % 5 - 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, prediction double, actual_return double")
    path = str(tmp_path / "p")
    L.land_in_order(df, path, "ts", 3)
    stream = L.stream_table(spark, path, "*.parquet", df.schema, files_per_trigger=1)
    got = {(r["symbol"], r["window_end"]): (round(r["accuracy"], 9), r["total_predictions"]) for r in L.run_append(L.stream_accuracy(stream), "panes").collect()}
    closed = rows[-1][1] - timedelta(minutes=10)
    want = {}
    for symbol, ts, p, r in rows:
        end = ts.replace(minute=0) + timedelta(hours=1)
        for k in range(24):
            if end + timedelta(hours=k) <= closed:
                want.setdefault((symbol, end + timedelta(hours=k)), []).append((p > 0.5) == (r > 0))
    assert got == {k: (round(sum(v) / len(v), 9), len(v)) for k, v in want.items()}
