"""The same values however a symbol is cut, and bars with holes."""

import numpy as np
import pandas as pd
import pytest
from helpers import ordered, walk

from tickloom.operators.catalogue import build_features
from tickloom.operators.sentiment import is_complete, sentiment_cached
from tickloom.sources.bars import unique_bars
from tickloom.sources.sinks import read_prediction_table, write_prediction_table
from tickloom.operators.panel import shared_days, universe


@pytest.fixture(scope="module")
def flat(spark):
    """A long run without any price change between two moving parts."""
    frame = walk(2600, 4, "FLT")
    for n in ("open", "high", "low", "close"):
        frame.loc[500:2200, n] = frame["close"][500]
    return spark.createDataFrame(frame).persist()


@pytest.mark.parametrize("name", ["rsi", "ta_rsi", "ta_stochrsi", "ta_stc"])
def test_flat_runs_whole_and_sliced(flat, name):
    whole = ordered(build_features(flat, [name], group_rows=2600))
    sliced = ordered(build_features(flat, [name], group_rows=2600, limit=400, slice_rows=400))
    pd.testing.assert_frame_equal(whole, sliced, rtol=1e-7, atol=1e-7)


def test_rsi_of_flat_runs_equals_recursion(flat):
    got = ordered(build_features(flat, ["rsi"], columns=["rsi_7"], group_rows=2600))
    change = got["close"].diff()
    up = change.clip(lower=0).fillna(0).ewm(alpha=1 / 7, adjust=False).mean()
    down = (-change.clip(upper=0)).fillna(0).ewm(alpha=1 / 7, adjust=False).mean()
    want = (100 - 100 / (1 + up / down)).where(down != 0, 100.0)
    want[:6] = np.nan
    assert np.allclose(got["rsi_7"], want, equal_nan=True, atol=1e-7)


def test_rows_without_a_whole_bar_are_no_bars(spark, frame):
    holed = frame.copy()
    holed.loc[holed.index[::17], "close"] = np.nan
    whole = holed.dropna()
    names = ["moving_averages", "rsi", "rolling_stats"]
    rows = spark.createDataFrame(holed.astype(object).where(holed.notna(), None), "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    got = ordered(build_features(rows, names, group_rows=1000))
    pd.testing.assert_frame_equal(got, ordered(build_features(spark.createDataFrame(whole), names, group_rows=1000)))


def test_repeated_bars(spark, bars):
    assert unique_bars(bars.unionByName(bars)).count() == bars.count()


def test_a_broken_cache_folder_is_written_anew(spark, tmp_path):
    daily = spark.createDataFrame([("A", 1.0)], "symbol string, score double")
    (tmp_path / "as_of=2024-01-01" / "_temporary").mkdir(parents=True)
    folder = f"file://{tmp_path}"
    assert not is_complete(spark, f"{folder}/as_of=2024-01-01")
    assert sentiment_cached(daily, folder, "2024-01-01").count() == 1 and is_complete(spark, f"{folder}/as_of=2024-01-01")


def test_no_default_cuts(spark, bars, tmp_path):
    table = spark.range(700).selectExpr("concat('S', id) AS symbol", "'x' AS sector")
    assert universe(table).count() == 700 and universe(table, limit=5).count() == 5
    days = shared_days(bars, "BBB")
    assert days.where("symbol = 'BBB'").count() == 400 and days.where("symbol = 'AAA'").count() == 400
    records = bars.selectExpr("symbol", "ts", "0.5D AS prediction", "0D AS confidence", "'HOLD' AS signal")
    write_prediction_table(records, f"{tmp_path}/t")
    assert read_prediction_table(spark, f"{tmp_path}/t").count() == bars.count()
