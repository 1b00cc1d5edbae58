import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import ordered, walk
from tickloom.operators.catalogue import build_features, families, feature_names, helper_clashes
from tickloom.operators.psar import psar_into
from tickloom.functions.series import Series, slice_series

FRAME_FAMILIES = ["price_returns", "candles", "rolling_stats", "bollinger_grid", "stochastic_grid", "cci", "mfi"]


def test_catalogue_counts():
    own = [f.name for f in families() if not f.suite]
    suite = [f.name for f in families() if f.suite]
    assert len(feature_names(own)) == 472 and len(feature_names(suite)) == 86
    assert len(feature_names()) == 558


def test_helpers_do_not_clash(spark):
    assert helper_clashes([f.name for f in families()] + ["fallback_set"]) == {}


def test_families_side_by_side_equal_families_alone(bars):
    names = ["rsi", "macd_grid", "volume_smoothing", "obv", "ta_kama", "ta_stc", "adx", "ta_adx", "candles"]
    together = ordered(build_features(bars, names, group_rows=1000))
    for n in names:
        alone = ordered(build_features(bars, [n], group_rows=1000))
        for c in families([n])[0].columns:
            pd.testing.assert_series_equal(together[c], alone[c], rtol=1e-11)


def test_missing_column_is_an_error(bars):
    with pytest.raises(ValueError, match="volume"):
        build_features(bars.drop("volume"))


def test_no_leak_across_symbols_or_from_the_future(spark, frame, bars):
    names = ["price_returns", "moving_averages", "rsi", "psar_grid", "obv"]
    full = ordered(build_features(bars, names, group_rows=1000))
    part = frame[(frame["symbol"] == "AAA")].sort_values("ts").head(500)
    cut = ordered(build_features(spark.createDataFrame(part), names, group_rows=1000))
    head = full[full["symbol"] == "AAA"].head(500).reset_index(drop=True)
    for c in feature_names(names):
        pd.testing.assert_series_equal(head[c], cut[c], rtol=1e-11, atol=1e-9)


def test_constant_price_and_single_row(spark):
    n = 60
    flat = pd.DataFrame({"symbol": "C", "ts": pd.date_range("2021-01-01", periods=n), "open": 10.0, "high": 10.0, "low": 10.0, "close": 10.0, "volume": 0.0})
    single = walk(1, 9, "ONE")
    df = spark.createDataFrame(pd.concat([flat, single]))
    out = ordered(build_features(df, FRAME_FAMILIES + ["rsi", "adx", "vwap", "price_ratios"], group_rows=100))
    c = out[out["symbol"] == "C"].iloc[-1]
    assert c["return_1d"] == 0 and c["rsi_14"] == 100 and c["skew_20"] == 0 and c["kurt_20"] == 0
    assert not c["doji"] and pd.isna(c["price_position"]) and pd.isna(c["stoch_k_14_3"]) and pd.isna(c["vwap_5"])
    assert c["adx"] == 0 and pd.isna(c["bb_position_20_2_0"]) and c["bb_width_20_2_0"] == 0
    one = out[out["symbol"] == "ONE"].iloc[0]
    assert pd.isna(one["return_1d"]) and pd.isna(one["rsi_7"])
    numbers = out.select_dtypes("number")
    assert not np.isinf(numbers.to_numpy(float)).any()


def test_nan_comparisons_count_as_false(bars):
    out = ordered(build_features(bars, ["trend_strength", "moving_averages"], group_rows=1000))
    first = out.groupby("symbol").head(1)
    assert (first["trend_direction_20"] == -1).all() and (first["price_above_sma_3"] == 0).all()


def test_moments_against_pandas(bars, frame):
    out = ordered(build_features(bars, ["rolling_stats", "dispersion"], group_rows=1000))
    g = frame[frame["symbol"] == "BBB"].sort_values("ts")["close"].reset_index(drop=True)
    got = out[out["symbol"] == "BBB"].reset_index(drop=True)
    np.testing.assert_allclose(got["skew_20"], g.rolling(20).skew(), rtol=1e-7, atol=1e-7)
    np.testing.assert_allclose(got["kurt_20"], g.rolling(20).kurt(), rtol=1e-6, atol=1e-6)
    np.testing.assert_allclose(got["quantile_25_10"], g.rolling(10).quantile(0.25), rtol=1e-12)
    np.testing.assert_allclose(got["avg_dev_5"], g.rolling(5).apply(lambda x: np.abs(x - x.mean()).mean(), raw=True), rtol=1e-10, atol=1e-10)


def test_keltner_forms_and_partial_start(bars):
    from tickloom.operators.bands import keltner_grid

    out = ordered(build_features(bars, ["keltner_grid"], group_rows=1000))
    assert out["keltner_middle_20_2_0"].notna().all() and (out["keltner_upper_20_1_5"] == out["keltner_upper_20_2_5"]).all()
    other = ordered(keltner_grid(Series(bars), form="atr").tidy())
    last = other.groupby("symbol").tail(1)
    assert (last["keltner_upper_20_2_5"] > last["keltner_upper_20_1_5"]).all()
    with pytest.raises(ValueError):
        keltner_grid(Series(bars), form="other")


def test_psar_slices_repair_wrong_guesses(bars):
    """Slices far too short to forget their guess must still give the exact levels."""
    sets = {"p": (0.02, 0.2), "q": (0.001, 0.01)}
    whole = ordered(psar_into(Series(bars), sets).tidy())
    cut = ordered(psar_into(slice_series(bars, 200, 4), sets).tidy())
    for n in ("p", "q"):
        np.testing.assert_array_equal(whole[n], cut[n])
        assert (whole[f"{n}__up"].astype("boolean") == cut[f"{n}__up"].astype("boolean")).fillna(True).all()


def test_filled_suite_has_no_gaps(bars):
    names = ["ta_rsi", "ta_stoch", "ta_wr", "ta_adx", "ta_bb", "ta_macd", "ta_cmf"]
    out = build_features(bars, names, group_rows=1000, fillna=True)
    assert out.na.drop().count() == out.count()


def test_one_exchange_for_all_families(bars):
    plain = bars.sparkSession.createDataFrame(bars.toPandas())
    names = ["moving_averages", "macd_grid", "rsi", "bollinger_grid", "atr"]
    plan = build_features(plain, names, group_rows=1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_columns_prune_families(bars):
    out = build_features(bars, columns=["return_5d", "rsi_14"], group_rows=1000)
    assert out.columns[-2:] == ["return_5d", "rsi_14"]
    assert out.where(F.col("rsi_14").isNotNull()).count() > 0
