import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import ordered
from tickloom.functions.asof import asof_join
from tickloom.functions.scalars import grid
from tickloom.functions.series import Axis, Ewm, Roll, Series, as_series, slice_series, span, wilder


def by_symbol(frame, fn):
    frame = frame.sort_values(["symbol", "ts"])
    return pd.concat([fn(g) for _, g in frame.groupby("symbol")]).to_numpy()


def close_to(a, b, tol=1e-12):
    a, b = np.asarray(a, float), np.asarray(b, float)
    assert (np.isnan(a) == np.isnan(b)).all()
    scale = max(1.0, np.nanmax(np.abs(b)))
    assert np.nanmax(np.abs(a - b)) <= tol * scale


@pytest.mark.parametrize("n", [2, 3, 12, 89, 233])
def test_span_matches_recursive_average(bars, frame, n):
    out = ordered(Series(bars).ewm({"y": span("close", n)}).tidy())
    close_to(out["y"], by_symbol(frame, lambda g: g["close"].ewm(span=n, adjust=False, min_periods=n).mean()))


def test_many_blocks_and_one_row(spark):
    x = np.random.default_rng(0).normal(100, 5, 6000)
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2000-01-01", periods=6000), "close": x})
    pdf = pd.concat([pdf, pd.DataFrame({"symbol": ["B"], "ts": [pd.Timestamp("2000-01-01")], "close": [7.0]})])
    out = ordered(Series(spark.createDataFrame(pdf)).ewm({"fast": span("close", 3), "slow": Ewm("close", 0.002)}).tidy())
    close_to(out["fast"][:6000], pd.Series(x).ewm(span=3, adjust=False, min_periods=3).mean())
    close_to(out["slow"][:6000], pd.Series(x).ewm(alpha=0.002, adjust=False).mean())
    assert out["slow"].iloc[-1] == 7.0 and np.isnan(out["fast"].iloc[-1])


def test_adjusted_mean_seed_and_null_head(bars, frame):
    s = Series(bars).add({"late": Axis().diff("close", 26)})
    out = ordered(
        s.ewm({"adj": Ewm("volume", 2 / 21, adjust=True), "w": wilder("close", 14, seed="mean", before=0.0), "late9": span("late", 9), "same": span("close", 1)}).tidy()
    )
    close_to(out["adj"], by_symbol(frame, lambda g: g["volume"].ewm(span=20).mean()))
    close_to(out["same"], by_symbol(frame, lambda g: g["close"]))
    close_to(out["late9"], by_symbol(frame, lambda g: g["close"].diff(26).ewm(span=9, adjust=False, min_periods=9).mean()))

    def seeded(g):
        x, y = g["close"].to_numpy(), np.zeros(len(g))
        y[13] = x[:14].mean()
        for i in range(14, len(x)):
            y[i] = (y[i - 1] * 13 + x[i]) / 14
        return pd.Series(y)

    close_to(out["w"], by_symbol(frame, seeded))


@pytest.mark.parametrize("n", [3, 21, 144])
def test_long_sums(bars, frame, n):
    out = ordered(Series(bars).ewm({"s": Roll("close", n), "r": Roll("close", n, ramp=True), "e": span("close", 3)}).tidy())
    close_to(out["s"], by_symbol(frame, lambda g: g["close"].rolling(n).sum()))
    weights = np.arange(1, n + 1)
    close_to(out["r"], by_symbol(frame, lambda g: g["close"].rolling(n).apply(lambda x: (x * weights).sum(), raw=True)), 1e-10)


def test_slices_keep_rows_and_values(bars):
    cut = slice_series(bars, slice_rows=120, lookback=100, ahead=3)
    assert cut.df.groupBy("symbol", "_slice").count().agg(F.max("count")).first()[0] <= 223
    a = cut.axis
    sliced = ordered(cut.add({"m": a.mean("close", 50), "z": F.lead("close", 3).over(a.spec)}).tidy())
    whole = Series(bars)
    plain = ordered(whole.add({"m": whole.axis.mean("close", 50), "z": F.lead("close", 3).over(whole.axis.spec)}).tidy())
    assert len(sliced) == len(plain)
    close_to(sliced["m"], plain["m"])
    close_to(sliced["z"], plain["z"])


def test_folds_across_slices(bars):
    specs = {
        "total": ("sum", F.col("volume")), "peak": ("max", F.col("close")), "low0": ("min", F.col("close")),
        "last": ("last", F.when(F.col("volume") % 5 == 0, F.col("close"))), "first": ("first", F.col("close")),
        "grow": ("product", F.lit(1.0) + F.col("volume") / 1e5),
    }
    a = ordered(slice_series(bars, 70, 10).fold(specs).tidy())
    b = ordered(Series(bars).fold(specs).tidy())
    for n in specs:
        close_to(a[n], b[n])


def test_layout_follows_the_group_size(bars):
    assert not as_series(bars).axis.sliced
    assert as_series(bars, limit=500, slice_rows=100).axis.sliced


def test_full_and_partial_frames(bars):
    s = Series(bars)
    out = ordered(s.add({"f": s.axis.mean("close", 10), "p": Axis(full=False).mean("close", 10)}).tidy())
    assert out["f"].isna().sum() == 18 and out["p"].notna().all()


@pytest.mark.parametrize("era", [None, 40 * 86_400])
def test_asof_carries_whole_rows(spark, frame, era):
    right = frame.sample(frac=0.1, random_state=5)[["symbol", "ts", "volume"]].rename(columns={"volume": "p"})
    right["q"] = np.where(right["p"] % 2 == 0, right["p"], np.nan)
    left = frame[["symbol", "ts", "close"]]
    nulls = F.when(~F.isnan("q"), F.col("q"))
    got = ordered(asof_join(spark.createDataFrame(left), spark.createDataFrame(right).withColumn("q", nulls), era_seconds=era))
    want = pd.merge_asof(left.sort_values("ts"), right.sort_values("ts"), on="ts", by="symbol").sort_values(["symbol", "ts"])
    close_to(got["p"], want["p"])
    close_to(got["q"], want["q"])  # a NULL cell of the last row stays NULL


def test_grid_rounds_half_up(spark):
    row = spark.range(1).select(grid(F.lit(2.5), 0).alias("a"), grid(F.lit(-0.04), 1).alias("b"), grid(F.lit(1250.0), -2).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (3.0, 0.0, 1300.0)
