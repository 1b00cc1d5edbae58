import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import ordered
from tickloom.functions.series import Series, as_series, slice_series
from tickloom.operators import backtest as B
from tickloom.operators import targets as T
from tickloom.operators import walkforward as WF
from tickloom.operators.symbol_models import Forest, Logistic, fit_one, score_one
from tickloom.operators.trees import Shape


@pytest.fixture(scope="module")
def predictions(spark, frame):
    rng = np.random.default_rng(42)
    some = frame.sort_values(["symbol", "ts"]).groupby("symbol").apply(lambda g: g.iloc[7::3], include_groups=False).reset_index(level=0)
    some = some[["symbol", "ts"]].assign(prediction=rng.uniform(0.3, 0.7, len(some)))
    return some


def by_hand(g: pd.DataFrame, p: pd.DataFrame, flat=False) -> dict:
    """The strategy computed with plain pandas."""
    d = g.sort_values("ts").set_index("ts")
    known = p.set_index("ts")["prediction"].reindex(d.index, method="ffill")
    r = d["close"].pct_change().fillna(0)
    q = known.fillna(0)
    pos = pd.Series(np.where(q > 0.6, 1, np.where(q < 1 - 0.6, -1, 0)), index=d.index)
    if flat:
        pos[known.isna()] = 0
    change = pos.diff().abs()
    s = pos.shift(1) * r - change * 0.001 - change * 0.0005
    equity = (1 + s).cumprod() * 100_000
    down = (equity - equity.cummax()) / equity.cummax()
    x = s.dropna()
    var = np.percentile(x, 5)
    return {
        "total_return": equity.iloc[-1] / 100_000 - 1, "max_drawdown": down.min(), "win_rate": (x > 0).mean(),
        "strategy_volatility": x.std() * 252**0.5, "var_95": var, "cvar_95": x[x <= var].mean(),
        "directional_accuracy": ((r > 0) == (q > 0.5)).mean(), "total_trades": len(x),
        "sortino_ratio": (equity.iloc[-1] / 100_000 - 1 - 0.02) / (x[x < 0].std() * 252**0.5),
    }


@pytest.mark.parametrize("layout", [{}, {"limit": 100, "slice_rows": 130}])
@pytest.mark.parametrize("missing", ["zero", "flat"])
def test_metrics_against_pandas(spark, frame, bars, predictions, layout, missing):
    s = B.run_backtest(bars, spark.createDataFrame(predictions), missing_prediction=missing, **layout)
    got = B.metrics(s).toPandas().set_index("symbol")
    for sym, g in frame.groupby("symbol"):
        want = by_hand(g, predictions[predictions["symbol"] == sym], missing == "flat")
        for name, value in want.items():
            assert got.loc[sym, name] == pytest.approx(value, rel=1e-9, abs=1e-12), name


def test_unknown_names_are_errors(bars):
    with pytest.raises(ValueError):
        B.position_of("sideways", 0.6)
    with pytest.raises(ValueError):
        T.create_targets(bars, "colour")


def test_exact_percentile_with_ties_and_tiny_groups(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.choice(list("abc"), 3000, p=[0.6, 0.39, 0.01]), "x": np.round(rng.standard_t(2, 3000), 1)})
    pdf = pd.concat([pdf, pd.DataFrame({"g": ["one", "same", "same"], "x": [3.0, 5.0, 5.0]})])
    for q, limit, pivots in ((0.05, 20, 4), (0.5, 3, 8), (0.0, 1, 2), (1.0, 100, 16)):
        got = B.exact_percentile(spark.createDataFrame(pdf), ["g"], "x", q, limit, pivots).toPandas().set_index("g")["value"]
        assert len(got) == 5
        for g, rows in pdf.groupby("g"):
            assert got[g] == pytest.approx(np.percentile(rows["x"], 100 * q), abs=1e-12)


def test_exact_percentile_of_equal_values_and_an_outlier(spark):
    same = spark.range(200_000).select(F.lit("s").alias("g"), F.lit(0.25).alias("x"))
    rest = spark.createDataFrame([("s", 1e300), ("s", -1e300), ("s", 0.5)], "g string, x double")
    low = spark.range(50_000).select(F.lit("t").alias("g"), F.pow(F.lit(10.0), F.col("id") / 200 - 200).alias("x"))  # over 250 orders of magnitude
    df = same.unionByName(rest).unionByName(low)
    got = {r["g"]: r["value"] for r in B.exact_percentile(df, ["g"], "x", 0.05, limit=100).collect()}
    assert got["s"] == 0.25
    assert got["t"] == pytest.approx(np.percentile(10.0 ** (np.arange(50_000) / 200 - 200), 5), rel=1e-12)


def test_targets(spark, frame, bars):
    g = frame[frame["symbol"] == "AAA"].sort_values("ts")["close"].reset_index(drop=True)
    for layout in ({}, {"limit": 10, "slice_rows": 90}):
        up = ordered(T.create_targets(bars, "directional", 3, **layout))
        assert (up[up["symbol"] == "AAA"]["target"].to_numpy() == (g.pct_change(3).shift(-3) > 0).astype(int).to_numpy()).all()
        vol = ordered(T.create_targets(bars, "volatility", 5, **layout))
        np.testing.assert_allclose(vol[vol["symbol"] == "AAA"]["target"], g.pct_change().rolling(5).std().shift(-5), rtol=1e-9)
    assert T.create_targets(bars, "directional", 1, drop_unlabelled=True).count() == len(frame) - 2
    assert T.create_targets(bars, "volatility", 1).where("target is not null").isEmpty()


def test_folds_by_arithmetic(bars, frame):
    rows = WF.fold_rows(Series(bars), train=100, test=30, step=20).toPandas()
    for sym, g in frame.groupby("symbol"):
        days = g["ts"].sort_values().tolist()
        starts = list(range(100, len(days) - 30, 20))
        mine = rows[rows["symbol"] == sym]
        assert sorted(mine["fold"].unique()) == list(range(len(starts)))
        for f, i in enumerate(starts):
            part = mine[mine["fold"] == f]
            assert sorted(part[part["part"] == "train"]["ts"]) == days[i - 100 : i]
            assert sorted(part[part["part"] == "test"]["ts"]) == days[i : i + 30]


def test_splits_do_not_depend_on_the_layout(bars):
    whole, cut = Series(bars), slice_series(bars, 130, 5)
    for split in (lambda s: WF.fold_rows(s, 100, 30, 20), WF.time_series_split, lambda s: WF.chrono_split(s).tidy()):
        a, b = split(whole), split(cut)
        assert a.count() == b.count() and a.exceptAll(b.select(*a.columns)).isEmpty()


def test_time_series_split(bars, frame):
    rows = WF.time_series_split(Series(bars), 4).toPandas()
    for sym, g in frame.groupby("symbol"):
        n = len(g)
        size = n // 5
        for f in range(4):
            part = rows[(rows["symbol"] == sym) & (rows["fold"] == f)]
            start = n - (4 - f) * size
            assert (part["part"] == "train").sum() == start and (part["part"] == "test").sum() == size


SMALL_VOTERS = {"forest": Forest(trees=5, shape=Shape(depth=4, ridge=0.0, bins=8)), "logistic": Logistic()}


def test_walk_forward_uses_only_its_fold(spark, bars):
    s = T.add_target(as_series(bars, group_rows=1000)).add({"x": F.array(F.col("close") - F.col("open"), F.col("volume"))})
    votes, out = WF.walk_forward_run(s, SMALL_VOTERS, 120, 40, 60)
    votes, out = votes.toPandas(), out.toPandas()
    rows = s.tidy().toPandas().sort_values(["symbol", "ts"])
    for (symbol, fold), v in votes.groupby(["symbol", "fold"]):
        g = rows[rows["symbol"] == symbol].reset_index(drop=True)
        part, after = g[fold * 60 : fold * 60 + 120], g[fold * 60 + 120 : fold * 60 + 160]
        assert sorted(v["ts"]) == after["ts"].tolist()
        ids = part["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        for name, spec in SMALL_VOTERS.items():
            x = np.array(part["x"].tolist())
            model = fit_one(name, spec, x, part["target"].to_numpy(float), ids, np.zeros(120, bool))
            p = score_one(model, spec, np.array(after["x"].tolist()))
            np.testing.assert_allclose(v.sort_values("ts")[name], p, atol=1e-12)
    assert len(out) and set(B.METRICS) <= set(out.columns)
    assert (out["total_trades"] == 39).all()
    whole = WF.walk_forward_summary(spark.createDataFrame(out)).first()
    assert whole["total_periods"] == len(out) and whole["avg_total_return"] == pytest.approx(out["total_return"].mean())


def test_report_text(spark, bars, predictions):
    s = B.run_backtest(bars, spark.createDataFrame(predictions))
    text = B.report(B.metrics(s)).first()["report"]
    assert "Total Return: " in text and "VaR (95%): " in text and "Total Trades: " in text
