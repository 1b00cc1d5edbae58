import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import ordered, walk
from tickloom.operators import ensemble as E
from tickloom.operators import monitor as M
from tickloom.operators import panel as P
from tickloom.operators import sentiment as N
from tickloom.sources import bars as S
from tickloom.sources import news as W


def test_negation_and_empty_text(spark):
    texts = [(1, "Good gain, not bad"), (2, ""), (3, None), (4, "plain words only"), (5, "never good")]
    items = spark.createDataFrame(texts, "id int, text string")
    got = {r["id"]: r for r in N.text_sentiment(items, F.col("text"), N.lexicon_table(spark), ["id"]).collect()}
    total = 2.0 + 2.5 + 2.5 * 0.74
    assert got[1]["vader_compound"] == pytest.approx(total / math.sqrt(total**2 + 15))
    assert got[1]["textblob_polarity"] == pytest.approx((0.75 + 0.5 + 0.375) / 3)
    for i in (2, 3):
        assert all(got[i][n] == 0 for n in N.SCORES)
    assert got[4]["vader_neutral"] == 1 and got[4]["sentiment_score"] == 0
    assert got[5]["vader_compound"] < 0 and len(got) == 5


def test_surroundings_of_words(spark):
    texts = {
        "plain": "the gain", "very": "a very good day", "far": "very big and good", "slight": "slightly good", "loud": "what a GOOD day", "all": "GOOD GAIN", "turned": "it is not a good day",
        "isnt": "This isn't good", "but": "good start but bad end", "marks": "good day!!!!!!", "asks": "good? day??",
    }
    items = spark.createDataFrame(list(texts.items()), "id string, text string")
    got = {r["id"]: r for r in N.text_sentiment(items, F.col("text"), N.lexicon_table(spark), ["id"]).collect()}
    want = {
        "plain": 2.5, "very": 2 + N.STEP, "far": 2 + N.STEP * 0.9, "slight": 2 - N.STEP, "loud": 2 + N.EMPHASIS, "all": 4.5, "turned": 2 * N.NEGATED, "isnt": 2 * N.NEGATED,
        "but": 2 * 0.5 - 2.5 * 1.5, "marks": 2 + 4 * N.EXCLAMATION, "asks": 2 + 3 * N.QUESTION,
    }
    for k, total in want.items():
        assert got[k]["vader_compound"] == pytest.approx(total / math.sqrt(total**2 + N.NORMALISE)), k
    assert got["very"]["textblob_polarity"] == pytest.approx(min(1.0, 0.75 * 1.3)) and got["but"]["vader_neutral"] == pytest.approx(3 / (3 + 2 + 4.75))


def test_lexicon_of_any_size(spark, monkeypatch):
    items = spark.createDataFrame([(1, "good start but bad end"), (2, "nothing here")], "id int, text string")
    few = N.text_sentiment(items, F.col("text"), N.lexicon_table(spark), ["id"]).orderBy("id").collect()
    monkeypatch.setattr(N, "FILTERED", 3)
    assert N.text_sentiment(items, F.col("text"), N.lexicon_table(spark), ["id"]).orderBy("id").collect() == few


def test_lexicon_join_is_broadcast_without_hint(spark):
    items = spark.createDataFrame([(1, "good")], "id int, text string")
    plan = N.text_sentiment(items, F.col("text"), N.lexicon_table(spark), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_regime_edges(spark):
    df = spark.createDataFrame([(-0.2,), (0.2,), (0.21,), (-0.3,)], "x double").select(N.regime(F.col("x")).alias("r"))
    assert [r["r"] for r in df.collect()] == ["negative", "neutral", "positive", "negative"]


def test_headlines(spark):
    body = "".join(f'<h3 class="big article__headline">T{i} <b>x</b>\n &amp; y</h3>' for i in range(12))
    html = f'<h3 class="other">no</h3><h3 class="article__headline"> </h3>{body}'
    pages = spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")
    got = W.page_headlines(pages).collect()
    assert len(got) == 12 and got[0]["title"] == "T0 x & y"  # the first element is empty
    assert W.page_headlines(pages, per_page=10).count() == 9


def test_quality_and_skipped(bars, frame):
    good = S.quality_filter(bars, 500, 0.1, 10)
    assert good.select("symbol").distinct().collect()[0][0] == "AAA"
    assert S.skipped_symbols(bars, good).collect()[0][0] == "BBB"
    assert S.quality_filter(bars, 1, 0.1, 1e9).isEmpty()


def test_csv_bars(spark, frame, tmp_path):
    frame.assign(ts=frame["ts"].dt.strftime("%Y-%m-%dT%H:%M:%S")).to_csv(tmp_path / "b.csv", index=False)
    got = S.read_bars(spark, str(tmp_path / "b.csv"), "2020-02-01", "2020-03-01", fmt="csv")
    want = frame[(frame["ts"] >= "2020-02-01") & (frame["ts"] < "2020-03-01")]
    assert got.count() == len(want)
    with pytest.raises(ValueError):
        S.require_columns(got.drop("close"))


def test_feature_columns_skip_bars_and_keys(bars):
    df = bars.withColumn("target", F.lit(1)).withColumn("rsi_14", F.lit(1.0)).withColumn("Dividends", F.lit(0.0))
    assert S.feature_columns(df) == ["rsi_14"]


def test_date_range_reaches_the_scan(spark, bars, tmp_path):
    bars.write.parquet(str(tmp_path / "p"))
    plan = S.read_bars(spark, str(tmp_path / "p"), "2020-02-01")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan


@pytest.mark.parametrize("layout", [{}, {"limit": 10, "slice_rows": 50}])
def test_calendar_alignment(spark, layout):
    index, late = walk(60, 5, "IDX"), walk(200, 6, "LATE").iloc[20:120:3]
    df = spark.createDataFrame(pd.concat([index, late]))
    got = ordered(P.market_calendar_align(df, "IDX", **layout))
    want = late.set_index("ts")["close"].reindex(index["ts"], method="ffill").to_numpy()
    np.testing.assert_array_equal(got[got["symbol"] == "LATE"]["close"].to_numpy(float), want)
    assert len(got) == 120


def test_beta_defaults_to_one(spark):
    rows = [("A", i * 0.01, i * 0.02) for i in range(10)] + [("B", 0.0, 0.01 * i) for i in range(30)] + [("C", 0.03 * i, 0.01 * i) for i in range(30)]
    got = {r[0]: r[1] for r in P.beta(spark.createDataFrame(rows, "symbol string, asset_return double, market_return double")).collect()}
    assert got["A"] == 1.0 and got["B"] == 1.0 and got["C"] == pytest.approx(3.0)


def test_signals(spark):
    df = spark.createDataFrame([("a", None, p) for p in (0.6, 0.61, 0.4, 0.39)], "symbol string, ts timestamp, prediction double")
    assert [r["signal"] for r in M.signal_record(df).collect()] == ["HOLD", "BUY", "HOLD", "SELL"]


def test_weights_with_a_missing_model(spark):
    rows = [(1, 0.9, 0.2, None), (0, 0.1, 0.9, None), (1, 0.8, 0.9, None)]
    df = spark.createDataFrame(rows, "target int, a double, b double, c double")
    got = {r["model"]: r for r in E.ensemble_weights(df, ["a", "b", "c"]).collect()}
    assert got["a"]["accuracy"] == 1 and got["c"]["accuracy"] == 0.5
    assert sum(r["weight"] for r in got.values()) == pytest.approx(1)


def test_logistic_per_symbol_matches_direct_fit(spark):
    from tickloom.operators.trees import ridge_logistic

    rng = np.random.default_rng(0)
    parts = []
    for sym, shift in (("A", 1.5), ("B", -0.7)):
        x = rng.normal(size=(400, 2))
        y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] * shift - x[:, 1])))).astype(int)
        parts.append(pd.DataFrame({"symbol": sym, "x1": x[:, 0], "x2": x[:, 1], "target": y}))
    pdf = pd.concat(parts)
    small = pd.DataFrame({"symbol": ["C"], "x1": [0.1], "x2": [0.2], "target": [1]})
    df = spark.createDataFrame(pd.concat([pdf, small]))
    got = {r["symbol"]: r["w"] for r in E.fit_per_symbol(df, ["x1", "x2"], rounds=8).collect()}
    assert set(got) == {"A", "B"}
    for sym, g in pdf.groupby("symbol"):
        x = g[["x1", "x2"]].to_numpy()
        np.testing.assert_allclose(got[sym][:2], ridge_logistic(x, g["target"].to_numpy(float))[:2], atol=0.02)
    scored = E.score_per_symbol(df, spark.createDataFrame([(k, v) for k, v in got.items()], "symbol string, w array<double>"), ["x1", "x2"])
    assert scored.where("symbol = 'C'").first()["prediction"] == 0.5
