"""A sample of registered queries against their SQL (tests/check_queries.py runs all of them)."""

import pytest

import __spark_entry__ as entry
from check_queries import connect, differences
from helpers import SF

SAMPLE = (
    "bars_from_trades", "price_returns", "candles", "calendar", "moving_averages", "macd_grid", "psar_grid", "ta_kama", "ta_stc",
    "quality_filter", "asof_predictions_eras", "market_features", "beta", "target_volatility", "backtest_metrics", "backtest_report",
    "walk_forward_metrics", "time_series_split", "sentiment_features", "page_headlines", "accuracy_rollup", "ensemble_weights",
    "asset_rankings", "stream_bars", "stream_accuracy",
)


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    mine = entry.queries()[name](spark, SF).toPandas()
    assert differences(mine, duck.execute(entry.oracle_sql()[name]).df()) == []


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_large_tables_of_names_are_not_broadcast(spark, monkeypatch):
    from tickloom.plans import datasets

    sf = "/root/testdata/sf0.001"
    joined = lambda: datasets.trades(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" not in joined()
    rows = sorted(datasets.trades(spark, sf).select("symbol", "ts", "price").collect())
    monkeypatch.setattr(datasets, "MOST_NAMES", 10)
    assert "strategy=merge" in joined()
    assert sorted(datasets.trades(spark, sf).select("symbol", "ts", "price").collect()) == rows


def test_parts_of_the_matrix_are_not_broadcast(spark, bars):
    from tickloom.operators.matrix import feature_matrix

    rows, names = feature_matrix(bars, ["rsi", "atr", "obv"], per_step=1)
    assert "strategy=broadcast" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") == len({"rsi", "atr", "obv"})
    assert rows.count() == bars.count() and all(len(r["x"]) == len(names) for r in rows.select("x").collect())
