"""Queries over bars: sources, cleaning, joins, targets, backtests, monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.asof import asof_join
from ..functions.scalars import grid
from ..functions.series import Series, as_series
from ..operators import backtest as B
from ..operators import monitor as M
from ..operators import panel as P
from ..operators import targets as T
from ..operators import walkforward as WF
from ..operators.ensemble import ensemble_predict, ensemble_weights, sequence_windows, vote
from ..sources import bars as S
from ..sources.sinks import read_prediction_json, read_prediction_table, write_prediction_json, write_prediction_table
from ..streaming.live import workspace
from ..streaming.messages import parse_messages, to_messages
from . import datasets as D
from .oracles.base import DAY, W, bars_cte, change, frame, lag, mean, rnd, running, std
from .registry import day, query, rounded

B0 = f"WITH {bars_cte()}"
S0 = f"WITH {bars_cte('supplier')}"
CALM = bars_cte().replace("bars AS", "raw AS", 1) + """,
bars AS MATERIALIZED (SELECT symbol, ts, 1e7 + floor(open / 10) AS open, 1e7 + floor(high / 10) AS high,
  1e7 + floor(low / 10) AS low, 1e7 + floor(close / 10) AS close, volume FROM raw)"""
PRED = "(CAST(volume * 20 AS BIGINT) % 1000) / 1000.0"


def model_sql(m: int) -> str:
    return f"(CAST(volume * {m} AS BIGINT) % 1000) / 1000.0"


def bound(spark: SparkSession, sf: str) -> dict:
    return {"group_rows": D.bars_per_symbol(spark, sf)}


# ---------------------------------------------------------------- sources and cleaning

BAR_COLS = "symbol, " + DAY + ", open, high, low, close, volume"


@query("bars_from_trades", f"{B0} SELECT {BAR_COLS} FROM bars")
def bars_from_trades(spark: SparkSession, sf: str) -> DataFrame:
    return D.bars(spark, sf).select("symbol", day(), *S.OHLCV)


@query(
    "read_bars",
    f"{B0} SELECT {BAR_COLS} FROM bars WHERE ts >= '1996-01-01' AND ts < '1999-07-01' AND volume > 9",
)
def read_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Landed bars (small volumes missing) read back from parquet with a date range."""
    path = workspace(spark, "landed-bars")
    raw = D.bars(spark, sf).withColumn("volume", F.when(F.col("volume") > 9, F.col("volume")))
    raw.withColumn("Dividends", F.lit(0.0)).write.parquet(path)
    return S.read_bars(spark, path, "1996-01-01", "1999-07-01").select("symbol", day(), *S.OHLCV)


@query(
    "latest_bar",
    f"""{B0} SELECT symbol, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, open, high, low, close,
    CAST(volume AS BIGINT) AS volume, 'bars' AS source FROM bars
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1""",
)
def latest_bar(spark: SparkSession, sf: str) -> DataFrame:
    return S.latest_bar(D.bars(spark, sf))


@query("rename_ohlcv", f"{B0} SELECT {BAR_COLS} FROM bars")
def rename_ohlcv(spark: SparkSession, sf: str) -> DataFrame:
    provider = D.bars(spark, sf).select(
        "symbol", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("Timestamp"),
        *[F.col(n).cast("string").alias(n.capitalize()) for n in S.OHLCV],
    )
    return S.rename_ohlcv(provider).select("symbol", day(), *S.OHLCV)


HOLES = "CASE WHEN volume % 3 = 0 THEN NULL ELSE close END AS close, CASE WHEN volume % 7 = 0 THEN NULL ELSE volume END AS volume"


def with_holes(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("volume")
    return D.bars(spark, sf).select(
        "symbol", "ts", F.when(v % 3 != 0, F.col("close")).alias("close"), F.when(v % 7 != 0, v).alias("volume")
    )


@query(
    "clean_features",
    f"""{B0} SELECT symbol, {DAY}, CASE WHEN high > low THEN close / (high - low) END AS thin,
    CASE WHEN volume % 5 <> 0 THEN close END AS odd FROM bars""",
)
def clean_features(spark: SparkSession, sf: str) -> DataFrame:
    spread = F.col("high") - F.col("low")
    dirty = D.bars(spark, sf).select(
        "symbol", "ts",
        F.when(spread > 0, F.try_divide("close", spread)).otherwise(F.lit(float("inf"))).alias("thin"),
        F.when(F.col("volume") % 5 != 0, F.col("close")).otherwise(F.lit(float("nan"))).alias("odd"),
    )
    return S.clean_features(dirty).select("symbol", day(), "thin", "odd")


@query(
    "drop_incomplete",
    f"""{B0}, h AS (SELECT symbol, ts, {HOLES} FROM bars), k AS (SELECT * FROM h WHERE close IS NOT NULL AND volume IS NOT NULL)
    SELECT symbol, {DAY}, close, volume FROM k QUALIFY count(*) OVER (PARTITION BY symbol) >= 870""",
)
def drop_incomplete(spark: SparkSession, sf: str) -> DataFrame:
    return S.drop_incomplete(with_holes(spark, sf), 870).select("symbol", day(), "close", "volume")


@query("fill_zero", f"{B0}, h AS (SELECT symbol, ts, {HOLES} FROM bars) SELECT symbol, {DAY}, coalesce(close, 0) AS close, coalesce(volume, 0) AS volume FROM h")
def fill_zero(spark: SparkSession, sf: str) -> DataFrame:
    return S.fill_zero(with_holes(spark, sf)).select("symbol", day(), "close", "volume")


def _ffill(x: str) -> str:
    return f"coalesce(last_value({x} IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 0)"


@query(
    "ffill_then_zero",
    f"{B0}, h AS (SELECT symbol, ts, {HOLES} FROM bars) SELECT symbol, {DAY}, {_ffill('close')} AS close, {_ffill('volume')} AS volume FROM h",
)
def ffill_then_zero(spark: SparkSession, sf: str) -> DataFrame:
    s = as_series(with_holes(spark, sf), **bound(spark, sf))
    return B.ffill_then_zero(s, ("close", "volume")).tidy().select("symbol", day(), "close", "volume")


SECTORS = """sectors AS (SELECT r_name AS sector, s_name AS symbol, s_acctbal AS market_cap
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def sectors(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = D.table(spark, sf, "nation"), D.table(spark, sf, "region")
    return (
        D.table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("r_name").alias("sector"), F.col("s_name").alias("symbol"), F.col("s_acctbal").alias("market_cap"))
    )


@query("universe", f"WITH {SECTORS} SELECT DISTINCT symbol FROM sectors")
def universe(spark: SparkSession, sf: str) -> DataFrame:
    return P.universe(sectors(spark, sf))


@query("universe_sector", f"WITH {SECTORS} SELECT DISTINCT sector, symbol FROM sectors WHERE sector = 'ASIA'")
def universe_sector(spark: SparkSession, sf: str) -> DataFrame:
    return P.universe(sectors(spark, sf), sector="ASIA")


@query("universe_filter", f"WITH {SECTORS} SELECT DISTINCT symbol FROM sectors WHERE sector IN ('ASIA', 'EUROPE') AND market_cap BETWEEN 0 AND 8000")
def universe_filter(spark: SparkSession, sf: str) -> DataFrame:
    table = sectors(spark, sf)
    return P.universe_filter(P.universe(table, limit=None), table, 0.0, 8000.0, ["ASIA", "EUROPE"])


HOLED = "holed AS (SELECT symbol, ts, open, high, low, close, CASE WHEN volume % 7 = 0 THEN NULL ELSE volume END AS volume FROM bars)"
GOOD = f"""{HOLED}, good AS (SELECT symbol FROM holed GROUP BY symbol HAVING count(*) >= 530
  AND (count(*) - count(volume)) / (count(*) * 7.0) <= 0.0205 AND (avg(volume) IS NULL OR avg(volume) >= 26))"""


def supplier_holed(spark: SparkSession, sf: str) -> DataFrame:
    return D.supplier_bars(spark, sf).withColumn("volume", F.when(F.col("volume") % 7 != 0, F.col("volume")))


@query("quality_filter", f"{S0}, {GOOD} SELECT {BAR_COLS} FROM holed SEMI JOIN good USING (symbol)")
def quality_filter(spark: SparkSession, sf: str) -> DataFrame:
    return S.quality_filter(supplier_holed(spark, sf), 530, 0.0205, 26).select("symbol", day(), *S.OHLCV)


@query("skipped_symbols", f"{S0}, {GOOD} SELECT DISTINCT symbol FROM holed ANTI JOIN good USING (symbol)")
def skipped_symbols(spark: SparkSession, sf: str) -> DataFrame:
    rows = supplier_holed(spark, sf)
    return S.skipped_symbols(rows, S.quality_filter(rows, 530, 0.0205, 26))


@query("last_n_per_symbol", f"{B0} SELECT {BAR_COLS} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 1000")
def last_n_per_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return S.last_n_per_symbol(D.bars(spark, sf), 1000).select("symbol", day(), *S.OHLCV)


@query(
    "symbol_union",
    f"WITH {bars_cte()}, {bars_cte('supplier').replace('bars AS', 'sb AS', 1)} SELECT {BAR_COLS} FROM bars UNION ALL SELECT {BAR_COLS} FROM sb",
)
def symbol_union(spark: SparkSession, sf: str) -> DataFrame:
    return D.bars(spark, sf).unionByName(D.supplier_bars(spark, sf), allowMissingColumns=True).select("symbol", day(), *S.OHLCV)


TWO = f"WITH {bars_cte()}, {bars_cte('supplier').replace('bars AS', 'sb AS', 1)}"


@query("key_intersection", f"{TWO} SELECT DISTINCT symbol, {DAY} FROM bars WHERE ts IN (SELECT ts FROM bars WHERE symbol = 'Brand#1')")
def key_intersection(spark: SparkSession, sf: str) -> DataFrame:
    """The days that every symbol shares with one of them."""
    return P.shared_days(D.bars(spark, sf), "Brand#1").select("symbol", day())


# ---------------------------------------------------------------------------- messages


@query("kafka_sink", f"{B0} SELECT symbol AS key, {DAY}, open, high, low, close, CAST(volume AS BIGINT) AS volume FROM bars")
def kafka_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Message frame of all bars, decoded again."""
    sent = to_messages(
        D.bars(spark, sf).select("symbol", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), *S.OHLCV[:4],
                                 F.col("volume").cast("bigint").alias("volume"), F.lit("bars").alias("source"))
    )
    keyed = parse_messages(sent).withColumnRenamed("symbol", "key")
    return keyed.select("key", day(), *S.OHLCV)


@query(
    "stream_stats",
    f"""{B0} SELECT symbol, count(*) AS messages, count(DISTINCT symbol) AS symbols, 0 AS overall FROM bars GROUP BY symbol
    UNION ALL SELECT NULL, count(*), count(DISTINCT symbol), 1 FROM bars""",
)
def stream_stats(spark: SparkSession, sf: str) -> DataFrame:
    return M.message_stats(D.bars(spark, sf))


# ------------------------------------------------------------------ predictions, records


@query(
    "asof_predictions",
    f"""{B0}, p AS (SELECT symbol, ts, {PRED} AS prediction FROM bars WHERE date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) % 5 = 0)
    SELECT b.symbol, CAST(CAST(b.ts AS DATE) AS VARCHAR) AS day, close, prediction
    FROM bars b ASOF LEFT JOIN p ON b.symbol = p.symbol AND b.ts >= p.ts""",
)
def asof_predictions(spark: SparkSession, sf: str) -> DataFrame:
    left = D.bars(spark, sf).select("symbol", "ts", "close")
    return asof_join(left, D.sparse_predictions(spark, sf)).select("symbol", day(), "close", "prediction")


@query(
    "asof_predictions_eras",
    f"""{B0}, p AS (SELECT symbol, ts, {PRED} AS prediction FROM bars WHERE date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) % 5 = 0)
    SELECT b.symbol, CAST(CAST(b.ts AS DATE) AS VARCHAR) AS day, close, prediction
    FROM bars b ASOF LEFT JOIN p ON b.symbol = p.symbol AND b.ts >= p.ts""",
)
def asof_predictions_eras(spark: SparkSession, sf: str) -> DataFrame:
    """The same join with every symbol split into calendar eras, as for a hot symbol."""
    left = D.bars(spark, sf).select("symbol", "ts", "close")
    joined = asof_join(left, D.sparse_predictions(spark, sf), era_seconds=90 * D.DAY)
    return joined.select("symbol", day(), "close", "prediction")


SIGNAL = "CASE WHEN prediction > 0.6 THEN 'BUY' WHEN prediction < 0.4 THEN 'SELL' ELSE 'HOLD' END AS signal"
RECORDS = f"p AS (SELECT symbol, ts, {PRED} AS prediction FROM bars), rec AS (SELECT *, floor(abs(prediction - 0.5) * 2 * 1e6 + 0.5) / 1e6 AS confidence, {SIGNAL} FROM p)"


def records(spark: SparkSession, sf: str) -> DataFrame:
    out = M.signal_record(D.predictions(spark, sf))
    return out.withColumn("confidence", grid("confidence", 6))


RECORD_COLS = ("prediction", "confidence", "signal")


@query("signal_record", f"{B0}, {RECORDS} SELECT symbol, {DAY}, prediction, confidence, signal FROM rec")
def signal_record(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("symbol", day(), *RECORD_COLS)


@query("prediction_json_sink", f"{B0}, {RECORDS} SELECT symbol, {DAY}, prediction, confidence, signal FROM rec")
def prediction_json_sink(spark: SparkSession, sf: str) -> DataFrame:
    """All records written as JSON by day, and read back."""
    path = workspace(spark, "prediction-json")
    write_prediction_json(records(spark, sf), path)
    return read_prediction_json(spark, path).select("symbol", day(), *RECORD_COLS)


@query("prediction_table", f"{B0}, {RECORDS} SELECT symbol, {DAY}, prediction, confidence, signal FROM rec WHERE ts >= '2001-06-01'")
def prediction_table(spark: SparkSession, sf: str) -> DataFrame:
    path = workspace(spark, "prediction-table")
    write_prediction_table(records(spark, sf), path)
    return read_prediction_table(spark, path, since="2001-06-01").select("symbol", day(), *RECORD_COLS)


@query(
    "prediction_history",
    f"{B0}, {RECORDS} SELECT {DAY}, prediction, confidence, signal FROM rec WHERE symbol = 'Brand#7' AND ts > TIMESTAMP '2001-06-01' - INTERVAL 2400 HOUR ORDER BY ts DESC",
)
def prediction_history(spark: SparkSession, sf: str) -> DataFrame:
    return M.prediction_history(records(spark, sf), "Brand#7", "2001-06-01", 2400).select(day(), *RECORD_COLS)


HISTORY = f"hist AS (SELECT symbol, ts, {PRED} AS prediction, lead(close) OVER ({W}) / close - 1 AS actual_return FROM bars)"


def history(spark: SparkSession, sf: str) -> DataFrame:
    s = as_series(D.bars(spark, sf), ahead=1, **bound(spark, sf))
    s = s.add({"prediction": D.prediction(), "actual_return": T.forward_return(s.axis, 1)})
    return s.tidy().select("symbol", "ts", "prediction", "actual_return")


RIGHT = "(coalesce(prediction > 0.5, false) = coalesce(actual_return > 0, false))"


@query(
    "accuracy_rollup",
    f"""{B0}, {HISTORY} SELECT symbol, {rnd(f'avg(CAST({RIGHT} AS DOUBLE))', 8)} AS accuracy, count(*) AS total_predictions,
    CAST(grouping(symbol) AS INTEGER) AS overall FROM hist WHERE ts > TIMESTAMP '2001-01-01' - INTERVAL 8760 HOUR GROUP BY ROLLUP (symbol)""",
)
def accuracy_rollup(spark: SparkSession, sf: str) -> DataFrame:
    out = M.accuracy_rollup(history(spark, sf), "2001-01-01", 8760)
    return rounded(out, {"accuracy": 8}, ["symbol", "total_predictions", "overall"])


@query(
    "score_default",
    f"""{B0}, every AS (SELECT DISTINCT s_name AS symbol FROM supplier UNION SELECT DISTINCT symbol FROM bars),
    scored AS (SELECT symbol, arg_max({PRED}, ts) AS prediction FROM bars GROUP BY symbol),
    j AS (SELECT e.symbol, s.prediction AS raw, coalesce(s.prediction, 0.5) AS prediction FROM every e LEFT JOIN scored s USING (symbol))
    SELECT symbol, prediction, {rnd('abs(prediction - 0.5) * 2', 6)} AS confidence, {SIGNAL},
    CASE WHEN raw IS NULL THEN 'default' ELSE '1.0' END AS model_version, CASE WHEN raw IS NULL THEN 0 ELSE 12 END AS features_used,
    CASE WHEN raw IS NULL THEN 'Model not available' END AS error FROM j""",
)
def score_default(spark: SparkSession, sf: str) -> DataFrame:
    preds = D.predictions(spark, sf)
    newest = preds.groupBy("symbol").agg(F.max_by("prediction", "ts").alias("prediction"))
    names = D.table(spark, sf, "supplier").select(F.col("s_name").alias("symbol"))
    every = names.unionByName(newest.select("symbol")).distinct()
    return M.score_default(every, newest, 12).withColumn("confidence", grid("confidence", 6))


# ------------------------------------------------------------------------- market panel

ABSENT = "SPY"
ALIGN = f"""m AS (SELECT ts FROM bars WHERE symbol = 'IDX'), names AS (SELECT DISTINCT symbol FROM bars),
g AS (SELECT n.symbol, m.ts FROM names n CROSS JOIN m),
al AS (SELECT g.symbol, g.ts, b.open, b.high, b.low, b.close, b.volume FROM g ASOF LEFT JOIN bars b ON g.symbol = b.symbol AND g.ts >= b.ts)"""
RELATIVE = f"""mk AS (SELECT ts, {change('close')} AS market_return FROM bars WHERE symbol = 'IDX'),
mv AS (SELECT ts, market_return, CASE WHEN count(market_return) OVER (ORDER BY ts ROWS 19 PRECEDING) = 20
  THEN stddev_samp(market_return) OVER (ORDER BY ts ROWS 19 PRECEDING) END AS market_volatility FROM mk),
ar AS (SELECT *, {change('close')} AS asset_return FROM al),
rel AS (SELECT ar.*, market_return, market_volatility, asset_return - market_return AS relative_performance FROM ar LEFT JOIN mv USING (ts))"""


def with_index(sql: str) -> str:
    return sql.replace("'IDX'", "(SELECT min(s_name) FROM supplier)")


def index_symbol(spark: SparkSession, sf: str) -> str:
    return D.table(spark, sf, "supplier").agg(F.min("s_name")).first()[0]


@query("market_calendar_align", with_index(f"{S0}, {ALIGN} SELECT {BAR_COLS} FROM al"))
def market_calendar_align(spark: SparkSession, sf: str) -> DataFrame:
    out = P.market_calendar_align(D.supplier_bars(spark, sf), index_symbol(spark, sf), **bound(spark, sf))
    return out.select("symbol", day(), *S.OHLCV)


def relative(spark: SparkSession, sf: str) -> DataFrame:
    return P.market_features(D.supplier_bars(spark, sf), index_symbol(spark, sf), **bound(spark, sf))


REL_COLS = {"close": 0, "market_return": 6, "market_volatility": 5, "relative_performance": 6}


@query(
    "market_features",
    with_index(f"{S0}, {ALIGN}, {RELATIVE} SELECT symbol, {DAY}, " + ", ".join(f"{rnd(n, d)} AS {n}" for n, d in REL_COLS.items()) + " FROM rel"),
)
def market_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(relative(spark, sf), REL_COLS, ["symbol", day()])


@query("market_features_absent", f"{S0} SELECT {BAR_COLS} FROM bars")
def market_features_absent(spark: SparkSession, sf: str) -> DataFrame:
    """Without the index symbol in the panel the bars stay as they are."""
    return P.market_features(D.supplier_bars(spark, sf), ABSENT).select("symbol", day(), *S.OHLCV)


@query(
    "beta",
    with_index(f"""{S0}, {ALIGN}, {RELATIVE}, ok AS (SELECT * FROM rel WHERE asset_return IS NOT NULL AND market_return IS NOT NULL),
    st AS (SELECT symbol, count(*) AS n, corr(asset_return, market_return) AS c, stddev_samp(asset_return) AS a, stddev_samp(market_return) AS b FROM ok GROUP BY symbol)
    SELECT n.symbol, {rnd('CASE WHEN n > 20 AND a > 0 AND b > 0 THEN c * a / b ELSE 1.0 END', 6)} AS beta FROM names n LEFT JOIN st USING (symbol)"""),
)
def beta(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.beta(relative(spark, sf)), {"beta": 6}, ["symbol"])


@query(
    "beta_60",
    with_index(f"""{S0}, {ALIGN}, {RELATIVE} SELECT symbol, {DAY}, {rnd(f"CASE WHEN {frame('count(asset_return + market_return)', 60)} = 60 THEN {frame('covar_samp(asset_return, market_return)', 60)} / nullif({frame('var_samp(market_return)', 60)}, 0) END", 5)} AS beta_60 FROM rel"""),
)
def beta_60(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.rolling_beta(relative(spark, sf), **bound(spark, sf)), {"beta_60": 5}, ["symbol", day()])


# ----------------------------------------------------------------------------- targets


def target_query(kind: str, horizon: int, digits: int | None):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = T.create_targets(D.bars(spark, sf), kind, horizon, **bound(spark, sf))
        value = F.col("target") if digits is None else grid("target", digits).alias("target")
        return out.select("symbol", day(), value)

    return run


AHEAD = f"lead(close, 3) OVER ({W}) / close - 1"
query("target_directional", f"{B0} SELECT symbol, {DAY}, CAST(coalesce({AHEAD} > 0, false) AS INTEGER) AS target FROM bars")(target_query("directional", 3, None))
query("target_return", f"{B0} SELECT symbol, {DAY}, {rnd(AHEAD, 6)} AS target FROM bars")(target_query("regression", 3, 6))
NEXT = f"OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
query(
    "target_volatility",
    f"{B0}, r AS (SELECT *, {change('close')} AS ret FROM bars) SELECT symbol, {DAY}, {rnd(f'CASE WHEN count(ret) {NEXT} = 5 THEN stddev_samp(ret) {NEXT} END', 5)} AS target FROM r",
)(target_query("volatility", 5, 5))


@query(
    "label_align",
    f"""{B0}, y AS (SELECT symbol, ts, CAST(lead(close) OVER ({W}) > close AS INTEGER) AS target FROM bars QUALIFY lead(close) OVER ({W}) IS NOT NULL)
    SELECT b.symbol, CAST(CAST(b.ts AS DATE) AS VARCHAR) AS day, close, target FROM bars b JOIN y ON b.symbol = y.symbol AND b.ts = y.ts""",
)
def label_align(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.bars(spark, sf)
    labels = T.create_targets(rows, drop_unlabelled=True, **bound(spark, sf))
    return T.label_align(rows.select("symbol", "ts", "close"), labels).select("symbol", day(), "close", "target")


# ---------------------------------------------------------------------------- backtest


def backtest_sql(strategy: str = "long_short", t: float = 0.6, sparse: bool = True) -> str:
    """CTEs up to ``eq``: the per-bar result of a strategy on the index-scale bars."""
    pos = {
        "long_only": f"CASE WHEN prediction > {t} THEN 1 ELSE 0 END",
        "short_only": f"CASE WHEN prediction < 1 - {t}::DOUBLE THEN -1 ELSE 0 END",
        "long_short": f"CASE WHEN prediction > {t} THEN 1 WHEN prediction < 1 - {t}::DOUBLE THEN -1 ELSE 0 END",
    }[strategy]
    where = "WHERE date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) % 5 = 0" if sparse else ""
    return f"""WITH {CALM}, p AS (SELECT symbol, ts, {PRED} AS prediction FROM bars {where}),
j AS (SELECT b.*, p.prediction AS raw_p FROM bars b ASOF LEFT JOIN p ON b.symbol = p.symbol AND b.ts >= p.ts),
f0 AS (SELECT *, {change('close')} AS r0, ln(close / {lag('close')}) AS lr0 FROM j),
fr AS (SELECT symbol, ts, close, coalesce(raw_p, 0.0) AS prediction, coalesce(r0, 0.0) AS returns, coalesce(lr0, 0.0) AS log_returns,
  coalesce(({std('r0', 20)}) * sqrt(252.0), 0.0) AS volatility, coalesce({mean('close', 20)}, 0.0) AS sma_20, coalesce({mean('close', 50)}, 0.0) AS sma_50 FROM f0),
sg AS (SELECT *, {pos} AS position FROM fr),
sc AS (SELECT *, position - {lag('position')} AS position_change, abs(position - {lag('position')}) * 0.001 AS trade_cost FROM sg),
sr AS (SELECT *, {lag('position')} * returns - trade_cost - abs(position_change) * 0.0005 AS strategy_returns, returns AS benchmark_returns FROM sc),
e0 AS (SELECT *, 100000.0 * {running('product(1.0 + strategy_returns)')} AS c0, 100000.0 * {running('product(1.0 + benchmark_returns)')} AS benchmark_cumulative,
  strategy_returns - benchmark_returns AS excess_returns FROM sr),
e1 AS (SELECT *, CASE WHEN {running('count(strategy_returns)')} > 0 THEN c0 END AS cumulative_returns FROM e0),
eq AS (SELECT *, cumulative_returns / {running('max(cumulative_returns)')} - 1 AS drawdown FROM e1)"""


def result(spark: SparkSession, sf: str, strategy: str = "long_short", **kw) -> Series:
    return B.run_backtest(D.calm_bars(spark, sf).select("symbol", "ts", "close"), D.sparse_predictions(spark, sf), strategy, **bound(spark, sf), **kw)


FRAME_COLS = {"prediction": 6, "returns": 7, "log_returns": 7, "volatility": 5, "sma_20": 2, "sma_50": 2}


def cols_sql(cols: dict[str, int]) -> str:
    return ", ".join(f"{rnd(n, d)} AS {n}" for n, d in cols.items())


@query("backtest_frame", f"{backtest_sql()} SELECT symbol, {DAY}, {cols_sql(FRAME_COLS)} FROM fr")
def backtest_frame(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(result(spark, sf).tidy(), FRAME_COLS, ["symbol", day()])


def _signal_query(strategy: str) -> None:
    @query(f"signals_{strategy}", f"{backtest_sql(strategy)} SELECT symbol, {DAY}, prediction, position FROM sg")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return result(spark, sf, strategy).tidy().select("symbol", day(), "prediction", "position")


for _name in ("long_only", "short_only", "long_short"):
    _signal_query(_name)


@query("trade_costs", f"{backtest_sql()} SELECT symbol, {DAY}, position_change, {rnd('trade_cost', 6)} AS trade_cost FROM sc")
def trade_costs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(result(spark, sf).tidy(), {"trade_cost": 6}, ["symbol", day(), "position_change"])


@query("strategy_returns", f"{backtest_sql()} SELECT symbol, {DAY}, {cols_sql({'strategy_returns': 8, 'benchmark_returns': 8})} FROM sr")
def strategy_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(result(spark, sf).tidy(), {"strategy_returns": 8, "benchmark_returns": 8}, ["symbol", day()])


EQUITY = {"cumulative_returns": 2, "benchmark_cumulative": 2, "excess_returns": 7}


@query("equity_curve", f"{backtest_sql()} SELECT symbol, {DAY}, {cols_sql(EQUITY)} FROM eq")
def equity_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(result(spark, sf).tidy(), EQUITY, ["symbol", day()])


@query("drawdown", f"{backtest_sql()} SELECT symbol, {DAY}, {rnd('drawdown', 7)} AS drawdown FROM eq")
def drawdown(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(result(spark, sf).tidy(), {"drawdown": 7}, ["symbol", day()])


def metrics_sql(by: str = "symbol", src: str = "eq") -> str:
    """CTE ``mt`` with every metric, one row per group of ``src``."""
    def z(x: str) -> str:
        return f"coalesce({x}, 0)"

    def over(a: str, b: str) -> str:
        return f"CASE WHEN {b} > 0 THEN ({a}) / nullif({b}, 0) ELSE 0 END"

    return f"""vr AS (SELECT *, quantile_cont(strategy_returns, 0.05) OVER (PARTITION BY {by}) AS v,
  returns > 0 AS up, prediction > 0.5 AS said FROM {src}),
ag AS (SELECT {by}, arg_max(cumulative_returns, ts) / 100000.0 - 1 AS g, arg_max(benchmark_cumulative, ts) / 100000.0 - 1 AS bg,
  stddev_samp(strategy_returns) * sqrt(252.0) AS vol, stddev_samp(benchmark_returns) * sqrt(252.0) AS bvol,
  stddev_samp(strategy_returns) FILTER (strategy_returns < 0) * sqrt(252.0) AS dvol, min(drawdown) AS md,
  count(strategy_returns) AS n, count(*) FILTER (strategy_returns > 0) AS nw, count(*) FILTER (strategy_returns < 0) AS nl,
  avg(strategy_returns) FILTER (strategy_returns > 0) AS aw, avg(strategy_returns) FILTER (strategy_returns < 0) AS al,
  sum(strategy_returns) FILTER (strategy_returns > 0) AS sw, sum(strategy_returns) FILTER (strategy_returns < 0) AS sl,
  avg(excess_returns) AS ex, stddev_samp(excess_returns) * sqrt(252.0) AS te, avg(CAST(up = said AS DOUBLE)) AS acc,
  count(*) FILTER (up AND said) AS tp, count(*) FILTER (NOT up AND said) AS fp, count(*) FILTER (up AND NOT said) AS fn,
  any_value(v) AS v, avg(strategy_returns) FILTER (strategy_returns <= v) AS cv FROM vr GROUP BY {by}),
a2 AS (SELECT *, {z('tp / nullif(tp + fp, 0)')} AS pr, {z('tp / nullif(tp + fn, 0)')} AS rc FROM ag),
mt AS (SELECT {by}, g AS total_return, bg AS benchmark_return, g - bg AS excess_return, vol AS strategy_volatility, bvol AS benchmark_volatility,
  {over('g - 0.02', 'vol')} AS sharpe_ratio, {over('g - 0.02', 'dvol')} AS sortino_ratio, md AS max_drawdown, {z('g / nullif(abs(md), 0)')} AS calmar_ratio,
  {z('nw / nullif(n, 0)')} AS win_rate, {z('aw')} AS avg_win, {z('al')} AS avg_loss, {z('CASE WHEN sl IS NOT NULL THEN abs(coalesce(sw, 0) / nullif(sl, 0)) END')} AS profit_factor,
  {over('ex * 252', 'te')} AS information_ratio, acc AS directional_accuracy, pr AS "precision", rc AS recall, {z('2 * pr * rc / nullif(pr + rc, 0)')} AS f1_score,
  n AS total_trades, nw AS profitable_trades, nl AS losing_trades, v AS var_95, cv AS cvar_95 FROM a2)"""


COUNTS = ("total_trades", "profitable_trades", "losing_trades")
METRIC_DIGITS = {n: 6 for n in B.METRICS if n not in COUNTS}
METRIC_COLS = ", ".join(f"{rnd(chr(34) + n + chr(34), d)} AS {n}" for n, d in METRIC_DIGITS.items()).replace(" AS precision", ' AS "precision"')


@query("backtest_metrics", f"{backtest_sql()}, {metrics_sql()} SELECT symbol, {', '.join(COUNTS)}, {METRIC_COLS} FROM mt")
def backtest_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.metrics(result(spark, sf)), METRIC_DIGITS, ["symbol", *COUNTS])


@query("backtest_metrics_sliced", f"{backtest_sql()}, {metrics_sql()} SELECT symbol, {', '.join(COUNTS)}, {METRIC_COLS} FROM mt")
def backtest_metrics_sliced(spark: SparkSession, sf: str) -> DataFrame:
    """The same metrics with every symbol cut into slices and the tail risk from counted bins."""
    out = B.metrics(result(spark, sf, limit=400, slice_rows=400, era_seconds=180 * D.DAY))
    return rounded(out, METRIC_DIGITS, ["symbol", *COUNTS])


BINNED = f"""{backtest_sql()}, lg AS (SELECT symbol, 'strategy_returns' AS kind, strategy_returns AS value FROM eq UNION ALL SELECT symbol, 'benchmark_returns', benchmark_returns FROM eq),
lv AS (SELECT * FROM lg WHERE value IS NOT NULL), sp AS (SELECT symbol, kind, min(value) AS lo, max(value) AS hi, count(*) AS n FROM lv GROUP BY 1, 2),
bn AS (SELECT symbol, kind, lo, hi, n, CAST(coalesce(least(floor((value - lo) / nullif((hi - lo) / 50, 0)), 49), 0) AS INTEGER) AS bin FROM lv JOIN sp USING (symbol, kind))
SELECT symbol, kind, bin, {rnd('any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 50', 6)} AS left_edge, count(*) AS n_returns,
{rnd('count(*) / (any_value(n) * nullif((any_value(hi) - any_value(lo)) / 50, 0))', 4)} AS density FROM bn GROUP BY symbol, kind, bin"""


@query("returns_histogram", BINNED)
def returns_histogram(spark: SparkSession, sf: str) -> DataFrame:
    out = B.returns_histogram(result(spark, sf).tidy())
    return rounded(out, {"left_edge": 6, "density": 4}, ["symbol", "kind", "bin", "n_returns"])


@query("signal_points", f"{backtest_sql()} SELECT symbol, {DAY}, close, CASE WHEN position = 1 THEN 'buy' ELSE 'sell' END AS mark FROM sg WHERE position <> 0")
def signal_points(spark: SparkSession, sf: str) -> DataFrame:
    return B.signal_points(result(spark, sf).tidy()).select("symbol", day(), "close", "mark")


def report_sql() -> str:
    lines = ["'BACKTEST SUMMARY REPORT'", "'Strategy: long_short'", "'Confidence Threshold: 0.6'"]
    for title, entries in B.REPORT:
        lines.append(f"'{title}'")
        for label, name, kind in entries:
            label, q = label.replace("%%", "%"), f'"{name}"'
            value = f"CAST({q} AS VARCHAR)" if kind == "d" else f"format('{{:.2f}}', {rnd(f'{q} * {100 if kind == '%' else 1}', 2)})"
            lines.append(f"'{label}: ' || {value}" + (" || '%'" if kind == "%" else ""))
    return f"{backtest_sql()}, {metrics_sql()} SELECT symbol, concat_ws(chr(10), {', '.join(lines)}) AS report FROM mt"


@query("backtest_report", report_sql())
def backtest_report(spark: SparkSession, sf: str) -> DataFrame:
    return B.report(B.metrics(result(spark, sf)))


# ---------------------------------------------------------------- folds and walk-forward

NUMBERED = f"nb AS (SELECT *, row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars)"
FOLDS = f"""{NUMBERED}, sy AS (SELECT DISTINCT symbol, n FROM nb), fd AS (SELECT symbol, unnest(range(252, n - 63, 21)) AS i FROM sy),
fj AS (SELECT nb.*, CAST((i - 252) / 21 AS INTEGER) AS fold, CASE WHEN rn < i THEN 'train' ELSE 'test' END AS part
  FROM nb JOIN fd ON nb.symbol = fd.symbol AND rn >= i - 252 AND rn < i + 63)"""


@query(
    "walk_forward_folds",
    f"""{B0}, {FOLDS} SELECT symbol, fold, CAST(CAST(min(ts) FILTER (part = 'train') AS DATE) AS VARCHAR) AS train_start,
    CAST(CAST(max(ts) FILTER (part = 'train') AS DATE) AS VARCHAR) AS train_end, CAST(CAST(min(ts) FILTER (part = 'test') AS DATE) AS VARCHAR) AS test_start,
    CAST(CAST(max(ts) FILTER (part = 'test') AS DATE) AS VARCHAR) AS test_end, count(*) FILTER (part = 'train') AS train_rows,
    count(*) FILTER (part = 'test') AS test_rows FROM fj GROUP BY symbol, fold""",
)
def walk_forward_folds(spark: SparkSession, sf: str) -> DataFrame:
    out = WF.folds(as_series(D.bars(spark, sf), **bound(spark, sf)))
    dates = [F.to_date(n).cast("string").alias(n) for n in ("train_start", "train_end", "test_start", "test_end")]
    return out.select("symbol", "fold", *dates, "train_rows", "test_rows")


@query("fold_join", f"{B0}, {FOLDS} SELECT symbol, {DAY}, fold, part, close FROM fj")
def fold_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = WF.fold_rows(as_series(D.bars(spark, sf), **bound(spark, sf)))
    return rows.select("symbol", day(), "fold", "part", "close")


@query(
    "time_series_split",
    f"""{B0}, {NUMBERED}, k AS (SELECT unnest(range(0, 5)) AS fold), z AS (SELECT nb.*, fold, n // 6 AS size, n - 5 * (n // 6) + fold * (n // 6) AS lo FROM nb CROSS JOIN k)
    SELECT symbol, CAST(fold AS INTEGER) AS fold, count(*) FILTER (rn < lo) AS train_rows, count(*) FILTER (rn >= lo AND rn < lo + size) AS test_rows,
    CAST(CAST(min(ts) FILTER (rn >= lo AND rn < lo + size) AS DATE) AS VARCHAR) AS test_start FROM z WHERE size > 0 GROUP BY symbol, fold""",
)
def time_series_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = WF.time_series_split(as_series(D.bars(spark, sf), **bound(spark, sf)))
    part = F.col("part")
    return rows.groupBy("symbol", "fold").agg(
        F.count(F.when(part == "train", 1)).alias("train_rows"), F.count(F.when(part == "test", 1)).alias("test_rows"),
        F.to_date(F.min(F.when(part == "test", F.col("ts")))).cast("string").alias("test_start"),
    )


@query("chrono_split", f"{B0}, {NUMBERED} SELECT symbol, {DAY}, CASE WHEN rn < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS part FROM nb")
def chrono_split(spark: SparkSession, sf: str) -> DataFrame:
    return WF.chrono_split(as_series(D.bars(spark, sf), **bound(spark, sf))).tidy().select("symbol", day(), "part")


FW = "PARTITION BY symbol, fold ORDER BY ts"
FOLD_EQ = f"""WITH {CALM}, {FOLDS}, t0 AS (SELECT *, {PRED} AS prediction, coalesce(close / lag(close) OVER ({FW}) - 1, 0.0) AS returns FROM fj WHERE part = 'test'),
t1 AS (SELECT *, CASE WHEN prediction > 0.6 THEN 1 WHEN prediction < 1 - 0.6::DOUBLE THEN -1 ELSE 0 END AS position FROM t0),
t2 AS (SELECT *, lag(position) OVER ({FW}) * returns - abs(position - lag(position) OVER ({FW})) * 0.001 - abs(position - lag(position) OVER ({FW})) * 0.0005 AS strategy_returns,
  returns AS benchmark_returns FROM t1),
t3 AS (SELECT *, 100000.0 * product(1.0 + strategy_returns) OVER ({FW} ROWS UNBOUNDED PRECEDING) AS c0,
  100000.0 * product(1.0 + benchmark_returns) OVER ({FW} ROWS UNBOUNDED PRECEDING) AS benchmark_cumulative, strategy_returns - benchmark_returns AS excess_returns FROM t2),
t4 AS (SELECT *, CASE WHEN strategy_returns IS NOT NULL THEN c0 END AS cumulative_returns FROM t3),
eq AS (SELECT *, cumulative_returns / max(cumulative_returns) OVER ({FW} ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM t4), {metrics_sql('symbol, fold')}"""


def fold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    s = as_series(D.calm_bars(spark, sf), **bound(spark, sf)).add({"prediction": D.prediction()})
    rows = WF.fold_rows(s, parts=("test",)).select("symbol", "fold", "ts", "close", "prediction")
    return WF.walk_forward_metrics(rows)


FOLD_DIGITS = {n: 5 for n in METRIC_DIGITS}
FOLD_COLS = METRIC_COLS.replace("1e6", "1e5")


@query("walk_forward_metrics", f"{FOLD_EQ} SELECT symbol, fold, {', '.join(COUNTS)}, {FOLD_COLS} FROM mt")
def walk_forward_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Walk-forward backtests of the fixture predictions."""
    return rounded(fold_metrics(spark, sf), FOLD_DIGITS, ["symbol", "fold", *COUNTS])


SUMMARY = {n: 6 for n in ("avg_total_return", "avg_sharpe_ratio", "avg_max_drawdown", "avg_directional_accuracy", "consistency_score")}


@query(
    "walk_forward_summary",
    f"""{FOLD_EQ} SELECT symbol, count(*) AS total_periods, {rnd('avg(total_return)', 6)} AS avg_total_return, {rnd('avg(sharpe_ratio)', 6)} AS avg_sharpe_ratio,
    {rnd('avg(max_drawdown)', 6)} AS avg_max_drawdown, {rnd('avg(directional_accuracy)', 6)} AS avg_directional_accuracy,
    {rnd('avg(CAST(total_return > 0 AS DOUBLE))', 6)} AS consistency_score FROM mt GROUP BY symbol""",
)
def walk_forward_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(WF.walk_forward_summary(fold_metrics(spark, sf), ["symbol"]), SUMMARY, ["symbol", "total_periods"])


# ------------------------------------------------------------------ model-level operators

MODEL_SQL = ", ".join(f"{model_sql(m)} AS {n}" for n, m in D.MODELS.items())
TARGETED = f"tg AS (SELECT symbol, ts, CAST(coalesce(lead(close) OVER ({W}) / close - 1 > 0, false) AS INTEGER) AS target, {MODEL_SQL} FROM bars)"
LONG = "lg AS (UNPIVOT (SELECT * FROM tg) ON model_a, model_b, model_c, model_d INTO NAME model VALUE p)"


def model_rows(spark: SparkSession, sf: str) -> DataFrame:
    s = as_series(D.bars(spark, sf), ahead=1, **bound(spark, sf))
    s = T.add_target(s).add({n: D.prediction(m) for n, m in D.MODELS.items()})
    return s.tidy().select("symbol", "ts", "target", *D.MODELS)


CLASS = {"accuracy": 6, "precision": 6, "recall": 6, "f1": 6}
CLASS_SQL = f"""SELECT KEYS model, {rnd('avg(CAST((target = 1) = (p > 0.5) AS DOUBLE))', 6)} AS accuracy,
{rnd('coalesce(count(*) FILTER (target = 1 AND p > 0.5) / nullif(count(*) FILTER (p > 0.5), 0), 0)', 6)} AS "precision",
{rnd('coalesce(count(*) FILTER (target = 1 AND p > 0.5) / nullif(count(*) FILTER (target = 1), 0), 0)', 6)} AS recall,
{rnd('coalesce(2 * count(*) FILTER (target = 1 AND p > 0.5) / nullif(count(*) FILTER (target = 1) + count(*) FILTER (p > 0.5), 0), 0)', 6)} AS f1
FROM lg GROUP BY KEYS model"""


@query("classification_metrics", f"{B0}, {TARGETED}, {LONG} {CLASS_SQL.replace('KEYS', 'symbol,')}")
def classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = M.classification_metrics(model_rows(spark, sf), list(D.MODELS), ["symbol"])
    return rounded(out, CLASS, ["symbol", "model"])


WEIGHTS = f"""ac AS (SELECT model, avg(CAST((target = 1) = (p > 0.5) AS DOUBLE)) AS accuracy FROM lg GROUP BY model),
wt AS (SELECT model, accuracy, accuracy / sum(accuracy) OVER () AS weight FROM ac)"""


@query("ensemble_weights", f"{B0}, {TARGETED}, {LONG}, {WEIGHTS} SELECT model, {rnd('accuracy', 8)} AS accuracy, {rnd('weight', 8)} AS weight FROM wt")
def weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ensemble_weights(model_rows(spark, sf), list(D.MODELS)), {"accuracy": 8, "weight": 8}, ["model"])


FIXED = {"model_a": 0.4, "model_b": 0.3, "model_c": 0.2, "model_d": 0.1}
PRESENT = "CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY ts) > 60 THEN model_d END"


@query(
    "ensemble_predict",
    f"""{B0}, {TARGETED}, q AS (SELECT *, {PRESENT} AS d FROM tg) SELECT symbol, {DAY},
    {rnd('0.4 * model_a + 0.3 * model_b + 0.2 * model_c + 0.1 * coalesce(d, 0)', 6)} AS prediction,
    {rnd('(0.4 * model_a + 0.3 * model_b + 0.2 * model_c + 0.1 * coalesce(d, 0)) / (0.9 + CASE WHEN d IS NULL THEN 0 ELSE 0.1 END)', 6)} AS renormalised FROM q""",
)
def weighted_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed weights; the last model is missing for the first 60 rows of each symbol."""
    s = as_series(model_rows(spark, sf), **bound(spark, sf))
    s = s.add({"model_d": F.when(F.row_number().over(s.axis.spec) > 60, F.col("model_d"))})
    s = s.add({"prediction": ensemble_predict(FIXED), "renormalised": ensemble_predict(FIXED, True)})
    return rounded(s.tidy(), {"prediction": 6, "renormalised": 6}, ["symbol", day()])


@query("soft_vote", f"{B0}, {TARGETED} SELECT symbol, {DAY}, {rnd('(model_a + model_b) / 2', 6)} AS prediction FROM tg")
def soft_vote(spark: SparkSession, sf: str) -> DataFrame:
    out = model_rows(spark, sf).withColumn("prediction", vote(["model_a", "model_b"]))
    return rounded(out, {"prediction": 6}, ["symbol", day()])


@query(
    "sequence_windows",
    f"""{B0}, q AS (SELECT symbol, ts, count(*) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS n,
    list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS c,
    list(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS v FROM bars)
    SELECT symbol, {DAY}, len(c) AS length, c[1] AS oldest_close, c[60] AS newest_close, v[1] AS oldest_volume, list_sum(v) AS volume_sum FROM q WHERE n = 60""",
)
def sequences(spark: SparkSession, sf: str) -> DataFrame:
    s = sequence_windows(as_series(D.bars(spark, sf), lookback=60, **bound(spark, sf)), ["close", "volume"])
    q = F.col("sequence")
    volumes = F.transform(q, lambda r: r[1])
    return s.tidy().where(q.isNotNull()).select(
        "symbol", day(), F.size(q).cast("bigint").alias("length"), q[0][0].alias("oldest_close"), q[59][0].alias("newest_close"),
        q[0][1].alias("oldest_volume"), F.aggregate(volumes, F.lit(0.0), lambda a, x: a + x).alias("volume_sum"),
    )


PERF = f"{B0}, {TARGETED}, {LONG}, cm AS ({CLASS_SQL.replace('KEYS', 'symbol,')}), pf AS (SELECT * FROM cm)"


def performance(spark: SparkSession, sf: str) -> DataFrame:
    """All four models on all symbols."""
    return classification_metrics(spark, sf)


@query("asset_rankings", f'{PERF} SELECT symbol, model, accuracy AS metric, "precision", recall, row_number() OVER (PARTITION BY model ORDER BY accuracy DESC, symbol) AS place FROM pf QUALIFY place <= 10')
def asset_rankings(spark: SparkSession, sf: str) -> DataFrame:
    return M.asset_rankings(performance(spark, sf), "accuracy", 10, ["model"]).withColumn("place", F.col("place").cast("bigint"))


@query("panel_summary", f"{PERF} SELECT model, count(accuracy) AS successful_models, {rnd('avg(accuracy)', 5)} AS mean_accuracy FROM pf GROUP BY model")
def panel_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.panel_summary(performance(spark, sf), ["model"]), {"mean_accuracy": 5}, ["model", "successful_models"])


@query(
    "stream_performance",
    f"""{backtest_sql()}, d AS (SELECT CAST(ts AS DATE) AS d, avg(strategy_returns) AS s, avg(benchmark_returns) AS b FROM eq
    WHERE CAST(ts AS DATE) <= DATE '2000-12-31' AND CAST(ts AS DATE) > DATE '2000-12-31' - 30 GROUP BY 1)
    SELECT CAST(d AS VARCHAR) AS day, {rnd('product(1.0 + coalesce(s, 0)) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) - 1', 7)} AS strategy_returns,
    {rnd('product(1.0 + coalesce(b, 0)) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) - 1', 7)} AS benchmark_returns FROM d""",
)
def stream_performance(spark: SparkSession, sf: str) -> DataFrame:
    out = M.performance_curve(result(spark, sf).tidy(), "2000-12-31", 30)
    return rounded(out, {"strategy_returns": 7, "benchmark_returns": 7}, [F.col("day").cast("string").alias("day")])


@query("latest_features", f"{B0}, z AS (SELECT symbol, ts, {change('close')} AS return_1d, {mean('volume', 5)} AS volume_ma_5 FROM bars) SELECT symbol, {DAY}, {rnd('return_1d', 6)} AS return_1d, {rnd('volume_ma_5', 4)} AS volume_ma_5 FROM z QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1")
def latest_features(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.catalogue import build_features

    out = build_features(D.bars(spark, sf), columns=["return_1d", "volume_ma_5"], **bound(spark, sf))
    return rounded(S.latest_rows(out), {"return_1d": 6, "volume_ma_5": 4}, ["symbol", day()])

