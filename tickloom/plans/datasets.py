"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import Axis, Series, as_series, rows_bound
from ..sources.bars import bars_from_trades

DAY = 86_400


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: A table of names with more rows is joined by a shuffle. Spark's own check looks at compressed bytes of a
#: few columns, by which millions of rows, hundreds of MB when unpacked, still pass through the driver.
MOST_NAMES = 500_000
_NAMES: dict[tuple[str, str, str], int] = {}


def named(spark: SparkSession, sf: str, name: str, *columns: Column) -> DataFrame:
    """Columns of a table that trades look their symbol up in."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _NAMES:
        _NAMES[key] = table(spark, sf, name).count()
    names = table(spark, sf, name).select(*columns)
    return names.hint("merge") if _NAMES[key] > MOST_NAMES else names


def trade_seq() -> Column:
    """Order number, line, part and supplier packed into one fixed-width number."""
    d = "decimal(38,0)"
    high = F.col("l_orderkey").cast("decimal(15,0)") * F.lit(10).cast("decimal(2,0)") + F.col("l_linenumber")
    low = F.col("l_partkey").cast("decimal(11,0)") * F.lit(10**9).cast("decimal(10,0)") + F.col("l_suppkey")
    return (high.cast("decimal(17,0)") * F.lit("1" + "0" * 20).cast("decimal(21,0)")).cast(d) + low.cast(d)


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as trades. Prices are whole numbers of the smallest currency unit."""
    items = table(spark, sf, "lineitem")
    brands = named(spark, sf, "part", F.col("p_partkey"), F.col("p_brand").alias("symbol"))
    return items.join(brands, F.col("l_partkey") == F.col("p_partkey")).select(
        "symbol", *_trade_columns()
    )


def supplier_trades(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem")
    names = named(spark, sf, "supplier", F.col("s_suppkey"), F.col("s_name").alias("symbol"))
    return items.join(names, F.col("l_suppkey") == F.col("s_suppkey")).select("symbol", *_trade_columns())


def _trade_columns() -> list[Column]:
    return [
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.round(F.col("l_extendedprice") * 100).alias("price"),
        F.col("l_quantity").alias("qty"),
        trade_seq().alias("seq"),
    ]


def daily(rows: DataFrame) -> DataFrame:
    return bars_from_trades(rows, F.date_trunc("day", "ts"), F.col("seq"))


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return daily(trades(spark, sf))


def supplier_bars(spark: SparkSession, sf: str) -> DataFrame:
    return daily(supplier_trades(spark, sf))


def calm_bars(spark: SparkSession, sf: str) -> DataFrame:
    """The brand bars on an index scale, so that daily returns stay within some percent."""
    level = {n: F.floor(F.col(n) / 10).cast("double") + F.lit(1e7) for n in ("open", "high", "low", "close")}
    return bars(spark, sf).withColumns(level)


_BOUNDS: dict[tuple[str, str], int] = {}


def bars_per_symbol(spark: SparkSession, sf: str) -> int:
    """Calendar bound on the daily bars of one symbol, from the range of the trade dates."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BOUNDS:
        first, last = table(spark, sf, "lineitem").agg(F.min("l_shipdate"), F.max("l_shipdate")).first()
        _BOUNDS[key] = rows_bound(first, last, DAY)
    return _BOUNDS[key]


def series(
    spark: SparkSession, sf: str, lookback: int = 0, source=bars, axis: Axis = Axis(), **kw
) -> Series:
    return as_series(
        source(spark, sf), lookback=lookback, group_rows=bars_per_symbol(spark, sf), axis=axis, **kw
    )


def prediction(multiplier: int = 20) -> Column:
    return F.pmod((F.col("volume") * multiplier).cast("bigint"), F.lit(1000)) / F.lit(1000.0)


MODELS = {"model_a": 20, "model_b": 30, "model_c": 70, "model_d": 90}


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """One fixture prediction per bar, keyed by ``(symbol, ts)``."""
    return bars(spark, sf).select("symbol", "ts", prediction().alias("prediction"))


def sparse_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth day of the calendar."""
    day = F.unix_date(F.to_date("ts"))
    return predictions(spark, sf).where(day % 5 == 0)


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.round(F.col("value") * 100).alias("price"),
        F.lit(1.0).alias("qty"),
        F.col("event_id").alias("seq"),
    )


def news(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as news items of 25 symbols over 30 days."""
    body = F.col("text")
    return table(spark, sf, "documents").select(
        F.concat(F.lit("Brand#"), (F.col("doc_id") % 25 + 1).cast("string")).alias("symbol"),
        F.date_add(F.lit("1996-01-01").cast("date"), (F.floor(F.col("doc_id") / 25) % 30).cast("int")).alias("date"),
        F.col("source"),
        F.split_part(body, F.lit("\n"), F.lit(1)).alias("title"),
        body.alias("summary"),
        F.col("doc_id").alias("item_id"),
    )


def social_posts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.concat(F.lit("Brand#"), (F.col("conv_id") % 25 + 1).cast("string")).alias("symbol"),
        F.date_add(F.lit("1996-01-01").cast("date"), (F.floor(F.col("conv_id") / 25) % 30).cast("int")).alias("date"),
        ((F.length("text") % 61) / F.lit(100.0) - F.lit(0.3)).alias("score"),
        (F.col("role") == "user").cast("double").alias("engaged"),
    )
