"""Price bars: reading, resampling from trades, cleaning, quality."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scalars import finite

OHLCV = ("open", "high", "low", "close", "volume")
BAR_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType())]
    + [T.StructField(n, T.DoubleType()) for n in OHLCV]
)
CORPORATE = ("Dividends", "Stock Splits", "dividends", "stock_splits")


def require_columns(df: DataFrame, columns: Iterable[str] = OHLCV) -> DataFrame:
    for name in columns:
        if name not in df.columns:
            raise ValueError(f"Missing required column: {name}")
    return df


def rename_ohlcv(df: DataFrame) -> DataFrame:
    """Provider names (any case, ``timestamp`` or ``date``) to engine names and types."""
    known = {"timestamp": "ts", "date": "ts", "datetime": "ts"}
    names = {n: known.get(n.lower(), n.lower()) for n in df.columns if n.lower() in (*OHLCV, "symbol", *known)}
    df = df.withColumnsRenamed(names)
    casts: dict[str, Column] = {n: F.col(n).cast("double") for n in OHLCV if n in df.columns}
    if "ts" in df.columns:
        casts["ts"] = F.to_timestamp("ts")
    return df.withColumns(casts)


def read_bars(
    spark: SparkSession,
    path: str,
    start: str | None = None,
    end: str | None = None,
    symbols: Sequence[str] | None = None,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
) -> DataFrame:
    """Bars of many symbols in ``[start, end)``; the date range reaches the scan."""
    reader = spark.read.format(fmt)
    if fmt != "parquet":
        reader = reader.schema(schema or BAR_SCHEMA).option("header", True)
    return unique_bars(clean_bars(reader.load(path), start, end, symbols))


def clean_bars(
    df: DataFrame, start: str | None = None, end: str | None = None, symbols: Sequence[str] | None = None
) -> DataFrame:
    df = df.drop(*CORPORATE)
    if start:
        df = df.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        df = df.where(F.col("ts") < F.lit(end).cast("timestamp"))
    if symbols is not None:
        df = df.where(F.col("symbol").isin(list(symbols)))
    return df.na.drop()


def unique_bars(df: DataFrame) -> DataFrame:
    """One row per symbol and time: of several the smallest, column by column in their order."""
    rest = [n for n in df.columns if n not in ("symbol", "ts")]
    one = df.groupBy("symbol", "ts").agg(F.min(F.struct(*rest)).alias("_r"))
    return one.select("symbol", "ts", *[F.col("_r")[n].alias(n) for n in rest])


def bars_from_trades(
    trades: DataFrame, bucket: Column, order: Column, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Trades ``(symbol, ts, price, qty)`` to bars, one per key and ``bucket``.

    ``order`` is a total order of the trades of a bucket. Buffers have fixed width for
    numeric orders, so the map side combines in a hash table and a hot symbol leaves each
    task as one row per bucket.
    """
    return (
        trades.select(*keys, bucket.alias("ts"), order.alias("_seq"), "price", "qty")
        .groupBy(*keys, "ts")
        .agg(
            F.min_by("price", "_seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "_seq").alias("close"),
            F.sum("qty").alias("volume"),
        )
    )


def latest_bar(bars: DataFrame, source: str = "bars") -> DataFrame:
    """Last bar of each symbol as a tick message."""
    last = bars.groupBy("symbol").agg(F.max_by(F.struct("ts", *OHLCV), "ts").alias("b"))
    return last.select(
        "symbol",
        F.date_format("b.ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        *[F.col(f"b.{n}").alias(n) for n in OHLCV[:4]],
        F.col("b.volume").cast("bigint").alias("volume"),
        F.lit(source).alias("source"),
    )


def clean_features(df: DataFrame) -> DataFrame:
    """NaN and infinities of every floating column become NULL."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: finite(F.col(f"`{n}`")) for n in floats})


def drop_incomplete(df: DataFrame, min_rows: int = 100, key: str = "symbol") -> DataFrame:
    """Rows without NULL cells, of symbols that keep at least ``min_rows`` of them."""
    whole = df.na.drop()
    enough = whole.groupBy(key).count().where(F.col("count") >= min_rows)
    return whole.join(enough, key, "left_semi")


def fill_zero(df: DataFrame) -> DataFrame:
    return df.na.fill(0)


def feature_columns(df: DataFrame) -> list[str]:
    skip = {*OHLCV, "symbol", "ts", "target", "dividends", "stock_splits", "stock splits"}
    return [n for n in df.columns if n.lower() not in skip]


def quality_stats(bars: DataFrame, key: str = "symbol") -> DataFrame:
    """Rows, share of NULL cells over all columns, and mean volume per symbol."""
    cells = [F.sum(F.col(n).isNull().cast("int")) for n in bars.columns]
    missing = cells[0]
    for extra in cells[1:]:
        missing = missing + extra
    return bars.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        (missing / (F.count(F.lit(1)) * F.lit(len(cells)))).alias("missing_ratio"),
        F.avg("volume").alias("mean_volume"),
    )


def quality_filter(
    bars: DataFrame,
    min_data_points: int = 1000,
    max_missing_ratio: float = 0.1,
    min_volume: float = 1000,
    key: str = "symbol",
) -> DataFrame:
    stats = quality_stats(bars, key)
    good = stats.where(
        (F.col("n_rows") >= min_data_points)
        & (F.col("missing_ratio") <= max_missing_ratio)
        & (F.col("mean_volume").isNull() | (F.col("mean_volume") >= min_volume))
    )
    return bars.join(good, key, "left_semi")


def skipped_symbols(wanted: DataFrame, kept: DataFrame, key: str = "symbol") -> DataFrame:
    return wanted.select(key).distinct().join(kept.select(key).distinct(), key, "left_anti")


def last_n_per_symbol(df: DataFrame, n: int = 1000, key: str = "symbol", order: str = "ts") -> DataFrame:
    """Last ``n`` rows per symbol. The rank filter prunes inside each task before the shuffle."""
    newest = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")


def latest_rows(df: DataFrame, key: str = "symbol", order: str = "ts") -> DataFrame:
    """The whole last row of each symbol, by aggregation (no sort, combines on the map side)."""
    rest = [n for n in df.columns if n != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return last.select(key, *[F.col("_r")[n].alias(n) for n in rest])
