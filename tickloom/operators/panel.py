"""Universe of symbols and market-relative features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import ratio
from ..functions.series import BARS, Series, as_series
from ..session import cut


def universe(table: DataFrame, sector: str | None = None, limit: int | None = None) -> DataFrame:
    """Distinct symbols of one sector, or of all sectors; a ``limit`` takes the first ones by name."""
    if sector is not None:
        return table.where(F.col("sector") == sector).select("sector", "symbol").distinct()
    every = table.select("symbol").distinct()
    return every.orderBy("symbol").limit(limit) if limit else every


def universe_filter(
    symbols: DataFrame, table: DataFrame, min_market_cap: float = 1e9, max_market_cap: float = 1e12,
    sectors: Sequence[str] | None = None,
) -> DataFrame:
    wanted = table.where(F.col("market_cap").between(min_market_cap, max_market_cap))
    if sectors:
        wanted = wanted.where(F.col("sector").isin(list(sectors)))
    return symbols.join(wanted.select("symbol"), "symbol", "left_semi")


def index_calendar(bars: DataFrame, index: str, era_seconds: int = 365 * 86_400) -> DataFrame:
    """Every date of the panel with ``_open`` (1 if the index has a bar), ``_upto``, how many index
    dates there are up to it, and ``_last``, how many in all.

    Counted per era, plus the counts of earlier eras from a table of one row per era.
    """
    on_index = bars.where(F.col("symbol") == index).select("ts").distinct().withColumn("_open", F.lit(1))
    era = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / era_seconds)
    dates = bars.select("ts").distinct().join(on_index, "ts", "left").withColumn("_era", era)
    before = Window.orderBy("_era").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dates.groupBy("_era").agg(F.count("_open").alias("_n"))
    sizes = sizes.select("_era", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n").over(Window.partitionBy()).alias("_last"))
    within = Window.partitionBy("_era").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    dates = dates.withColumn("_in", F.count("_open").over(within)).join(sizes, "_era")
    return dates.select("ts", "_open", (F.col("_in") + F.col("_off")).alias("_upto"), "_last")


def market_calendar_align(bars: DataFrame, index: str, **layout) -> DataFrame:
    """Every symbol on the dates of the index symbol, last bar carried forward.

    A bar covers the index dates from its own date up to the next bar of its symbol. Index
    dates are numbered once (a table no longer than the calendar); each bar then covers a
    sequence of numbers, which is exploded and turned back into dates by an equi-join. The bars are
    read several times, so a frame that is costly to make should be written before (as
    ``market_features`` does).
    """
    dates = cut(index_calendar(bars, index))
    # first index date at or after a bar date
    place = dates.select("ts", F.when(F.col("_open") == 1, F.col("_upto")).otherwise(F.col("_upto") + 1).alias("_from"), "_last")
    s = as_series(bars.join(place, "ts"), lookback=1, ahead=1, **layout)
    s = s.add({"_next": F.coalesce(F.lead("_from").over(s.axis.spec), F.col("_last") + 1), "_before": F.lag("_from").over(s.axis.spec)})
    covers = F.when(F.col("_next") > F.col("_from"), F.sequence("_from", F.col("_next") - 1))
    head = F.when(F.col("_before").isNull() & (F.col("_from") > 1), F.sequence(F.lit(1).cast("bigint"), F.col("_from") - 1))
    none = F.array().cast("array<bigint>")
    spots = F.concat(
        F.transform(F.coalesce(covers, none), lambda i: F.struct(i.alias("at"), F.lit(True).alias("has"))),
        F.transform(F.coalesce(head, none), lambda i: F.struct(i.alias("at"), F.lit(False).alias("has"))),
    )
    rows = s.tidy_keep("_from", "_next", "_before").select("symbol", *BARS, F.explode(spots).alias("spot"))
    back = dates.where(F.col("_open") == 1).select("ts", F.col("_upto").alias("at"))
    return rows.select(
        "symbol", F.col("spot.at").alias("at"), *[F.when(F.col("spot.has"), F.col(n)).alias(n) for n in BARS]
    ).join(back, "at").select("symbol", "ts", *BARS)


def shared_days(bars: DataFrame, index: str) -> DataFrame:
    """``symbol, ts`` of the bars on days on which the index symbol has one too."""
    days = bars.where(F.col("symbol") == index).select("ts").distinct()
    return bars.select("symbol", "ts").join(days, "ts", "left_semi").distinct()


def market_features(bars: DataFrame, index: str, **layout) -> DataFrame:
    """Return and volatility of the index and the return relative to it, on index dates.

    The bars are written once and everything is made from that; without the index symbol they
    come back as they are.
    """
    bars = cut(bars)
    if bars.where(F.col("symbol") == index).isEmpty():
        return bars
    m = Series(bars.where(F.col("symbol") == index).select("symbol", "ts", "close"))
    m = m.add({"market_return": m.axis.change("close")})
    market = m.add({"market_volatility": m.axis.std("market_return", 20)}).df.select("ts", "market_return", "market_volatility")
    aligned = market_calendar_align(bars, index, **layout)
    s = as_series(aligned, lookback=1, **layout)
    s = s.add({"_ret": s.axis.change("close")})
    rows = s.tidy_keep("_ret").join(market, "ts", "left")
    return rows.select(
        "symbol", "ts", *BARS, "market_return", "market_volatility",
        F.col("_ret").alias("asset_return"), (F.col("_ret") - F.col("market_return")).alias("relative_performance"),
    )


def beta(relative: DataFrame, min_rows: int = 20) -> DataFrame:
    """Slope against the market over all common rows; 1 with few rows or without variance."""
    r, m = F.col("asset_return"), F.col("market_return")
    both = r.isNotNull() & m.isNotNull()
    r, m = F.when(both, r), F.when(both, m)
    stats = relative.groupBy("symbol").agg(
        F.count(r).alias("n"), F.covar_samp(r, m).alias("both"), F.stddev_samp(r).alias("sr"), F.var_samp(m).alias("vm")
    )
    usable = (F.col("n") > min_rows) & (F.col("sr") > 0) & (F.col("vm") > 0)
    # correlation times the ratio of deviations is covariance over market variance
    return stats.select("symbol", F.when(usable, ratio("both", "vm")).otherwise(1.0).alias("beta"))


def rolling_beta(relative: DataFrame, n: int = 60, **layout) -> DataFrame:
    s = as_series(relative.select("symbol", "ts", "asset_return", "market_return"), lookback=n, **layout)
    frame = s.axis.rows(n)
    full = F.count(F.col("asset_return") + F.col("market_return")).over(frame) == n
    slope = F.try_divide(F.covar_samp("asset_return", "market_return").over(frame), F.var_samp("market_return").over(frame))
    return s.add({f"beta_{n}": F.when(full, slope)}).tidy().select("symbol", "ts", f"beta_{n}")


