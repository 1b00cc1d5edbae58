"""Backward as-of join built from one window over both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .series import MAX_GROUP_ROWS


#: Calendar eras that long symbols are split into.
ERA = 365 * 86_400


def era_for(group_rows: int | None, limit: int = MAX_GROUP_ROWS) -> int | None:
    """No eras where the largest symbol is known to fit one window group, as for series."""
    return None if group_rows is not None and group_rows <= limit else ERA


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: str = "symbol",
    on: str = "ts",
    era_seconds: int | None = ERA,
) -> DataFrame:
    """For every left row the last right row with the same ``by`` and ``on`` at or before it.

    The whole right row is carried (NULL cells included); of right rows with one key the largest row
    counts. ``era_seconds`` splits long
    symbols into calendar eras: the window runs per era, and the last right row of the
    earlier eras comes from a table with one row per symbol and era.
    """
    payload = [n for n in right.columns if n not in (by, on)]
    keep = [n for n in left.columns if n not in (by, on)]
    stacked = left.select(
        by, on, F.lit(1).alias("_side"), F.struct(*keep).alias("_left") if keep else F.lit(True).alias("_left"),
        F.lit(None).cast(right.select(F.struct(*payload).alias("x")).schema["x"].dataType).alias("_right"),
    ).unionByName(
        right.select(
            by, on, F.lit(0).alias("_side"),
            F.lit(None).cast(
                left.select(F.struct(*keep).alias("x")).schema["x"].dataType if keep else "boolean"
            ).alias("_left"),
            F.struct(*payload).alias("_right"),
        )
    )
    keys = [by]
    if era_seconds:
        era = F.floor(F.unix_timestamp(F.col(on).cast("timestamp")) / era_seconds)
        stacked = stacked.withColumn("_era", era)
        keys = [by, "_era"]
    w = (
        Window.partitionBy(*keys)
        .orderBy(on, "_side", "_right")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = stacked.withColumn("_hit", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    if era_seconds:
        ends = right.withColumn("_era", era).groupBy(by, "_era").agg(F.max_by(F.struct(*payload), F.struct(on, *payload)).alias("_end"))
        # eras without right rows must exist as well, so that the carry reaches them
        eras = left.select(by, era.alias("_era")).distinct().join(ends, [by, "_era"], "full")
        before = Window.partitionBy(by).orderBy("_era").rowsBetween(Window.unboundedPreceding, -1)
        carry = eras.select(by, "_era", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
        joined = joined.join(carry, [by, "_era"], "left").withColumn("_hit", F.coalesce("_hit", "_carry"))
    return joined.select(
        by, on, *[F.col("_left")[n].alias(n) for n in keep], *[F.col("_hit")[n].alias(n) for n in payload]
    )
