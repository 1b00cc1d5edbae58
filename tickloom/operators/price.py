"""Returns, ratios, gaps, momentum, calendar and bar-shape features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.scalars import either, ratio
from ..functions.series import Series
from .catalogue import family

RETURN_LAGS = (1, 2, 3, 5, 10, 20, 50, 100)


@family("price_returns", [n for k in RETURN_LAGS for n in (f"return_{k}d", f"log_return_{k}d")], 101)
def price_returns(s: Series) -> Series:
    a = s.axis
    cols = {}
    for k in RETURN_LAGS:
        cols[f"return_{k}d"] = a.change("close", k)
        cols[f"log_return_{k}d"] = F.ln(ratio("close", a.lag("close", k)))
    return s.add(cols)


@family(
    "price_ratios",
    ["high_low_ratio", "close_open_ratio", "high_close_ratio", "low_close_ratio", "price_position"],
)
def price_ratios(s: Series) -> Series:
    return s.add(
        {
            "high_low_ratio": ratio("high", "low"),
            "close_open_ratio": ratio("close", "open"),
            "high_close_ratio": ratio("high", "close"),
            "low_close_ratio": ratio("low", "close"),
            "price_position": ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low")),
        }
    )


@family("gaps", ["gap_up", "gap_down"], 2)
def gaps(s: Series) -> Series:
    before = s.axis.lag("close")
    return s.add(
        {
            "gap_up": ratio(F.col("open") - before, before),
            "gap_down": ratio(before - F.col("open"), before),
        }
    )


ROC_LAGS = (5, 10, 20, 30, 50)
MOMENTUM_LAGS = (5, 10, 20, 30)


@family(
    "momentum",
    [f"roc_{k}" for k in ROC_LAGS] + [f"{p}_{k}" for p in ("momentum", "proc") for k in MOMENTUM_LAGS],
    51,
)
def momentum(s: Series) -> Series:
    a = s.axis
    cols = {f"roc_{k}": a.change("close", k) for k in ROC_LAGS}
    cols |= {f"momentum_{k}": a.change("close", k) for k in MOMENTUM_LAGS}
    cols |= {f"proc_{k}": ratio(a.diff("close", k), a.lag("close", k)) for k in MOMENTUM_LAGS}
    return s.add(cols)


@family(
    "calendar",
    ["day_of_week", "week_of_year", "month", "quarter", "year", "is_month_end", "is_quarter_end",
     "is_year_end", "day_sin", "day_cos", "month_sin", "month_cos"],
)
def calendar(s: Series) -> Series:
    day = F.to_date("ts")
    month_end = day == F.last_day(day)
    dow, month = F.weekday(day), F.month(day)
    turn = F.lit(2 * math.pi)
    return s.add(
        {
            "day_of_week": dow,
            "week_of_year": F.weekofyear(day),
            "month": month,
            "quarter": F.quarter(day),
            "year": F.year(day),
            "is_month_end": month_end.cast("int"),
            "is_quarter_end": (month_end & (month % 3 == 0)).cast("int"),
            "is_year_end": (month_end & (month == 12)).cast("int"),
            "day_sin": F.sin(turn * dow / 7),
            "day_cos": F.cos(turn * dow / 7),
            "month_sin": F.sin(turn * month / 12),
            "month_cos": F.cos(turn * month / 12),
        }
    )


@family("microstructure", ["spread_proxy", "price_impact", "tick_direction"], 2)
def microstructure(s: Series) -> Series:
    a = s.axis
    return s.add(
        {
            "spread_proxy": ratio(F.col("high") - F.col("low"), "close"),
            "price_impact": ratio(a.change("close"), a.change("volume")),
            "tick_direction": either(F.col("close") > F.col("open"), 1, -1),
        }
    )
