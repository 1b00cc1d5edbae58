"""Candle patterns. A bar without a range never counts as a pattern."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import ratio, truth
from ..functions.series import Series
from .catalogue import family

PATTERNS = ("doji", "doji_strong", "doji_weak", "hammer", "hanging_man", "shooting_star",
            "bullish_engulfing", "bearish_engulfing")


@family("candles", PATTERNS, 2)
def candles(s: Series) -> Series:
    a = s.axis
    o, h, low, close = (F.col(n) for n in ("open", "high", "low", "close"))
    body = F.abs(close - o)
    upper = h - F.greatest(o, close)
    lower = F.least(o, close) - low
    share = ratio(body, h - low)
    before_o, before_c = a.lag("open"), a.lag("close")
    hammer = (lower > 2 * body) & (upper < body)
    rules = {
        "doji": share < 0.1,
        "doji_strong": share < 0.05,
        "doji_weak": share < 0.15,
        "hammer": hammer,
        "hanging_man": hammer & (close < o),
        "shooting_star": (upper > 2 * body) & (lower < body),
        "bullish_engulfing": (close > o) & (before_c < before_o) & (o < before_c) & (close > before_o),
        "bearish_engulfing": (close < o) & (before_c > before_o) & (o > before_c) & (close < before_o),
    }
    return s.add({n: truth(r) for n, r in rules.items()})
