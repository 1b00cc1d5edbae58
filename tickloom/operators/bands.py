"""Bands and channels: Bollinger, Donchian, Keltner, average true range."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..functions.series import Axis, Series, ewm_reach, span, wilder
from .catalogue import dotted, family


def true_range(a: Axis) -> Column:
    """Largest of the bar's range and its distances to the last close (first row: the range)."""
    before = a.lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def middle_and_width(a: Axis, n: int) -> tuple[Column, Column]:
    return a.mean("close", n), a.frame(F.stddev_pop, "close", n)


BB_WINDOWS, BB_WIDTHS = (10, 15, 20, 25, 30), (1.5, 2.0, 2.5)


@family(
    "bollinger_grid",
    [f"bb_{p}_{n}_{dotted(d)}" for n in BB_WINDOWS for d in BB_WIDTHS
     for p in ("upper", "lower", "middle", "width", "position")],
    30,
)
def bollinger_grid(s: Series) -> Series:
    base = {}
    for n in BB_WINDOWS:
        base[f"_bbm_{n}"], base[f"_bbs_{n}"] = middle_and_width(s.axis, n)
    s = s.add(base)
    cols = {}
    for n in BB_WINDOWS:
        mid = F.col(f"_bbm_{n}")
        for d in BB_WIDTHS:
            off, tag = F.lit(d) * F.col(f"_bbs_{n}"), f"{n}_{dotted(d)}"
            upper, lower = mid + off, mid - off
            cols[f"bb_upper_{tag}"] = upper
            cols[f"bb_lower_{tag}"] = lower
            cols[f"bb_middle_{tag}"] = mid
            cols[f"bb_width_{tag}"] = ratio(upper - lower, mid)
            cols[f"bb_position_{tag}"] = ratio(F.col("close") - lower, upper - lower)
    return s.add(cols)


ATR_WINDOWS = (7, 14, 21, 30)


def atr_into(s: Series, names: dict[str, int]) -> Series:
    """Wilder average of the true range, started by a plain mean; 0 before it."""
    s = s.add({"_tr": true_range(s.axis)})
    return s.ewm({name: wilder("_tr", n, seed="mean", before=0.0) for name, n in names.items()})


@family("atr", [x for n in ATR_WINDOWS for x in (f"atr_{n}", f"atr_{n}_ratio")], ewm_reach(1 / 30) + 30)
def atr(s: Series) -> Series:
    s = atr_into(s, {f"atr_{n}": n for n in ATR_WINDOWS})
    return s.add({f"atr_{n}_ratio": ratio(f"atr_{n}", "close") for n in ATR_WINDOWS})


DONCHIAN_WINDOWS = (10, 20, 30, 50)


@family(
    "donchian",
    [f"donchian_{p}_{n}" for n in DONCHIAN_WINDOWS for p in ("upper", "lower", "middle", "position")],
    50,
)
def donchian(s: Series) -> Series:
    cols = {}
    for n in DONCHIAN_WINDOWS:
        upper, lower = s.axis.top("high", n), s.axis.bottom("low", n)
        cols[f"donchian_upper_{n}"] = upper
        cols[f"donchian_lower_{n}"] = lower
        cols[f"donchian_middle_{n}"] = (upper + lower) / 2
        cols[f"donchian_position_{n}"] = ratio(F.col("close") - lower, upper - lower)
    return s.add(cols)


KELTNER_WINDOWS, KELTNER_WIDTHS = (10, 20, 30), (1.5, 2.0, 2.5)


def keltner_lines(a: Axis, n: int) -> tuple[Column, Column, Column]:
    """Middle, upper and lower line of the original form (means of three price mixes)."""
    h, low, close = F.col("high"), F.col("low"), F.col("close")
    third = F.lit(3.0)  # divided last, so that sums of whole prices stay exact
    return (
        a.mean(h + low + close, n) / third,
        a.mean(4 * h - 2 * low + close, n) / third,
        a.mean(-2 * h + 4 * low + close, n) / third,
    )


@family(
    "keltner_grid",
    [f"keltner_{p}_{n}_{dotted(m)}" for n in KELTNER_WINDOWS for m in KELTNER_WIDTHS
     for p in ("upper", "lower", "middle")],
    ewm_reach(1 / 30) + 30,
)
def keltner_grid(s: Series, form: str = "original") -> Series:
    """``original`` ignores the multiplier and starts with partial frames; ``atr`` is the
    exponential mean plus and minus ``multiplier`` average true ranges."""
    cols = {}
    if form == "original":
        partial = Axis(s.axis.keys, s.axis.order, full=False)
        base = {}
        for n in KELTNER_WINDOWS:
            base[f"_km_{n}"], base[f"_ku_{n}"], base[f"_kl_{n}"] = keltner_lines(partial, n)
        s = s.add(base)
    elif form == "atr":
        s = atr_into(s, {f"_katr_{n}": n for n in KELTNER_WINDOWS})
        s = s.ewm({f"_km_{n}": span("close", n) for n in KELTNER_WINDOWS})
    else:
        raise ValueError(f"unknown Keltner form: {form}")
    for n in KELTNER_WINDOWS:
        for m in KELTNER_WIDTHS:
            tag, mid = f"{n}_{dotted(m)}", F.col(f"_km_{n}")
            wide = F.lit(m) * F.col(f"_katr_{n}") if form == "atr" else None
            cols[f"keltner_upper_{tag}"] = F.col(f"_ku_{n}") if wide is None else mid + wide
            cols[f"keltner_lower_{tag}"] = F.col(f"_kl_{n}") if wide is None else mid - wide
            cols[f"keltner_middle_{tag}"] = mid
    return s.add(cols)
