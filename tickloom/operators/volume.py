"""Volume and money-flow features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import either, ratio, truth
from ..functions.series import Axis, Ewm, Series, ewm_reach, span
from .catalogue import family

PERIODS = (5, 10, 20, 50)
SHORT_PERIODS = (5, 10, 20, 30)


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / F.lit(3.0)


@family("volume_ratios", [n for k in PERIODS for n in (f"volume_ma_{k}", f"volume_ratio_{k}")], 50)
def volume_ratios(s: Series) -> Series:
    cols = {}
    for n in PERIODS:
        mean = s.axis.mean("volume", n)
        cols[f"volume_ma_{n}"] = mean
        cols[f"volume_ratio_{n}"] = ratio("volume", mean)
    return s.add(cols)


@family("volume_price", ["volume_price_trend", "volume_weighted_price"], 20)
def volume_price(s: Series) -> Series:
    a = s.axis
    return s.add(
        {
            "volume_price_trend": F.col("volume") * a.change("close"),
            "volume_weighted_price": _vwap(a, 20),
        }
    )


def _vwap(a: Axis, n: int, price: Column | None = None) -> Column:
    price = F.col("close") if price is None else price
    return ratio(a.total(price * F.col("volume"), n), a.total("volume", n))


def signed_volume(s: Series) -> Column:
    """Volume counts negative when the close falls, positive otherwise (ties, first row)."""
    return F.when(truth(F.col("_prev") < 0), -F.col("volume")).otherwise(F.col("volume"))


def obv_into(s: Series, name: str) -> Series:
    s = s.add({"_prev": s.axis.diff("close")})
    return s.fold({name: ("sum", signed_volume(s))})


@family("obv", ["obv"], 2)
def obv(s: Series) -> Series:
    return obv_into(s, "obv")


@family("volume_roc", [f"volume_roc_{k}" for k in SHORT_PERIODS], 31)
def volume_roc(s: Series) -> Series:
    return s.add({f"volume_roc_{k}": s.axis.change("volume", k) for k in SHORT_PERIODS})


@family(
    "volume_smoothing",
    [f"{p}_{n}" for n in SHORT_PERIODS for p in ("volume_sma", "volume_ema", "vpt")],
    ewm_reach(2 / 31),
)
def volume_smoothing(s: Series) -> Series:
    a = s.axis
    s = s.add({"_flow": F.col("volume") * a.change("close")})
    cols = {f"volume_sma_{n}": a.mean("volume", n) for n in SHORT_PERIODS}
    cols |= {f"vpt_{n}": a.total("_flow", n) for n in SHORT_PERIODS}
    return s.add(cols).ewm(
        {f"volume_ema_{n}": Ewm("volume", 2 / (n + 1), adjust=True) for n in SHORT_PERIODS}
    )


def mfi_into(s: Series, names: dict[str, int]) -> Series:
    s = s.add({"_tp": typical()})
    s = s.add({"_dtp": s.axis.diff("_tp"), "_money": F.col("_tp") * F.col("volume")})
    s = s.add(
        {
            "_mf_in": F.when(truth(F.col("_dtp") > 0), F.col("_money")).otherwise(0.0),
            "_mf_out": F.when(truth(F.col("_dtp") < 0), F.col("_money")).otherwise(0.0),
        }
    )
    cols = {}
    for name, n in names.items():
        inflow, outflow = s.axis.total("_mf_in", n), s.axis.total("_mf_out", n)
        # 100 - 100 / (1 + in/out), written so that a frame without outflow gives 100
        cols[name] = ratio(F.lit(100.0) * inflow, inflow + outflow)
    return s.add(cols)


@family("mfi", [f"mfi_{n}" for n in (7, 14, 21, 30)], 31)
def mfi(s: Series) -> Series:
    return mfi_into(s, {f"mfi_{n}": n for n in (7, 14, 21, 30)})


def force_into(s: Series, names: dict[str, int]) -> Series:
    s = s.add({"_force": s.axis.diff("close") * F.col("volume")})
    return s.ewm({name: span("_force", n) for name, n in names.items()})


@family("force_index", [f"force_index_{n}" for n in (1, 5, 10, 20)], ewm_reach(2 / 21) + 1)
def force_index(s: Series) -> Series:
    return force_into(s, {f"force_index_{n}": n for n in (1, 5, 10, 20)})


def ease(a: Axis) -> Column:
    moved = a.diff("high") + a.diff("low")
    return ratio(moved * (F.col("high") - F.col("low")), F.lit(2.0) * F.col("volume")) * F.lit(1e8)


@family("eom", [f"eom_{n}" for n in (5, 10, 20)], 2)
def eom(s: Series) -> Series:
    """The unsmoothed value does not depend on the window, so the three columns are equal."""
    return s.add({f"eom_{n}": ease(s.axis) for n in (5, 10, 20)})


@family("vwap", [f"vwap_{n}" for n in SHORT_PERIODS], 30)
def vwap(s: Series) -> Series:
    return s.add({f"vwap_{n}": _vwap(s.axis, n) for n in SHORT_PERIODS})


def range_share() -> Column:
    """Where the close lies in the bar, from -1 (low) to 1 (high); 0 without a range."""
    up, down = F.col("close") - F.col("low"), F.col("high") - F.col("close")
    return F.coalesce(ratio(up - down, F.col("high") - F.col("low")), F.lit(0.0))
