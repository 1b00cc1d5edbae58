"""RSI, stochastic, Williams, CCI, ultimate and awesome oscillators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import ratio, truth
from ..functions.series import Axis, Ewm, Series, ewm_reach
from .catalogue import family
from .volume import typical


def rsi_into(s: Series, names: dict[str, int]) -> Series:
    """Relative strength of smoothed gains and losses; 100 when there are no losses.

    While the price stands still both averages shrink by the same factor and their ratio stays, so
    the value of the last price change is carried on. A long flat run thus needs no history of its
    own length, and the value is the same however the symbol is cut.
    """
    s = s.add({"_dc": s.axis.diff("close")})
    s = s.add(
        {
            "_gain": F.when(truth(F.col("_dc") > 0), F.col("_dc")).otherwise(0.0),
            "_loss": F.when(truth(F.col("_dc") < 0), -F.col("_dc")).otherwise(0.0),
        }
    )
    windows = sorted(set(names.values()))
    s = s.ewm({f"_{x}_{n}": Ewm(source, 1.0 / n) for n in windows for x, source in (("up", "_gain"), ("dn", "_loss"))})

    def value(n: int) -> Column:
        up, dn = F.col(f"_up_{n}"), F.col(f"_dn_{n}")
        return F.when(dn == 0, 100.0).otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + ratio(up, dn)))

    moved = truth(F.col("_dc") != 0)
    s = s.fold({f"_rs_{n}": ("last", F.when(moved, value(n))) for n in windows})
    # no price change so far: no losses either
    return s.add({name: _from_row(s.axis, n, F.coalesce(F.col(f"_rs_{n}"), F.lit(100.0))) for name, n in names.items()})


def _from_row(a: Axis, n: int, x: Column) -> Column:
    return F.when(a.filled("close", n), x) if a.full else x


RSI_WINDOWS = (7, 9, 14, 21, 28)


@family(
    "rsi", [f"rsi_{n}{x}" for n in RSI_WINDOWS for x in ("", "_change", "_ma")], ewm_reach(1 / 28) + 6
)
def rsi(s: Series) -> Series:
    s = rsi_into(s, {f"rsi_{n}": n for n in RSI_WINDOWS})
    a = s.axis
    cols = {}
    for n in RSI_WINDOWS:
        cols[f"rsi_{n}_change"] = a.diff(f"rsi_{n}")
        cols[f"rsi_{n}_ma"] = a.mean(f"rsi_{n}", 5)
    return s.add(cols)


def stochastic(a: Axis, n: int, close="close", high="high", low="low") -> Column:
    bottom, top = a.bottom(low, n), a.top(high, n)
    return ratio(F.lit(100.0) * (F.col(close) - bottom), top - bottom)


K_WINDOWS, D_WINDOWS = (5, 9, 14, 21), (3, 5, 9)


@family(
    "stochastic_grid",
    [f"stoch_{p}_{k}_{d}" for k in K_WINDOWS for d in D_WINDOWS for p in ("k", "d")],
    31,
)
def stochastic_grid(s: Series) -> Series:
    s = s.add({f"_sk_{k}": stochastic(s.axis, k) for k in K_WINDOWS})
    cols = {}
    for k in K_WINDOWS:
        for d in D_WINDOWS:
            cols[f"stoch_k_{k}_{d}"] = F.col(f"_sk_{k}")
            cols[f"stoch_d_{k}_{d}"] = s.axis.mean(f"_sk_{k}", d)
    return s.add(cols)


def williams(a: Axis, n: int) -> Column:
    top, bottom = a.top("high", n), a.bottom("low", n)
    return ratio(F.lit(-100.0) * (top - F.col("close")), top - bottom)


@family("williams_r", [f"williams_r_{n}" for n in (7, 14, 21, 28)], 28)
def williams_r(s: Series) -> Series:
    return s.add({f"williams_r_{n}": williams(s.axis, n) for n in (7, 14, 21, 28)})


def cci_into(s: Series, names: dict[str, int]) -> Series:
    s = s.add({"_tp": typical()})
    a = s.axis
    return s.add(
        {
            name: ratio(F.col("_tp") - a.mean("_tp", n), F.lit(0.015) * a.mad("_tp", n))
            for name, n in names.items()
        }
    )


@family("cci", [f"cci_{n}" for n in (10, 14, 20, 30)], 30)
def cci(s: Series) -> Series:
    return cci_into(s, {f"cci_{n}": n for n in (10, 14, 20, 30)})


UO_SETS = [(x, y, z) for x in (7, 14) for y in (14, 21) for z in (28, 42)]


def ultimate_into(s: Series, names: dict[str, tuple[int, int, int]]) -> Series:
    before = s.axis.lag("close")
    low, high = F.least(F.col("low"), before), F.greatest(F.col("high"), before)
    s = s.add({"_bp": F.col("close") - low, "_span": high - low})
    a = s.axis
    windows = sorted({n for t in names.values() for n in t})
    s = s.add({f"_press_{n}": ratio(a.total("_bp", n), a.total("_span", n)) for n in windows})
    press = {n: F.col(f"_press_{n}") for n in windows}
    return s.add(
        {
            name: F.lit(100.0) * (press[x] * 4 + press[y] * 2 + press[z]) / F.lit(7.0)
            for name, (x, y, z) in names.items()
        }
    )


@family("ultimate_osc", [f"ultimate_osc_{x}_{y}_{z}" for x, y, z in UO_SETS], 43)
def ultimate_osc(s: Series) -> Series:
    return ultimate_into(s, {f"ultimate_osc_{x}_{y}_{z}": (x, y, z) for x, y, z in UO_SETS})


def awesome(a: Axis, fast: int = 5, slow: int = 34) -> Column:
    middle = (F.col("high") + F.col("low")) / 2
    return a.mean(middle, fast) - a.mean(middle, slow)


@family("awesome_osc", ["awesome_osc"], 34)
def awesome_osc(s: Series) -> Series:
    return s.add({"awesome_osc": awesome(s.axis)})
