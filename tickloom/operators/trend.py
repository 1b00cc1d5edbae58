"""Moving averages and what is built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import either, flag, ratio
from ..functions.series import Axis, Roll, Series, ewm_reach, span, wilder
from .bands import middle_and_width, true_range
from .catalogue import family
from .oscillators import rsi_into, stochastic, williams


@family(
    "trend_strength",
    [x for n in (20, 50, 100) for x in (f"trend_strength_{n}", f"trend_direction_{n}")],
    100,
)
def trend_strength(s: Series) -> Series:
    cols = {}
    for n in (20, 50, 100):
        mean = s.axis.mean("close", n)
        cols[f"trend_strength_{n}"] = ratio("close", mean)
        cols[f"trend_direction_{n}"] = either(F.col("close") > mean, 1, -1)
    return s.add(cols)


@family("detrended", ["detrended_price_20", "detrended_price_50"], 50)
def detrended(s: Series) -> Series:
    return s.add({f"detrended_price_{n}": F.col("close") - s.axis.mean("close", n) for n in (20, 50)})


def adx_into(s: Series, n: int, adx: str, pos: str, neg: str) -> Series:
    """Directional movement: smoothed +DM and -DM over smoothed range, then smoothed DX.

    All three smoothings are Wilder's, each started by a plain mean. Without any movement
    DX is 0, and without any range DI is 0.
    """
    a = s.axis
    s = s.add({"_dh": a.diff("high"), "_dl": -a.diff("low"), "_tr1": F.when(a.lag("close").isNotNull(), true_range(a))})
    up, down = F.col("_dh"), F.col("_dl")
    s = s.add(
        {
            "_pdm": F.when(up.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0)),
            "_ndm": F.when(up.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0)),
        }
    )
    s = s.ewm({f"_s{x}": wilder(x, n, seed="mean") for x in ("_pdm", "_ndm", "_tr1")})

    def di(x: str) -> Column:
        share = F.coalesce(ratio(F.lit(100.0) * F.col(x), "_s_tr1"), F.lit(0.0))
        return F.when(F.col("_s_tr1").isNotNull(), share)

    s = s.add({pos: di("_s_pdm"), neg: di("_s_ndm")})
    gap, both = F.abs(F.col(pos) - F.col(neg)), F.col(pos) + F.col(neg)
    s = s.add(
        {f"_dx_{adx}": F.when(both.isNotNull(), F.coalesce(ratio(F.lit(100.0) * gap, both), F.lit(0.0)))}
    )
    return s.ewm({adx: wilder(f"_dx_{adx}", n, seed="mean")})


@family("adx", ["adx", "adx_pos", "adx_neg"], 2 * ewm_reach(1 / 14) + 30)
def adx(s: Series) -> Series:
    return adx_into(s, 14, "adx", "adx_pos", "adx_neg")


MACD_SETS = [(f, w) for f in (8, 12, 16) for w in (21, 26, 30)]


def macd_into(s: Series, sets: dict[str, tuple[int, int]], names, x: str = "close", signal: int = 9, percent=False) -> Series:
    """Fast minus slow exponential mean, its signal line, and the difference.

    ``names(tag)`` gives the three column names; ``percent`` divides by the slow mean.
    """
    periods = sorted({n for pair in sets.values() for n in pair})
    s = s.ewm({f"_e_{x}_{n}": span(x, n) for n in periods})
    lines = {}
    for tag, (fast, slow) in sets.items():
        f, w = F.col(f"_e_{x}_{fast}"), F.col(f"_e_{x}_{slow}")
        lines[names(tag)[0]] = ratio(f - w, w) * F.lit(100.0) if percent else f - w
    s = s.add(lines)
    s = s.ewm({names(t)[1]: span(names(t)[0], signal) for t in sets})
    return s.add({names(t)[2]: F.col(names(t)[0]) - F.col(names(t)[1]) for t in sets})


def _macd_names(tag: str) -> tuple[str, str, str]:
    return f"macd_{tag}", f"macd_signal_{tag}", f"macd_diff_{tag}"


@family(
    "macd_grid", [n for f, w in MACD_SETS for n in _macd_names(f"{f}_{w}")], ewm_reach(2 / 31) + ewm_reach(0.2)
)
def macd_grid(s: Series) -> Series:
    return macd_into(s, {f"{f}_{w}": (f, w) for f, w in MACD_SETS}, _macd_names)


PPO_SETS = [(f, w) for f in (6, 12, 18) for w in (26, 35, 50)]


def _ppo_names(tag: str) -> tuple[str, str, str]:
    return f"ppo_{tag}", f"ppo_signal_{tag}", f"ppo_hist_{tag}"


@family("ppo_grid", [n for f, w in PPO_SETS for n in _ppo_names(f"{f}_{w}")], ewm_reach(2 / 51) + ewm_reach(0.2))
def ppo_grid(s: Series) -> Series:
    return macd_into(s, {f"{f}_{w}": (f, w) for f, w in PPO_SETS}, _ppo_names, percent=True)


MA_WINDOWS = (3, 7, 13, 17, 21, 34, 55, 89, 144, 233)


@family(
    "moving_averages",
    [x for n in MA_WINDOWS for x in (f"sma_{n}", f"ema_{n}", f"wma_{n}", f"price_above_sma_{n}",
     f"price_above_ema_{n}", f"sma_{n}_slope", f"ema_{n}_slope")],
    ewm_reach(2 / 234) + 5,
)
def moving_averages(s: Series) -> Series:
    a = s.axis
    s = s.ewm(
        {f"ema_{n}": span("close", n) for n in MA_WINDOWS}
        | {f"_sum_{n}": Roll("close", n) for n in MA_WINDOWS}
        | {f"_ramp_{n}": Roll("close", n, ramp=True) for n in MA_WINDOWS}
    )
    s = s.add(
        {f"sma_{n}": F.col(f"_sum_{n}") / F.lit(float(n)) for n in MA_WINDOWS}
        | {f"wma_{n}": F.col(f"_ramp_{n}") / F.lit(n * (n + 1) / 2) for n in MA_WINDOWS}
    )
    cols = {}
    for n in MA_WINDOWS:
        for kind in ("sma", "ema"):
            cols[f"price_above_{kind}_{n}"] = flag(F.col("close") > F.col(f"{kind}_{n}"))
            cols[f"{kind}_{n}_slope"] = a.diff(f"{kind}_{n}", 5)
    return s.add(cols)


def midpoint(a: Axis, n: int) -> Column:
    return (a.top("high", n) + a.bottom("low", n)) / 2


@family("ichimoku", ["ichimoku_a", "ichimoku_b", "ichimoku_base", "ichimoku_conversion", "ichimoku_span"], 52)
def ichimoku(s: Series) -> Series:
    a = s.axis
    s = s.add({"ichimoku_conversion": midpoint(a, 9), "ichimoku_base": midpoint(a, 26), "ichimoku_b": midpoint(a, 52)})
    s = s.add({"ichimoku_a": (F.col("ichimoku_conversion") + F.col("ichimoku_base")) / 2})
    return s.add({"ichimoku_span": F.col("ichimoku_a") - F.col("ichimoku_b")})


FALLBACK_WINDOWS = (5, 10, 20, 50, 100, 200)
FALLBACK = (
    ["rsi_14", "rsi_21", "stoch_k", "stoch_d", "williams_r", "macd", "macd_signal", "macd_diff"]
    + [f"{p}_{n}" for n in FALLBACK_WINDOWS for p in ("sma", "ema")]
    + ["bb_high", "bb_low", "bb_mid", "bb_width", "bb_position"]
)


@family("fallback_set", FALLBACK, ewm_reach(2 / 201))
def fallback_set(s: Series) -> Series:
    """The small indicator set under its short names."""
    s = rsi_into(s, {"rsi_14": 14, "rsi_21": 21})
    s = macd_into(s, {"": (12, 26)}, lambda _: ("macd", "macd_signal", "macd_diff"))
    s = s.ewm({f"ema_{n}": span("close", n) for n in FALLBACK_WINDOWS})
    a = s.axis
    mid, dev = middle_and_width(a, 20)
    s = s.add(
        {f"sma_{n}": a.mean("close", n) for n in FALLBACK_WINDOWS}
        | {"stoch_k": stochastic(a, 14), "williams_r": williams(a, 14), "bb_mid": mid, "_bbs": dev}
    )
    s = s.add(
        {
            "stoch_d": a.mean("stoch_k", 3),
            "bb_high": F.col("bb_mid") + F.col("_bbs") * 2,
            "bb_low": F.col("bb_mid") - F.col("_bbs") * 2,
        }
    )
    width = F.col("bb_high") - F.col("bb_low")
    return s.add({"bb_width": ratio(width, "bb_mid"), "bb_position": ratio(F.col("close") - F.col("bb_low"), width)})


