"""The 86-column indicator suite: published formulas with their usual parameters.

Values are NULL during warm-up. With ``Axis(full=False)`` frames may be partial, and
:data:`NEUTRAL` lists what replaces the cells that are still missing (0 for the rest).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import ratio, truth
from ..functions.series import FORGET, Series, ewm_reach, span, wilder
from .bands import atr_into, keltner_lines, middle_and_width, true_range
from .catalogue import CATALOGUE, family
from .oscillators import awesome, cci_into, rsi_into, stochastic, ultimate_into, williams
from .psar import psar_into
from .trend import adx_into, macd_into, midpoint
from .volume import _vwap, ease, force_into, mfi_into, obv_into, range_share, typical

NEUTRAL = {
    "momentum_rsi": 50.0, "momentum_stoch": 50.0, "momentum_stoch_signal": 50.0, "momentum_uo": 50.0,
    "volume_mfi": 50.0, "momentum_wr": -50.0, "trend_adx": 20.0, "trend_adx_pos": 20.0, "trend_adx_neg": 20.0,
}


def suite(name: str, columns: list[str], reach: int = 1):
    return family(name, columns, reach, suite=True)


def outside(upper: str, lower: str, above: str, below: str) -> dict[str, Column]:
    close = F.col("close")
    return {
        above: truth(close > F.col(upper)).cast("double"),
        below: truth(close < F.col(lower)).cast("double"),
    }


@suite("ta_adi", ["volume_adi"])
def ta_adi(s: Series) -> Series:
    return s.fold({"volume_adi": ("sum", range_share() * F.col("volume"))})


@suite("ta_obv", ["volume_obv"], 2)
def ta_obv(s: Series) -> Series:
    return obv_into(s, "volume_obv")


@suite("ta_cmf", ["volume_cmf"], 20)
def ta_cmf(s: Series) -> Series:
    a = s.axis
    return s.add({"volume_cmf": ratio(a.total(range_share() * F.col("volume"), 20), a.total("volume", 20))})


@suite("ta_fi", ["volume_fi"], ewm_reach(2 / 14) + 1)
def ta_fi(s: Series) -> Series:
    return force_into(s, {"volume_fi": 13})


@suite("ta_eom", ["volume_em", "volume_sma_em"], 15)
def ta_eom(s: Series) -> Series:
    s = s.add({"volume_em": ease(s.axis)})
    return s.add({"volume_sma_em": s.axis.mean("volume_em", 14)})


@suite("ta_vpt", ["volume_vpt"], 2)
def ta_vpt(s: Series) -> Series:
    s = s.add({"_flow": F.col("volume") * s.axis.change("close")})
    return s.fold({"volume_vpt": ("sum", F.col("_flow"))})


@suite("ta_vwap", ["volume_vwap"], 14)
def ta_vwap(s: Series) -> Series:
    return s.add({"volume_vwap": _vwap(s.axis, 14, typical())})


@suite("ta_mfi", ["volume_mfi"], 15)
def ta_mfi(s: Series) -> Series:
    return mfi_into(s, {"volume_mfi": 14})


@suite("ta_nvi", ["volume_nvi"], 2)
def ta_nvi(s: Series) -> Series:
    a = s.axis
    s = s.add({"_nvi_step": F.when(truth(F.col("volume") < a.lag("volume")), 1 + a.change("close")).otherwise(1.0)})
    s = s.fold({"_nvi": ("product", F.col("_nvi_step"))})
    return s.add({"volume_nvi": F.lit(1000.0) * F.col("_nvi")})


@suite("ta_bb", [f"volatility_bb{x}" for x in ("m", "h", "l", "w", "p", "hi", "li")], 20)
def ta_bb(s: Series) -> Series:
    mid, dev = middle_and_width(s.axis, 20)
    s = s.add({"volatility_bbm": mid, "_dev": dev})
    m, d = F.col("volatility_bbm"), F.col("_dev") * 2
    s = s.add({"volatility_bbh": m + d, "volatility_bbl": m - d})
    h, low = F.col("volatility_bbh"), F.col("volatility_bbl")
    return s.add(
        {"volatility_bbw": ratio(h - low, m) * 100, "volatility_bbp": ratio(F.col("close") - low, h - low)}
        | outside("volatility_bbh", "volatility_bbl", "volatility_bbhi", "volatility_bbli")
    )


@suite("ta_kc", [f"volatility_kc{x}" for x in ("c", "h", "l", "w", "p", "hi", "li")], 10)
def ta_kc(s: Series) -> Series:
    mid, upper, lower = keltner_lines(s.axis, 10)
    s = s.add({"volatility_kcc": mid, "volatility_kch": upper, "volatility_kcl": lower})
    h, low = F.col("volatility_kch"), F.col("volatility_kcl")
    return s.add(
        {
            "volatility_kcw": ratio(h - low, "volatility_kcc") * 100,
            "volatility_kcp": ratio(F.col("close") - low, h - low),
        }
        | outside("volatility_kch", "volatility_kcl", "volatility_kchi", "volatility_kcli")
    )


@suite("ta_dc", [f"volatility_dc{x}" for x in ("l", "h", "m", "w", "p")], 20)
def ta_dc(s: Series) -> Series:
    a = s.axis
    s = s.add({"volatility_dcl": a.bottom("low", 20), "volatility_dch": a.top("high", 20), "_mid": a.mean("close", 20)})
    h, low = F.col("volatility_dch"), F.col("volatility_dcl")
    return s.add(
        {
            "volatility_dcm": low + (h - low) / 2,
            "volatility_dcw": ratio(h - low, "_mid") * 100,
            "volatility_dcp": ratio(F.col("close") - low, h - low),
        }
    )


@suite("ta_atr", ["volatility_atr"], ewm_reach(1 / 10) + 10)
def ta_atr(s: Series) -> Series:
    return atr_into(s, {"volatility_atr": 10})


@suite("ta_ui", ["volatility_ui"], 28)
def ta_ui(s: Series) -> Series:
    peak = F.max("close").over(s.axis.rows(14))
    s = s.add({"_drop": F.pow(ratio(F.lit(100.0) * (F.col("close") - peak), peak), 2)})
    return s.add({"volatility_ui": F.sqrt(s.axis.mean("_drop", 14))})


@suite("ta_macd", ["trend_macd", "trend_macd_signal", "trend_macd_diff"], ewm_reach(2 / 27) + ewm_reach(0.2))
def ta_macd(s: Series) -> Series:
    return macd_into(s, {"": (12, 26)}, lambda _: ("trend_macd", "trend_macd_signal", "trend_macd_diff"))


@suite("ta_ma", ["trend_sma_fast", "trend_sma_slow", "trend_ema_fast", "trend_ema_slow"], ewm_reach(2 / 27))
def ta_ma(s: Series) -> Series:
    s = s.add({"trend_sma_fast": s.axis.mean("close", 12), "trend_sma_slow": s.axis.mean("close", 26)})
    return s.ewm({"trend_ema_fast": span("close", 12), "trend_ema_slow": span("close", 26)})


@suite("ta_vortex", ["trend_vortex_ind_pos", "trend_vortex_ind_neg", "trend_vortex_ind_diff"], 15)
def ta_vortex(s: Series) -> Series:
    a = s.axis
    s = s.add(
        {"_tr": true_range(a), "_vp": F.abs(F.col("high") - a.lag("low")), "_vm": F.abs(F.col("low") - a.lag("high"))}
    )
    total = a.total("_tr", 14)
    s = s.add({"trend_vortex_ind_pos": ratio(a.total("_vp", 14), total), "trend_vortex_ind_neg": ratio(a.total("_vm", 14), total)})
    return s.add({"trend_vortex_ind_diff": F.col("trend_vortex_ind_pos") - F.col("trend_vortex_ind_neg")})


@suite("ta_trix", ["trend_trix"], 3 * ewm_reach(2 / 16) + 1)
def ta_trix(s: Series) -> Series:
    s = s.ewm({"_x1": span("close", 15)}).ewm({"_x2": span("_x1", 15)}).ewm({"_x3": span("_x2", 15)})
    return s.add({"trend_trix": s.axis.change("_x3") * 100})


@suite("ta_mass", ["trend_mass_index"], 2 * ewm_reach(0.2) + 25)
def ta_mass(s: Series) -> Series:
    s = s.add({"_hl": F.col("high") - F.col("low")}).ewm({"_m1": span("_hl", 9)}).ewm({"_m2": span("_m1", 9)})
    s = s.add({"_mass": ratio("_m1", "_m2")})
    return s.add({"trend_mass_index": s.axis.total("_mass", 25)})


@suite("ta_dpo", ["trend_dpo"], 20)
def ta_dpo(s: Series) -> Series:
    return s.add({"trend_dpo": s.axis.lag("close", 11) - s.axis.mean("close", 20)})


@suite("ta_kst", ["trend_kst", "trend_kst_sig", "trend_kst_diff"], 60)
def ta_kst(s: Series) -> Series:
    a, terms = s.axis, ((10, 10), (15, 10), (20, 10), (30, 15))
    s = s.add({f"_roc{r}": a.change("close", r) for r, _ in terms})
    smooth = [a.mean(f"_roc{r}", n) * i for i, (r, n) in enumerate(terms, 1)]
    s = s.add({"trend_kst": F.lit(100.0) * (smooth[0] + smooth[1] + smooth[2] + smooth[3])})
    s = s.add({"trend_kst_sig": a.mean("trend_kst", 9)})
    return s.add({"trend_kst_diff": F.col("trend_kst") - F.col("trend_kst_sig")})


@suite(
    "ta_ichimoku",
    [f"trend_ichimoku_{x}" for x in ("conv", "base", "a", "b")]
    + ["trend_visual_ichimoku_a", "trend_visual_ichimoku_b"],
    78,
)
def ta_ichimoku(s: Series) -> Series:
    a = s.axis
    s = s.add(
        {
            "trend_ichimoku_conv": midpoint(a, 9),
            "trend_ichimoku_base": midpoint(a, 26),
            "trend_ichimoku_b": midpoint(a, 52),
        }
    )
    s = s.add({"trend_ichimoku_a": (F.col("trend_ichimoku_conv") + F.col("trend_ichimoku_base")) / 2})
    return s.add({f"trend_visual_ichimoku_{x}": a.lag(f"trend_ichimoku_{x}", 26) for x in ("a", "b")})


#: Relative differences below this are rounding.
NOISE = 1e-11


def _stoch_of(s: Series, x: str, out: str, n: int) -> Series:
    """Stochastic of a single line; a frame without range repeats the last value."""
    s = s.add({f"_raw{x}": stochastic(s.axis, n, x, x, x)})
    return s.fold({out: ("last", F.col(f"_raw{x}"))})


@suite("ta_stc", ["trend_stc"], ewm_reach(2 / 51) + 2 * ewm_reach(0.5) + 20)
def ta_stc(s: Series) -> Series:
    s = s.ewm({"_f": span("close", 23), "_w": span("close", 50)})
    # what two averages of one price still differ by after a long flat run is rounding, not trend
    gap = F.col("_f") - F.col("_w")
    s = s.add({"_line": F.when(F.abs(gap) < F.abs("close") * NOISE, 0.0).otherwise(gap)})
    s = _stoch_of(s, "_line", "_k1", 10).ewm({"_stc_d": span("_k1", 3)})
    return _stoch_of(s, "_stc_d", "_k2", 10).ewm({"trend_stc": span("_k2", 3)})


@suite("ta_adx", ["trend_adx", "trend_adx_pos", "trend_adx_neg"], 2 * ewm_reach(1 / 14) + 30)
def ta_adx(s: Series) -> Series:
    return adx_into(s, 14, "trend_adx", "trend_adx_pos", "trend_adx_neg")


@suite("ta_cci", ["trend_cci"], 20)
def ta_cci(s: Series) -> Series:
    return cci_into(s, {"trend_cci": 20})


@suite("ta_aroon", ["trend_aroon_up", "trend_aroon_down", "trend_aroon_ind"], 25)
def ta_aroon(s: Series) -> Series:
    """Place (1..25) of the highest high and lowest low in the frame, the oldest on ties."""
    n = 25
    s = s.add({"_pos": F.row_number().over(s.axis.spec)})
    frame = s.axis.rows(n)

    def place(value: Column) -> Column:
        first = F.min_by("_pos", F.struct(value.alias("v"), F.col("_pos").alias("p"))).over(frame)
        out = (first - F.col("_pos") + n) / F.lit(float(n)) * 100
        return F.when(F.col("_pos") >= n, out) if s.axis.full else out

    s = s.add({"trend_aroon_up": place(-F.col("high")), "trend_aroon_down": place(F.col("low"))})
    return s.add({"trend_aroon_ind": F.col("trend_aroon_up") - F.col("trend_aroon_down")})


PSAR_COLUMNS = ["trend_psar_up", "trend_psar_down", "trend_psar_up_indicator", "trend_psar_down_indicator"]


@family("ta_psar", PSAR_COLUMNS, 2000, suite=True, grouped=True)
def ta_psar(s: Series) -> Series:
    s = psar_into(s, {"_stop": (0.02, 0.2)})
    up = F.col("_stop__up")
    s = s.add({"trend_psar_up": F.when(up, F.col("_stop")), "trend_psar_down": F.when(~up, F.col("_stop"))})
    before = s.axis.lag("_stop__up")
    return s.add(
        {
            "trend_psar_up_indicator": truth(up & ~F.coalesce(before, F.lit(False))).cast("double"),
            "trend_psar_down_indicator": truth(~up & F.coalesce(before, F.lit(True))).cast("double"),
        }
    )


@suite("ta_rsi", ["momentum_rsi"], ewm_reach(1 / 14) + 1)
def ta_rsi(s: Series) -> Series:
    return rsi_into(s, {"momentum_rsi": 14})


@suite("ta_stochrsi", ["momentum_stoch_rsi", "momentum_stoch_rsi_k", "momentum_stoch_rsi_d"], ewm_reach(1 / 14) + 20)
def ta_stochrsi(s: Series) -> Series:
    s = rsi_into(s, {"_rsi": 14})
    a = s.axis
    low, high = a.bottom("_rsi", 14), a.top("_rsi", 14)
    s = s.add({"momentum_stoch_rsi": ratio(F.col("_rsi") - low, high - low)})
    s = s.add({"momentum_stoch_rsi_k": a.mean("momentum_stoch_rsi", 3)})
    return s.add({"momentum_stoch_rsi_d": a.mean("momentum_stoch_rsi_k", 3)})


@suite("ta_tsi", ["momentum_tsi"], ewm_reach(2 / 26) + ewm_reach(2 / 14))
def ta_tsi(s: Series) -> Series:
    s = s.add({"_d": s.axis.diff("close")}).add({"_da": F.abs("_d")})
    s = s.ewm({"_d1": span("_d", 25), "_a1": span("_da", 25)}).ewm({"_d2": span("_d1", 13), "_a2": span("_a1", 13)})
    return s.add({"momentum_tsi": ratio("_d2", "_a2") * 100})


@suite("ta_uo", ["momentum_uo"], 29)
def ta_uo(s: Series) -> Series:
    return ultimate_into(s, {"momentum_uo": (7, 14, 28)})


@suite("ta_stoch", ["momentum_stoch", "momentum_stoch_signal"], 16)
def ta_stoch(s: Series) -> Series:
    s = s.add({"momentum_stoch": stochastic(s.axis, 14)})
    return s.add({"momentum_stoch_signal": s.axis.mean("momentum_stoch", 3)})


@suite("ta_wr", ["momentum_wr"], 14)
def ta_wr(s: Series) -> Series:
    return s.add({"momentum_wr": williams(s.axis, 14)})


@suite("ta_ao", ["momentum_ao"], 34)
def ta_ao(s: Series) -> Series:
    return s.add({"momentum_ao": awesome(s.axis)})


@suite("ta_roc", ["momentum_roc"], 13)
def ta_roc(s: Series) -> Series:
    return s.add({"momentum_roc": s.axis.change("close", 12) * 100})


def _ppo(s: Series, x: str, stem: str) -> Series:
    names = (stem, f"{stem}_signal", f"{stem}_hist")
    return macd_into(s, {"": (12, 26)}, lambda _: names, x=x, percent=True)


@suite("ta_ppo", ["momentum_ppo", "momentum_ppo_signal", "momentum_ppo_hist"], ewm_reach(2 / 27) + ewm_reach(0.2))
def ta_ppo(s: Series) -> Series:
    return _ppo(s, "close", "momentum_ppo")


@suite("ta_pvo", ["momentum_pvo", "momentum_pvo_signal", "momentum_pvo_hist"], ewm_reach(2 / 27) + ewm_reach(0.2))
def ta_pvo(s: Series) -> Series:
    return _ppo(s, "volume", "momentum_pvo")


KAMA_BLOCK = 1000
KAMA_REACH = math.ceil(FORGET / -math.log(1 - (2 / 31) ** 2)) + 11


@suite("ta_kama", ["momentum_kama"], KAMA_REACH)
def ta_kama(s: Series) -> Series:
    """Adaptive mean: the smoothing constant follows |net move| / path length of 10 rows.

    The recurrence has a coefficient per row, so the block scan works on running sums of
    ``ln(1 - constant)`` instead of powers of one constant.
    """
    a, n = s.axis, 10
    slow, fast = 2 / 31, 2 / 3
    s = s.add({"_ka_step": F.abs(a.diff("close")), "_ka_net": F.abs(a.diff("close", n)), "_ka_row": F.row_number().over(a.spec) - 1})
    share = F.coalesce(ratio("_ka_net", F.sum("_ka_step").over(a.rows(n))), F.lit(0.0))
    s = s.add(
        {"_ka_sc": F.when(F.col("_ka_net").isNotNull(), F.pow(share * F.lit(fast - slow) + F.lit(slow), 2)),
         "_ka_block": F.floor(F.col("_ka_row") / KAMA_BLOCK)}
    )
    live, first = F.col("_ka_row") >= n, F.col("_ka_row") == n
    inner = Window.partitionBy(*a.keys, "_ka_block").orderBy(*a.order).rowsBetween(Window.unboundedPreceding, 0)
    s = s.add({"_ka_log": F.sum(F.when(F.col("_ka_row") > n, F.ln(F.lit(1.0) - F.col("_ka_sc"))).otherwise(0.0)).over(inner)})
    weight = F.when(first, 1.0).when(live, F.col("_ka_sc")).otherwise(0.0)
    s = s.add({"_ka_part": F.exp("_ka_log") * F.sum(weight * F.col("close") * F.exp(-F.col("_ka_log"))).over(inner)})
    hops = math.ceil(KAMA_REACH / KAMA_BLOCK)
    blocks = Window.partitionBy(*a.keys).orderBy("_ka_block")
    end = F.struct(F.col("_ka_part").alias("p"), F.exp("_ka_log").alias("d"))
    s = s.add({f"_ka_end{h}": F.max_by(end, "_ka_row").over(blocks.rangeBetween(-h, -h)) for h in range(1, hops + 1)})
    carry, keep = F.lit(0.0), F.lit(1.0)
    for h in range(1, hops + 1):
        carry = carry + F.coalesce(F.col(f"_ka_end{h}.p"), F.lit(0.0)) * keep
        keep = keep * F.coalesce(F.col(f"_ka_end{h}.d"), F.lit(1.0))
    return s.add({"momentum_kama": F.when(live, F.col("_ka_part") + F.exp("_ka_log") * carry)}).drop(
        *[f"_ka_end{h}" for h in range(1, hops + 1)]
    )


@suite("ta_returns", ["others_dr", "others_dlr", "others_cr"], 2)
def ta_returns(s: Series) -> Series:
    a = s.axis
    s = s.fold({"_c0": ("first", F.col("close"))})
    return s.add(
        {
            "others_dr": a.change("close") * 100,
            "others_dlr": F.ln(ratio("close", a.lag("close"))) * 100,
            "others_cr": (ratio("close", "_c0") - 1) * 100,
        }
    )


SUITE = [f.name for f in CATALOGUE.values() if f.suite]
