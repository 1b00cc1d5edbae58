"""Decimals at which the feature columns are compared (shared by both engines).

Prices are whole numbers of 1e5 to 1e7, so price-level columns compare at whole units; a
column whose value is the same arithmetic on whole numbers in both engines is exact anyway.
"""

from __future__ import annotations

import re

# Family -> decimals, or (pattern, decimals) pairs tried in order.
DIGITS: dict[str, object] = {
    "price_returns": 6, "price_ratios": 6, "gaps": 6, "momentum": 6,
    "calendar": [("_sin|_cos", 6), ("", None)],
    "microstructure": [("tick_direction", None), ("", 6)],
    "candles": None,
    "rolling_stats": [("std|quantile", 0), ("", 3)],
    "zscores": 5, "volatility": 4, "range_vol": 6,
    "dispersion": [("avg_dev", 0), ("", 4)],
    "volume_ratios": 5, "volume_price": [("trend", 4), ("", 1)], "obv": 0, "volume_roc": 6,
    "volume_smoothing": [("sma", 4), ("", 3)],
    "mfi": 4, "force_index": -2, "eom": -8, "vwap": 1,
    "bollinger_grid": [("width|position", 4), ("", 0)],
    "atr": [("ratio", 4), ("", 0)],
    "donchian": [("position", 6), ("", 1)],
    "keltner_grid": 1,
    "rsi": 4, "stochastic_grid": 4, "williams_r": 4, "cci": 4, "ultimate_osc": 4, "awesome_osc": 1,
    "trend_strength": [("direction", None), ("", 6)],
    "detrended": 1, "adx": 4, "macd_grid": 0, "ppo_grid": 4,
    "moving_averages": [("price_above", None), ("ema", 0), ("", 2)],
    "ichimoku": 2,
    "psar_grid": 0,
    "fallback_set": [("rsi|stoch|williams|width|position", 4), ("", 0)],
    "ta_adi": 2, "ta_obv": 0, "ta_cmf": 5, "ta_fi": -2, "ta_eom": -8, "ta_vpt": 2, "ta_vwap": 1, "ta_mfi": 4,
    "ta_nvi": -300, "ta_bb": [("bbw|bbp|bbhi|bbli", 4), ("", 0)], "ta_kc": [("kcw|kcp|kchi|kcli", 4), ("", 1)],
    "ta_dc": [("dcw|dcp", 4), ("", 1)], "ta_atr": 0, "ta_ui": 4, "ta_macd": 0, "ta_ma": 0, "ta_vortex": 5,
    "ta_trix": 4, "ta_mass": 4, "ta_dpo": 1, "ta_kst": 3, "ta_ichimoku": 2, "ta_stc": 2, "ta_adx": 4, "ta_cci": 4,
    "ta_aroon": 4, "ta_psar": [("indicator", None), ("", 0)], "ta_rsi": 4, "ta_stochrsi": 4, "ta_tsi": 4, "ta_uo": 4,
    "ta_stoch": 4, "ta_wr": 4, "ta_ao": 1, "ta_roc": 4, "ta_ppo": 4, "ta_pvo": 4, "ta_kama": 0, "ta_returns": 4,
}


def digits_of(family: str, column: str) -> int | None:
    rule = DIGITS[family]
    if isinstance(rule, list):
        return next(d for pattern, d in rule if re.search(pattern, column))
    return rule
