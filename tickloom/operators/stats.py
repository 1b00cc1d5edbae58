"""Rolling moments, quantiles, deviations and volatility estimates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..functions.series import Axis, Series
from .catalogue import family

YEAR = math.sqrt(252)
PERIODS = (5, 10, 20, 50)
SHORT_PERIODS = (5, 10, 20, 30)


def _skew(a: Axis, x: str, n: int) -> Column:
    """Bias-adjusted skewness; a constant frame has skewness 0."""
    value = F.skewness(x).over(a.rows(n)) * F.lit(math.sqrt(n * (n - 1)) / (n - 2))
    return F.when(F.count(x).over(a.rows(n)) == n, F.coalesce(value, F.lit(0.0)))


def _kurt(a: Axis, x: str, n: int) -> Column:
    value = (F.lit(n + 1.0) * F.kurtosis(x).over(a.rows(n)) + 6) * F.lit((n - 1) / ((n - 2) * (n - 3)))
    return F.when(F.count(x).over(a.rows(n)) == n, F.coalesce(value, F.lit(0.0)))


@family(
    "rolling_stats",
    [f"{p}_{n}" for n in PERIODS for p in ("std", "skew", "kurt", "quantile_25", "quantile_75")],
    50,
)
def rolling_stats(s: Series) -> Series:
    a, cols = s.axis, {}
    for n in PERIODS:
        cols[f"std_{n}"] = a.std("close", n)
        cols[f"skew_{n}"] = _skew(a, "close", n)
        cols[f"kurt_{n}"] = _kurt(a, "close", n)
        for q in (25, 75):
            cols[f"quantile_{q}_{n}"] = a.frame(lambda x, q=q: F.percentile(x, F.lit(q / 100)), "close", n)
    return s.add(cols)


@family("zscores", ["zscore_20", "zscore_50"], 50)
def zscores(s: Series) -> Series:
    a = s.axis
    return s.add(
        {f"zscore_{n}": ratio(F.col("close") - a.mean("close", n), a.std("close", n)) for n in (20, 50)}
    )


@family("volatility", [f"volatility_{n}" for n in PERIODS], 51)
def volatility(s: Series) -> Series:
    s = s.add({"_ret": s.axis.change("close")})
    return s.add({f"volatility_{n}": s.axis.std("_ret", n) * F.lit(YEAR) for n in PERIODS})


@family("range_vol", ["parkinson_vol", "gk_vol"])
def range_vol(s: Series) -> Series:
    spread = F.pow(F.ln(ratio("high", "low")), 2)
    drift = F.pow(F.ln(ratio("close", "open")), 2)
    return s.add(
        {
            "parkinson_vol": F.sqrt(spread / F.lit(4 * math.log(2))),
            "gk_vol": spread * F.lit(0.5) - F.lit(2 * math.log(2) - 1) * drift,
        }
    )


@family("dispersion", [f"{p}_{n}" for n in SHORT_PERIODS for p in ("hist_vol", "avg_dev", "cv")], 31)
def dispersion(s: Series) -> Series:
    a = s.axis
    s = s.add({"_ret": a.change("close")})
    cols = {}
    for n in SHORT_PERIODS:
        cols[f"hist_vol_{n}"] = a.std("_ret", n) * F.lit(YEAR)
        cols[f"avg_dev_{n}"] = a.mad("close", n)
        cols[f"cv_{n}"] = ratio(a.std("close", n), a.mean("close", n))
    return s.add(cols)
