"""Labels of the next bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import flag
from ..functions.series import Axis, Series, as_series


def forward_return(a: Axis, horizon: int) -> Column:
    return F.try_divide(F.lead("close", horizon).over(a.spec), F.col("close")) - F.lit(1.0)


def forward_volatility(s: Series, horizon: int) -> Series:
    s = s.add({"_ret": s.axis.change("close")})
    ahead = s.axis.spec.rowsBetween(1, horizon)
    full = F.count("_ret").over(ahead) == horizon
    return s.add({"target": F.when(full, F.stddev_samp("_ret").over(ahead))})


def add_target(s: Series, kind: str = "directional", horizon: int = 1, drop_unlabelled: bool = False) -> Series:
    """``directional`` (1 when the close rises over the horizon), ``regression`` or ``volatility``.

    The last rows of a symbol have no future: their directional label is 0 unless
    ``drop_unlabelled`` removes them.
    """
    if kind == "volatility":
        s = forward_volatility(s, horizon)
    elif kind in ("directional", "regression"):
        s = s.add({"_future": forward_return(s.axis, horizon)})
        s = s.add({"target": flag(F.col("_future") > 0) if kind == "directional" else F.col("_future")})
        if drop_unlabelled:
            s = Series(s.df.where(F.col("_future").isNotNull()), s.axis)
    else:
        raise ValueError(f"Unknown target type: {kind}")
    return s


def create_targets(bars: DataFrame, kind: str = "directional", horizon: int = 1, drop_unlabelled: bool = False, **layout) -> DataFrame:
    s = as_series(bars, lookback=1, ahead=horizon + 1, **layout)
    return add_target(s, kind, horizon, drop_unlabelled).tidy().select("symbol", "ts", "target")


def label_align(features: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows whose key occurs on both sides."""
    return features.join(targets, ["symbol", "ts"], "inner")
