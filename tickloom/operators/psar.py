"""Parabolic stop-and-reverse, the one indicator whose state branches on every row.

Rows go through an Arrow grouped map. In the sliced layout each slice starts from a guess
inside its copied rows; the states at the slice borders are then compared, and slices that
started from a wrong state are run again from the right one until all borders agree. The
first slice is exact, so agreement along the chain makes every slice exact.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.series import Series
from ..session import cut
from .catalogue import family


def _track(high, low, close, step: float, limit: float, state, begin: int):
    """Stop levels and trend flags of rows ``begin..``; ``state`` is (rising, pace, extreme, stop)."""
    n = len(close)
    stops, rising_at = np.full(n, np.nan), np.zeros(n, dtype=bool)
    states = [None] * n
    rising, pace, extreme, stop = state
    for i in range(begin, n):
        top, bottom = high[i], low[i]
        if i < 2:  # no history yet: the stop is the close
            stop, turned = close[i], None
        else:
            stop += pace * (extreme - stop)
            turned = bottom < stop if rising else top > stop
        if turned:
            stop, pace, rising = extreme, step, not rising
            extreme = top if rising else bottom
        elif turned is not None:
            further = top > extreme if rising else bottom < extreme
            if further:
                extreme, pace = (top if rising else bottom), min(pace + step, limit)
            # the stop may not enter the range of the last two bars, the older one first
            for level in (low[i - 2], low[i - 1]) if rising else (high[i - 2], high[i - 1]):
                if (level < stop) if rising else (level > stop):
                    stop = level
                    break
        stops[i], rising_at[i] = stop, rising
        states[i] = (float(rising), pace, extreme, stop)
    return stops, rising_at, states


def _mapper(sets: Mapping[str, tuple[float, float]], order: str, sliced: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        high, low, close = (pdf[n].tolist() for n in ("high", "low", "close"))
        halo = int(pdf["_halo"].sum()) if sliced else 0
        for name, (step, limit) in sets.items():
            seed = pdf[f"_seed_{name}"].iloc[0] if sliced else None
            if seed is None:
                state, begin = (True, step, high[0], close[0]), 0
            else:
                state, begin = (bool(seed[0]), *map(float, seed[1:])), halo
            stops, rising, states = _track(high, low, close, step, limit, state, begin)
            started = np.arange(len(pdf)) >= 2
            if sliced:  # only the first slice holds the first two rows of the symbol
                started |= halo > 0
            pdf[name] = stops
            pdf[f"{name}__up"] = pd.array(np.where(started, rising, None), dtype="boolean")
            if sliced:
                borders = {len(pdf) - 1: states[-1]}
                if halo:
                    borders[halo - 1] = list(seed) if seed is not None else states[halo - 1]
                pdf[f"_state_{name}"] = [borders.get(i) for i in range(len(pdf))]
                pdf = pdf.drop(columns=f"_seed_{name}")
        return pdf

    return run


def psar_into(s: Series, sets: Mapping[str, tuple[float, float]]) -> Series:
    """Adds for each name the stop level and ``<name>__up`` (NULL on the first two rows)."""
    axis, sliced = s.axis, s.axis.sliced
    order = axis.order[0]
    out = list(s.df.schema.fields)
    for n in sets:
        out += [T.StructField(n, T.DoubleType()), T.StructField(f"{n}__up", T.BooleanType())]
        if sliced:
            out.append(T.StructField(f"_state_{n}", T.ArrayType(T.DoubleType())))
    schema = T.StructType(out)
    run = _mapper(sets, order, sliced)
    if not sliced:
        return replace(s, df=s.df.groupBy(*axis.keys).applyInPandas(run, schema))

    def pass_over(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*axis.keys).applyInPandas(run, schema)

    blank = F.lit(None).cast("array<double>")
    done = cut(pass_over(s.add({f"_seed_{n}": blank for n in sets}).df))
    while True:
        wrong = _wrong_borders(done, sets, axis.keys, order)
        if wrong.isEmpty():
            break
        wrong = cut(wrong)
        redo = s.df.join(wrong, list(axis.keys))
        kept = done.join(wrong.select(*axis.keys), list(axis.keys), "left_anti")
        done = cut(kept.unionByName(pass_over(redo).select(*kept.columns)))
    return replace(s, df=done.drop(*[f"_state_{n}" for n in sets]))


def _wrong_borders(done: DataFrame, sets, keys, order: str) -> DataFrame:
    """Slices whose starting state differs from the end of the slice before, with the right one."""
    edges = done.groupBy(*keys).agg(
        F.max(~F.col("_halo")).alias("_own"),
        *[F.max_by(f"_state_{n}", order).alias(f"_end_{n}") for n in sets],
        *[F.max_by(f"_state_{n}", F.when(F.col("_halo"), F.col(order))).alias(f"_start_{n}") for n in sets],
    )
    chain = Window.partitionBy(keys[0]).orderBy("_slice")
    linked = edges.where("_own").select(
        *keys, *[F.col(f"_start_{n}") for n in sets],
        *[F.lag(f"_end_{n}").over(chain).alias(f"_seed_{n}") for n in sets],
    )
    bad = F.lit(False)
    for n in sets:
        bad = bad | ~F.col(f"_start_{n}").eqNullSafe(F.col(f"_seed_{n}"))
    return linked.where(F.col("_slice") > 0).where(bad).select(*keys, *[f"_seed_{n}" for n in sets])


PSAR_SETS = {
    f"psar_{round(step * 100)}_{round(limit * 100)}": (step, limit)
    for step in (0.02, 0.04, 0.06)
    for limit in (0.1, 0.2, 0.3)
}


@family("psar_grid", list(PSAR_SETS), 2000, grouped=True)
def psar_grid(s: Series) -> Series:
    s = psar_into(s, PSAR_SETS)
    return s.drop(*[f"{n}__up" for n in PSAR_SETS])


