"""Scores of every bar on a stream from state per symbol: indicators carried from bar to bar.

An indicator is a few numbers and a step that takes them past one bar, so a symbol's state has a fixed
size and a bar costs the same however long the history is. The values are those that the batch builder
gives for the same bar. State of a symbol that has been silent for ``forget`` is dropped by event time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

NAN = math.nan
Bar = tuple[float, float, float, float, float]  # open, high, low, close, volume


class Indicator(Protocol):
    size: int

    def start(self) -> list[float]: ...

    def step(self, held: list[float], bar: Bar, n: int) -> tuple[list[float], float]:
        """The numbers after the ``n``-th bar (from 1) and the value there (NaN: missing)."""


@dataclass(frozen=True)
class Return:
    """Change of the close over ``lag`` bars; holds that many closes."""

    lag: int

    @property
    def size(self) -> int:
        return self.lag

    def start(self) -> list[float]:
        return [NAN] * self.lag

    def step(self, held: list[float], bar: Bar, n: int) -> tuple[list[float], float]:
        old = held[0]
        return [*held[1:], bar[3]], NAN if math.isnan(old) or old == 0 else bar[3] / old - 1


@dataclass(frozen=True)
class Rsi:
    """Relative strength of smoothed gains and losses; holds the last close, both averages and the value of
    the last price change."""

    n: int
    size: int = 4

    def start(self) -> list[float]:
        return [NAN, 0.0, 0.0, 100.0]

    def step(self, held: list[float], bar: Bar, n: int) -> tuple[list[float], float]:
        last, up, down, value = held
        moved = 0.0 if math.isnan(last) else bar[3] - last
        if n > 1:
            up += (max(moved, 0.0) - up) / self.n
            down += (max(-moved, 0.0) - down) / self.n
        if moved:
            value = 100.0 if down == 0 else 100.0 - 100.0 / (1.0 + up / down)
        return [bar[3], up, down, value], value if n >= self.n else NAN


@dataclass(frozen=True)
class Position:
    """Place of the close between low and high; holds nothing."""

    size: int = 0

    def start(self) -> list[float]:
        return []

    def step(self, held: list[float], bar: Bar, n: int) -> tuple[list[float], float]:
        width = bar[1] - bar[2]
        return held, (bar[3] - bar[2]) / width if width else NAN


def keyed_scores(
    bars: DataFrame, indicators: Mapping[str, Indicator], score: Callable[[np.ndarray], np.ndarray], minimum: int = 50, late: str = "1 hour", forget: str = "30 days"
) -> DataFrame:
    """``symbol, ts, n``, the indicators and ``prediction`` for every bar from a symbol's ``minimum``-th on.

    Bars (``symbol, ts, open, high, low, close, volume``) come in order of time per symbol, as closed
    windows do; a bar at or before the last one taken is a repetition and gives nothing. ``score`` takes a
    row per bar and a column per indicator (missing is 0).
    """
    silence = int(pd.Timedelta(forget).total_seconds() * 1000)
    names = list(indicators)

    def follow(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last, numbers = state.get if state.exists else (0, -(2**62), [x for i in indicators.values() for x in i.start()])
        numbers = [NAN if x is None else x for x in numbers]
        held, at = {}, 0
        for name, i in indicators.items():
            held[name] = numbers[at : at + i.size]
            at += i.size
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable").drop_duplicates("ts", keep="last")
        out = []
        for r in rows.itertuples(index=False):
            us = r.ts.value // 1000
            if us <= last:
                continue
            n, last = n + 1, us
            bar = (r.open, r.high, r.low, r.close, r.volume)
            values = []
            for name, i in indicators.items():
                held[name], value = i.step(held[name], bar, n)
                values.append(value)
            if n >= minimum:
                out.append((key[0], r.ts, n, *values))
        state.update((n, last, [float(x) for name in names for x in held[name]]))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + silence)
        if out:
            made = pd.DataFrame(out, columns=["symbol", "ts", "n", *names])
            made["prediction"] = score(np.nan_to_num(made[names].to_numpy(float), nan=0.0))
            yield made

    source = bars.select("symbol", "ts", "open", "high", "low", "close", "volume").withWatermark("ts", late)
    columns = "symbol string, ts timestamp, n long, " + ", ".join(f"`{n}` double" for n in names) + ", prediction double"
    return source.groupBy("symbol").applyInPandasWithState(
        follow, columns, "n long, last long, numbers array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )
