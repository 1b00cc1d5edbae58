"""Feature families: each has a fixed list of output columns and a builder."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..functions.series import BARS, Axis, Series, as_series
from ..sources.bars import clean_features, require_columns


@dataclass(frozen=True)
class Family:
    name: str
    columns: tuple[str, ...]
    build: Callable[[Series], Series]
    reach: int  # rows of history that a value depends on (to double precision)
    suite: bool = False
    grouped: bool = False  # needs a grouped map over the rows


CATALOGUE: dict[str, Family] = {}


def family(name: str, columns: Sequence[str], reach: int = 1, suite: bool = False, grouped: bool = False):
    def register(fn: Callable[..., Series]) -> Callable[..., Series]:
        CATALOGUE[name] = Family(name, tuple(columns), fn, reach, suite, grouped)
        return fn

    return register


def dotted(x: float) -> str:
    """Parameter values inside column names, with ``_`` for the decimal point."""
    return str(float(x)).replace(".", "_")


def families(names: Sequence[str] | None = None) -> list[Family]:
    from . import load_all

    load_all()
    if names is None:
        return [f for f in CATALOGUE.values() if f.name != "fallback_set"]
    return [CATALOGUE[n] for n in names]


def feature_names(names: Sequence[str] | None = None) -> list[str]:
    return list(dict.fromkeys(c for f in families(names) for c in f.columns))


def lookback_of(names: Sequence[str] | None = None) -> int:
    return max(f.reach for f in families(names))


@dataclass(frozen=True)
class Recorder:
    """Stands in for a series and notes the steps a family takes."""

    axis: Axis
    steps: tuple[tuple[str, dict], ...] = ()

    def add(self, cols: Mapping) -> Recorder:
        return self._note("add", cols)

    def ewm(self, specs: Mapping) -> Recorder:
        return self._note("scan", specs)

    def fold(self, specs: Mapping) -> Recorder:
        return self._note("fold", specs)

    def drop(self, *names: str) -> Recorder:
        return self

    def _note(self, kind: str, cols: Mapping) -> Recorder:
        return replace(self, steps=(*self.steps, (kind, dict(cols))))


def apply_families(s: Series, names: Sequence[str] | None = None) -> Series:
    """Runs the families side by side, level by level.

    The steps of all families are noted first. Then every family moves on through its plain
    columns until it waits for a scan or a running fold, and those are taken for all families
    at once. The plan has as many window passes as the deepest family, not as all together.
    """
    wanted = families(names)
    for f in wanted:  # grouped maps first, while the rows are narrow
        if f.grouped:
            s = f.build(s)
    queues = [list(f.build(Recorder(s.axis)).steps) for f in wanted if not f.grouped]
    have: set[str] = set(s.df.columns)
    while any(queues):
        waiting = {q[0][0] for q in queues if q}
        kind = next(k for k in ("add", "fold", "scan") if k in waiting)
        level: dict[str, object] = {}
        for q in queues:
            if q and q[0][0] == kind:
                level |= {n: e for n, e in q.pop(0)[1].items() if n not in have}
        have |= set(level)
        if level:
            s = {"add": s.add, "fold": s.fold, "scan": s.ewm}[kind](level)
    return s


def helper_clashes(names: Sequence[str] | None = None) -> dict[str, set[str]]:
    """Helper columns that two families define differently (must be empty)."""
    seen: dict[str, set[str]] = {}
    for f in families(names):
        if not f.grouped:
            for _kind, cols in f.build(Recorder(Axis())).steps:
                for n, e in cols.items():
                    seen.setdefault(n, set()).add(str(e))
    return {n: v for n, v in seen.items() if len(v) > 1}


def build_features(
    bars: DataFrame,
    names: Sequence[str] | None = None,
    columns: Sequence[str] | None = None,
    group_rows: int | None = None,
    fillna: bool = False,
    **layout,
) -> DataFrame:
    """Bars plus the features of the named families (all by default).

    All families hang off one exchange on the symbol; the layout is whole or sliced as
    :func:`as_series` decides. ``columns`` prunes the result, and Catalyst then drops the
    window expressions that nothing needs. ``fillna`` lets frames be partial and replaces
    what is still missing by the indicator's neutral value. Rows without a symbol, a time or a
    whole bar are no bars and are left out; bars must be unique per symbol and time, which
    ``unique_bars`` sees to.
    """
    require_columns(bars)
    bars = bars.na.drop(subset=["symbol", "ts", *BARS])
    if columns is not None and names is None:
        names = [f.name for f in families() if set(f.columns) & set(columns)]
    s = as_series(
        bars, lookback=lookback_of(names), group_rows=group_rows, axis=Axis(full=not fillna), **layout
    )
    out = apply_families(s, names).tidy()
    wanted = columns if columns is not None else feature_names(names)
    if fillna:
        from .suite import NEUTRAL

        out = out.na.fill({n: NEUTRAL.get(n, 0.0) for n in wanted})
    return clean_features(out.select("symbol", "ts", *BARS, *wanted))


def create_advanced_features(bars: DataFrame) -> DataFrame:
    """Short name for the full feature table."""
    return build_features(bars)


def write_features(bars: DataFrame, path: str, group_rows: int | None = None) -> None:
    """The full table, family by family: one narrow parquet dataset per family.

    A plan with hundreds of window expressions is slow to analyse and too wide for code
    generation; written per family, every job stays small and readers open only the
    families they use (all keyed by ``symbol, ts``).
    """
    for f in families():
        build_features(bars, [f.name], group_rows=group_rows).drop(*BARS).write.mode("overwrite").parquet(
            f"{path}/{f.name}"
        )
