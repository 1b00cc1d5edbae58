"""Ordered-series toolkit: axes, row frames, sliced layouts, running folds.

Every time-series operator works on a :class:`Series`, a DataFrame together with the
:class:`Axis` that says how its rows are grouped and ordered. Two layouts exist.

* **whole** - one window group per symbol. Right while the bars of one symbol are known
  to fit a task; bars are unique per ``(symbol, ts)``, so the calendar bounds them no
  matter how skewed the trades are.
* **sliced** - each symbol is cut into runs of ``slice_rows`` rows, and every run carries
  a copy of the ``lookback`` rows in front of it. Window groups are then bounded by
  ``slice_rows + lookback`` even if one symbol holds a third of the data. Totals that
  never forget (running sums, products, maxima) are stitched with per-slice totals.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .scalars import c

BARS = ("open", "high", "low", "close", "volume")
MAX_GROUP_ROWS = 4_000_000


@dataclass(frozen=True)
class Axis:
    keys: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("ts",)
    full: bool = True  # False: frames may be partial (warm-up rows get a value)

    @property
    def sliced(self) -> bool:
        return "_slice" in self.keys

    @property
    def spec(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    @property
    def running(self) -> WindowSpec:
        return self.spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def rows(self, n: int) -> WindowSpec:
        return self.spec.rowsBetween(-(n - 1), Window.currentRow)

    def lag(self, x, k: int = 1) -> Column:
        return F.lag(c(x), k).over(self.spec)

    def diff(self, x, k: int = 1) -> Column:
        return c(x) - self.lag(x, k)

    def change(self, x, k: int = 1) -> Column:
        return F.try_divide(c(x), self.lag(x, k)) - F.lit(1.0)

    def frame(self, agg: Callable[[Column], Column], x, n: int) -> Column:
        """``agg`` over the last ``n`` rows, NULL until ``n`` values are there.

        Bar columns have no NULLs, so the row number tells whether the frame is full; other
        columns are counted.
        """
        value = agg(c(x)).over(self.rows(n))
        return F.when(self.filled(x, n), value) if self.full else value

    def filled(self, x, n: int) -> Column:
        if isinstance(x, str) and x in BARS:
            return F.row_number().over(self.spec) >= n
        return F.count(c(x)).over(self.rows(n)) == n

    def mean(self, x, n: int) -> Column:
        return self.frame(F.avg, x, n)

    def total(self, x, n: int) -> Column:
        return self.frame(F.sum, x, n)

    def top(self, x, n: int) -> Column:
        return self.frame(F.max, x, n)

    def bottom(self, x, n: int) -> Column:
        return self.frame(F.min, x, n)

    def std(self, x, n: int) -> Column:
        return self.frame(F.stddev_samp, x, n)

    def mad(self, x, n: int) -> Column:
        """Mean absolute deviation around the mean of the frame."""

        def agg(v: Column) -> Column:
            return F.collect_list(v)

        def spread(values: Column, centre: Column) -> Column:
            return F.aggregate(values, F.lit(0.0), lambda s, v: s + F.abs(v - centre)) / F.size(values)

        values = agg(c(x)).over(self.rows(n))
        centre = F.avg(c(x)).over(self.rows(n))
        out = spread(values, centre)
        return F.when(self.filled(x, n), out) if self.full else out


@dataclass(frozen=True)
class Series:
    df: DataFrame
    axis: Axis = Axis()

    def add(self, cols: Mapping[str, Column]) -> Series:
        return replace(self, df=self.df.withColumns(dict(cols)))

    def drop(self, *names: str) -> Series:
        return replace(self, df=self.df.drop(*names))

    def tidy(self) -> DataFrame:
        """The rows of the series itself, without helper columns and copied rows."""
        return self.tidy_keep()

    def tidy_keep(self, *names: str) -> DataFrame:
        """Like :meth:`tidy`, but the named helper columns stay."""
        df = self.df.where(~F.col("_halo")) if "_halo" in self.df.columns else self.df
        return df.drop(*[n for n in df.columns if n.startswith("_") and n not in names])

    def ewm(self, specs: Mapping[str, Ewm | Roll]) -> Series:
        return _scan(self, specs)

    def fold(self, specs: Mapping[str, tuple[str, Column]]) -> Series:
        return _fold(self, specs)


# --------------------------------------------------------------------------- layouts


def rows_bound(first_ts, last_ts, seconds: int) -> int:
    """Most bars one symbol can hold when bars are ``seconds`` wide."""
    return int((last_ts - first_ts).total_seconds() // seconds) + 1


def largest_group(df: DataFrame, key: str = "symbol") -> int:
    """Measured size of the largest symbol (one aggregation with map-side counts)."""
    return df.groupBy(key).count().agg(F.max("count")).first()[0] or 0


def slice_series(
    df: DataFrame,
    slice_rows: int,
    lookback: int,
    ahead: int = 0,
    key: str = "symbol",
    order: str = "ts",
    era_seconds: int = 30 * 86_400,
    axis: Axis = Axis(),
) -> Series:
    """Cut every symbol into runs of ``slice_rows`` rows with ``lookback`` copied rows in
    front and ``ahead`` copied rows behind.

    Global row numbers come from two levels, so that no task sees a whole symbol: the row
    number inside a calendar era, plus the number of rows in earlier eras (a table with one
    row per symbol and era).
    """
    placed = df.withColumn("_era", F.floor(F.unix_timestamp(F.col(order).cast("timestamp")) / era_seconds))
    sizes = placed.groupBy(key, "_era").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_era").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "_era", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(key, "_era").orderBy(order)
    ranked = (
        placed.withColumn("_pos", F.row_number().over(inner) - 1)
        .join(offsets, [key, "_era"])
        .withColumn("_row", F.col("_pos") + F.col("_off"))
        .drop("_pos", "_off", "_era")
    )
    home = F.floor(F.col("_row") / slice_rows)
    start = F.greatest(F.floor((F.col("_row") - ahead) / slice_rows), F.lit(0))
    reach = F.floor((F.col("_row") + lookback) / slice_rows)
    cut = (
        ranked.withColumn("_home", home)
        .withColumn("_slice", F.explode(F.sequence(start, reach)))
        .withColumn("_halo", F.col("_slice") != F.col("_home"))
        .drop("_home", "_row")
    )
    return Series(cut, replace(axis, keys=(key, "_slice"), order=(order,)))


def spread(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Hash partitioning on the window keys with the session's full partition count.

    Window stages are heavy on CPU and light on bytes; adaptive coalescing looks at bytes
    only and would run them on a few cores.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def as_series(
    df: DataFrame,
    lookback: int = 0,
    ahead: int = 0,
    group_rows: int | None = None,
    limit: int = MAX_GROUP_ROWS,
    slice_rows: int = 250_000,
    axis: Axis = Axis(),
) -> Series:
    """Whole layout while the largest symbol has at most ``limit`` rows, else sliced.

    ``group_rows`` is a bound that the caller already knows (see :func:`rows_bound`);
    without it the size is measured.
    """
    if group_rows is None:
        group_rows = largest_group(df, axis.keys[0])
    if group_rows <= limit:
        return Series(spread(df, axis.keys), axis)
    rows = max(slice_rows, lookback, ahead)
    return slice_series(df, rows, lookback, ahead, key=axis.keys[0], order=axis.order[0], axis=axis)


# --------------------------------------------------------------------- running folds

_AGG = {"sum": F.sum, "product": F.product, "max": F.max, "min": F.min}


def _last(x: Column) -> Column:
    return F.last(x, ignorenulls=True)


def _first(x: Column) -> Column:
    return F.first(x, ignorenulls=True)


def _merge(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.when(carried.isNull(), local).when(local.isNull(), carried).otherwise(carried + local)
    if kind == "product":
        return F.when(carried.isNull(), local).when(local.isNull(), carried).otherwise(carried * local)
    if kind == "max":
        return F.greatest(carried, local)
    if kind == "min":
        return F.least(carried, local)
    if kind == "last":
        return F.coalesce(local, carried)
    return F.coalesce(carried, local)


def _fold(s: Series, specs: Mapping[str, tuple[str, Column]]) -> Series:
    """Running aggregates from the first row of the symbol; NULL inputs are skipped.

    Kinds: ``sum``, ``product``, ``max``, ``min``, ``last``, ``first``.
    """
    aggs = {**_AGG, "last": _last, "first": _first}
    if not s.axis.sliced:
        return s.add({name: aggs[kind](x).over(s.axis.running) for name, (kind, x) in specs.items()})
    own = ~F.col("_halo")
    value = {name: f"_v_{name}" for name in specs}
    # the last value is also right for most copied rows, which later steps look back on
    with_x = s.add({value[n]: x if kind == "last" else F.when(own, x) for n, (kind, x) in specs.items()})
    order = s.axis.order[0]
    ends = {"last": F.max_by, "first": F.min_by}
    totals = with_x.df.groupBy(*s.axis.keys).agg(
        *[
            (
                ends[kind](F.col(value[n]), F.when(own & F.col(value[n]).isNotNull(), F.col(order)))
                if kind in ends
                else aggs[kind](F.col(value[n]))
            ).alias(f"_t_{n}")
            for n, (kind, _) in specs.items()
        ]
    )
    before = (
        Window.partitionBy(s.axis.keys[0]).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.select(
        *s.axis.keys,
        *[aggs[kind](F.col(f"_t_{n}")).over(before).alias(f"_p_{n}") for n, (kind, _) in specs.items()],
    )
    joined = with_x.df.join(carried, list(s.axis.keys), "left")
    local = {n: aggs[kind](F.col(value[n])).over(s.axis.running) for n, (kind, _) in specs.items()}
    out = joined.withColumns({n: _merge(kind, F.col(f"_p_{n}"), local[n]) for n, (kind, _) in specs.items()})
    return replace(s, df=out.drop(*value.values(), *[f"_p_{n}" for n in specs]))


# ----------------------------------------------------- exponentially weighted averages


@dataclass(frozen=True)
class Ewm:
    """One exponential average ``y = (1-alpha) * y_prev + alpha * x``.

    seed ``first`` starts from the first value, ``mean`` from the average of the first
    ``need`` values. Rows before the ``need``-th value give ``before``. ``adjust`` divides
    by the sum of the weights instead of seeding.
    """

    source: str
    alpha: float
    need: int = 1
    seed: str = "first"
    adjust: bool = False
    before: float | None = None


def span(source: str, n: int, **kw) -> Ewm:
    return Ewm(source, 2.0 / (n + 1), need=n, **kw)


def wilder(source: str, n: int, **kw) -> Ewm:
    return Ewm(source, 1.0 / n, need=n, **kw)


FORGET = 39.2  # exp(-39.2) is below the resolution of a double


def ewm_reach(alpha: float) -> int:
    """Rows after which a starting value no longer changes the result."""
    return 1 if alpha >= 1 else math.ceil(FORGET / -math.log(1 - alpha))


@dataclass(frozen=True)
class Roll:
    """Sum of the last ``n`` values of a NULL-free column, at a cost that does not grow with ``n``.

    ``ramp`` weights the values 1..n, the newest most. Rows without ``n`` values give NULL.
    """

    source: str
    n: int
    ramp: bool = False


def _scan(s: Series, specs: Mapping[str, Ewm | Roll]) -> Series:
    """All averages and long sums of one level in three window passes, without Python in the rows.

    Rows are numbered and cut into blocks of ``B`` rows. Inside a block an exponential
    average is ``r^k * sum(w * x * r^-k)``, a plain running sum; the ends of the few blocks
    before it that still matter are carried over with powers of ``r``. ``B`` keeps ``r^-B``
    finite for the fastest average of the level, so all of them share the same windows. Long
    sums are differences of the in-block running sums.
    """
    axis = s.axis
    direct = {n: e.source for n, e in specs.items() if isinstance(e, Ewm) and e.alpha >= 1}
    if direct:
        s = s.add({n: c(x) for n, x in direct.items()})
    averages = {n: e for n, e in specs.items() if isinstance(e, Ewm) and n not in direct}
    rolls = {n: e for n, e in specs.items() if isinstance(e, Roll)}
    if not averages and not rolls:
        return s
    decay = {n: 1.0 - e.alpha for n, e in averages.items()}
    block = min([2048, *(int(600 / -math.log(r)) for r in decay.values())])
    block = max([block, *(e.n for e in rolls.values())]) if not averages else block
    if any(e.n > block for e in rolls.values()):
        raise ValueError(f"a rolling sum may span at most {block} rows here")
    hops = {n: math.ceil(FORGET / (-math.log(r) * block)) for n, r in decay.items()}
    far = max([1, *hops.values()])

    sources = sorted({e.source for e in averages.values()})
    counted = [x for x in sources if x not in BARS]
    cols: dict[str, Column] = {"_rn": F.row_number().over(axis.spec) - 1}
    cols |= {f"_n_{x}": F.count(F.col(x)).over(axis.running) for x in counted}
    seeds = sorted({(e.source, e.need) for e in averages.values() if e.seed == "mean"})
    cols |= {f"_seed_{x}_{n}": F.avg(F.col(x)).over(axis.rows(n)) for x, n in seeds}
    s = s.add(cols)
    s = s.add({"_blk": F.floor(F.col("_rn") / block), "_k": (F.col("_rn") % block).cast("double")})

    def seen(x: str) -> Column:
        return F.col(f"_n_{x}") if x in counted else F.col("_rn") + 1

    def weighted(n: str, e: Ewm) -> Column:
        count, x = seen(e.source), F.col(e.source)
        if e.adjust:
            wx = x
        elif e.seed == "mean":
            start = F.col(f"_seed_{e.source}_{e.need}")
            wx = F.when(count == e.need, start).when(count > e.need, x * F.lit(e.alpha))
        else:
            wx = F.when(count == 1, x).otherwise(x * F.lit(e.alpha))
        return F.coalesce(wx, F.lit(0.0)) * F.pow(F.lit(decay[n]), -F.col("_k"))

    inner = (
        Window.partitionBy(*axis.keys, "_blk")
        .orderBy(*axis.order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    plain = sorted({e.source for e in rolls.values()})
    ramps = sorted({e.source for e in rolls.values() if e.ramp})
    s = s.add(
        {f"_p_{n}": F.sum(weighted(n, e)).over(inner) for n, e in averages.items()}
        | {f"_s_{x}": F.sum(F.col(x)).over(inner) for x in plain}
        | {f"_m_{x}": F.sum(F.col(x) * F.col("_k")).over(inner) for x in ramps}
    )
    s = s.add({f"_p_{n}": F.pow(F.lit(decay[n]), F.col("_k")) * F.col(f"_p_{n}") for n in averages})
    sums = [f"_s_{x}" for x in plain] + [f"_m_{x}" for x in ramps]
    slot = {name: f"e{i}" for i, name in enumerate([f"_p_{n}" for n in averages] + sums)}
    ends = F.struct(*[F.col(name).alias(e) for name, e in slot.items()])
    by_block = Window.partitionBy(*axis.keys).orderBy("_blk")
    s = s.add({f"_end{h}": F.max_by(ends, F.col("_k")).over(by_block.rangeBetween(-h, -h)) for h in range(1, far + 1)})

    out: dict[str, Column] = {}
    for n, e in averages.items():
        r = decay[n]
        carry = F.lit(0.0)
        for h in range(1, hops[n] + 1):
            carry = carry + F.coalesce(F.col(f"_end{h}")[slot[f"_p_{n}"]], F.lit(0.0)) * F.lit(r ** ((h - 1) * block))
        y = F.col(f"_p_{n}") + F.pow(F.lit(r), F.col("_k") + 1) * carry
        count = seen(e.source)
        if e.adjust:
            y = y * F.lit(e.alpha) / (F.lit(1.0) - F.pow(F.lit(r), count.cast("double")))
        need = e.need if axis.full or e.seed == "mean" else 1
        out[n] = F.when(count >= need, y).otherwise(F.lit(e.before))
    for n, e in rolls.items():
        # what the block held n rows ago; from an older block, count up to that block's end
        crossed = F.col("_k") < e.n

        def since(name: str) -> Column:
            old = F.coalesce(axis.lag(name, e.n), F.lit(0.0))
            whole = F.coalesce(F.col("_end1")[slot[name]], F.lit(0.0))
            return F.when(crossed, F.lit(0.0) + whole - old).otherwise(-old)

        x = e.source
        total = F.col(f"_s_{x}") + since(f"_s_{x}")
        if e.ramp:
            # positions in the older block count from its end, i.e. they are block rows lower
            moment = F.col(f"_m_{x}") + since(f"_m_{x}")
            moment = moment - F.when(crossed, F.lit(float(block)) * since(f"_s_{x}")).otherwise(0.0)
            total = moment - (F.col("_k") - e.n) * total
        out[n] = F.when(F.col("_rn") + 1 >= e.n, total)
    s = s.add(out)
    return s.drop(
        "_rn", "_blk", "_k", *sums,
        *[f"_n_{x}" for x in counted],
        *[f"_seed_{x}_{n}" for x, n in seeds],
        *[f"_p_{n}" for n in averages],
        *[f"_end{h}" for h in range(1, far + 1)],
    )
