"""Signals, strategy returns and risk metrics, per symbol or per (symbol, fold)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.asof import asof_join, era_for
from ..functions.scalars import flag, grid, ratio, truth
from ..functions.series import Axis, Series, as_series
from ..session import cut

YEAR = math.sqrt(252)


@dataclass(frozen=True)
class Costs:
    initial_capital: float = 100_000.0
    commission: float = 0.001
    slippage: float = 0.0005


def ffill_then_zero(s: Series, columns: Sequence[str]) -> Series:
    """Carry the last value forward; what is still missing becomes 0."""
    s = s.fold({f"_f_{n}": ("last", F.col(n)) for n in columns})
    return s.add({n: F.coalesce(F.col(f"_f_{n}"), F.lit(0).cast("double")) for n in columns}).drop(
        *[f"_f_{n}" for n in columns]
    )


FRAME = ("prediction", "returns", "log_returns", "volatility", "sma_20", "sma_50")


def prepare(s: Series, missing_prediction: str = "zero") -> Series:
    """Returns, volatility and averages next to ``prediction``, gaps filled.

    A bar in front of the first prediction gets prediction 0, which a long-short strategy
    reads as a short signal; ``missing_prediction="flat"`` keeps it out of the market.
    """
    a = s.axis
    s = s.add({"_known": F.col("prediction").isNotNull(), "returns": a.change("close"), "log_returns": F.ln(ratio("close", a.lag("close")))})
    s = s.add({"volatility": a.std("returns", 20) * F.lit(YEAR), "sma_20": a.mean("close", 20), "sma_50": a.mean("close", 50)})
    s = ffill_then_zero(s, FRAME)
    if missing_prediction == "flat":
        s = s.add({"_flat": ~F.col("_known")})
    return s


def position_of(strategy: str, threshold: float) -> Column:
    p = F.col("prediction")
    up, down = p > threshold, p < F.lit(1 - threshold)
    if strategy == "long_only":
        return F.when(up, 1).otherwise(0)
    if strategy == "short_only":
        return F.when(down, -1).otherwise(0)
    if strategy == "long_short":
        return F.when(up, 1).when(down, -1).otherwise(0)
    raise ValueError(f"Unknown strategy type: {strategy}")


def add_signals(s: Series, strategy: str = "long_short", threshold: float = 0.6, costs: Costs = Costs()) -> Series:
    position = position_of(strategy, threshold)
    if "_flat" in s.df.columns:
        position = F.when(F.col("_flat"), 0).otherwise(position)
    s = s.add({"position": position})
    s = s.add({"position_change": s.axis.diff("position")})
    return s.add({"trade_cost": F.abs("position_change") * F.lit(costs.commission)})


def add_returns(s: Series, costs: Costs = Costs()) -> Series:
    held = s.axis.lag("position") * F.col("returns")
    slip = F.abs("position_change") * F.lit(costs.slippage)
    return s.add({"strategy_returns": held - F.col("trade_cost") - slip, "benchmark_returns": F.col("returns")})


def add_equity(s: Series, costs: Costs = Costs()) -> Series:
    s = s.fold(
        {
            "_grow": ("product", F.lit(1.0) + F.col("strategy_returns")),
            "_hold": ("product", F.lit(1.0) + F.col("benchmark_returns")),
        }
    )
    return s.add(
        {
            "cumulative_returns": F.col("_grow") * F.lit(costs.initial_capital),
            "benchmark_cumulative": F.col("_hold") * F.lit(costs.initial_capital),
            "excess_returns": F.col("strategy_returns") - F.col("benchmark_returns"),
        }
    )


def add_drawdown(s: Series) -> Series:
    s = s.fold({"_peak": ("max", F.col("cumulative_returns"))})
    return s.add({"drawdown": ratio(F.col("cumulative_returns") - F.col("_peak"), "_peak")})


def backtest(
    s: Series,
    strategy: str = "long_short",
    threshold: float = 0.6,
    costs: Costs = Costs(),
    missing_prediction: str = "zero",
) -> Series:
    """Bars with ``prediction`` to the full per-bar result."""
    s = add_signals(prepare(s, missing_prediction), strategy, threshold, costs)
    return add_drawdown(add_equity(add_returns(s, costs), costs))


def run_backtest(
    bars: DataFrame, predictions: DataFrame, strategy: str = "long_short", threshold: float = 0.6,
    costs: Costs = Costs(), missing_prediction: str = "zero", era_seconds: int | None = None, **layout,
) -> Series:
    era_seconds = era_seconds or era_for(layout.get("group_rows"))
    joined = asof_join(bars, predictions.select("symbol", "ts", "prediction"), era_seconds=era_seconds)
    return backtest(as_series(joined, lookback=51, **layout), strategy, threshold, costs, missing_prediction)


METRICS = (
    "total_return", "benchmark_return", "excess_return", "strategy_volatility", "benchmark_volatility",
    "sharpe_ratio", "sortino_ratio", "max_drawdown", "calmar_ratio", "win_rate", "avg_win", "avg_loss",
    "profit_factor", "information_ratio", "directional_accuracy", "precision", "recall", "f1_score",
    "total_trades", "profitable_trades", "losing_trades", "var_95", "cvar_95",
)


def zero_if_null(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def metrics(s: Series, costs: Costs = Costs(), by: Sequence[str] | None = None, accuracy_lag: int = 0) -> DataFrame:
    """One row of risk and accuracy metrics per group.

    The return counts against the risk-free rate as a whole (not per year), ``total_trades``
    counts bars with a return, and the prediction is compared with the return of its own bar
    (``accuracy_lag=1``: with the one before).
    """
    by = list(by or s.axis.keys[: 1 if s.axis.sliced else None])
    order = s.axis.order[0]
    r, b = F.col("strategy_returns"), F.col("benchmark_returns")
    guess = s.axis.lag("prediction", accuracy_lag) if accuracy_lag else F.col("prediction")
    s = s.add({"_up": truth(F.col("returns") > 0), "_said": truth(guess > 0.5)})
    rows = _with_var(s, by)
    up, said = F.col("_up"), F.col("_said")
    total = rows.groupBy(*by).agg(
        F.max_by("cumulative_returns", order).alias("end"),
        F.max_by("benchmark_cumulative", order).alias("bench_end"),
        F.stddev_samp(r).alias("sd"),
        F.stddev_samp(b).alias("bench_sd"),
        F.stddev_samp(F.when(r < 0, r)).alias("down_sd"),
        F.min("drawdown").alias("max_drawdown"),
        F.count(r).alias("total_trades"),
        F.count(F.when(r > 0, 1)).alias("profitable_trades"),
        F.count(F.when(r < 0, 1)).alias("losing_trades"),
        F.avg(F.when(r > 0, r)).alias("mean_win"),
        F.avg(F.when(r < 0, r)).alias("mean_loss"),
        F.sum(F.when(r > 0, r)).alias("won"),
        F.sum(F.when(r < 0, r)).alias("lost"),
        F.avg("excess_returns").alias("mean_excess"),
        F.stddev_samp("excess_returns").alias("sd_excess"),
        F.avg((up == said).cast("double")).alias("directional_accuracy"),
        F.sum(flag(up & said)).alias("tp"),
        F.sum(flag(~up & said)).alias("fp"),
        F.sum(flag(up & ~said)).alias("fn"),
        F.max("_var").alias("var_95"),
        F.avg(F.when(r <= F.col("_var"), r)).alias("cvar_95"),
    )
    gain = F.col("end") / F.lit(costs.initial_capital) - 1
    bench = F.col("bench_end") / F.lit(costs.initial_capital) - 1
    vol, down = F.col("sd") * F.lit(YEAR), F.col("down_sd") * F.lit(YEAR)
    prec = zero_if_null(ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    rec = zero_if_null(ratio(F.col("tp"), F.col("tp") + F.col("fn")))

    def over(num: Column, den: Column) -> Column:
        return F.when(truth(den > 0), num / den).otherwise(0.0)

    return total.select(
        *by,
        gain.alias("total_return"),
        bench.alias("benchmark_return"),
        (gain - bench).alias("excess_return"),
        vol.alias("strategy_volatility"),
        (F.col("bench_sd") * F.lit(YEAR)).alias("benchmark_volatility"),
        over(gain - 0.02, vol).alias("sharpe_ratio"),
        over(gain - 0.02, down).alias("sortino_ratio"),
        "max_drawdown",
        zero_if_null(ratio(gain, F.abs("max_drawdown"))).alias("calmar_ratio"),
        zero_if_null(ratio(F.col("profitable_trades"), F.col("total_trades"))).alias("win_rate"),
        zero_if_null(F.col("mean_win")).alias("avg_win"),
        zero_if_null(F.col("mean_loss")).alias("avg_loss"),
        zero_if_null(F.when(F.col("lost").isNotNull(), F.abs(ratio(zero_if_null(F.col("won")), "lost")))).alias("profit_factor"),
        over(F.col("mean_excess") * 252, F.col("sd_excess") * F.lit(YEAR)).alias("information_ratio"),
        "directional_accuracy",
        prec.alias("precision"),
        rec.alias("recall"),
        zero_if_null(ratio(2 * prec * rec, prec + rec)).alias("f1_score"),
        "total_trades", "profitable_trades", "losing_trades", "var_95", "cvar_95",
    )


def _with_var(s: Series, by: list[str], q: float = 0.05) -> DataFrame:
    """Rows with ``_var``, the exact ``q`` percentile of the strategy returns of their group."""
    rows = s.tidy_keep("_up", "_said")
    if not s.axis.sliced:
        # the rows of a group already sit together, so this costs no further exchange
        whole = Axis(tuple(by), s.axis.order).whole
        return rows.withColumn("_var", F.percentile("strategy_returns", F.lit(q)).over(whole))
    rows = cut(rows)  # read several times below
    return rows.join(exact_percentile(rows, by, "strategy_returns", q).withColumnRenamed("value", "_var"), by, "left")


def exact_percentile(df: DataFrame, by: Sequence[str], x: str, q: float, limit: int = 100_000, pivots: int = 64) -> DataFrame:
    """Linear-interpolated percentile per group for groups too large for one task, for any values.

    The value at the lower of the two ranks is selected by narrowing: a mergeable sketch gives pivots
    among the values that are still in question, one aggregation counts the values at and between the
    pivots, and the rank either lies at a pivot, however often that value occurs, or between two of them.
    Every round leaves about one in ``pivots`` values; when at most ``limit`` are left, they are sorted.
    The upper value is the next larger one, from one more aggregation.
    """
    by = list(by)
    data = df.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"))
    rank = (F.col("_n") - 1) * F.lit(q)
    none = F.lit(None).cast("double")
    asked = data.groupBy(*by).agg(F.count("_x").alias("_n")).select(*by, F.floor(rank).alias("_low"), F.ceil(rank).alias("_high"), (rank - F.floor(rank)).alias("_part"), "_n")
    state = cut(asked.select(*by, "_low", none.alias("_lo"), none.alias("_hi"), F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_left")))
    found = []
    while True:
        small = state.where(F.col("_left") <= limit)
        place = F.row_number().over(Window.partitionBy(*by).orderBy("_x")) - 1 + F.col("_below")
        found.append(_between(data, small, by).withColumn("_at", place).where(F.col("_at") == F.col("_low")).select(*by, "_x"))
        open_ = state.where(F.col("_left") > limit)
        if open_.isEmpty():
            break
        rows = _between(data, open_, by)
        shares = F.array(*[F.lit(k / pivots) for k in range(1, pivots)])
        marks = rows.groupBy(*by).agg(F.array_sort(F.array_distinct(F.percentile_approx("_x", shares, F.lit(64 * pivots)))).alias("_p"))
        marks = cut(open_.join(marks, by))
        smaller = F.size(F.filter("_p", lambda p: p < F.col("_x")))
        at_mark = F.coalesce(F.get("_p", F.col("_slot")) == F.col("_x"), F.lit(False)).cast("int")
        slots = _between(data, marks, by).withColumn("_slot", smaller).withColumn("_on", at_mark)
        # between two pivots come the values below a pivot (0), then those equal to it (1)
        counts = slots.groupBy(*by, "_slot", "_on").agg(F.count(F.lit(1)).alias("_c"))
        before = Window.partitionBy(*by).orderBy("_slot", "_on").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.join(marks, by).withColumn("_upto", F.col("_below") + F.coalesce(F.sum("_c").over(before), F.lit(0)))
        hit = cut(placed.where((F.col("_upto") <= F.col("_low")) & (F.col("_low") < F.col("_upto") + F.col("_c"))))
        found.append(hit.where("_on = 1").select(*by, F.get("_p", F.col("_slot")).alias("_x")))
        lower, upper = F.coalesce(F.get("_p", F.col("_slot") - 1), F.col("_lo")), F.coalesce(F.get("_p", F.col("_slot")), F.col("_hi"))
        state = cut(hit.where("_on = 0").select(*by, "_low", lower.alias("_lo"), upper.alias("_hi"), F.col("_upto").alias("_below"), F.col("_c").alias("_left")))
    values = found[0]
    for f in found[1:]:
        values = values.unionByName(f)
    values = asked.join(cut(values.withColumnRenamed("_x", "_a")), by)
    above = data.join(values, by).groupBy(*by).agg(
        F.max("_a").alias("_a"), F.max("_part").alias("_part"), F.max("_high").alias("_high"),
        F.count(F.when(F.col("_x") <= F.col("_a"), 1)).alias("_upto"), F.min(F.when(F.col("_x") > F.col("_a"), F.col("_x"))).alias("_next"),
    )
    upper = F.when(F.col("_high") < F.col("_upto"), F.col("_a")).otherwise(F.col("_next"))
    return above.select(*by, (F.col("_a") + (upper - F.col("_a")) * F.col("_part")).alias("value"))


def _between(data: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """The values of the state's groups that lie strictly between its bounds."""
    inside = (F.col("_lo").isNull() | (F.col("_x") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_x") < F.col("_hi")))
    return data.join(state, by).where(inside)


def returns_histogram(result: DataFrame, bins: int = 50, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Density of strategy and benchmark returns in equal-width bins between their extremes."""
    by = list(by)
    long = result.select(*by, "strategy_returns", "benchmark_returns").unpivot(
        by, ["strategy_returns", "benchmark_returns"], "kind", "value"
    ).where(F.col("value").isNotNull())
    keys = [*by, "kind"]
    span = long.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_of = F.least(F.floor(ratio(F.col("value") - F.col("lo"), width)), F.lit(bins - 1)).cast("int")
    counted = long.join(span, keys).groupBy(*keys, F.coalesce(bin_of, F.lit(0)).alias("bin"), "lo", "hi", "n").count()
    return counted.select(
        *keys, "bin", (F.col("lo") + F.col("bin") * width).alias("left_edge"),
        F.col("count").alias("n_returns"), ratio("count", F.col("n") * width).alias("density"),
    )


def signal_points(result: DataFrame) -> DataFrame:
    """Bars that carry a buy or sell mark."""
    return result.where(F.col("position") != 0).select(
        "symbol", "ts", "close", F.when(F.col("position") == 1, "buy").otherwise("sell").alias("mark")
    )


REPORT = (
    ("PERFORMANCE METRICS", (("Total Return", "total_return", "%"), ("Benchmark Return", "benchmark_return", "%"), ("Excess Return", "excess_return", "%"))),
    ("RISK METRICS", (("Strategy Volatility", "strategy_volatility", "%"), ("Benchmark Volatility", "benchmark_volatility", "%"),
                      ("Sharpe Ratio", "sharpe_ratio", "f"), ("Sortino Ratio", "sortino_ratio", "f"),
                      ("Maximum Drawdown", "max_drawdown", "%"), ("Calmar Ratio", "calmar_ratio", "f"))),
    ("TRADING METRICS", (("Total Trades", "total_trades", "d"), ("Win Rate", "win_rate", "%"), ("Average Win", "avg_win", "%"),
                         ("Average Loss", "avg_loss", "%"), ("Profit Factor", "profit_factor", "f"))),
    ("ACCURACY METRICS", (("Directional Accuracy", "directional_accuracy", "%"), ("Precision", "precision", "%"),
                          ("Recall", "recall", "%"), ("F1 Score", "f1_score", "f"))),
    ("RISK MEASURES", (("VaR (95%%)", "var_95", "%"), ("CVaR (95%%)", "cvar_95", "%"), ("Information Ratio", "information_ratio", "f"))),
)


def report(metric_rows: DataFrame, strategy: str = "long_short", threshold: float = 0.6) -> DataFrame:
    """The metrics of each symbol as text."""
    lines = ["BACKTEST SUMMARY REPORT", f"Strategy: {strategy}", f"Confidence Threshold: {threshold}"]
    args: list[Column] = []
    for title, entries in REPORT:
        lines.append(title)
        for label, name, kind in entries:
            if kind == "d":
                lines.append(f"{label}: %d")
                args.append(F.col(name))
            else:
                lines.append(f"{label}: %.2f" + ("%%" if kind == "%" else ""))
                args.append(grid(F.col(name) * 100 if kind == "%" else F.col(name), 2))
    return metric_rows.select("symbol", F.format_string("\n".join(lines), *args).alias("report"))
