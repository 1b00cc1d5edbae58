"""Chronological splits and walk-forward folds by row arithmetic, without a range join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.series import Axis, Series
from ..session import written
from .backtest import Costs, backtest, metrics
from .ensemble import vote
from .matrix import matrix_of
from .symbol_models import VOTERS, Spec, dealt, fit_one, score_one


def numbered(s: Series) -> Series:
    """Rows with ``_rn`` (from 0) and ``_n``, the length of their symbol.

    In the sliced layout the numbers run on across slices, and the copied rows are dropped.
    """
    if not s.axis.sliced:
        return s.add({"_rn": F.row_number().over(s.axis.spec) - 1, "_n": F.count(F.lit(1)).over(s.axis.whole)})
    s = s.fold({"_seq": ("sum", F.lit(1))})
    own = s.df.where(~F.col("_halo")).withColumn("_rn", F.col("_seq") - 1).drop("_seq")
    key = s.axis.keys[0]
    return Series(own.join(own.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key), s.axis)


def fold_count(train: int, test: int, step: int):
    """Fold starts run from ``train`` to ``n - test``, the end excluded."""
    return F.greatest(F.ceil((F.col("_n") - test - train) / step), F.lit(0))


def folds(s: Series, train: int = 252, test: int = 63, step: int = 21) -> DataFrame:
    """One row per symbol and fold with the dates of its train and test rows."""
    rows = fold_rows(s, train, test, step)
    part = F.col("part")
    return rows.groupBy("symbol", "fold").agg(
        F.min(F.when(part == "train", F.col("ts"))).alias("train_start"),
        F.max(F.when(part == "train", F.col("ts"))).alias("train_end"),
        F.min(F.when(part == "test", F.col("ts"))).alias("test_start"),
        F.max(F.when(part == "test", F.col("ts"))).alias("test_end"),
        F.count(F.when(part == "train", 1)).alias("train_rows"),
        F.count(F.when(part == "test", 1)).alias("test_rows"),
    )


def fold_rows(s: Series, train: int = 252, test: int = 63, step: int = 21, parts: Sequence[str] = ("train", "test")) -> DataFrame:
    """Every row once per fold it belongs to.

    Row ``r`` is a train row of the folds with ``step*f <= r < step*f + train`` and a test row
    of those with ``step*f + train <= r < step*f + train + test``, so its folds are a short
    sequence and the rows only have to be exploded.
    """
    s = numbered(s)
    r, last = F.col("_rn"), fold_count(train, test, step) - 1

    def member(offset: int, size: int, part: str):
        low = F.greatest(F.ceil((r - offset - size + 1) / step), F.lit(0))
        high = F.least(F.floor((r - offset) / step), last)
        spans = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(spans, lambda f: F.struct(f.alias("fold"), F.lit(part).alias("part")))

    pieces = {"train": member(0, train, "train"), "test": member(train, test, "test")}
    exploded = s.df.withColumn("_m", F.explode(F.concat(*[pieces[p] for p in parts])))
    keep = [n for n in s.df.columns if not n.startswith("_") and n not in ("fold", "part")]
    return exploded.select(*keep, F.col("_m.fold").cast("int").alias("fold"), F.col("_m.part").alias("part"))


def chrono_split(s: Series, share: float = 0.8) -> Series:
    """``part`` is train for the first rows of each symbol and val for the rest."""
    s = numbered(s)
    return s.add({"part": F.when(F.col("_rn") < F.floor(F.col("_n") * F.lit(share)), "train").otherwise("val")})


def time_series_split(s: Series, n_splits: int = 5) -> DataFrame:
    """Expanding folds: test blocks of ``n // (n_splits + 1)`` rows at the end, train before them."""
    s = numbered(s)
    size = F.floor(F.col("_n") / (n_splits + 1))
    first = F.col("_n") - n_splits * size
    own = F.floor((F.col("_rn") - first) / size)  # test fold of the row, negative before the first
    own = F.when(size > 0, own).otherwise(F.lit(-1))
    test = F.when(own >= 0, F.array(own)).otherwise(F.array().cast("array<bigint>"))
    later = F.greatest(own + 1, F.lit(0))
    train = F.when((later <= n_splits - 1) & (size > 0), F.sequence(later, F.lit(n_splits - 1).cast("bigint"))).otherwise(
        F.array().cast("array<bigint>")
    )
    tag = lambda arr, part: F.transform(arr, lambda f: F.struct(f.alias("fold"), F.lit(part).alias("part")))
    rows = s.df.withColumn("_m", F.explode(F.concat(tag(train, "train"), tag(test, "test"))))
    keep = [n for n in s.df.columns if not n.startswith("_") and n not in ("fold", "part")]
    return rows.select(*keep, F.col("_m.fold").cast("int").alias("fold"), F.col("_m.part").alias("part"))


def fold_runs(s: Series, train: int = 252, test: int = 63, step: int = 21, per_run: int = 16) -> DataFrame:
    """Every row once per run of ``per_run`` successive folds that it belongs to, with its number ``_rn`` and
    the number of its symbol's folds ``_folds``.

    The folds of a run overlap, so a run has far fewer rows than its folds together, and at most
    ``per_run * step + train + test``.
    """
    s = numbered(s)
    r, folds = F.col("_rn"), fold_count(train, test, step)
    low = F.floor(F.greatest(F.ceil((r - train - test + 1) / step), F.lit(0)) / per_run)
    high = F.floor(F.least(F.floor(r / step), folds - 1) / per_run)
    spans = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    keep = [n for n in s.df.columns if not n.startswith("_")]
    return s.df.select(*keep, "_rn", folds.cast("int").alias("_folds"), F.explode(spans.cast("array<int>")).alias("_run"))


def _voted(specs: Mapping[str, Spec], keys: Sequence[str], out: T.StructType, train: int, test: int, step: int, per_run: int):
    """Fits and scores the folds of one run of a symbol."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_rn")
        x, y = matrix_of(table.column("x")), table.column("target").to_numpy().astype(float)
        rn, ids = table.column("_rn").to_numpy(), table.column("ts").cast(pa.timestamp("us")).cast(pa.int64()).to_numpy()
        first, folds = table.column("_run")[0].as_py() * per_run, table.column("_folds")[0].as_py()
        parts = []
        for fold in range(first, min(first + per_run, folds)):
            lo, mid, hi = np.searchsorted(rn, [fold * step, fold * step + train, fold * step + train + test])
            columns = {k: table.column(k).slice(mid, hi - mid) for k in (*keys, "ts", "close")}
            columns["fold"] = pa.array(np.full(hi - mid, fold, np.int32))
            for name, spec in specs.items():
                model = fit_one(name, spec, x[lo:mid], y[lo:mid], ids[lo:mid], np.zeros(mid - lo, bool))
                columns[name] = pa.array(score_one(model, spec, x[mid:hi]))
                right = ((score_one(model, spec, x[lo:mid]) > 0.5) == (y[lo:mid] == 1)).mean()
                columns[f"{name}_fit"] = pa.array(np.full(hi - mid, right))
            columns["base"] = pa.array(np.full(hi - mid, max(y[lo:mid].mean(), 1 - y[lo:mid].mean())))
            parts.append(pa.table([columns[n].cast(schema.field(n).type) for n in schema.names], schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    schema = to_arrow_schema(out)
    return run


def fold_votes(s: Series, specs: Mapping[str, Spec] = VOTERS, train: int = 252, test: int = 63, step: int = 21, per_run: int = 16) -> DataFrame:
    """The test rows of every fold (``symbol, fold, ts, close``) with the probability of each model that was
    fitted on the fold's train rows, and ``prediction``, their mean (soft vote).

    ``<model>_fit`` is the model's accuracy on its train rows, ``base`` that of always saying the commoner
    class. Series rows carry ``ts, close, target, x``. All folds of all symbols are one job, whose groups
    are runs of successive folds, so their size is fixed by the fold geometry.
    """
    rows = fold_runs(s, train, test, step, per_run)
    keys = ["symbol"]
    fields = [rows.schema["symbol"], T.StructField("fold", T.IntegerType()), rows.schema["ts"], rows.schema["close"]]
    fields += [T.StructField(n, T.DoubleType()) for m in specs for n in (m, f"{m}_fit")] + [T.StructField("base", T.DoubleType())]
    out = T.StructType(fields)
    used = rows.select(*keys, "_run", "_rn", "_folds", "ts", "close", "target", "x")
    votes = dealt(used, [*keys, "_run"]).groupBy(*keys, "_run").applyInArrow(_voted(specs, keys, out, train, test, step, per_run), out)
    return votes.withColumn("prediction", vote(list(specs)))


def walk_forward_metrics(test_rows: DataFrame, costs: Costs = Costs(), **kw) -> DataFrame:
    """Backtest of every fold on its test rows (``symbol, fold, ts, close, prediction``)."""
    s = backtest(Series(test_rows, Axis(keys=("symbol", "fold"))), costs=costs, **kw)
    return metrics(s, costs)


def walk_forward_run(s: Series, specs: Mapping[str, Spec] = VOTERS, train: int = 252, test: int = 63, step: int = 21) -> tuple[DataFrame, DataFrame]:
    """Fit, score and backtest each fold: the votes, written once, and the metrics of every fold from them.

    The models are a forest and a logistic model by default, as a soft vote.
    """
    votes = written(fold_votes(s, specs, train, test, step), "votes")
    return votes, walk_forward_metrics(votes.select("symbol", "fold", "ts", "close", "prediction"))


def walk_forward_summary(per_fold: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return per_fold.groupBy(*by).agg(
        F.avg("total_return").alias("avg_total_return"),
        F.avg("sharpe_ratio").alias("avg_sharpe_ratio"),
        F.avg("max_drawdown").alias("avg_max_drawdown"),
        F.avg("directional_accuracy").alias("avg_directional_accuracy"),
        F.avg((F.col("total_return") > 0).cast("double")).alias("consistency_score"),
        F.count(F.lit(1)).alias("total_periods"),
    )
