"""The four models of every symbol (or fold) at once: one grouped job trains them all, one scores them.

A group is all rows of a symbol, whose number the calendar bounds, or one train and test interval of a
fold. Inside a group the vectorised kernel of :mod:`tickloom.operators.trees` does the work. Models are
rows of a table (``symbol, model`` and arrays of nodes or weights), written once and read by scoring,
importance and reports. Groups beyond :data:`MOST_ROWS` go to the distributed fits of
:mod:`tickloom.operators.boosting` and :mod:`tickloom.operators.linear`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.series import largest_group
from .matrix import matrix_of
from .trees import Boost, Shape, Trees, binned, boosted, cuts_of, forest, joined, ridge_logistic, sigmoid

MOST_ROWS = 50_000


@dataclass(frozen=True)
class Forest:
    """Trees over drawn rows; a node looks at the square root of the number of columns."""

    trees: int = 100
    shape: Shape = Shape(depth=10, leaf=2.0, split=5.0, ridge=0.0)


@dataclass(frozen=True)
class Logistic:
    ridge: float = 1.0


@dataclass(frozen=True)
class Sequence60:
    """Random convolutions over the ``length`` rows before a row, then a ridge logistic model of what they give.

    Every kernel sums ``taps`` rows that lie a drawn distance apart, of a few drawn columns with drawn
    weights. Of its responses within the window it gives the largest and the share above its bias. The
    kernels are fixed by the seed; only the linear model is fitted.
    """

    length: int = 60
    kernels: int = 256
    taps: int = 9
    columns: int = 8
    ridge: float = 10.0
    seed: int = 42


Spec = Forest | Boost | Logistic | Sequence60

#: boosted trees with rows and columns drawn per round, and with patience
BOOST_A = Boost(rounds=100, rate=0.01, rows=0.8, columns=0.8, shape=Shape(depth=6, ridge=1.0))
BOOST_B = Boost(rounds=1000, rate=0.01, patience=50, shape=Shape(depth=6, ridge=3.0))
MEMBERS: Mapping[str, Spec] = {"forest": Forest(), "boost_a": BOOST_A, "boost_b": BOOST_B, "sequence": Sequence60()}
VOTERS: Mapping[str, Spec] = {"forest": Forest(), "logistic": Logistic()}

_DOUBLES, _INTS = T.ArrayType(T.DoubleType()), T.ArrayType(T.IntegerType())
MODEL = T.StructType(
    [T.StructField("model", T.StringType()), T.StructField("roots", T.IntegerType()), T.StructField("start", T.DoubleType())]
    + [T.StructField(n, _INTS if n in ("column", "left") else _DOUBLES) for n in ("column", "cut", "left", "value", "gain", "w", "mean", "dev")]
    + [T.StructField("losses", T.ArrayType(T.StructType([T.StructField("train", T.DoubleType()), T.StructField("held", T.DoubleType())])))]
    + [T.StructField("n_train", T.LongType())]
)


@dataclass
class Fitted:
    """One model of one group, as its table row holds it. Cuts are values, not bins."""

    model: str
    roots: int = 0
    start: float = 0.0
    column: Sequence = ()
    cut: Sequence = ()
    left: Sequence = ()
    value: Sequence = ()
    gain: Sequence = ()
    w: Sequence = ()
    mean: Sequence = ()
    dev: Sequence = ()
    losses: Sequence = field(default_factory=list)
    n_train: int = 0

    def trees(self) -> Trees:
        a = np.asarray
        return Trees(a(self.column, np.int64), a(self.cut, float), a(self.left, np.int64), a(self.value, float), a(self.gain, float), self.roots)


def _of_trees(name: str, trees: Trees, cuts: list[np.ndarray], **more) -> Fitted:
    value = np.array([cuts[c][k] if at >= 0 else 0.0 for c, k, at in zip(trees.column, trees.cut, trees.left)])
    return Fitted(name, trees.roots, column=trees.column, cut=value, left=trees.left, value=trees.value, gain=trees.gain, **more)


def standard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, dev = x.mean(axis=0), x.std(axis=0)
    return mean, np.where(dev > 1e-12 * np.maximum(np.abs(mean), 1.0), dev, np.inf)


def convolved(x: np.ndarray, spec: Sequence60) -> np.ndarray:
    """Per row what the kernels give on the ``length`` rows before it (``x``: standardised, oldest first).
    Rows without that many before them get NaN."""
    rng = np.random.default_rng(spec.seed)
    n, width = x.shape
    out = np.full((n, 2 * spec.kernels), np.nan)
    for k in range(spec.kernels):
        apart = int(rng.choice([d for d in (1, 2, 3, 5, 7) if d * (spec.taps - 1) < spec.length] or [0]))
        some = rng.integers(0, max(width, 1), spec.columns)
        weights = rng.normal(size=(spec.taps, spec.columns)) / np.sqrt(spec.taps * spec.columns)
        bias = float(rng.normal() * 0.5)
        reach = apart * (spec.taps - 1)
        if n <= spec.length or not width:
            continue
        taken = x[:, some]
        answer = sum(taken[t * apart : n - reach + t * apart] @ weights[t] for t in range(spec.taps))  # answer[i]: rows i .. i + reach
        inside = spec.length - reach  # answers whose rows lie within a window
        windows = np.lib.stride_tricks.sliding_window_view(answer, inside)[: n - spec.length]
        out[spec.length :, 2 * k] = windows.max(axis=1)
        out[spec.length :, 2 * k + 1] = (windows > bias).mean(axis=1)
    return out


def fit_one(name: str, spec: Spec, x: np.ndarray, y: np.ndarray, row: np.ndarray, held: np.ndarray) -> Fitted:
    """A model of rows in time order; ``row`` is what draws are hashed from, ``held`` marks the rows that
    do not train. A group without training rows, or with one class only, gives a constant."""
    train = ~held
    n = int(train.sum())
    base = float(y[train].mean()) if n else 0.5
    if n == 0 or base in (0.0, 1.0):
        return Fitted(name, start=np.nan, w=[base], n_train=n)
    if isinstance(spec, Forest):
        cuts = cuts_of(x[train], spec.shape.bins)
        shape = Shape(**{**spec.shape.__dict__, "per_node": spec.shape.per_node or max(1, int(np.sqrt(x.shape[1])))})
        return _of_trees(name, forest(binned(x[train], cuts), y[train], row[train], spec.trees, shape), cuts, n_train=n)
    if isinstance(spec, Boost):
        cuts = cuts_of(x[train], spec.shape.bins)
        made, start, losses = boosted(binned(x, cuts), y, row, held, spec)
        return _of_trees(name, joined(made), cuts, start=start, losses=losses, n_train=n)
    if isinstance(spec, Logistic):
        mean, dev = standard(x[train])
        return Fitted(name, w=ridge_logistic((x[train] - mean) / dev, y[train], spec.ridge), mean=mean, dev=dev, n_train=n)
    mean, dev = standard(x[train])
    given = convolved(np.clip((x - mean) / dev, -5, 5), spec)
    use = train & ~np.isnan(given[:, 0]) if given.shape[1] else np.zeros(len(x), bool)
    if not use.any() or y[use].min() == y[use].max():
        return Fitted(name, start=np.nan, w=[base], n_train=int(use.sum()))
    mid, wide = standard(given[use])
    w = ridge_logistic((given[use] - mid) / wide, y[use], spec.ridge)
    return Fitted(name, w=w, mean=np.r_[mean, mid], dev=np.r_[dev, wide], n_train=int(use.sum()))


def score_one(m: Fitted, spec: Spec, x: np.ndarray) -> np.ndarray:
    """The probability of a rise for rows in time order; NaN where the sequence model has too few before."""
    if np.isnan(m.start):
        out = np.full(len(x), float(m.w[0]))
        if isinstance(spec, Sequence60):
            out[: spec.length] = np.nan
        return out
    if isinstance(spec, Forest):
        return m.trees().total(x) / max(m.roots, 1)
    if isinstance(spec, Boost):
        return sigmoid(m.start + m.trees().total(x))
    w, mean, dev = np.asarray(m.w), np.asarray(m.mean), np.asarray(m.dev)
    if isinstance(spec, Logistic):
        return sigmoid((x - mean) / dev @ w[:-1] + w[-1])
    k = x.shape[1]
    given = convolved(np.clip((x - mean[:k]) / dev[:k], -5, 5), spec)
    return sigmoid((given - mean[k:]) / dev[k:] @ w[:-1] + w[-1])


# ---------------------------------------------------------------------------- as Spark jobs


def _ordered(table: pa.Table, order: str = "ts") -> pa.Table:
    return table.sort_by(order)


def _row_ids(table: pa.Table, order: str = "ts") -> np.ndarray:
    return table.column(order).cast(pa.timestamp("us")).cast(pa.int64()).to_numpy()


def _as_table(fitted: Sequence[Fitted], keys: Mapping[str, object], key_fields: Sequence[T.StructField]) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T.StructType([*key_fields, *MODEL.fields]))
    columns = {k: [v] * len(fitted) for k, v in keys.items()}
    for f in MODEL.fields:
        if f.name == "losses":
            columns[f.name] = [[{"train": a, "held": b} for a, b in m.losses] for m in fitted]
        else:
            columns[f.name] = [np.asarray(v).tolist() if f.dataType.typeName() == "array" else v for v in (getattr(m, f.name) for m in fitted)]
    return pa.table({n: pa.array(columns[n], schema.field(n).type) for n in schema.names}, schema=schema)


def dealt(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups dealt to several times as many tasks as there are cores: fits are long and groups few, and
    adaptive coalescing, which looks at bytes only, would put many into one task."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    return rows.repartition(n, *keys)


def _fit_group(specs: Mapping[str, Spec], keys: Sequence[str], key_fields: Sequence[T.StructField]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = _ordered(table)
        x, y = matrix_of(table.column("x")), table.column("target").to_numpy().astype(float)
        row, held = _row_ids(table), table.column("_held").to_numpy(zero_copy_only=False)
        fitted = [fit_one(name, spec, x, y, row, held) for name, spec in specs.items()]
        return _as_table(fitted, {k: table.column(k)[0].as_py() for k in keys}, key_fields)

    return run


def fit_groups(rows: DataFrame, specs: Mapping[str, Spec] = MEMBERS, keys: Sequence[str] = ("symbol",), held: Column | None = None, group_rows: int | None = None) -> DataFrame:
    """The models of every group, as a table. ``rows`` carry ``ts, target, x``; rows that ``held`` marks do
    not train (the boosted model with patience watches its loss on them)."""
    largest = largest_group(rows, keys[0]) if group_rows is None else group_rows
    if largest > MOST_ROWS:
        raise ValueError(f"a group of {largest} rows is fitted by boosting.fit_boosted and linear.fit_logistic, not in one task")
    fields = [rows.schema[k] for k in keys]
    used = rows.select(*keys, "ts", "target", "x", (F.lit(False) if held is None else F.coalesce(held, F.lit(False))).alias("_held"))
    return dealt(used, keys).groupBy(*keys).applyInArrow(_fit_group(specs, keys, fields), T.StructType([*fields, *MODEL.fields]))


def models_of(table: pa.Table) -> dict[str, Fitted]:
    names = [f.name for f in MODEL.fields]
    return {r["model"]: Fitted(**{n: r[n] for n in names}) for r in table.select(names).to_pylist()}


def _score_group(specs: Mapping[str, Spec], out: T.StructType, keep: Sequence[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, models: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        table = _ordered(table)
        x, known = matrix_of(table.column("x")), models_of(models)
        columns = {n: table.column(n).cast(schema.field(n).type) for n in keep}
        for name, spec in specs.items():
            p = score_one(known[name], spec, x) if name in known and len(x) else np.full(len(x), np.nan)
            columns[name] = pa.array(p, pa.float64(), from_pandas=True)
        return pa.table(columns, schema=schema)

    return run


def score_groups(rows: DataFrame, models: DataFrame, specs: Mapping[str, Spec] = MEMBERS, keys: Sequence[str] = ("symbol",), keep: Sequence[str] = ("ts",)) -> DataFrame:
    """The rows with a probability per model: NULL without a model, or (sequence) without enough rows
    before. ``keep`` names the other columns that stay."""
    kept = list(dict.fromkeys([*keys, "ts", *keep]))
    fields = [rows.schema[k] for k in kept] + [T.StructField(n, T.DoubleType()) for n in specs]
    left = rows.select(*kept, "x").groupBy(*keys)
    return left.cogroup(models.groupBy(*keys)).applyInArrow(_score_group(specs, T.StructType(fields), kept), T.StructType(fields))


def member_weights(scored: DataFrame, specs: Sequence[str], keys: Sequence[str] = ("symbol",), missing: float = 0.5) -> DataFrame:
    """Per group and model the accuracy on the scored rows, and its share of the accuracies' sum."""
    from pyspark.sql.window import Window

    long = scored.unpivot([*keys, "target"], list(specs), "model", "p")
    right = F.when(F.col("p").isNotNull(), ((F.col("p") > 0.5) == (F.col("target") == 1)).cast("double"))
    rated = long.groupBy(*keys, "model").agg(F.coalesce(F.avg(right), F.lit(missing)).alias("accuracy"))
    return rated.withColumn("weight", F.col("accuracy") / F.sum("accuracy").over(Window.partitionBy(*keys)))


def combined(scored: DataFrame, weights: DataFrame, specs: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``prediction``: the weighted sum of the models' probabilities (a missing one adds nothing)."""
    wide = weights.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("model", "weight"))).alias("_w"))
    total = F.lit(0.0)
    for n in specs:
        total = total + F.coalesce(F.col(n), F.lit(0.0)) * F.try_element_at("_w", F.lit(n))
    return scored.join(wide, list(keys)).withColumn("prediction", total).drop("_w")


def column_importance(models: DataFrame, names: Sequence[str], keys: Sequence[str] = ("symbol",), top: int | None = 20) -> DataFrame:
    """Per group the columns by their mean share in the gains of the tree models, largest first."""
    from pyspark.sql.window import Window

    cuts = models.where(F.size("left") > 0).select(*keys, "model", F.explode(F.arrays_zip("column", "left", "gain")).alias("n")).where("n.left >= 0")
    share = cuts.groupBy(*keys, "model", F.col("n.column").alias("_c")).agg(F.sum("n.gain").alias("gain"))
    whole = Window.partitionBy(*keys, "model")
    share = share.withColumn("share", F.col("gain") / F.sum("gain").over(whole))
    counted = models.where(F.size("left") > 0).groupBy(*keys).agg(F.count_distinct("model").alias("_m"))
    mean = share.groupBy(*keys, "_c").agg(F.sum("share").alias("_s")).join(counted, list(keys))
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_c") + 1)
    out = mean.select(*keys, named.alias("feature"), (F.col("_s") / F.col("_m")).alias("importance"))
    if top is None:
        return out
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("importance").desc(), "feature"))
    return out.withColumn("_r", place).where(F.col("_r") <= top).drop("_r")
