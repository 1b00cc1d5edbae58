"""Model queries. The reference workflow fits four models per symbol over all features; so do these.

What a fit gives has no SQL, so a query returns its keys and labels, which SQL derives from the tables,
with what must hold of the model: losses that the written predictions give again, the round at which
training had to stop, slopes that vanish, metrics that another formula gives from the written votes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import Series, as_series
from ..operators import ensemble as E
from ..operators import linear as LR
from ..operators import monitor as M
from ..operators import symbol_models as SM
from ..operators import walkforward as WF
from ..operators.catalogue import build_features, feature_names
from ..operators.matrix import feature_matrix
from ..operators.targets import add_target
from ..operators.training import train_and_backtest
from ..session import cut, written
from ..sources.bars import latest_rows
from ..sources.sinks import load_model, load_weights, save_model, save_weights
from ..streaming.live import workspace
from . import datasets as D
from .market_queries import CALM, FOLD_EQ, W, bound
from .news_queries import combined
from .oracles.base import DAY, bars_cte, rnd
from .registry import day, query, rounded

FEATURES = ("return_1d", "return_5d", "volume_ratio_5", "price_position", "spread_proxy", "roc_10")


def panel(spark: SparkSession, sf: str) -> Series:
    """A few features, target and chronological part of every bar, written once for the fits."""
    feats = build_features(D.bars(spark, sf), columns=list(FEATURES), **bound(spark, sf))
    s = WF.chrono_split(add_target(as_series(feats, ahead=1, **bound(spark, sf))))
    rows = s.tidy().select("symbol", "ts", "close", "target", "part", *FEATURES)
    # heavy tails of the fixture returns: squash to a fixed scale
    squash = {n: F.coalesce(F.col(n) / (F.lit(1.0) + F.abs(F.col(n))), F.lit(0.0)) for n in FEATURES}
    return as_series(cut(rows.withColumns(squash)), **bound(spark, sf))


_WRITTEN: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, key: tuple, make) -> DataFrame:
    """A table that several queries of a session read, written by the first of them."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _WRITTEN:
        _WRITTEN[key] = written(make(), str(key[2]))
    return _WRITTEN[key]


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    """All features, target and chronological part of every bar."""

    def make() -> DataFrame:
        rows, _ = feature_matrix(D.calm_bars(spark, sf), **bound(spark, sf))
        s = WF.chrono_split(add_target(as_series(rows, ahead=1, **bound(spark, sf))))
        return s.tidy().select("symbol", "ts", "close", "target", "part", "x")

    return once(spark, (sf, "matrix"), make)


def group_rows(spark: SparkSession, sf: str) -> int:
    return D.bars_per_symbol(spark, sf)


EVERY = {**SM.MEMBERS, **SM.VOTERS}


def models(spark: SparkSession, sf: str, name: str) -> DataFrame:
    held = F.col("part") == "val"
    make = lambda: SM.fit_groups(matrix(spark, sf), {name: EVERY[name]}, held=held, group_rows=group_rows(spark, sf))
    return once(spark, (sf, f"models-{name}"), make)


def scores(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """``symbol, ts, target, part`` and the probability that the symbol's model gives."""
    make = lambda: SM.score_groups(matrix(spark, sf), models(spark, sf, name), {name: EVERY[name]}, keep=("target", "part"))
    return once(spark, (sf, f"scores-{name}"), make)


def learned(scored: DataFrame, name: str) -> DataFrame:
    """Per symbol whether the model's squared error on its training rows is below that of their mean."""
    train = scored.where((F.col("part") == "train") & F.col(name).isNotNull())
    error, spread = F.avg((F.col(name) - F.col("target")) ** 2), F.var_pop(F.col("target").cast("double"))
    return train.groupBy("symbol").agg((error < spread).alias("learned"))


def validation(scored: DataFrame, checks: DataFrame, name: str) -> DataFrame:
    val = scored.where("part = 'val'").join(checks, "symbol")
    flags = [n for n in checks.columns if n != "symbol"]
    return val.select("symbol", day(), "target", F.col(name).between(0.0, 1.0).alias("in_range"), *flags)


NUMBERED_CALM = f"""WITH {CALM}, nb AS (SELECT *, row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n,
CAST(coalesce(lead(close) OVER ({W}) / close - 1 > 0, false) AS INTEGER) AS target FROM bars)"""


def validation_sql(*flags: str) -> str:
    return f"{NUMBERED_CALM} SELECT symbol, {DAY}, target, {', '.join(f'true AS {f}' for f in ('in_range', *flags))} FROM nb WHERE rn >= floor(n * 0.8)"


@query("ml_forest", validation_sql("learned"))
def ml_forest(spark: SparkSession, sf: str) -> DataFrame:
    """A forest of 100 trees per symbol over all features."""
    scored = scores(spark, sf, "forest")
    return validation(scored, learned(scored, "forest"), "forest")


def log_loss(p: Column, y: Column) -> Column:
    return F.avg(-F.ln(F.when(y == 1, p).otherwise(F.lit(1.0) - p)))


def boost_checks(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Per symbol: whether the losses that were written in training are those of the predictions that were
    written in scoring, whether the training loss fell, and whether training stopped where it had to."""
    spec = EVERY[name]
    p, y = F.col(name), F.col("target")
    part = lambda v: F.when(F.col("part") == v, p)
    again = scores(spark, sf, name).groupBy("symbol").agg(log_loss(part("train"), y).alias("train"), log_loss(part("val"), y).alias("held"))
    fitted = models(spark, sf, name).select("symbol", "roots", "losses")
    least = F.array_min(F.col("losses.held"))
    best = F.array_position(F.col("losses.held"), least)
    if spec.patience is None:
        stop = (F.col("roots") == spec.rounds) & (F.size("losses") == spec.rounds)
    else:
        stop = (F.col("roots") == best) & (F.size("losses") == F.least(best + spec.patience, F.lit(spec.rounds)))
    kept = F.element_at("losses", F.col("roots"))
    same = (F.abs(kept["train"] - F.col("train")) < 1e-5) & (F.abs(kept["held"] - F.col("held")) < 1e-5)
    fell = F.element_at("losses", -1)["train"] < F.element_at("losses", 1)["train"]
    return fitted.join(again, "symbol").select("symbol", same.alias("losses_match"), fell.alias("loss_fell"), stop.alias("stop_matches"))


BOOST_FLAGS = ("losses_match", "loss_fell", "stop_matches")


@query("ml_boost_a", validation_sql(*BOOST_FLAGS))
def ml_boost_a(spark: SparkSession, sf: str) -> DataFrame:
    """100 rounds of depth 6 at rate 0.01 per symbol, with rows and columns drawn for every round."""
    return validation(scores(spark, sf, "boost_a"), boost_checks(spark, sf, "boost_a"), "boost_a")


@query("ml_boost_b", validation_sql(*BOOST_FLAGS))
def ml_boost_b(spark: SparkSession, sf: str) -> DataFrame:
    """Up to 1000 rounds per symbol, ended 50 rounds after the least loss on the held-out rows."""
    return validation(scores(spark, sf, "boost_b"), boost_checks(spark, sf, "boost_b"), "boost_b")


@query("ml_voting", validation_sql("learned", "mean_of_both"))
def ml_voting(spark: SparkSession, sf: str) -> DataFrame:
    """Soft vote of a forest and a logistic model per symbol."""
    names = list(SM.VOTERS)
    both = scores(spark, sf, "forest").join(scores(spark, sf, "logistic").select("symbol", "ts", "logistic"), ["symbol", "ts"])
    voted = both.withColumn("voted", E.vote(names))
    halves = F.abs(F.col("voted") * 2 - F.col("forest") - F.col("logistic")) < 1e-12
    checks = learned(voted, "voted").join(voted.groupBy("symbol").agg(F.bool_and(halves).alias("mean_of_both")), "symbol")
    return validation(voted, checks, "voted")


@query(
    "ml_sequence",
    f"{NUMBERED_CALM} SELECT symbol, {DAY}, target, rn >= 60 AS scored, true AS in_range, true AS learned FROM nb",
)
def ml_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """Random convolutions over the 60 rows before each row, all features, and a linear model per symbol."""
    out = scores(spark, sf, "sequence")
    p = F.col("sequence")
    rows = out.join(learned(out, "sequence"), "symbol")
    return rows.select("symbol", day(), "target", p.isNotNull().alias("scored"), F.coalesce(p.between(0.0, 1.0), F.lit(True)).alias("in_range"), "learned")


def members(spark: SparkSession, sf: str) -> DataFrame:
    """All rows with the probabilities of the four models."""
    out = scores(spark, sf, "forest")
    for name in list(SM.MEMBERS)[1:]:
        out = out.join(scores(spark, sf, name).select("symbol", "ts", name), ["symbol", "ts"])
    return out


@query("ensemble_panel", validation_sql("weights_sum", "weighted"))
def ensemble_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The four models of every symbol, weighted by their accuracy on the validation rows."""
    names = list(SM.MEMBERS)
    val = members(spark, sf).where("part = 'val'")
    weights = SM.member_weights(val, names)
    out = SM.combined(val, weights, names)
    low, high = F.least(*[F.coalesce(F.col(n), F.lit(0.0)) for n in names]), F.greatest(*names)
    between = F.col("prediction").between(low - 1e-12, high + 1e-12)
    sums = weights.groupBy("symbol").agg((F.abs(F.sum("weight") - 1) < 1e-12).alias("weights_sum"))
    checks = sums.join(out.groupBy("symbol").agg(F.bool_and(between).alias("weighted")), "symbol")
    return validation(out, checks, "prediction")


TREES = ("forest", "boost_a", "boost_b")


@query("feature_importance", f"WITH {bars_cte()} SELECT symbol, unnest(range(1, 21)) AS place, true AS known, true AS shares FROM (SELECT DISTINCT symbol FROM bars)")
def feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 features of each symbol with the largest mean share in the gains of the three tree models."""
    from pyspark.sql.window import Window

    names = feature_names()
    fitted = models(spark, sf, TREES[0])
    for n in TREES[1:]:
        fitted = fitted.unionByName(models(spark, sf, n))
    every = SM.column_importance(fitted, names, top=None)
    whole = every.groupBy("symbol").agg((F.abs(F.sum("importance") - 1) < 1e-9).alias("shares"))
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("importance").desc(), "feature"))
    top = SM.column_importance(fitted, names).withColumn("place", place)
    return top.join(whole, "symbol").select("symbol", F.col("place").cast("long"), F.col("feature").isin(names).alias("known"), "shares")


BUCKETS, RIDGE = 32, 1.0


def with_symbol(rows: DataFrame) -> DataFrame:
    """The symbol as more columns of ``x``: a flag for each of 32 hash buckets."""
    own = F.pmod(F.xxhash64("symbol"), F.lit(BUCKETS))
    flags = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: (i == own).cast("double"))
    return rows.withColumn("x", F.concat("x", flags))


@query("train_panel", f"{NUMBERED_CALM} SELECT symbol, count(*) AS n_rows, CAST(sum(target) AS BIGINT) AS ups, true AS flat, true AS learned FROM nb WHERE rn >= floor(n * 0.8) GROUP BY symbol")
def train_panel(spark: SparkSession, sf: str) -> DataFrame:
    """One pooled logistic model of all symbols over all features; at its weights the loss has no slope."""
    rows = with_symbol(matrix(spark, sf))
    train = rows.where("part = 'train'")
    model = LR.fit_logistic(train, RIDGE)
    flat = LR.slope_of_loss(train, model, RIDGE).agg((F.max(F.abs("slope")) < 1e-4).alias("flat"))
    scored = written(rows.select("symbol", "part", "target", LR.probability(model).alias("p")), "pooled")
    error, spread = F.avg((F.col("p") - F.col("target")) ** 2), F.var_pop(F.col("target").cast("double"))
    better = scored.where("part = 'train'").agg((error < spread).alias("learned"))
    facts = {**flat.first().asDict(), **better.first().asDict()}
    counts = scored.where("part = 'val'").groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("target").cast("long")).alias("ups"))
    return counts.select("*", *[F.lit(v).alias(n) for n, v in facts.items()])


@query("train_per_symbol")
def train_per_symbol(spark: SparkSession, sf: str) -> DataFrame:
    """A logistic model per symbol, all fitted by the same aggregations."""
    rows = panel(spark, sf).df
    weights = E.fit_per_symbol(rows.where("part = 'train'"), FEATURES, rounds=6)
    scored = E.score_per_symbol(rows.where("part = 'val'"), weights, FEATURES)
    return M.classification_metrics(scored, ["prediction"], ["symbol"])


def newest(spark: SparkSession, sf: str, fitted: dict[str, DataFrame]) -> DataFrame:
    """The newest bar of every symbol with the mean of its models' probabilities."""
    last = written(latest_rows(matrix(spark, sf)), "newest")
    out = last.select("symbol", "ts")
    for name, table in fitted.items():
        out = out.join(SM.score_groups(last, table, {name: EVERY[name]}), ["symbol", "ts"])
    return out.withColumn("prediction", E.vote(list(fitted)))


def every_name(spark: SparkSession, sf: str) -> DataFrame:
    """The symbols that have models, and suppliers, which have none."""
    names = D.table(spark, sf, "supplier").select(F.col("s_name").alias("symbol"))
    return names.unionByName(matrix(spark, sf).select("symbol").distinct()).distinct()


def record_checks(records: DataFrame) -> DataFrame:
    p = F.col("prediction")
    signal = F.when(p > 0.6, "BUY").when(p < 0.4, "SELL").otherwise("HOLD")
    right = (signal == F.col("signal")) & (F.abs(F.abs(p - 0.5) * 2 - F.col("confidence")) < 1e-9) & p.between(0.0, 1.0)
    neutral = F.col("error").isNull() | (p == 0.5)
    return records.select("symbol", F.col("model_version"), F.col("features_used").cast("long"), "error", (right & neutral).alias("right"))


RECORDS_SQL = f"""WITH {bars_cte()} SELECT DISTINCT symbol, '1.0' AS model_version, CAST({len(feature_names())} AS BIGINT) AS features_used, CAST(NULL AS VARCHAR) AS error, true AS "right" FROM bars
UNION ALL SELECT DISTINCT s_name, 'default', 0, 'Model not available', true FROM supplier"""


@query("predict_panel", RECORDS_SQL)
def predict_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The newest bar of every symbol scored, neutral records for symbols without a model."""
    fitted = {n: models(spark, sf, n) for n in SM.VOTERS}
    return record_checks(M.score_default(every_name(spark, sf), newest(spark, sf, fitted), len(feature_names())))


@query("batch_score", RECORDS_SQL)
def batch_score(spark: SparkSession, sf: str) -> DataFrame:
    """Stored models of all symbols scored on the newest bars; the error record where there is none."""
    root = workspace(spark, "symbol-models")
    for n in SM.VOTERS:
        models(spark, sf, n).write.parquet(f"{root}/model={n}", mode="overwrite")
    stored = {n: spark.read.parquet(f"{root}/model={n}") for n in SM.VOTERS}
    return record_checks(M.score_default(every_name(spark, sf), newest(spark, sf, stored), len(feature_names())))


@query("weights_store", f"WITH {bars_cte()} SELECT symbol, true AS same FROM bars GROUP BY symbol HAVING floor(count(*) * 0.8) >= 50")
def weights_store(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of the aggregated per-symbol fit, stored and loaded."""
    root = workspace(spark, "weights")
    fitted = cut(E.fit_per_symbol(panel(spark, sf).df.where("part = 'train'"), FEATURES))
    save_weights(fitted, root, list(FEATURES))
    loaded, _ = load_weights(root, spark)
    return loaded.select("symbol", F.col("w").alias("v")).join(fitted, "symbol").select("symbol", (F.col("w") == F.col("v")).alias("same"))


BACKTESTED = {n: SM.MEMBERS[n] for n in ("forest", "boost_a", "sequence")}


@query(
    "ensemble_backtest",
    f"""{NUMBERED_CALM} SELECT symbol, count(*) - 1 AS total_trades, {rnd('arg_max(close, ts) / arg_min(close, ts) - 1', 6)} AS benchmark_return, true AS in_range
    FROM nb WHERE rn >= floor(n * 0.8) GROUP BY symbol""",
)
def ensemble_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """From bars to risk metrics: all features with sentiment, labels, chronological split, models per symbol, their own backtest."""
    out = train_and_backtest(D.calm_bars(spark, sf), workspace(spark, "trained"), BACKTESTED, sentiment=combined(spark, sf), **bound(spark, sf))
    fine = F.col("directional_accuracy").between(0.0, 1.0) & (F.col("max_drawdown") <= 0) & (F.col("var_95") <= F.col("avg_win"))
    return rounded(out.withColumn("in_range", fine), {"benchmark_return": 6}, ["symbol", "total_trades", "in_range"])


VAL_SQL = f"""WITH {bars_cte()} SELECT symbol, {DAY}, true AS same FROM bars
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 >= floor(count(*) OVER (PARTITION BY symbol) * 0.8)"""


@query("model_store", VAL_SQL)
def model_store(spark: SparkSession, sf: str) -> DataFrame:
    """Save, load, score: the loaded model must agree with the fitted one."""
    rows = E.model_input(panel(spark, sf).df, FEATURES)
    model = E.fit(rows.where("part = 'train'"), FEATURES, E.logistic())
    root = workspace(spark, "models")
    save_model(model, root, "pooled")
    val = rows.where("part = 'val'")
    both = E.up_probability(load_model(root, "pooled"), E.up_probability(model, val, "before"), "after")
    return both.select("symbol", day(), (F.abs(F.col("before") - F.col("after")) < 1e-12).alias("same"))


@query("fit_per_symbol", f"WITH {bars_cte()} SELECT symbol, true AS optimal FROM bars GROUP BY symbol HAVING floor(count(*) * 0.8) >= 50")
def fit_per_symbol(spark: SparkSession, sf: str) -> DataFrame:
    """At the fitted weights of every symbol the gradient of its ridge logistic loss vanishes."""
    rows = panel(spark, sf).df.where("part = 'train'")
    weights = E.fit_per_symbol(rows, FEATURES, rounds=12)
    scored = E.score_per_symbol(E.model_input(rows, FEATURES), weights, FEATURES).join(weights, "symbol")
    miss = F.col("target") - F.col("prediction")
    slopes = [F.sum(miss * x) - F.any_value(F.col("w")[i]) for i, x in enumerate([*[F.col(n) for n in FEATURES], F.lit(1.0)])]
    return scored.groupBy("symbol").agg((F.greatest(*[F.abs(x) for x in slopes]) < 1e-6).alias("optimal"))


VOTE_METRICS = """
WITH a AS (SELECT symbol, fold, ts, prediction, coalesce(close / lag(close) OVER w - 1, 0.0) AS r,
  CASE WHEN prediction > 0.6 THEN 1 WHEN prediction < 0.4 THEN -1 ELSE 0 END AS held FROM {votes} WINDOW w AS (PARTITION BY symbol, fold ORDER BY ts)),
b AS (SELECT *, lag(held) OVER w * r - abs(held - lag(held) OVER w) * 0.0015 AS gain FROM a WINDOW w AS (PARTITION BY symbol, fold ORDER BY ts)),
c AS (SELECT *, exp(sum(ln(1 + gain)) OVER w) AS worth FROM b WINDOW w AS (PARTITION BY symbol, fold ORDER BY ts ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, worth / max(worth) OVER w - 1 AS below FROM c WINDOW w AS (PARTITION BY symbol, fold ORDER BY ts ROWS UNBOUNDED PRECEDING))
SELECT symbol, fold, max_by(worth, ts) - 1 AS total_return, stddev_samp(gain) * sqrt(252) AS strategy_volatility, min(below) AS max_drawdown,
  avg(CAST((r > 0) = (prediction > 0.5) AS DOUBLE)) AS directional_accuracy, percentile(gain, 0.05) AS var_95, count_if(gain > 0) / count(gain) AS win_rate
FROM d GROUP BY symbol, fold"""

BENCH = {"benchmark_return": 5, "benchmark_volatility": 5}
BENCH_SQL = ", ".join(f"{rnd(n, d)} AS {n}" for n, d in BENCH.items())


@query("walk_forward_run", f"{FOLD_EQ} SELECT symbol, fold, total_trades, {BENCH_SQL}, true AS recomputed, true AS mean_of_both, true AS learned FROM mt")
def walk_forward_run(spark: SparkSession, sf: str) -> DataFrame:
    """A forest of 100 trees and a logistic model, fitted over all features on the train rows of every fold
    of every symbol; their soft vote, written, is backtested. The metrics are computed a second time from
    the written votes by plain SQL."""
    votes, metrics = WF.walk_forward_run(as_series(matrix(spark, sf), **bound(spark, sf)))
    again = spark.sql(VOTE_METRICS, votes=votes)
    names = [n for n in again.columns if n not in ("symbol", "fold")]
    mean = F.bool_and(F.abs(F.col("prediction") * 2 - F.col("forest") - F.col("logistic")) < 1e-12)
    better = F.bool_and((F.col("forest_fit") > F.col("base")) & (F.col("logistic_fit") > F.col("base")))
    facts = votes.groupBy("symbol", "fold").agg(mean.alias("mean_of_both"), better.alias("learned"))
    same = F.lit(True)
    for n in names:
        same = same & (F.abs(F.col(f"m.{n}") - F.col(f"a.{n}")) < 1e-9)
    keys = ["symbol", "fold"]
    joined = metrics.alias("m").join(again.alias("a"), keys).join(facts, keys)
    out = joined.select(*keys, "m.total_trades", "m.benchmark_return", "m.benchmark_volatility", same.alias("recomputed"), "mean_of_both", "learned")
    return rounded(out, BENCH, [*keys, "total_trades", "recomputed", "mean_of_both", "learned"])


@query(
    "feature_name_union",
    "SELECT DISTINCT feature FROM (SELECT p_brand AS feature FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT s_name FROM supplier)",
)
def feature_name_union(spark: SparkSession, sf: str) -> DataFrame:
    part, supplier = D.table(spark, sf, "part"), D.table(spark, sf, "supplier")
    pick = lambda df, n: df.select(F.col(n).alias("feature"))
    return E.feature_name_union(pick(part, "p_brand"), pick(part, "p_type"), pick(supplier, "s_name"))


