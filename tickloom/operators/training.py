"""One call from bars to a backtest of the trained models of every symbol."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import as_series
from .backtest import Costs, metrics, run_backtest
from .matrix import feature_matrix
from .sentiment import SENTIMENT_FEATURES, attach, sentiment_features
from .symbol_models import MEMBERS, Spec, combined, fit_groups, member_weights, score_groups
from .targets import add_target
from .walkforward import chrono_split


def train_rows(bars: DataFrame, names: Sequence[str] | None = None, sentiment: DataFrame | None = None, share: float = 0.8, **layout) -> DataFrame:
    """``symbol, ts, close, target, part, x``: all features (those of the named families), with those of
    daily sentiment behind them if given, the target and the chronological part of every bar."""
    rows, _ = feature_matrix(bars, names, **layout)
    if sentiment is not None:
        rows = attach(rows, sentiment_features(bars, sentiment, layout.get("group_rows")))
        extra = F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in SENTIMENT_FEATURES])
        rows = rows.withColumn("x", F.concat("x", extra)).drop(*SENTIMENT_FEATURES)
    s = chrono_split(add_target(as_series(rows, ahead=1, **layout)), share)
    return s.tidy().select("symbol", "ts", "close", "target", "part", "x")


def train_and_backtest(
    bars: DataFrame, folder: str, specs: Mapping[str, Spec] = MEMBERS, names: Sequence[str] | None = None, sentiment: DataFrame | None = None,
    strategy: str = "long_short", threshold: float = 0.6, costs: Costs = Costs(), share: float = 0.8, **layout,
) -> DataFrame:
    """Train every symbol's models on its first part, weight them by their accuracy on the rest, and
    backtest the weighted predictions of the rest.

    Bars, rows, models, scores and predictions are written below ``folder``, so what gives the bars runs once;
    the metrics are those of the predictions that were written. Returns one row of metrics per symbol.
    """
    spark = bars.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    bars = kept(bars, "bars")
    rows = kept(train_rows(bars, names, sentiment, share, **layout), "rows")
    models = kept(fit_groups(rows, specs, held=F.col("part") == "val", group_rows=layout.get("group_rows")), "models")
    val = kept(score_groups(rows, models, specs, keep=("target", "part")), "scores").where("part = 'val'")
    predictions = kept(combined(val, member_weights(val, list(specs)), list(specs)).select("symbol", "ts", "prediction"), "predictions")
    first = predictions.groupBy("symbol").agg(F.min("ts").alias("_first"))
    tested = bars.join(first, "symbol").where(F.col("ts") >= F.col("_first")).drop("_first")
    return metrics(run_backtest(tested, predictions, strategy, threshold, costs, **layout), costs)
