"""Prediction records, their history, accuracy and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import confidence_of, flag, ratio, signal_of, truth


def signal_record(predictions: DataFrame) -> DataFrame:
    """Confidence ``2|p - 0.5|`` and BUY above 0.6, SELL below 0.4, HOLD between."""
    return predictions.select(
        "symbol", "ts", "prediction", confidence_of("prediction").alias("confidence"), signal_of("prediction").alias("signal")
    )


def score_default(symbols: DataFrame, scored: DataFrame, features_used: int, version: str = "1.0") -> DataFrame:
    """A record for every symbol; those without a score get the neutral default."""
    joined = symbols.select("symbol").join(scored.select("symbol", "prediction"), "symbol", "left")
    missing = F.col("prediction").isNull()
    p = F.coalesce(F.col("prediction"), F.lit(0.5))
    return joined.select(
        "symbol", p.alias("prediction"), confidence_of(p).alias("confidence"), signal_of(p).alias("signal"),
        F.when(missing, "default").otherwise(version).alias("model_version"),
        F.when(missing, 0).otherwise(features_used).alias("features_used"),
        F.when(missing, "Model not available").alias("error"),
    )


def since(as_of: str, hours: int):
    return F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(hours))


def accuracy_rollup(history: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Share of right directions per symbol and overall (``symbol`` NULL), with counts."""
    recent = history.where(F.col("ts") > since(as_of, hours))
    right = truth(F.col("prediction") > 0.5) == truth(F.col("actual_return") > 0)
    return (
        recent.rollup("symbol")
        .agg(F.avg(right.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("total_predictions"), F.grouping("symbol").cast("int").alias("overall"))
    )


def prediction_history(records: DataFrame, symbol: str, as_of: str, hours: int = 24) -> DataFrame:
    return (
        records.where((F.col("symbol") == symbol) & (F.col("ts") > since(as_of, hours)))
        .select("ts", "prediction", "confidence", "signal")
        .orderBy(F.col("ts").desc())
    )


def classification_metrics(rows: DataFrame, models: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 of each model column against ``target``."""
    by = list(by)
    long = rows.select(*by, "target", *models).unpivot([*by, "target"], list(models), "model", "p")
    up, said = F.col("target") == 1, truth(F.col("p") > 0.5)
    sums = long.groupBy(*by, "model").agg(
        F.avg((up == said).cast("double")).alias("accuracy"),
        F.sum(flag(up & said)).alias("tp"), F.sum(flag(~up & said)).alias("fp"), F.sum(flag(up & ~said)).alias("fn"),
    )
    zero = F.lit(0.0)
    precision = F.coalesce(ratio("tp", F.col("tp") + F.col("fp")), zero)
    recall = F.coalesce(ratio("tp", F.col("tp") + F.col("fn")), zero)
    f1 = F.coalesce(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), zero)
    return sums.select(*by, "model", "accuracy", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def asset_rankings(performance: DataFrame, metric: str = "accuracy", top: int | None = 10, by: Sequence[str] = ()) -> DataFrame:
    """Symbols by one metric, best first, ties by name; ``by`` ranks within groups such as models.

    ``top`` is how many places are reported (None: all). The limit on the rank prunes inside each
    task before the shuffle.
    """
    cols = [c for c in ("sharpe_ratio", "precision", "recall") if c in performance.columns]
    order = Window.partitionBy(*by).orderBy(F.col("metric").desc(), "symbol")
    ranked = performance.select("symbol", *by, F.col(metric).alias("metric"), *cols).withColumn("place", F.rank().over(order))
    return ranked if top is None else ranked.where(F.col("place") <= top)


def panel_summary(performance: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return performance.groupBy(*by).agg(F.count("accuracy").alias("successful_models"), F.avg("accuracy").alias("mean_accuracy"))


def message_stats(messages: DataFrame) -> DataFrame:
    """Messages per symbol and in all, with the number of symbols."""
    return messages.rollup("symbol").agg(
        F.count(F.lit(1)).alias("messages"), F.count_distinct("symbol").alias("symbols"), F.grouping("symbol").cast("int").alias("overall")
    )


def performance_curve(daily: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Cumulative strategy and benchmark return by day over the last days.

    Input: returns per symbol and day. They are averaged over symbols first, so the running
    product sees one row per day.
    """
    end = F.lit(as_of).cast("date")
    day = F.to_date("ts")
    per_day = (
        daily.where((day <= end) & (day > F.date_sub(end, days)))
        .groupBy(day.alias("day"))
        .agg(F.avg("strategy_returns").alias("s"), F.avg("benchmark_returns").alias("b"))
    )
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return per_day.select(
        "day",
        (F.product(F.lit(1.0) + F.coalesce("s", F.lit(0.0))).over(upto) - 1).alias("strategy_returns"),
        (F.product(F.lit(1.0) + F.coalesce("b", F.lit(0.0))).over(upto) - 1).alias("benchmark_returns"),
    )
