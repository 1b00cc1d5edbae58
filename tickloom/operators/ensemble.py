"""Classifier ensemble on Spark ML: forest, two boosted models, a sequence model, voting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import ratio
from ..functions.series import Series
from ..session import cut


def model_input(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature columns as doubles without NULLs (missing is 0), flags as 0/1."""
    return df.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in features})


def forest(trees: int = 100, depth: int = 10, leaf: int = 2, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(
        labelCol="target", featuresCol="features", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed
    )


def boosted(
    rounds: int = 100, depth: int = 6, rate: float = 0.01, rows: float = 0.8, columns: str = "0.8",
    validation: str | None = None, seed: int = 42,
) -> GBTClassifier:
    """Boosted trees; with a ``validation`` flag column training stops when it no longer helps."""
    model = GBTClassifier(
        labelCol="target", featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=rate,
        subsamplingRate=rows, featureSubsetStrategy=columns, seed=seed,
    )
    return model.setValidationIndicatorCol(validation) if validation else model


def logistic(ridge: float = 0.01) -> LogisticRegression:
    return LogisticRegression(labelCol="target", featuresCol="features", regParam=ridge)


def perceptron(inputs: int, hidden: Sequence[int] = (32, 16), rounds: int = 50, seed: int = 42):
    return MultilayerPerceptronClassifier(
        labelCol="target", featuresCol="features", layers=[inputs, *hidden, 2], maxIter=rounds, seed=seed
    )


def fit(rows: DataFrame, features: Sequence[str], estimator, by_symbol: bool = False) -> PipelineModel:
    """Assemble, optionally append the one-hot symbol (pooled panel model), and fit."""
    stages: list = []
    inputs = list(features)
    if by_symbol:
        stages += [
            StringIndexer(inputCol="symbol", outputCol="symbol_index", handleInvalid="keep"),
            OneHotEncoder(inputCol="symbol_index", outputCol="symbol_vector", handleInvalid="keep"),
        ]
        inputs.append("symbol_vector")
    stages += [VectorAssembler(inputCols=inputs, outputCol="features"), estimator]
    return Pipeline(stages=stages).fit(rows)


def up_probability(model: PipelineModel, rows: DataFrame, name: str) -> DataFrame:
    scored = model.transform(rows)
    keep = [n for n in rows.columns]
    return scored.select(*keep, vector_to_array("probability")[1].alias(name))


def sequence_windows(s: Series, features: Sequence[str], length: int = 60) -> Series:
    """``sequence``: the feature rows of the ``length`` rows before the current one, oldest
    first; NULL while there are fewer."""
    before = s.axis.spec.rowsBetween(-length, -1)
    row = F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in features])
    s = s.add({"_row": row})
    full = F.count(F.lit(1)).over(before) == length
    return s.add({"sequence": F.when(full, F.collect_list("_row").over(before))})


def sequence_vector(rows: DataFrame) -> DataFrame:
    """Rows with a sequence, flattened into the vector the sequence model reads."""
    return rows.where(F.col("sequence").isNotNull()).withColumn("flat", array_to_vector(F.flatten("sequence"))).drop("sequence")


def fit_sequence(rows: DataFrame, inputs: int, hidden: Sequence[int] = (16,), rounds: int = 20, seed: int = 42) -> PipelineModel:
    scale = StandardScaler(inputCol="flat", outputCol="features", withMean=True, withStd=True)
    return Pipeline(stages=[scale, perceptron(inputs, hidden, rounds, seed)]).fit(rows)


def vote(columns: Sequence[str]) -> Column:
    """Soft vote: the mean of the probabilities."""
    total = F.col(columns[0])
    for n in columns[1:]:
        total = total + F.col(n)
    return total / F.lit(float(len(columns)))


def ensemble_weights(validation: DataFrame, models: Sequence[str], missing: float = 0.5) -> DataFrame:
    """Validation accuracy of each model, normalised to sum 1. A model without any
    validation rows (all NULL) counts with ``missing``."""
    long = validation.select("target", *models).unpivot(["target"], list(models), "model", "p").where(F.col("p").isNotNull())
    right = ((F.col("p") > 0.5) == (F.col("target") == 1)).cast("double")
    names = ", ".join(f"('{m}')" for m in models)
    every = validation.sparkSession.sql(f"SELECT * FROM VALUES {names} AS t(model)")
    scored = every.join(long.groupBy("model").agg(F.avg(right).alias("accuracy")), "model", "left")
    accuracy = F.coalesce(F.col("accuracy"), F.lit(missing))
    return scored.select("model", accuracy.alias("accuracy"), ratio(accuracy, F.sum(accuracy).over(Window.partitionBy())).alias("weight"))


def ensemble_predict(weights: Mapping[str, float], renormalise: bool = False) -> Column:
    """Weighted sum of the model probabilities. A missing probability (the sequence model's
    first rows) adds nothing; ``renormalise`` divides by the weights that are present."""
    total, present = F.lit(0.0), F.lit(0.0)
    for name, w in weights.items():
        total = total + F.coalesce(F.col(name), F.lit(0.0)) * F.lit(float(w))
        present = present + F.when(F.col(name).isNotNull(), F.lit(float(w))).otherwise(0.0)
    return ratio(total, present) if renormalise else total


def feature_importance(models: Sequence[PipelineModel], features: Sequence[str], spark, top: int = 20) -> DataFrame:
    """Mean importance over the tree models, largest first (one value per feature and model)."""
    rows = []
    for i, m in enumerate(models):
        rows += [(i, n, float(v)) for n, v in zip(features, m.stages[-1].featureImportances.toArray())]
    table = spark.createDataFrame(rows, "model int, feature string, importance double")
    return table.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(F.col("importance").desc(), "feature").limit(top)


def feature_name_union(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("feature")
    for t in tables[1:]:
        out = out.union(t.select("feature"))
    return out.distinct()


@dataclass
class Ensemble:
    """The four models over one panel; ``fit`` takes rows with ``symbol, ts, target, part``."""

    features: Sequence[str]
    trees: int = 100
    boost_rounds: int = 100
    long_rounds: int = 1000
    sequence_length: int = 60
    sequence_features: Sequence[str] | None = None
    seed: int = 42
    models: dict[str, PipelineModel] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)

    def fit(self, s: Series) -> Ensemble:
        rows = model_input(s.df, self.features).persist()
        train, val = rows.where("part = 'train'"), rows.where("part = 'val'")
        both = rows.withColumn("held_out", F.col("part") == "val")
        self.models["forest"] = fit(train, self.features, forest(self.trees, seed=self.seed))
        self.models["boost_a"] = fit(train, self.features, boosted(self.boost_rounds, seed=self.seed))
        self.models["boost_b"] = fit(both, self.features, boosted(self.long_rounds, rows=1.0, columns="all", validation="held_out", seed=self.seed))
        seq = self._sequences(Series(rows, s.axis))
        width = self.sequence_length * len(self.sequence_features or self.features)
        self.models["sequence"] = fit_sequence(seq.where("part = 'train'"), width)
        scored = self.members(Series(rows, s.axis)).where("part = 'val'")
        names = list(self.models)
        self.weights = {r["model"]: r["weight"] for r in ensemble_weights(scored, names).collect()}
        rows.unpersist()
        return self

    def _sequences(self, s: Series) -> DataFrame:
        names = self.sequence_features or self.features
        return sequence_vector(sequence_windows(s, names, self.sequence_length).tidy())

    def members(self, s: Series) -> DataFrame:
        """Rows with one probability column per model."""
        rows = model_input(s.df, self.features)
        for name in ("forest", "boost_a", "boost_b"):
            rows = up_probability(self.models[name], rows, name)
        seq = self._sequences(Series(model_input(s.df, self.features), s.axis))
        extra = up_probability(self.models["sequence"], seq, "sequence").select("symbol", "ts", "sequence")
        return rows.join(extra, ["symbol", "ts"], "left")

    def predict(self, s: Series, renormalise: bool = False) -> DataFrame:
        return self.members(s).withColumn("prediction", ensemble_predict(self.weights, renormalise))


# ------------------------------------------------------------- one logistic per symbol


def _newton_step(width: int, ridge: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for sym, w, grad, hess in zip(pdf["symbol"], pdf["w"], pdf["grad"], pdf["hess"]):
            w, grad = np.asarray(w, float), np.asarray(grad, float)
            full = np.zeros((width, width))
            full[np.triu_indices(width)] = hess
            full = full + np.triu(full, 1).T + ridge * np.eye(width)
            out.append((sym, (w + np.linalg.solve(full, grad - ridge * w)).tolist()))
        return pd.DataFrame(out, columns=["symbol", "w"])

    def batches(frames):
        for pdf in frames:
            yield run(pdf)

    return batches


BROADCAST_BYTES = 64 << 20


def small(weights: DataFrame, width: int) -> DataFrame:
    """Marks the weights for broadcast if their counted size allows it; otherwise the join
    shuffles and adaptive execution splits a hot symbol."""
    return F.broadcast(weights) if weights.count() * (8 * width + 64) <= BROADCAST_BYTES else weights


def linear(features: Sequence[str]) -> Column:
    z = F.col("w")[len(features)]
    for i, n in enumerate(features):
        z = z + F.col("w")[i] * F.col(n)
    return z


def fit_per_symbol(rows: DataFrame, features: Sequence[str], rounds: int = 6, ridge: float = 1.0, min_rows: int = 50) -> DataFrame:
    """A ridge logistic model for every symbol at once, as weights per symbol.

    Each Newton round is one aggregation: gradient and curvature of a symbol are plain sums
    that combine on the map side, so a symbol of any size costs no more than its rows. Only
    the small solve per symbol runs in Python. Features should be standardised.
    """
    rows = model_input(rows, features)
    width = len(features) + 1
    big = rows.groupBy("symbol").count().where(F.col("count") >= min_rows)
    weights = cut(big.select("symbol", F.array(*[F.lit(0.0)] * width).alias("w")))
    x = [F.col(n) for n in features] + [F.lit(1.0)]
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-linear(features)))
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    for _ in range(rounds):
        scored = rows.join(small(weights, width), "symbol").withColumn("_p", p)
        bend, miss = F.col("_p") * (F.lit(1.0) - F.col("_p")), F.col("target") - F.col("_p")
        sums = scored.groupBy("symbol").agg(
            F.any_value("w").alias("w"),
            F.array(*[F.sum(miss * v) for v in x]).alias("grad"),
            F.array(*[F.sum(bend * x[i] * x[j]) for i, j in pairs]).alias("hess"),
        )
        weights = cut(sums.mapInPandas(_newton_step(width, ridge), "symbol string, w array<double>"))
    return weights


def score_per_symbol(rows: DataFrame, weights: DataFrame, features: Sequence[str]) -> DataFrame:
    """Scores of all rows; symbols without a model get the neutral 0.5."""
    keep = rows.columns
    scored = model_input(rows, features).join(small(weights, len(features) + 1), "symbol", "left")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-linear(features)))
    return scored.select(*keep, F.coalesce(p, F.lit(0.5)).alias("prediction"))
