"""Where predictions and models go."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("prediction", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("signal", T.StringType()),
    ]
)


def write_prediction_json(records: DataFrame, path: str, mode: str = "append") -> None:
    """Prediction records as JSON under ``dt=`` folders, one a month."""
    _by_month(records).write.mode(mode).partitionBy("dt").json(path)


def _by_month(records: DataFrame) -> DataFrame:
    """Records in ranges of month and symbol: a task writes few months, and a month or symbol with a
    large share of the records is dealt to several tasks."""
    out = records.withColumn("dt", F.trunc("ts", "month"))
    return out.repartitionByRange("dt", "symbol", "ts")


def read_prediction_json(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*RECORD.fields, T.StructField("dt", T.DateType())])
    return spark.read.schema(schema).json(path).drop("dt")


def write_prediction_table(records: DataFrame, path: str, mode: str = "append") -> None:
    """History table in parquet, partitioned by month for time-range reads."""
    _by_month(records).write.mode(mode).partitionBy("dt").parquet(path)


def read_prediction_table(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """``since`` prunes whole month folders before the row filter."""
    df = spark.read.parquet(path)
    if since:
        df = df.where((F.col("dt") >= F.trunc(F.lit(since).cast("date"), "month")) & (F.col("ts") >= F.lit(since).cast("timestamp")))
    return df.drop("dt")


def read_prediction_jdbc(spark: SparkSession, url: str, table: str = "predictions", since: str | None = None, **options) -> DataFrame:
    """The same table in a relational database; the time filter is pushed into its query."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return df.where(F.col("timestamp") > F.lit(since).cast("timestamp")) if since else df


def save_model(model: PipelineModel, root: str, name: str) -> None:
    model.write().overwrite().save(f"{root}/{name}")


def load_model(root: str, name: str) -> PipelineModel:
    return PipelineModel.load(f"{root}/{name}")


def save_ensemble(model, root: str, spark: SparkSession) -> None:
    """An ensemble: every member under its name, and one row with features, weights and settings."""
    for name, member in model.models.items():
        save_model(member, root, name)
    row = (list(model.features), list(model.sequence_features or model.features), model.sequence_length, dict(model.weights))
    spark.createDataFrame([row], SETTINGS).coalesce(1).write.mode("overwrite").parquet(f"{root}/settings")


SETTINGS = "features array<string>, sequence_features array<string>, sequence_length int, weights map<string, double>"


def load_ensemble(root: str, spark: SparkSession):
    from ..operators.ensemble import Ensemble

    row = spark.read.schema(SETTINGS).parquet(f"{root}/settings").first()
    out = Ensemble(row["features"], sequence_length=row["sequence_length"], sequence_features=row["sequence_features"])
    out.weights = dict(row["weights"])
    out.models = {name: load_model(root, name) for name in out.weights}
    return out


def save_weights(weights: DataFrame, root: str, features: list[str], version: str = "1.0") -> None:
    """Weights of the models per symbol, with the feature names they belong to."""
    named = weights.withColumn("features", F.array(*[F.lit(n) for n in features])).withColumn("version", F.lit(version))
    named.write.mode("overwrite").parquet(f"{root}/weights")


def load_weights(root: str, spark: SparkSession) -> tuple[DataFrame, list[str]]:
    table = spark.read.parquet(f"{root}/weights")
    first = table.select("features").first()
    return table.select("symbol", "w"), list(first["features"]) if first else []
