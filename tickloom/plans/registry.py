"""The registered queries: each takes a session and a table folder and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import grid
from ..operators.catalogue import build_features, families, feature_names
from . import datasets as D
from .oracles.features import feature_sql, suite_sql
from .oracles.rounding import digits_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def day(name: str = "ts") -> Column:
    return F.to_date(name).cast("string").alias("day")


def rounded(df: DataFrame, digits: dict[str, int], keep: Sequence[Column | str]) -> DataFrame:
    """Key columns and the named columns at their compared precision."""
    return df.select(*keep, *[grid(F.col(n), d).alias(n) for n, d in digits.items()])


def family_query(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = build_features(D.bars(spark, sf), [name], group_rows=D.bars_per_symbol(spark, sf))
        return compared(out, [name])

    return run


def compared_columns(names: Sequence[str]) -> list[Column]:
    cols = []
    for f in families(names):
        for n in f.columns:
            d = digits_of(f.name, n)
            cols.append(F.col(n) if d is None else grid(F.col(n), d).alias(n))
    return cols


def compared(out: DataFrame, names: Sequence[str]) -> DataFrame:
    return out.select("symbol", day(), *compared_columns(names))


def _register_families() -> None:
    for f in [*families(), *families(["fallback_set"])]:
        if f.name == "ta_nvi":
            continue
        QUERIES[f.name] = family_query(f.name)
        ORACLES[f.name] = feature_sql(f.name)


_register_families()
SUITE = [f.name for f in families() if f.suite and f.name != "ta_nvi"]


def as_logarithm(sql: str) -> str:
    return sql.replace("floor((volume_nvi) * 1e-300 + 0.5) / 1e-300 AS volume_nvi", "floor(ln(volume_nvi) * 1e6 + 0.5) / 1e6 AS ln_volume_nvi")


@query("ta_nvi", as_logarithm(feature_sql("ta_nvi")))
def ta_nvi(spark: SparkSession, sf: str) -> DataFrame:
    """Compared as a logarithm: the index of these series spans many orders of magnitude."""
    out = build_features(D.bars(spark, sf), ["ta_nvi"], group_rows=D.bars_per_symbol(spark, sf))
    return out.select("symbol", day(), grid(F.ln("volume_nvi"), 6).alias("ln_volume_nvi"))


@query("ta_suite", as_logarithm(suite_sql([*SUITE, "ta_nvi"])))
def ta_suite(spark: SparkSession, sf: str) -> DataFrame:
    """The whole suite in one plan (the index above again as a logarithm)."""
    out = build_features(D.bars(spark, sf), [*SUITE, "ta_nvi"], group_rows=D.bars_per_symbol(spark, sf))
    return out.select("symbol", day(), *compared_columns(SUITE), grid(F.ln("volume_nvi"), 6).alias("ln_volume_nvi"))


@query("ta_suite_filled")
def ta_suite_filled(spark: SparkSession, sf: str) -> DataFrame:
    """The suite with partial frames and neutral values instead of NULL."""
    names = [f.name for f in families() if f.suite]
    out = build_features(D.bars(spark, sf), names, group_rows=D.bars_per_symbol(spark, sf), fillna=True)
    return out.select("symbol", day(), *feature_names(names))


#: Every family; the index that is compared as a logarithm is left to its own query.
SLICED = tuple(f.name for f in families() if f.name != "ta_nvi")


def _register_sliced() -> None:
    """The same results with every symbol cut into slices, as a hot symbol would be."""
    for name in SLICED:

        def run(spark: SparkSession, sf: str, name: str = name) -> DataFrame:
            out = build_features(D.bars(spark, sf), [name], group_rows=D.bars_per_symbol(spark, sf), limit=500, slice_rows=500)
            return compared(out, [name])

        QUERIES[f"{name}_sliced"] = run
        ORACLES[f"{name}_sliced"] = feature_sql(name)


_register_sliced()
