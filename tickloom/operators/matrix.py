"""All features of a bar as one array column, for models that read the whole catalogue."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import BARS
from ..session import written
from .catalogue import build_features, families

PLANNED_AT_ONCE = 6


def feature_matrix(bars: DataFrame, names: Sequence[str] | None = None, per_step: int = 10, **layout) -> tuple[DataFrame, list[str]]:
    """``symbol, ts``, the bar and ``x``, the features of the named families (all by default) as doubles in
    the order of the returned names. Flags are 0 or 1, missing values 0.

    A plan with hundreds of window expressions is slow to analyse, so the families are built some at a
    time, several such jobs side by side, each part written as narrow rows, and the parts are joined on
    their unique key.
    """
    bars = written(bars.select("symbol", "ts", *BARS), "bars")
    every = families(names)
    steps, seen = [], set()
    for k in range(0, len(every), per_step):
        step = every[k : k + per_step]
        steps.append(([f.name for f in step], [c for f in step for c in f.columns if c not in seen and not seen.add(c)]))

    def part(step: tuple[list[str], list[str]]) -> DataFrame:
        built = build_features(bars, step[0], **layout)
        values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in step[1]])
        return written(built.select("symbol", "ts", values.alias("_x")), "features")

    with ThreadPoolExecutor(min(PLANNED_AT_ONCE, len(steps))) as pool:
        parts = list(pool.map(inheritable_thread_target(bars.sparkSession)(part), steps))
    out = bars
    for k, p in enumerate(parts):
        out = out.join(p.withColumnRenamed("_x", f"_x{k}").hint("merge"), ["symbol", "ts"])  # no part goes through the driver
    values = F.concat(*[F.col(f"_x{k}") for k in range(len(parts))])
    return out.select("symbol", "ts", *BARS, values.alias("x")), [c for _, columns in steps for c in columns]


def matrix_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of an array column without NULLs as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
