"""Ridge logistic regression over rows of any number, by sums of blocks of the Gram matrix.

Every Newton round sums gradient and curvature per task with matrix products, hands the blocks of the
curvature on by their number, and adds them up by a shuffle. What comes to the driver has the size of
the columns squared, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matrix import matrix_of
from .trees import logit, sigmoid

EDGE = 128  #: rows and columns of a block
MOST_COLUMNS = 8192


@dataclass(frozen=True)
class Linear:
    """``w`` (the last one is the intercept) for columns that are centred and scaled first."""

    w: np.ndarray
    mean: np.ndarray
    dev: np.ndarray
    rounds: int

    def raw(self) -> np.ndarray:
        """The weights for columns as they are, the intercept last."""
        slopes = self.w[:-1] / self.dev
        return np.r_[slopes, self.w[-1] - (slopes * self.mean).sum()]


def _added(rows: DataFrame, step, count: int) -> dict[int, np.ndarray]:
    """Sums of the arrays that ``step`` gives per task, by their number: partial sums per task, one shuffle,
    and in each receiving task a running sum of what arrives."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.frombuffer(data.as_buffer(), np.float64)
                held[block] = held[block] + values if block in held else values.copy()
        yield _blocks(held)

    parts = rows.mapInArrow(step, "block int, data binary").repartition(max(1, min(count, 64)), "block")
    return {r["block"]: np.frombuffer(r["data"], np.float64) for r in parts.mapInArrow(add, "block int, data binary").collect()}


def _blocks(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["block", "data"])


def _moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        x = matrix_of(batch.column(0))
        if len(x):
            part = np.vstack([np.r_[x.sum(axis=0), float(len(x))], np.r_[(x * x).sum(axis=0), float(np.nansum(batch.column(1).to_numpy(zero_copy_only=False)))]])
            total = part if total is None else total + part
    if total is not None:
        yield _blocks({0: total[0], 1: total[1]})


def _curvature(w: np.ndarray, mean: np.ndarray, dev: np.ndarray):
    size = len(w)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hess, grad, loss = np.zeros((size, size)), np.zeros(size), 0.0
        seen = False
        for batch in batches:
            x, y = matrix_of(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            if not len(x):
                continue
            seen = True
            wide = np.column_stack([(x - mean) / dev, np.ones(len(x))])
            z = wide @ w
            p = sigmoid(z)
            bent = wide * np.sqrt(np.maximum(p * (1 - p), 1e-10))[:, None]
            hess += bent.T @ bent
            grad += wide.T @ (y - p)
            loss += float((np.logaddexp(0, z) - y * z).sum())
        if seen:
            out = {0: np.r_[grad, loss]}
            edges = range(0, size, EDGE)
            for k, (i, j) in enumerate([(i, j) for i in edges for j in edges if j >= i], 1):
                out[k] = np.ascontiguousarray(hess[i : i + EDGE, j : j + EDGE]).ravel()
            yield _blocks(out)

    return run


def _assembled(blocks: dict[int, np.ndarray], size: int) -> np.ndarray:
    hess = np.zeros((size, size))
    edges = range(0, size, EDGE)
    for k, (i, j) in enumerate([(i, j) for i in edges for j in edges if j >= i], 1):
        part = blocks[k].reshape(min(EDGE, size - i), min(EDGE, size - j))
        hess[i : i + EDGE, j : j + EDGE] = part
        hess[j : j + EDGE, i : i + EDGE] = part.T
    return hess


def fit_logistic(rows: DataFrame, ridge: float = 1.0, rounds: int = 25, close: float = 1e-9) -> Linear:
    """The minimum of the ridge logistic loss over all rows of ``x, target`` (the intercept is not shrunk).

    A step that does not lower the loss is halved. Rows without a target do not count; without rows, or
    with one class only, the weights are 0 and the intercept says the share of ones.
    """
    used = rows.select("x", F.col("target").cast("double").alias("target")).where(F.col("target").isNotNull())
    sums = _added(used, _moments, 2)
    if not sums:
        return Linear(np.zeros(1), np.zeros(0), np.ones(0), 0)
    n, width = sums[0][-1], len(sums[0]) - 1
    if width > MOST_COLUMNS:
        raise ValueError(f"{width} columns: the curvature is held by the driver, for {MOST_COLUMNS} at most")
    mean = sums[0][:-1] / n
    dev = np.sqrt(np.maximum(sums[1][:-1] / n - mean**2, 0.0))
    dev = np.where(dev > 1e-9 * np.maximum(np.abs(mean), 1.0), dev, np.inf)
    share = sums[1][-1] / n
    w = np.r_[np.zeros(width), logit(min(max(share, 1e-9), 1 - 1e-9))]
    if share in (0.0, 1.0):
        return Linear(w, mean, dev, 0)
    shrink = np.r_[np.full(width, ridge), 0.0]
    count = 1 + (lambda e: e * (e + 1) // 2)(-(-len(w) // EDGE))
    best, step, base = np.inf, None, w
    for done in range(1, rounds + 1):
        blocks = _added(used, _curvature(w, mean, dev), count)
        loss = blocks[0][-1] + 0.5 * float((shrink * w * w).sum())
        if step is not None and loss > best * (1 + 1e-12):
            step = step / 2
            w = base + step
            continue
        best, base = loss, w
        step = np.linalg.solve(_assembled(blocks, len(w)) + np.diag(shrink), blocks[0][:-1] - shrink * w)
        if np.abs(step).max() < close:
            return Linear(w, mean, dev, done)
        w = base + step
    return Linear(base, mean, dev, rounds)


def probability(model: Linear) -> Column:
    """The probability for a row's ``x``, as one expression."""
    raw = model.raw()
    slopes = F.array(*[F.lit(float(v)) for v in raw[:-1]])
    z = F.aggregate(F.zip_with("x", slopes, lambda a, b: a * b), F.lit(float(raw[-1])), lambda s, v: s + v)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(z, F.lit(-35.0)), F.lit(35.0))))


def slope_of_loss(rows: DataFrame, model: Linear, ridge: float) -> DataFrame:
    """Per scaled column (and the intercept, last) the slope of the loss at the model's weights, by plain sums."""
    k = len(model.w) - 1
    miss = F.col("target").cast("double") - probability(model)
    mean, dev = F.array(*[F.lit(float(v)) for v in model.mean]), F.array(*[F.lit(float(v)) for v in model.dev])
    scaled = F.zip_with(F.zip_with("x", mean, lambda a, b: a - b), dev, lambda a, b: a / b)
    # in two steps, or the probability would be computed once per column
    each = rows.select(miss.alias("_miss"), F.concat(scaled, F.array(F.lit(1.0))).alias("_all"))
    wide = each.select("_miss", F.posexplode("_all").alias("column", "_v"))
    weight = F.element_at(F.array(*[F.lit(float(v)) for v in model.w]), F.col("column") + 1)
    shrunk = F.when(F.col("column") < k, F.lit(ridge) * weight).otherwise(0.0)
    return wide.groupBy("column").agg(F.sum(F.col("_miss") * F.col("_v")).alias("_s")).select("column", (F.col("_s") - shrunk).alias("slope"))
