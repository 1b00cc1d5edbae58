"""Boosted trees over rows of any number: the histograms of a level are partial sums per task.

Columns are cut at the quantiles of a mergeable sketch (counts of logarithmic buckets, exact under any
order of merging). Rows are kept as bin numbers with their margin. A level is one job: every task sums
its rows into (node, column, bin) cells, blocks of columns are added up by a shuffle, and each receiving
task gives the best cut of every node among its columns. Trees go out to the tasks; margins are written
anew every few rounds, so a task applies no more than the trees since. Sums are of whole numbers and
draws are hashes of the rows' keys, so the model is the same for every layout, and equal to what
:func:`trees.boosted` gives on the same bins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .matrix import matrix_of
from .trees import (
    LEAST_GAIN, UNIT, Boost, Trees, best_cuts, binned, cells, finish, gradients, joined, kept_rounds, log_loss, logit, round_columns, sigmoid,
    stopped, whole,
)

STEP = 0.02  #: two values of one bucket differ by less than this share
SIDE = 2048  #: buckets on each side of 0
TINY = 1e-9  #: values nearer to 0 count as 0
BLOCK_COLUMNS = 32
REWRITE = 10  #: rounds after which margins are written anew


# ------------------------------------------------------------------------ quantile sketch


def buckets_of(x: np.ndarray) -> np.ndarray:
    """Bucket of each value; buckets are in the order of the values, 0 is that of 0."""
    size = np.abs(x)
    with np.errstate(divide="ignore"):
        level = np.floor(np.log(np.maximum(size, TINY) / TINY) / np.log1p(STEP)).astype(np.int64) + 1
    return np.where(size < TINY, 0, np.sign(x).astype(np.int64) * np.clip(level, 1, SIDE))


def bucket_top(bucket: np.ndarray) -> np.ndarray:
    """The largest value that a bucket may hold."""
    edge = lambda b: TINY * np.exp(np.log1p(STEP) * b)
    top = np.where(bucket > 0, edge(np.maximum(bucket, 0)), -edge(np.maximum(-bucket, 1) - 1))
    return np.where(bucket == 0, TINY, np.nextafter(top, -np.inf))


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = None
    for batch in batches:
        x = matrix_of(batch.column(0))
        if not len(x):
            continue
        span = 2 * SIDE + 1
        if counts is None:
            counts = np.zeros((x.shape[1], span), np.int64)
        for j in range(x.shape[1]):
            counts[j] += np.bincount(buckets_of(x[:, j]) + SIDE, minlength=span)
    if counts is not None:
        column, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(column.astype(np.int32)), pa.array((bucket - SIDE).astype(np.int32)), pa.array(counts[column, bucket])], ["column", "bucket", "n"]
        )


def sketch_cuts(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Per column of ``x`` up to ``bins - 1`` cuts near equal shares of the values. The driver gets one row
    per column and bucket that occurs, at most 4097 a column, whatever the number of rows."""
    counts = rows.select("x").mapInArrow(_sketch, "`column` int, bucket int, n long").groupBy("column", "bucket").agg(F.sum("n").alias("n"))
    held: dict[int, list[tuple[int, int]]] = {}
    for r in counts.orderBy("column", "bucket").collect():
        held.setdefault(r["column"], []).append((r["bucket"], r["n"]))
    cuts = []
    for j in range(max(held, default=-1) + 1):
        bucket, n = np.array(held[j]).T
        upto = np.cumsum(n)
        at = np.searchsorted(upto, (np.arange(1, bins) * upto[-1]) / bins, side="left")
        cuts.append(np.unique(bucket_top(bucket[at[at < len(bucket) - 1]])))
    return cuts


# ------------------------------------------------------------------------------- boosting


@dataclass
class Boosted:
    trees: Trees
    start: float
    cuts: list[np.ndarray]
    losses: list[tuple[float, float]]

    def by_value(self) -> Trees:
        """The trees with cuts as values, for rows that are not binned."""
        t = self.trees
        cut = np.array([self.cuts[c][k] if at >= 0 else 0.0 for c, k, at in zip(t.column, t.cut, t.left)])
        return Trees(t.column, cut, t.left, t.value, t.gain, t.roots)


def _binned(cuts: list[np.ndarray], start: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = binned(matrix_of(batch.column(3)), cuts)
            packed = pa.array([b.tobytes() for b in bins], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), packed, pa.array(np.full(len(bins), start))], ["row", "y", "held", "bins", "margin"])

    return run


ROWS = "row long, y double, held boolean, bins binary, margin double"


def _unpacked(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, width)
    number = lambda i: batch.column(i).to_numpy(zero_copy_only=False)
    return number(0), number(1), number(2).astype(bool), bins, number(4)


def _margins(made: list[Trees], width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, _, _, bins, margin = _unpacked(batch, width)
                margin = margin.copy()
                for t in made:
                    margin += t.total(bins)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(margin)], batch.schema.names)

    return run


def _level(made: list[Trees], now: Trees, open_: np.ndarray, columns: np.ndarray, spec: Boost, round_: int, width: int):
    """Partial cells of one level, a row per block of columns; block -1 has the losses before the round."""
    bins_wide = spec.shape.bins

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, losses = None, np.zeros(4)
        place = np.full(len(now.left), -1)
        place[open_] = np.arange(len(open_))
        looked = np.broadcast_to(columns, (len(open_), len(columns)))
        for batch in batches:
            if not batch.num_rows:
                continue
            row, y, held, bins, margin = _unpacked(batch, width)
            margin = margin.copy()
            for t in made:
                margin += t.total(bins)
            if len(open_) and open_[0] == 0:
                loss = whole(log_loss(y, margin))
                losses += [loss[~held].sum(), (~held).sum(), loss[held].sum(), held.sum()]
            g, h = gradients(y, margin, row, spec, round_)
            slot = place[now.leaves(bins)[0]]
            use = np.flatnonzero(~held & (slot >= 0) & (h > 0))
            part = np.stack(cells(bins, use, slot[use], g[use], h[use], looked, bins_wide))
            total = part if total is None else total + part
        if total is not None:
            blocks = [(k, np.ascontiguousarray(total[:, :, lo : lo + BLOCK_COLUMNS]).tobytes()) for k, lo in enumerate(range(0, len(columns), BLOCK_COLUMNS))]
            blocks.append((-1, losses.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.binary())], ["block", "data"])

    return run


def _choose(slots: int, columns: np.ndarray, spec: Boost):
    """Adds up the cells of each block and gives every node's best cut among the block's columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.frombuffer(data.as_buffer(), np.float64)
                held[k] = held[k] + values if k in held else values.copy()
        out = []
        for k, values in held.items():
            if k < 0:
                out.append((k, values.tobytes()))
                continue
            some = columns[k * BLOCK_COLUMNS : (k + 1) * BLOCK_COLUMNS]
            g, h = values.reshape(2, slots, len(some), spec.shape.bins)
            gain, column, cut = best_cuts(g, h, np.broadcast_to(some, (slots, len(some))), spec.shape)
            at = np.searchsorted(some, column)
            pick = np.arange(slots)
            gl, hl = np.cumsum(g, axis=2)[pick, at, cut], np.cumsum(h, axis=2)[pick, at, cut]
            out.append((k, np.stack([gain, column, cut, gl, hl, g[:, 0].sum(axis=1), h[:, 0].sum(axis=1)]).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], ["block", "data"])

    return run


def _round(rows: DataFrame, made: list[Trees], spec: Boost, round_: int, width: int) -> tuple[Trees, np.ndarray]:
    """One tree, level by level, and the losses before it (train sum and rows, held-out sum and rows)."""
    columns = round_columns(width, spec, round_)
    count = -(-len(columns) // BLOCK_COLUMNS) + 1
    now, open_ = Trees.planted(1), np.array([0])
    losses = np.zeros(4)
    for level in range(spec.shape.depth):
        cells_ = rows.mapInArrow(_level(made, now, open_, columns, spec, round_, width), "block int, data binary")
        found = cells_.repartition(count, "block").mapInArrow(_choose(len(open_), columns, spec), "block int, data binary").collect()
        best = np.zeros((7, len(open_)))
        for r in sorted(found, key=lambda r: r["block"]):
            values = np.frombuffer(r["data"], np.float64)
            if r["block"] < 0:
                losses = values if level == 0 else losses
            else:
                part = values.reshape(7, -1)
                better = part[0] > best[0]
                best = np.where(better | (best[6] == 0), part, best)
        if level == 0:
            finish(now, open_, best[5], best[6], spec.shape.ridge)
        ok = best[0] > LEAST_GAIN
        if not ok.any():
            break
        first = len(now.left)
        now.extend(open_[ok], best[1][ok].astype(np.int32), best[2][ok].astype(np.int32), best[0][ok])
        children = np.arange(first, len(now.left))
        gl, hl, gt, ht = best[3][ok], best[4][ok], best[5][ok], best[6][ok]
        g, h = np.column_stack([gl, gt - gl]).ravel(), np.column_stack([hl, ht - hl]).ravel()
        finish(now, children, g, h, spec.shape.ridge)
        open_ = children[h >= spec.shape.split * UNIT]
        if not len(open_):
            break
    now.value *= spec.rate
    return now, losses


def fit_boosted(rows: DataFrame, spec: Boost, cuts: list[np.ndarray] | None = None) -> Boosted:
    """Boosted trees for ``row`` (what draws are hashed from), ``target``, ``held`` and ``x`` of any number of rows.

    Held-out rows do not train; with ``patience`` training ends that many rounds after their least mean
    loss, and the trees after it are dropped. Without training rows, or with one class, there are no trees.
    """
    train = rows.where(~F.col("held"))
    n, ones = train.agg(F.count(F.lit(1)), F.sum(F.col("target").cast("double"))).first()
    if not n or ones in (0.0, float(n)):
        return Boosted(Trees.planted(0), logit(min(max((ones or 0.0) / max(n, 1), 1e-6), 1 - 1e-6)), [], [])
    cuts = sketch_cuts(train, spec.shape.bins) if cuts is None else cuts
    start, width = logit(min(max(ones / n, 1e-6), 1 - 1e-6)), len(cuts)
    source = rows.select(F.col("row").cast("long"), F.col("target").cast("double").alias("y"), "held", "x")
    table = written(source.mapInArrow(_binned(cuts, start), ROWS), "boost-rows")
    made: list[Trees] = []
    fresh: list[Trees] = []
    losses: list[tuple[float, float]] = []
    watched = False
    for r in range(spec.rounds + 1):
        if r == spec.rounds:
            before = _losses(table, fresh, width)
        else:
            one, before = _round(table, fresh, spec, r, width)
        watched = before[3] > 0
        if r:
            losses.append((before[0] / UNIT / before[1], before[2] / UNIT / before[3] if watched else 0.0))
            if r == spec.rounds or (watched and stopped([b for _, b in losses], spec.patience)):
                break
        made.append(one)
        fresh.append(one)
        if len(fresh) == REWRITE:
            table = written(table.mapInArrow(_margins(fresh, width), ROWS), "boost-rows")
            fresh = []
    kept = kept_rounds([b for _, b in losses], spec.patience if watched else None)
    return Boosted(joined(made[:kept]), start, cuts, losses)


def _losses(table: DataFrame, made: list[Trees], width: int) -> np.ndarray:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4)
        for batch in batches:
            if batch.num_rows:
                _, y, held, bins, margin = _unpacked(batch, width)
                loss = whole(log_loss(y, margin + sum(t.total(bins) for t in made)))
                total += [loss[~held].sum(), (~held).sum(), loss[held].sum(), held.sum()]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], ["a", "b", "c", "d"])

    sums = table.mapInArrow(run, "a double, b double, c double, d double").agg(*[F.sum(c) for c in "abcd"]).first()
    return np.array([float(v) for v in sums])


def _scored(model: Boosted, names: list[str]):
    trees = model.by_value()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column(len(names)))
            p = sigmoid(model.start + trees.total(x)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(p)], [*names, "probability_up"])

    return run


def score_boosted(rows: DataFrame, model: Boosted, keep: list[str]) -> DataFrame:
    kept = rows.select(*keep)
    schema = kept.schema.add("probability_up", "double")
    return rows.select(*keep, "x").mapInArrow(_scored(model, keep), schema)
