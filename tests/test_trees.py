"""Tree and linear models against plain loops, between layouts, and against optimality conditions."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import boosting, linear, symbol_models as S
from tickloom.operators import trees as TR


def made(n, width, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 2)
    x[:, 0] = rng.integers(0, 2, n)
    y = (x[:, 1] + x[:, 2] * x[:, 0] + rng.normal(size=n) * 0.7 > 0).astype(float)
    return x, y


def slow_tree(bins, g, h, columns, shape, salt=0):
    """One tree by trying every cut of every node in turn; nodes are numbered level by level."""
    nodes = {0: np.flatnonzero(h > 0)}
    column, cut, left, value = {}, {}, {0: -1}, {}
    size, level = 1, [0]
    for depth in range(shape.depth + 1):
        after = []
        for node in level:
            rows = nodes[node]
            gt, ht = g[rows].sum() / TR.UNIT, h[rows].sum() / TR.UNIT
            value[node] = gt / (ht + shape.ridge)
            if depth == shape.depth or ht < shape.split:
                continue
            looked = TR.node_columns(np.array([node]), columns, shape, salt)[0]
            best = (0.0, None, None)
            for c in sorted(set(looked.tolist())):
                for k in range(shape.bins):
                    low = rows[bins[rows, c] <= k]
                    gl, hl = g[low].sum() / TR.UNIT, h[low].sum() / TR.UNIT
                    if hl < shape.leaf or ht - hl < shape.leaf:
                        continue
                    gain = gl**2 / (hl + shape.ridge) + (gt - gl) ** 2 / (ht - hl + shape.ridge) - gt**2 / (ht + shape.ridge)
                    if gain > best[0] + 1e-12:
                        best = (gain, c, k)
            if best[0] > TR.LEAST_GAIN:
                column[node], cut[node], left[node] = best[1], best[2], size
                side = bins[rows, best[1]] > best[2]
                for child, own in ((size, rows[~side]), (size + 1, rows[side])):
                    nodes[child], left[child] = own, -1
                    after.append(child)
                size += 2
        level = after
    return column, cut, left, value


@pytest.mark.parametrize("shape", [TR.Shape(depth=3, bins=8), TR.Shape(depth=6, bins=32, ridge=3.0), TR.Shape(depth=12, leaf=2, split=5, ridge=0.0, bins=16, per_node=3), TR.Shape(depth=30, split=2, ridge=0.0, bins=5)])
def test_trees_equal_plain_loops(shape):
    x, y = made(90, 7)
    bins = TR.binned(x, TR.cuts_of(x, shape.bins))
    drawn = TR.row_draws(np.arange(90), np.arange(4), shape.seed)
    for t in range(4):
        g, h = TR.whole(drawn[t] * y), TR.whole(drawn[t])
        grown = TR.grow(bins, g[None], h[None], np.arange(7), shape)
        column, cut, left, value = slow_tree(bins, g, h, np.arange(7), shape)
        if shape.per_node is None:
            other = TR.grow_one(bins, g, h, np.arange(7), shape)
            assert all(np.array_equal(getattr(other, n), getattr(grown, n)) for n in ("column", "cut", "left", "value", "gain"))
        assert len(grown.left) == len(left)
        for node in left:
            assert grown.left[node] == left[node] and math.isclose(grown.value[node], value[node], abs_tol=1e-12)
            assert left[node] < 0 or (grown.column[node], grown.cut[node]) == (column[node], cut[node])
    both = TR.grow(bins, TR.whole(drawn * y), TR.whole(drawn), np.arange(7), TR.Shape(**{**shape.__dict__, "per_node": None}))
    alone = [TR.grow(bins, TR.whole(drawn[t] * y)[None], TR.whole(drawn[t])[None], np.arange(7), TR.Shape(**{**shape.__dict__, "per_node": None})) for t in range(4)]
    assert np.allclose(both.total(bins), sum(a.total(bins) for a in alone)) and np.allclose(TR.joined(alone).total(bins), both.total(bins))


def test_node_columns_are_distinct_and_by_node():
    shape = TR.Shape(per_node=5)
    picked = TR.node_columns(np.arange(50), np.arange(23), shape, 0)
    assert picked.shape == (50, 5) and all(len(set(p)) == 5 for p in picked.tolist())
    assert (TR.node_columns(np.array([7]), np.arange(23), shape, 0)[0] == picked[7]).all() and len({tuple(p) for p in picked.tolist()}) > 40
    assert set(np.unique(picked)) == set(range(23))


def test_cells_in_parts_give_the_same_trees(monkeypatch):
    x, y = made(200, 9)
    bins = TR.binned(x, TR.cuts_of(x, 16))
    shape = TR.Shape(depth=8, ridge=0.0, bins=16, per_node=3)
    whole = TR.forest(bins, y, np.arange(200), 5, shape)
    monkeypatch.setattr(TR, "CELLS", 100)
    parts = TR.forest(bins, y, np.arange(200), 5, shape)
    assert all((getattr(whole, n) == getattr(parts, n)).all() for n in ("column", "cut", "left", "value"))


def test_patience_keeps_the_best_round():
    x, y = made(300, 6, 3)
    held = np.arange(300) >= 220
    spec = TR.Boost(rounds=200, rate=0.3, patience=7, shape=TR.Shape(depth=3, bins=16))
    trees, start, losses = TR.boosted(TR.binned(x, TR.cuts_of(x[~held], 16)), y, np.arange(300), held, spec)
    outside = [b for _, b in losses]
    assert len(trees) == int(np.argmin(outside)) + 1 and len(losses) == len(trees) + 7 < 200
    bins = TR.binned(x, TR.cuts_of(x[~held], 16))
    margin = start + TR.joined(trees).total(bins)
    assert math.isclose(TR.log_loss(y, margin)[held].mean(), min(outside), abs_tol=1e-7)


def frame(spark, x, y, parts, held=None):
    rows = [(i, float(t), bool(held[i]) if held is not None else False, v.tolist()) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row long, target double, held boolean, x array<double>").repartition(parts)


@pytest.mark.parametrize("spec", [TR.Boost(rounds=11, rate=0.3, rows=0.7, columns=0.6, shape=TR.Shape(depth=3, bins=8)), TR.Boost(rounds=30, rate=0.9, patience=2, shape=TR.Shape(depth=2, bins=8))])
def test_distributed_boosting_is_the_same_for_all_layouts(spark, spec):
    x, y = made(400, 40, 5)
    held = np.arange(400) % 5 == 0
    cuts = boosting.sketch_cuts(frame(spark, x[~held], y[~held], 3), 8)
    here, start, losses = TR.boosted(TR.binned(x, cuts), y, np.arange(400), held, spec)
    here = TR.joined(here)
    for parts in (1, 5):
        out = boosting.fit_boosted(frame(spark, x, y, parts, held), spec)
        assert [c.tolist() for c in out.cuts] == [c.tolist() for c in cuts] and out.start == start
        assert all((getattr(out.trees, n) == getattr(here, n)).all() for n in ("column", "cut", "left")) and np.allclose(out.trees.value, here.value, atol=1e-14)
        assert np.allclose(out.losses, losses, atol=1e-12)
    scored = boosting.score_boosted(frame(spark, x, y, 2, held), out, ["row"]).orderBy("row").toPandas()
    assert np.allclose(scored["probability_up"], TR.sigmoid(start + here.total(TR.binned(x, cuts))))


def test_sketch_cuts_are_near_equal_shares(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.lognormal(0, 3, 5000), rng.normal(size=5000), np.r_[np.zeros(4000), np.ones(1000)], rng.normal(size=5000) * 1e-12])
    cuts = boosting.sketch_cuts(frame(spark, x, np.zeros(5000), 4), 16)
    assert cuts[2].tolist() == [boosting.TINY] and len(cuts[3]) == 0
    for j in (0, 1):
        share = [(x[:, j] <= c).mean() for c in cuts[j]]
        assert np.abs(np.array(share) - np.arange(1, 16) / 16).max() < 0.03
    b = boosting.buckets_of(np.sort(x[:, 0]))
    assert (np.diff(b) >= 0).all() and (x[:, 1] <= boosting.bucket_top(boosting.buckets_of(x[:, 1]))).all()


def test_boosting_without_classes(spark):
    x, _ = made(20, 3)
    out = boosting.fit_boosted(frame(spark, x, np.ones(20), 2), TR.Boost(rounds=2))
    assert out.trees.roots == 0 and TR.sigmoid(np.array([out.start]))[0] > 0.99
    assert boosting.fit_boosted(frame(spark, x[:1], np.ones(1), 2).limit(0), TR.Boost(rounds=2)).trees.roots == 0


def test_ridge_logistic_over_rows_and_columns():
    for n, width in ((300, 5), (40, 200)):
        x, y = made(n, width)
        w = TR.ridge_logistic(x, y, 2.0)
        miss = y - TR.sigmoid(x @ w[:-1] + w[-1])
        assert np.abs(x.T @ miss - 2.0 * w[:-1]).max() < 1e-5 and abs(miss.sum()) < 1e-5


def test_linear_fit_is_optimal_in_any_layout(spark):
    x, y = made(500, 150, 4)
    x[:, 5] = 3.0  # a constant column
    fits = [linear.fit_logistic(frame(spark, x, y, parts), 1.0) for parts in (1, 7)]
    assert np.allclose(fits[0].w, fits[1].w, atol=1e-8)
    slopes = linear.slope_of_loss(frame(spark, x, y, 3), fits[0], 1.0).toPandas()
    assert len(slopes) == 151 and slopes["slope"].abs().max() < 1e-5
    one = linear.fit_logistic(frame(spark, x, np.zeros(500), 2))
    assert (one.w[:-1] == 0).all() and linear.fit_logistic(frame(spark, x, y, 2).limit(0)).w.shape == (1,)


def test_convolutions_against_plain_loops():
    spec = S.Sequence60(length=12, kernels=6, taps=3, columns=2, seed=9)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 4))
    given = S.convolved(x, spec)
    draw = np.random.default_rng(spec.seed)
    for k in range(spec.kernels):
        apart = int(draw.choice([d for d in (1, 2, 3, 5, 7) if d * 2 < 12]))
        some, weights = draw.integers(0, 4, 2), draw.normal(size=(3, 2)) / np.sqrt(6)
        bias = float(draw.normal() * 0.5)
        for r in range(30):
            if r < 12:
                assert np.isnan(given[r, 2 * k])
                continue
            window = x[r - 12 : r]
            answers = [sum(window[i + t * apart, some] @ weights[t] for t in range(3)) for i in range(12 - 2 * apart)]
            assert math.isclose(given[r, 2 * k], max(answers), abs_tol=1e-12)
            assert math.isclose(given[r, 2 * k + 1], sum(a > bias for a in answers) / len(answers), abs_tol=1e-12)


SMALL = {
    "forest": S.Forest(trees=7, shape=TR.Shape(depth=4, leaf=2, split=5, ridge=0.0, bins=8)), "boost_a": TR.Boost(rounds=9, rate=0.2, rows=0.8, columns=0.8, shape=TR.Shape(depth=3, bins=8)),
    "boost_b": TR.Boost(rounds=60, rate=0.3, patience=4, shape=TR.Shape(depth=2, bins=8)), "logistic": S.Logistic(), "sequence": S.Sequence60(length=10, kernels=8, taps=3, columns=2),
}


def test_grouped_models_do_not_depend_on_the_layout(spark):
    rows = []
    for symbol, n, seed in (("A", 150, 1), ("B", 90, 2), ("C", 1, 3)):
        x, y = made(n, 6, seed)
        rows += [(symbol, datetime(2020, 1, 1) + timedelta(days=i), int(y[i]), i >= n * 0.8, x[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, target int, held boolean, x array<double>")
    out = []
    for parts in (1, 6):
        laid = df.repartition(parts, "ts")
        models = S.fit_groups(laid, SMALL, held=F.col("held")).persist()
        out.append(S.score_groups(laid, models, SMALL, keep=("target",)).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True))
    assert out[0].equals(out[1]) and len(out[0]) == 241
    a = out[0][out[0].symbol == "A"]
    for name in SMALL:
        p = a[name].dropna()
        assert p.between(0, 1).all() and p.nunique() > 3 and a[name].isna().sum() == (10 if name == "sequence" else 0)
    assert out[0][out[0].symbol == "C"]["forest"].iloc[0] in (0.0, 1.0)  # one row, one class
    weights = S.member_weights(spark.createDataFrame(out[0][["symbol", "target", *SMALL]]), list(SMALL))
    sums = weights.groupBy("symbol").agg(F.sum("weight").alias("s")).toPandas()
    assert np.allclose(sums["s"], 1.0)
    top = S.column_importance(models, [f"c{i}" for i in range(6)], top=3).toPandas()
    assert (top.groupby("symbol").size() <= 3).all() and top[top.symbol == "A"].importance.sum() <= 1.0 + 1e-9


def test_too_large_groups_are_refused(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_ROWS", 3)
    x, y = made(5, 3)
    df = spark.createDataFrame([("A", datetime(2020, 1, 1 + i), int(y[i]), x[i].tolist()) for i in range(5)], "symbol string, ts timestamp, target int, x array<double>")
    with pytest.raises(ValueError, match="boosting.fit_boosted"):
        S.fit_groups(df, SMALL)
