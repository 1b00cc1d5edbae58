"""Histogram trees: the small vectorised kernel that all tree models share.

Rows come as a matrix of bin numbers. Trees grow level by level: one pass sums the statistics of a
level's rows into (node, column, bin) cells, a second one takes the best cut of every node. The
statistics are a gradient and a weight per row, kept as whole numbers of a fixed unit, so their sums
are exact and do not depend on the order or the layout of the rows. Drawing of rows and columns is a
hash of what is drawn for, never of a position, so it does not depend on the layout either.

The same two passes serve both layouts: rows of a group that fits a task (its size is bounded by the
calendar or by the fold) are grown in place, rows of larger groups are summed per task and the cells
are added up by a shuffle (:mod:`tickloom.operators.boosting`).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

UNIT = float(1 << 24)  #: statistics are whole numbers of 1 / UNIT
LEAST_GAIN = 1e-9


def _mixed(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draw(*parts) -> np.ndarray:
    """A hash of the parts as a number in [0, 1); arrays are combined by broadcasting."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = _mixed(_mixed(np.asarray(p).astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019)) ^ (h * np.uint64(3)))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x * UNIT)


#: chances of drawing a row 0, 1, 2, ... times (Poisson with mean 1), summed up
_TIMES = np.cumsum(np.exp(-1) / np.array([1.0, 1, 2, 6, 24, 120, 720, 5040]))


def row_draws(row: np.ndarray, trees: np.ndarray, seed: int) -> np.ndarray:
    """How often each tree (one line each) takes each row."""
    return np.searchsorted(_TIMES, draw(seed, row[None, :], trees[:, None])).astype(np.float64)


# ---------------------------------------------------------------------------------- bins


def cuts_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Per column up to ``bins - 1`` cuts at equal shares of the values; a value at a cut is left of it."""
    at = (np.arange(1, bins) * len(x)) // bins
    ordered = np.sort(x, axis=0)[np.minimum(np.maximum(at - 1, 0), max(len(x) - 1, 0))] if len(x) else np.zeros((0, x.shape[1]))
    return [np.unique(ordered[:, j]) for j in range(x.shape[1])]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.searchsorted(c, x[:, j], side="left")
    return out


# --------------------------------------------------------------------------------- trees


@dataclass(frozen=True)
class Shape:
    """How trees grow. ``leaf`` and ``split`` are the least weights of a leaf and of a node that is cut."""

    depth: int = 6
    leaf: float = 1.0
    split: float = 2.0
    ridge: float = 1.0
    bins: int = 32
    per_node: int | None = None  #: columns drawn for each node (all by default)
    seed: int = 42


@dataclass
class Trees:
    """Nodes of several trees; node ``t`` is the root of tree ``t``, a leaf has ``left`` -1, and the right
    child follows the left one. ``cut`` is the last bin of the left side."""

    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    roots: int

    @classmethod
    def planted(cls, roots: int) -> Trees:
        return cls(np.zeros(roots, np.int32), np.zeros(roots, np.int32), np.full(roots, -1, np.int32), np.zeros(roots), np.zeros(roots), roots)

    def extend(self, nodes: np.ndarray, column: np.ndarray, cut: np.ndarray, gain: np.ndarray) -> None:
        """Cuts the nodes; their children come to the end in the nodes' order."""
        size = len(self.left)
        self.column[nodes], self.cut[nodes], self.gain[nodes] = column, cut, gain
        self.left[nodes] = size + 2 * np.arange(len(nodes), dtype=np.int32)
        more = 2 * len(nodes)
        for name, fill in (("column", 0), ("cut", 0), ("left", -1), ("value", 0.0), ("gain", 0.0)):
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, np.full(more, fill, old.dtype)]))

    def step(self, node: np.ndarray, bins: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The child of each node that its row goes to (leaves stay)."""
        left = self.left[node]
        return np.where(left < 0, node, left + (bins[row, self.column[node]] > self.cut[node]))

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree (trees x rows)."""
        row = np.tile(np.arange(len(bins)), self.roots)
        node = np.repeat(np.arange(self.roots), len(bins))
        open_ = np.flatnonzero(self.left[node] >= 0)
        while len(open_):
            node[open_] = self.step(node[open_], bins, row[open_])
            open_ = open_[self.left[node[open_]] >= 0]
        return node.reshape(self.roots, len(bins))

    def total(self, bins: np.ndarray) -> np.ndarray:
        """Sum over the trees of the values of a row's leaves."""
        return self.value[self.leaves(bins)].sum(axis=0) if self.roots else np.zeros(len(bins))

    def importance(self, columns: int) -> np.ndarray:
        """Share of each column in the gains of all cuts."""
        gain = np.bincount(self.column[self.left >= 0], self.gain[self.left >= 0], minlength=columns)
        return gain / gain.sum() if gain.sum() > 0 else gain


def node_columns(nodes: np.ndarray, columns: np.ndarray, shape: Shape, salt: int) -> np.ndarray:
    """The columns that each node looks at (nodes x columns): all of them, or an arithmetic progression
    whose start and stride are drawn for the node, over the next prime number of places (a place beyond
    the last column counts as the first one and gives nothing new)."""
    if shape.per_node is None or shape.per_node >= len(columns):
        return np.broadcast_to(columns, (len(nodes), len(columns)))
    prime = len(columns)
    while any(prime % d == 0 for d in range(2, int(prime**0.5) + 1)):
        prime += 1
    start = (draw(shape.seed, salt, nodes, 1) * prime).astype(np.int64)
    stride = 1 + (draw(shape.seed, salt, nodes, 2) * (prime - 1)).astype(np.int64)
    place = (start[:, None] + stride[:, None] * np.arange(shape.per_node)) % prime
    return columns[np.where(place < len(columns), place, 0)]


def cells(bins: np.ndarray, row: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray, looked: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``g`` and ``h`` by (slot, column looked at, bin)."""
    slots, m = looked.shape
    alike = looked.strides[0] == 0 or slots == 1  # all slots look at the same columns
    key = (bins[:, looked[0]][row] if alike else bins[row[:, None], looked[slot]]).astype(np.int64)
    key += slot[:, None] * (m * width) + np.arange(m) * width
    flat, size = key.ravel(), slots * m * width
    shaped = (slots, m, width)
    return np.bincount(flat, np.repeat(g, m), size).reshape(shaped), np.bincount(flat, np.repeat(h, m), size).reshape(shaped)


def best_cuts(g: np.ndarray, h: np.ndarray, looked: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per slot: gain, column and bin of its best cut (gain 0 if there is none); of equal gains the one of
    the smaller column, then of the smaller bin.

    The sums are whole numbers, so cuts that part the rows alike have the very same gain.
    """
    ridge, leaf = shape.ridge * UNIT, max(shape.leaf * UNIT, 1.0)
    gl, hl = np.cumsum(g, axis=2), np.cumsum(h, axis=2)
    gt, ht = gl[:, :, -1:].copy(), hl[:, :, -1:].copy()
    gr, hr = gt - gl, ht - hl
    fits = (hl >= leaf) & (hr >= leaf)
    with np.errstate(divide="ignore", invalid="ignore"):
        gl *= gl
        gr *= gr
        hl += ridge
        hr += ridge
        gl /= hl
        gr /= hr
        gl += gr
        before = gt[:, 0, 0] ** 2 / (ht[:, 0, 0] + ridge)
    gl[~fits] = -np.inf
    bin_ = gl.argmax(axis=2)
    top = np.take_along_axis(gl, bin_[:, :, None], axis=2)[:, :, 0]
    best = top.max(axis=1)
    first = np.where(top == best[:, None], looked, np.iinfo(np.int32).max).argmin(axis=1)
    pick = np.arange(len(best))
    gain = np.where(np.isfinite(best) & (ht[:, 0, 0] >= shape.split * UNIT), best - before, 0.0) / UNIT
    return np.maximum(gain, 0.0), looked[pick, first], bin_[pick, first]


def finish(trees: Trees, nodes: np.ndarray, g: np.ndarray, h: np.ndarray, ridge: float) -> None:
    weight = h / UNIT + ridge
    trees.value[nodes] = np.where(weight > 0, g / UNIT / np.where(weight > 0, weight, 1), 0.0)


def grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, columns: np.ndarray, shape: Shape, salt: int = 0) -> Trees:
    """Trees over the rows of one task: ``g`` and ``h`` (trees x rows) are whole numbers of the unit; rows
    of weight 0 do not count. Leaf values are ``g / (h + ridge)``."""
    trees = Trees.planted(len(g))
    tree, row = np.nonzero(h > 0)
    node, gs, hs = tree.copy(), g[tree, row], h[tree, row]
    for level in range(shape.depth + 1):
        nodes, slot = np.unique(node, return_inverse=True)
        if not len(nodes):
            break
        ht, gt = np.bincount(slot, hs), np.bincount(slot, gs)
        finish(trees, nodes, gt, ht, shape.ridge)
        if level == shape.depth:
            break
        mixed = (ht >= shape.split * UNIT) & (np.bincount(slot, np.abs(gs - hs * (gt / ht)[slot])) > 0)
        if not mixed.any():
            break
        open_, keep = nodes[mixed], mixed[slot]
        row, gs, hs, slot = row[keep], gs[keep], hs[keep], (np.cumsum(mixed) - 1)[slot[keep]]
        looked = node_columns(open_, columns, shape, salt)
        gain, column, cut = _best_in_parts(bins, row, slot, gs, hs, looked, shape)
        ok = gain > LEAST_GAIN
        trees.extend(open_[ok], column[ok], cut[ok], gain[ok])
        keep = ok[slot]
        row, gs, hs = row[keep], gs[keep], hs[keep]
        node = trees.step(open_[slot[keep]], bins, row)
    return trees


def grow_one(bins: np.ndarray, g: np.ndarray, h: np.ndarray, columns: np.ndarray, shape: Shape) -> Trees:
    """What :func:`grow` gives for one tree whose nodes look at the same columns, with half the sums: of
    two children only the smaller one is summed, the other is what it leaves of the parent. Columns are
    taken some at a time, so that their cells stay in the processor's cache."""
    trees, width = Trees.planted(1), shape.bins
    parts = [columns[lo : lo + CACHED_COLUMNS] for lo in range(0, len(columns), CACHED_COLUMNS)]
    keys = [bins[:, part] + np.arange(len(part), dtype=np.int64) * width for part in parts]

    def summed(key: np.ndarray, every: np.ndarray, slot: np.ndarray, slots: int, weights: tuple) -> np.ndarray:
        m = key.shape[1]
        flat = key[every]
        flat += slot[:, None] * (m * width)
        flat, size = flat.ravel(), slots * m * width
        out = np.empty((2, slots, m, width))
        for k, v in enumerate(weights):
            out[k] = np.bincount(flat, np.repeat(v, m), size).reshape(slots, m, width)
        return out

    rows = [np.flatnonzero(h > 0)]
    if not len(rows[0]):
        return trees
    finish(trees, np.array([0]), g[rows[0]].sum(keepdims=True), h[rows[0]].sum(keepdims=True), shape.ridge)
    open_, start = np.array([0]), np.zeros(len(rows[0]), np.int64)
    sums = [summed(key, rows[0], start, 1, (g[rows[0]], h[rows[0]])) for key in keys]
    for level in range(shape.depth):
        gain, column, cut = np.zeros(len(open_)), np.zeros(len(open_), np.int64), np.zeros(len(open_), np.int64)
        for part, held in zip(parts, sums):
            found = best_cuts(*held, np.broadcast_to(part, (len(open_), len(part))), shape)
            better = found[0] > gain
            gain, column, cut = (np.where(better, new, old) for new, old in zip(found, (gain, column, cut)))
        ok = np.flatnonzero(gain > LEAST_GAIN)
        if not len(ok):
            break
        first = len(trees.left)
        trees.extend(open_[ok], column[ok], cut[ok], gain[ok])
        sides = []
        for i in ok:
            right = bins[rows[i], column[i]] > cut[i]
            sides.append((rows[i][~right], rows[i][right]))
        children = [part for pair in sides for part in pair]
        total = np.array([[v[part].sum() for part in children] for v in (g, h)])
        finish(trees, first + np.arange(len(children)), *total, shape.ridge)
        if level == shape.depth - 1:
            break
        small = np.array([int(len(b) < len(a)) for a, b in sides])
        lesser = [pair[k] for pair, k in zip(sides, small)]
        every, slot = np.concatenate(lesser), np.repeat(np.arange(len(ok)), [len(r) for r in lesser])
        keep, pick = total[1] >= shape.split * UNIT, np.arange(len(ok))
        weights = (g[every], h[every])
        for b, key in enumerate(keys):
            some = summed(key, every, slot, len(ok), weights)
            both = np.empty((2, len(ok), 2, *some.shape[2:]))
            both[:, pick, small] = some
            both[:, pick, 1 - small] = sums[b][:, ok] - some
            both = both.reshape(2, -1, *some.shape[2:])
            sums[b] = both if keep.all() else both[:, keep]
        rows = [part for part, k in zip(children, keep) if k]
        open_ = (first + np.arange(len(children)))[keep]
        if not len(open_):
            break
    return trees


CACHED_COLUMNS = 64
CELLS = 65536  #: cells that are held at a time


def _best_in_parts(bins, row, slot, g, h, looked, shape):
    """:func:`best_cuts` of all slots, for so many slots at a time that the cells stay bounded."""
    slots, m = looked.shape
    each = max(1, CELLS // (m * shape.bins))
    if each >= slots:
        return best_cuts(*cells(bins, row, slot, g, h, looked, shape.bins), looked, shape)
    order = np.argsort(slot, kind="stable")
    row, slot, g, h = row[order], slot[order], g[order], h[order]
    out = []
    for lo in range(0, slots, each):
        a, b = np.searchsorted(slot, [lo, lo + each])
        part = looked[lo : lo + each]
        out.append(best_cuts(*cells(bins, row[a:b], slot[a:b] - lo, g[a:b], h[a:b], part, shape.bins), part, shape))
    return tuple(np.concatenate(x) for x in zip(*out))


# -------------------------------------------------------------------------------- models


def forest(bins: np.ndarray, y: np.ndarray, row: np.ndarray, trees: int, shape: Shape) -> Trees:
    """Trees over rows drawn with repetition; a leaf's value is its share of ones."""
    drawn = row_draws(row, np.arange(trees), shape.seed)
    return grow(bins, whole(drawn * y), whole(drawn), np.arange(bins.shape[1]), shape)


def logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def log_loss(y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, margin) - y * margin


@dataclass(frozen=True)
class Boost:
    """``rows`` and ``columns`` are the shares drawn for a round; without ``patience`` all rounds are kept."""

    rounds: int = 100
    rate: float = 0.01
    rows: float = 1.0
    columns: float = 1.0
    patience: int | None = None
    shape: Shape = Shape()


def round_columns(width: int, spec: Boost, round_: int) -> np.ndarray:
    if spec.columns >= 1:
        return np.arange(width)
    order = np.argsort(draw(spec.shape.seed, 7, round_, np.arange(width)), kind="stable")
    return np.sort(order[: max(1, int(np.ceil(spec.columns * width)))])


def first_alike(bins: np.ndarray) -> np.ndarray:
    """The columns without those that are constant or equal an earlier one: no cut of them would be taken."""
    seen: dict[bytes, int] = {}
    for j in range(bins.shape[1]):
        seen.setdefault(np.ascontiguousarray(bins[:, j]).tobytes(), j)
    kept = np.array([j for j in seen.values() if len(bins) and bins[:, j].min() < bins[:, j].max()], np.int64)
    return kept if len(kept) else np.arange(min(1, bins.shape[1]))


def gradients(y: np.ndarray, margin: np.ndarray, row: np.ndarray, spec: Boost, round_: int) -> tuple[np.ndarray, np.ndarray]:
    p = sigmoid(margin)
    taken = draw(spec.shape.seed, 8, round_, row) < spec.rows if spec.rows < 1 else np.ones(len(y), bool)
    return np.where(taken, whole(y - p), 0.0), np.where(taken, np.maximum(whole(p * (1 - p)), 1.0), 0.0)


def stopped(losses: list[float], patience: int | None) -> bool:
    """Whether the best round lies ``patience`` rounds back."""
    return patience is not None and len(losses) - 1 - int(np.argmin(losses)) >= patience


def kept_rounds(losses: list[float], patience: int | None) -> int:
    return len(losses) if patience is None or not losses else int(np.argmin(losses)) + 1


def boosted(bins: np.ndarray, y: np.ndarray, row: np.ndarray, held_out: np.ndarray, spec: Boost) -> tuple[list[Trees], float, list[tuple[float, float]]]:
    """Rounds of trees on the rows that are not held out, the starting margin, and per round the mean loss
    of the training and of the held-out rows. With patience, rounds end ``patience`` rounds after the
    least held-out loss, and the trees after that round are dropped."""
    train = ~held_out
    start = logit(min(max(float(y[train].mean()), 1e-6), 1 - 1e-6)) if train.any() else 0.0
    twin = first_alike(bins[train]) if spec.columns >= 1 else None
    margin = np.full(len(y), start)
    made, losses = [], []
    for r in range(spec.rounds):
        g, h = gradients(y, margin, row, spec, r)
        one = grow_one(bins, np.where(train, g, 0.0), np.where(train, h, 0.0), round_columns(bins.shape[1], spec, r) if twin is None else twin, spec.shape)
        one.value *= spec.rate
        margin = margin + one.total(bins)
        made.append(one)
        loss = whole(log_loss(y, margin)) / UNIT
        losses.append((float(loss[train].mean()) if train.any() else 0.0, float(loss[held_out].mean()) if held_out.any() else 0.0))
        if held_out.any() and stopped([b for _, b in losses], spec.patience):
            break
    kept = kept_rounds([b for _, b in losses], spec.patience if held_out.any() else None)
    return made[:kept], start, losses


def joined(parts: list[Trees]) -> Trees:
    """Single trees as one set: roots first, then the other nodes of each."""
    if not parts:
        return Trees.planted(0)
    sizes = np.array([len(p.left) for p in parts])
    shift = len(parts) + np.cumsum(sizes - 1) - (sizes - 1) - 1  # node k > 0 of a tree comes to shift + k
    pick = lambda name: np.concatenate([[getattr(p, name)[0] for p in parts], *[getattr(p, name)[1:] for p in parts]])
    moved = [np.where(p.left >= 0, p.left + s, -1) for p, s in zip(parts, shift)]
    left = np.concatenate([[m[0] for m in moved], *[m[1:] for m in moved]]).astype(np.int32)
    return Trees(pick("column").astype(np.int32), pick("cut").astype(np.int32), left, pick("value"), pick("gain"), len(parts))


def ridge_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30, close: float = 1e-10) -> np.ndarray:
    """Weights (the last one is the intercept, which is not shrunk) of the ridge logistic loss by Newton
    steps. With fewer rows than columns each step is solved over the rows."""
    n, p = x.shape
    w, b = np.zeros(p), logit(min(max(float(y.mean()), 1e-6), 1 - 1e-6))
    gram = x @ x.T if n < p else None
    for _ in range(rounds):
        prob = sigmoid(x @ w + b)
        bend = np.maximum(prob * (1 - prob), 1e-10)
        miss = y - prob
        if gram is not None:
            # with w = x' a: (K + ridge / bend) a + b = z, sum of a = 0
            z = x @ w + b + miss / bend
            system = gram + np.diag(ridge / bend)
            both = np.linalg.solve(system, np.column_stack([z, np.ones(n)]))
            new_b = both[:, 0].sum() / both[:, 1].sum()
            new_w = x.T @ (both[:, 0] - new_b * both[:, 1])
        else:
            wide = np.column_stack([x, np.ones(n)])
            shrink = np.r_[np.full(p, ridge), 0.0]
            hess = wide.T @ (wide * bend[:, None]) + np.diag(shrink)
            step = np.linalg.solve(hess, wide.T @ miss - shrink * np.r_[w, b])
            new_w, new_b = w + step[:-1], b + step[-1]
        moved = max(np.abs(new_w - w).max(initial=0.0), abs(new_b - b))
        w, b = new_w, float(new_b)
        if moved < close:
            break
    return np.r_[w, b]
