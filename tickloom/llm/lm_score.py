"""Online logistic context mixing over the token streams of texts, learned from a corpus.

A text is the stream of its tokens, lower-cased words and one end. A token is a run of binary
decisions: frequent tokens are leaves of a Huffman tree, and the way to a leaf are its decisions.
All other tokens share one leaf, the escape. After it they are taken from the list of words seen, by
frequency, or spelled: the word's bytes, closed by a space (the end: by a line feed), bit by bit.

Every decision has one prediction from each context. In the tree: the node alone, the node after the
word before, after the word before that, after both, after the last common word, and the node in what the text has
had so far. In a word: hashed contexts, the bytes of the word so far, of several lengths. Predictions
are mixed in the logistic domain; a gate, the place of the decision and how well its contexts are
known, picks the weights, which gradient steps adapt online over the training texts, each event left
out of the counts it is predicted from. In a word an adaptive map then refines the mixed prediction.

The probability of a text is the product over all decisions, in order. Counts of the tree are over all
occurrences in the training texts. Contexts of the spelling end at word borders, so the cost of a
word's letters is the same wherever it stands, and each distinct word is spelled once; in its counts
a word weighs as often as the texts spell it. What tasks hold are tables of fixed size.
"""

from __future__ import annotations

import gc
import heapq
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import or_empty, text_rows, written
from .near_dup import _mix

#: Bytes of the word that each context holds; the last one also holds how long the word is.
ORDERS = (1, 2, 3, 4, 6, 0)
TABLE_BITS = 20
#: Table entries that travel together while tables of all partitions are added up.
CHUNK = 1 << 14
INPUTS = len(ORDERS) + 1
GATES = 8 * 8
REFINED = 24
RATE = 0.4
FIRST_WEIGHT = 0.2
#: Tokens of the first online steps; steps grow with their number, and the map begins to learn later.
FIRST_STEP, LATER = 50, 40
STRETCH_LIMIT = 12.0
#: Tokens that have a leaf of their own, and how often these come at least.
CODED_TOKENS, LEAST_CODED = 65_536, 3
SHARE_ROUNDS = 5
#: Tokens that every task holds in memory; the rest meet their scores in a join.
HELD_TOKENS = 100_000
HELD_BYTES = 64
FLUSH = 250_000
#: Hashed contexts of a node in the tree, and entries for each.
WAYS = 4
WAY_BITS = 20
TREE_INPUTS = WAYS + 3
DEPTHS = 6
TREE_GATES = DEPTHS * 4 * 3
#: So many leaves are common words.
COMMON = 30
#: How much the prediction of the node alone weighs beside the counts of a context.
BACKING = 1.0
TREE_RATE = 0.5
#: Tokens that are worked on together, and those of the first online steps. A longer text is worked on in runs that hand on what it has had.
RUN_TOKENS = 4096
FIRST_TOKENS = 200
FLAT_BYTES = 200_000
U64 = np.uint64


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -STRETCH_LIMIT, STRETCH_LIMIT)))


# -- bits of tokens -----------------------------------------------------------------------------


class Bits:
    """The bytes of some tokens in one row, and the contexts of each byte. The token of no bytes is the end."""

    def __init__(self, tokens: list[bytes]):
        parts = [t + b" " if t else b"\n" for t in tokens]
        self.lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        self.flat = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
        ends = self.lengths.cumsum()
        self.starts = ends - self.lengths
        self.place = np.arange(len(self.flat)) - np.repeat(self.starts, self.lengths)
        before = []
        for k in range(1, max(ORDERS) + 1):
            shifted = np.zeros_like(self.flat)
            shifted[k:] = self.flat[:-k]
            before.append(np.where(self.place >= k, shifted + 1, 0).astype(U64))
        self.contexts = []
        for which, order in enumerate(ORDERS):
            key = np.full(len(self.flat), which + 1, U64)
            for k in range(order):
                key = (key + before[k]) * U64(0x9E3779B97F4A7C15)
                key ^= key >> U64(29)
            if not order:
                key = (key + np.minimum(self.place, 40).astype(U64)) * U64(0x9E3779B97F4A7C15)
            self.contexts.append(key)
        self.gate = np.minimum(self.place, 7)
        self.before = before[0].astype(np.int64)

    def slots(self, which: int, node: np.ndarray) -> np.ndarray:
        """Table entries of a context at the node of the byte's bits so far."""
        key = (self.contexts[which] ^ node.astype(U64)) * U64(0xD6E8FEB86659FD93)
        return (key >> U64(64 - TABLE_BITS)).astype(np.int64)

    def steps(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each bit from the highest: its number, the node above it, its value."""
        for bit in range(8):
            yield bit, (self.flat | 256) >> (8 - bit), (self.flat >> (7 - bit)) & 1


def runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches of tokens in runs of a bounded number of bytes (a longer token stands alone)."""
    for batch in batches:
        tokens = batch.column(column).to_pylist()
        at = size = 0
        for k, t in enumerate(tokens):
            size += len(t) + 1
            if size >= FLAT_BYTES:
                yield batch.slice(at, k + 1 - at), tokens[at : k + 1]
                at, size = k + 1, 0
        if at < len(tokens):
            yield batch.slice(at), tokens[at:]


# -- sums over partitions -----------------------------------------------------------------------

PART = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("counts", T.BinaryType())])


def _part(chunk: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([values.astype(np.float32).tobytes()], pa.binary())], PART.names)


def _summed(parts: DataFrame, chunks: int) -> dict[int, np.ndarray]:
    """Arrays of a fixed number of chunks, added up over all partitions; only the sums reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw, np.float32).astype(np.float64)
                sums[k] = sums[k] + part if k in sums else part
        for k, part in sums.items():
            yield _part(k, part)

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = parts.repartition(min(n, chunks), "chunk").mapInArrow(add, PART).collect()
    return {r["chunk"]: np.frombuffer(r["counts"], np.float32) for r in rows}


def _sent(table: np.ndarray) -> tuple[int, np.ndarray | None, np.ndarray]:
    """A table of counts as it goes to the tasks: of one with few entries in use only these, and where they are.

    Every host keeps a file of each table, which for a small corpus would be far larger than the corpus.
    """
    used = np.flatnonzero(table.any(axis=1))
    return (len(table), None, table) if 3 * len(used) >= 2 * len(table) else (len(table), used.astype(np.uint32), table[used])


def _received(sent: tuple[int, np.ndarray | None, np.ndarray]) -> np.ndarray:
    n, used, counts = sent
    if used is None:
        return counts
    table = np.zeros((n, 2), np.float32)
    table[used] = counts
    return table


# -- counts -------------------------------------------------------------------------------------


def count_tokens(rows: DataFrame) -> DataFrame:
    """``token``, ``n``: how often each token is in the training texts (0: in held-out texts alone). The end is the empty token."""
    schema = T.StructType([T.StructField("token", T.BinaryType()), T.StructField("n", T.LongType())])

    def out(counts: Counter) -> Iterator[pa.RecordBatch]:
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema.names)
            counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        counts: Counter = Counter()
        for batch in batches:
            for kept, texts in text_rows(batch, ["held_out"], "text", 1_000_000):
                for t, held in zip(texts, kept.column(0).to_pylist(), strict=True):
                    words = tokens_of(t)
                    counts.update(dict.fromkeys(words, 0) if held else words)
                if len(counts) >= FLUSH:
                    yield from out(counts)
        yield from out(counts)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("held_out", "text").mapInArrow(run, schema).repartition(n, "token").groupBy("token").agg(F.sum("n").alias("n"))


def count_bits(vocabulary: DataFrame) -> np.ndarray:
    """Zeros and ones of every table entry over all tokens of the training part, as often as the texts spell
    them (``times``; once those that have a leaf, so that the spelling knows them too).

    The result has a fixed size, whatever the corpus: 2 * contexts * 2^TABLE_BITS numbers.
    """
    entries = len(ORDERS) << TABLE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((entries, 2), np.float32)
        for batch, tokens in runs(batches, 0):
            bits = Bits(tokens)
            times = np.tile(np.repeat(batch.column(1).to_numpy(), bits.lengths), 8)
            for which in range(len(ORDERS)):
                slots = np.concatenate([bits.slots(which, node) * 2 + value for _, node, value in bits.steps()])
                base = which << TABLE_BITS
                table[base : base + (1 << TABLE_BITS)] += np.bincount(slots, times, 2 << TABLE_BITS).reshape(-1, 2)
        for k in range(0, entries, CHUNK):
            if table[k : k + CHUNK].any():
                yield _part(k // CHUNK, table[k : k + CHUNK])

    training = vocabulary.where("n > 0").select("token", "times").coalesce(vocabulary.sparkSession.sparkContext.defaultParallelism)
    sums = _summed(training.mapInArrow(count, PART), entries // CHUNK)
    table = np.zeros((entries, 2), np.float32)
    for k, part in sums.items():
        table[k * CHUNK : (k + 1) * CHUNK] = part.reshape(-1, 2)
    return table


# -- mixing -------------------------------------------------------------------------------------


class Mixer:
    def __init__(self, weights: np.ndarray | None = None, refined: np.ndarray | None = None):
        self.weights = np.full((GATES, INPUTS), FIRST_WEIGHT) if weights is None else weights.copy()
        self.weights_seen = np.zeros(GATES)
        self.refined = np.zeros((256 * REFINED, 2)) if refined is None else refined

    def inputs(self, table: np.ndarray, bits: Bits, node: np.ndarray, value: np.ndarray | None, times: np.ndarray | int = 1) -> np.ndarray:
        """Stretched predictions; ``value``: each event is left out of the counts it is predicted from, with all ``times`` of its word."""
        out = np.empty((INPUTS, len(node)), np.float64)
        for which in range(len(ORDERS)):
            seen = table[(which << TABLE_BITS) + bits.slots(which, node)].astype(np.float64)
            zeros, ones = seen[:, 0], seen[:, 1]
            if value is not None:
                ones, zeros = np.maximum(ones - value * times, 0), np.maximum(zeros - (1 - value) * times, 0)
            out[which] = np.log((ones + 0.2) / (zeros + 0.2))
        out[-1] = 0.5
        return out

    def learn(self, table: np.ndarray, tokens: list[bytes], rate: float, refine: bool, times: np.ndarray | None = None) -> None:
        bits = Bits(tokens)
        each = 1 if times is None else np.repeat(times, bits.lengths)
        for bit, node, value in bits.steps():
            x = self.inputs(table, bits, node, value, each)
            gate = bits.gate * 8 + bit
            p = squash(np.einsum("ij,ji->i", self.weights[gate], x))
            error = value - p
            seen = np.bincount(gate, minlength=GATES)
            for k in range(INPUTS):
                self.weights[:, k] += rate * np.bincount(gate, error * x[k], GATES) / np.maximum(seen, 20)
            self.weights_seen += seen
            if refine:
                place = self._place(node, p) * 2 + value
                self.refined += np.bincount(place, minlength=512 * REFINED).reshape(-1, 2)

    def _place(self, node: np.ndarray, p: np.ndarray) -> np.ndarray:
        step = np.clip((stretch(p) + STRETCH_LIMIT) * (REFINED / (2 * STRETCH_LIMIT)), 0, REFINED - 1).astype(np.int64)
        return node * REFINED + step

    def log10_of(self, table: np.ndarray, tokens: list[bytes]) -> np.ndarray:
        """The log10 probability of each token's bytes."""
        bits = Bits(tokens)
        total = np.zeros(len(bits.flat))
        for bit, node, value in bits.steps():
            p = squash(np.einsum("ij,ji->i", self.weights[bits.gate * 8 + bit], self.inputs(table, bits, node, None)))
            seen = self.refined[self._place(node, p)]
            again = (seen[:, 1] + 30 * p) / (seen.sum(axis=1) + 30)
            p = np.clip((p + again) / 2, 1e-6, 1 - 1e-6)
            total += np.log10(np.where(value == 1, p, 1 - p))
        return np.add.reduceat(total, bits.starts)


def learn_mixer(vocabulary: DataFrame, table) -> Mixer:
    """Each partition adapts weights online over its tokens; the model takes their means, by how often each gate was used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, step, counts = Mixer(), 0, _received(table.value)
        for batch, tokens in runs(batches, 0):
            times, at = batch.column(1).to_numpy(), 0
            while at < len(tokens):
                stop = at + FIRST_STEP + 5 * step
                mixer.learn(counts, tokens[at:stop], RATE / (1 + step / 100), step >= LATER, times[at:stop])
                at, step = stop, step + 1
        yield _part(0, np.concatenate([(mixer.weights * mixer.weights_seen[:, None]).ravel(), mixer.weights_seen, mixer.refined.ravel()]))

    mixed_up = vocabulary.where("n > 0").select("token", "times").sortWithinPartitions(F.xxhash64("token"))  # not in alphabetical order
    sums = _summed(mixed_up.mapInArrow(run, PART), 1)
    if 0 not in sums:
        return Mixer()
    total, seen, refined = np.split(sums[0], [GATES * INPUTS, GATES * INPUTS + GATES])
    weights = np.where(seen[:, None] > 0, total.reshape(GATES, INPUTS) / np.maximum(seen, 1)[:, None], FIRST_WEIGHT)
    return Mixer(weights, refined.reshape(-1, 2))


def spelled(vocabulary: DataFrame, table, mixer: Mixer) -> DataFrame:
    """``token``, ``n``, ``spelling``: the log10 probability of the token's bytes."""
    schema = T.StructType([*vocabulary.schema, T.StructField("spelling", T.DoubleType())])
    weights, refined = mixer.weights, mixer.refined

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = Mixer(weights, refined), _received(table.value)
        for batch, tokens in runs(batches, 0):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.log10_of(counts, tokens))], schema.names)

    return vocabulary.mapInArrow(run, schema)


# -- the tree of frequent tokens ----------------------------------------------------------------


def tokens_of(text: str) -> list[bytes]:
    words = text.encode().lower().split()
    words.append(b"")
    return words


@dataclass
class Code:
    """A Huffman tree: the way to each leaf (``start``, ``length``), from the root, as nodes and values. Leaf 0 is the escape."""

    nodes: int
    start: np.ndarray
    length: np.ndarray
    node: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, counts: list[int]) -> Code:
        """The tree of leaves with these counts."""
        leaves = len(counts)
        heap = [(c, k) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        above, side = np.zeros(2 * leaves - 1, np.int64), np.zeros(2 * leaves - 1, np.int64)
        for node in range(leaves, 2 * leaves - 1):
            low, high = heapq.heappop(heap), heapq.heappop(heap)
            above[low[1]] = above[high[1]] = node
            side[high[1]] = 1
            heapq.heappush(heap, (low[0] + high[0], node))
        depth = np.zeros(2 * leaves - 1, np.int64)
        for node in range(2 * leaves - 3, -1, -1):
            depth[node] = depth[above[node]] + 1
        length = depth[:leaves]
        start = length.cumsum() - length
        way, value = np.zeros(length.sum(), np.int64), np.zeros(length.sum(), np.int64)
        leaf = at = np.arange(leaves)
        for back in range(1, int(length.max()) + 1):
            leaf, at = leaf[length[leaf] >= back], at[length[leaf] >= back]
            place = start[leaf] + length[leaf] - back
            way[place], value[place] = above[at] - leaves, side[at]
            at = above[at]
        return cls(leaves - 1, start, length, way, value)


class Decisions:
    """The decisions of a run of tokens: whose they are, node and value, the entries of their contexts, and what the text had."""

    def __init__(self, code: Code, ids: np.ndarray, text: np.ndarray, before: tuple[int, int, int] = (-1, -1, -1), had: np.ndarray | None = None):
        """``ids``: leaves; ``text``: number of each one's text; ``before``: the two ids before the first one in the
        same text (the nearest last) and the last common one, ``had``: zeros and ones of each node there."""
        length = code.length[ids]
        self.owner = np.repeat(np.arange(len(ids)), length)
        within = np.arange(len(self.owner)) - np.repeat(length.cumsum() - length, length)
        place = code.start[ids][self.owner] + within
        self.node, self.value = code.node[place], code.value[place]
        self.depth = np.minimum(within // 2, DEPTHS - 1)
        last, former = np.full(len(ids), -1), np.full(len(ids), -1)
        last[1:] = np.where(text[1:] == text[:-1], ids[:-1], -1)
        former[2:] = np.where(text[2:] == text[:-2], ids[:-2], -1)
        last[:1] = before[1]
        former[:1] = before[0]
        if len(ids) > 1 and text[1] == text[0]:
            former[1] = before[1]
        place, begins = np.arange(len(ids)), np.ones(len(ids), bool)
        begins[1:] = text[1:] != text[:-1]
        at = np.where((last > 0) & (last <= COMMON), place, np.where(begins, place, 0))  # where the last common word is the one before
        common = np.where((last > 0) & (last <= COMMON), last, -1)
        common[:1] = before[2]
        common = common[np.maximum.accumulate(at)]
        self.last = (int(last[-1]), int(ids[-1]), int(ids[-1]) if 0 < ids[-1] <= COMMON else int(common[-1])) if len(ids) else before
        own = self.node.astype(U64) * U64(0x9E3779B97F4A7C15)
        self.entries = []
        for which, key in enumerate((last, last * (1 << 20) + former, common, former)):
            mixed = _mix(key.astype(np.int64).view(U64) * U64(WAYS) + U64(which))[self.owner]
            hashed = _mix(mixed + own) >> U64(64 - WAY_BITS)
            self.entries.append(code.nodes + (which << WAY_BITS) + hashed.view(np.int64))
        # Zeros and ones at the same node earlier in the same text.
        order = np.argsort(text[self.owner] * max(1, code.nodes) + self.node, kind="stable")
        key, ones = (text[self.owner] * max(1, code.nodes) + self.node)[order], self.value[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        head = np.flatnonzero(first)
        sizes = np.diff(np.append(head, len(key)))
        run = ones.cumsum() - ones
        ones_before = run - np.repeat(run[head], sizes)
        all_before = np.arange(len(key)) - np.repeat(head, sizes)
        self.had = np.empty((2, len(key)), np.float32)
        self.had[1, order] = ones_before
        self.had[0, order] = all_before - ones_before
        if had is not None:
            self.had += had[:, self.node]


class TreeMixer:
    """Weights of the predictions in the tree."""

    def __init__(self, weights: np.ndarray | None = None):
        if weights is None:
            weights = np.tile([1.0] + [0.0] * (TREE_INPUTS - 1), (TREE_GATES, 1))
        self.weights = weights.copy()
        self.seen = np.zeros(TREE_GATES)

    def inputs(self, table: np.ndarray, d: Decisions, leave_out: bool) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions: the node's own, then by how much each context moves it. And the gates."""
        x = np.empty((TREE_INPUTS, len(d.node)), np.float32)
        own = d.value.astype(np.float32) if leave_out else np.float32(0)
        other = 1 - own if leave_out else own
        pairs = table.view(np.complex64).ravel()  # zeros and ones are looked up together
        counts = pairs.take(d.node)
        ones, zeros = np.maximum(counts.imag - own, 0) + np.float32(0.5), np.maximum(counts.real - other, 0) + np.float32(0.5)
        p = ones / (ones + zeros)
        x[0] = np.log(ones / zeros)
        known = np.zeros(len(d.node), np.int64)
        for which, entries in enumerate(d.entries):
            counts = pairs.take(entries)
            one, zero = np.maximum(counts.imag - own, 0), np.maximum(counts.real - other, 0)
            x[1 + which] = np.log((one + BACKING * p) / (zero + BACKING * (1 - p))) - x[0]
            if which == 0:
                known = np.where(one + zero == 0, 0, np.where(one + zero < 8, 1, 2))
        zero, one = d.had
        x[-2] = np.log((one + BACKING * p) / (zero + BACKING * (1 - p))) - x[0]
        x[-1] = 0.2
        often = np.searchsorted([3, 15, 63], zero + one, "right")
        return x, (d.depth * 4 + often) * 3 + known

    def _mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return squash(sum(self.weights[:, k].take(gate) * x[k] for k in range(TREE_INPUTS)))

    def learn(self, table: np.ndarray, d: Decisions, rate: float) -> None:
        x, gate = self.inputs(table, d, True)
        p = self._mixed(x, gate)
        seen = np.bincount(gate, minlength=TREE_GATES)
        for k in range(TREE_INPUTS):
            self.weights[:, k] += rate * np.bincount(gate, (d.value - p) * x[k], TREE_GATES) / np.maximum(seen, 20)
        self.seen += seen

    def log10_of(self, table: np.ndarray, d: Decisions) -> np.ndarray:
        """The log10 probability of each decision."""
        x, gate = self.inputs(table, d, False)
        p = np.clip(self._mixed(x, gate), 1e-6, 1 - 1e-6)
        return np.log10(np.where(d.value == 1, p, 1 - p))


def decided(code: Code, texts: list[np.ndarray], room: Callable[[], int]) -> Iterator[tuple[Decisions, np.ndarray]]:
    """The decisions of texts (as leaves) in runs of about ``room()`` tokens, and the number of each decision's text."""
    held: list[int] = []
    size = 0
    for k, ids in enumerate(texts):
        if len(ids) <= RUN_TOKENS:
            held.append(k)
            size += len(ids)
            if size < room():
                continue
        if held:
            text = np.repeat(held, [len(texts[j]) for j in held])
            d = Decisions(code, np.concatenate([texts[j] for j in held]), text)
            yield d, text[d.owner]
            held, size = [], 0
        if len(ids) > RUN_TOKENS:  # what it has had goes on with it
            had = np.zeros((2, code.nodes), np.float32)
            before = (-1, -1, -1)
            for a in range(0, len(ids), RUN_TOKENS):
                part = ids[a : a + RUN_TOKENS]
                d = Decisions(code, part, np.full(len(part), k), before, had)
                before = d.last
                yield d, np.full(len(d.owner), k)
                for v in (0, 1):
                    had[v] += np.bincount(d.node[d.value == v], minlength=code.nodes)
    if held:
        text = np.repeat(held, [len(texts[j]) for j in held])
        d = Decisions(code, np.concatenate([texts[j] for j in held]), text)
        yield d, text[d.owner]


def _training(batches: Iterator[pa.RecordBatch], leaf: dict[bytes, int], code: Code, room: Callable[[], int]) -> Iterator[Decisions]:
    gc.disable()
    for batch in batches:
        for _, texts in text_rows(batch, ["text"], "text", 1_000_000):
            ids = [np.array([leaf.get(w, 0) for w in tokens_of(t)], np.int64) for t in texts]
            for d, _ in decided(code, ids, room):
                yield d


def count_decisions(rows: DataFrame, tree) -> np.ndarray:
    """Zeros and ones of every node, alone and after other words, over all training texts: an array of fixed size.

    A task adds up many input splits, so the number of arrays on their way goes with the cores, not with the corpus.
    """
    entries = tree.value[1]["nodes"] + (WAYS << WAY_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, code = tree.value[0], Code(**tree.value[1])
        table = np.zeros((entries, 2), np.float32)
        for d in _training(batches, leaf, code, lambda: RUN_TOKENS):
            for place in (d.node, *d.entries):
                np.add.at(table.reshape(-1), place * 2 + d.value, np.float32(1))
        for k in range(0, entries, CHUNK):
            if table[k : k + CHUNK].any():
                yield _part(k // CHUNK, table[k : k + CHUNK])

    training = rows.where("NOT held_out").select("text").coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    sums = _summed(training.mapInArrow(count, PART), -(-entries // CHUNK))
    table = np.zeros((entries, 2), np.float32)
    for k, part in sums.items():
        table[k * CHUNK : (k + 1) * CHUNK] = part.reshape(-1, 2)
    return table


def learn_tree(rows: DataFrame, tree, table) -> TreeMixer:
    """Each partition adapts weights online over its texts; the model takes their means, by how often each gate was used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, code = tree.value[0], Code(**tree.value[1])
        mixer, step, counts = TreeMixer(), 0, _received(table.value)
        for d in _training(batches, leaf, code, lambda: min(RUN_TOKENS, FIRST_TOKENS + 20 * step)):
            mixer.learn(counts, d, TREE_RATE / (1 + step / 100))
            step += 1
        yield _part(0, np.concatenate([(mixer.weights * mixer.seen[:, None]).ravel(), mixer.seen]))

    sums = _summed(rows.where("NOT held_out").select("text").mapInArrow(run, PART), 1)
    if 0 not in sums:
        return TreeMixer()
    total, seen = np.split(sums[0], [TREE_GATES * TREE_INPUTS])
    return TreeMixer(np.where(seen[:, None] > 0, total.reshape(TREE_GATES, TREE_INPUTS) / np.maximum(seen, 1)[:, None], TreeMixer().weights))


# -- scores -------------------------------------------------------------------------------------


def escaped(words: DataFrame, escapes: int) -> Column:
    """The log10 probability of a token after an escape: from the list of words seen, or spelled. The share of
    the list is adapted so that training tokens, each left out of the counts once, are explained best."""
    spelling = F.pow(F.lit(10.0), F.greatest(F.col("spelling"), F.lit(-300.0)))
    share = 0.5
    for _ in range(SHARE_ROUNDS):
        listed = F.lit(share / max(1, escapes - 1)) * (F.col("n") - 1)
        found = words.where("n > 0").agg(F.sum(F.col("n") * listed / (listed + F.lit(1 - share) * spelling)), F.sum("n")).first()
        share = min(max((found[0] or 0.0) / max(1, found[1] or 0), 1e-4), 1 - 1e-4)
    return F.when(F.col("n") > 0, F.log10(F.lit(share / escapes) * F.col("n") + F.lit(1 - share) * spelling)).otherwise(F.col("spelling") + F.lit(float(np.log10(1 - share))))


def held_out(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", held: Column | None = None) -> DataFrame:
    """One row per input row: ``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score``, ``bits_per_byte``.

    Learns from the rows that are not held out (by default those whose crc32 of the key is not 2
    modulo 7; a NULL key is taken as empty). NULL and empty texts are an end alone. Repeated rows
    count and score each time. Without training rows every token is spelled by untrained weights.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), or_empty(text).alias("text"), (held_out(key) if held is None else held).alias("held_out"))
    vocabulary = written(count_tokens(rows), "vocabulary")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0))).first()
    small = F.octet_length("token") <= HELD_BYTES
    coded = small & (F.col("n") >= F.lit(max(LEAST_CODED, _least_held(vocabulary.where(small), CODED_TOKENS))))
    leaves = sorted((-r["n"], bytes(r["token"])) for r in vocabulary.where(coded).select("token", "n").collect())
    escapes = max(1, total + sum(n for n, _ in leaves))
    tree = spark.sparkContext.broadcast(({t: k for k, (_, t) in enumerate(leaves, 1)}, vars(Code.of([escapes, *[-n for n, _ in leaves]]))))
    counts = spark.sparkContext.broadcast(_sent(count_decisions(rows, tree)))
    mixer = learn_tree(rows, tree, counts)
    weighed = vocabulary.withColumn("times", F.when(coded, F.lit(1)).otherwise(F.greatest(F.col("n"), F.lit(1))).cast("long"))
    table = spark.sparkContext.broadcast(_sent(count_bits(weighed)))
    words = written(spelled(vocabulary, table, learn_mixer(weighed, table)), "spelled")
    words = written(words.withColumn("spelling", F.when(coded, 0.0).otherwise(escaped(words.where(~coded), escapes))), "words")
    base = F.log10((F.col("n") + 1) / F.lit(float(total + distinct + 1)))
    in_memory = coded | (small & (F.col("n") >= _least_held(words.where(small), HELD_TOKENS)))
    held_words = words.where(in_memory).select("token", base.alias("base"), "spelling").collect()
    known = spark.sparkContext.broadcast(({bytes(r["token"]): k for k, r in enumerate(held_words)}, np.array([r["base"] for r in held_words], float), np.array([r["spelling"] for r in held_words], float)))
    parts = written(_parts(rows, known, tree, counts, mixer), "parts")
    joined = parts.where("token IS NOT NULL").select("row", "token", "times").join(words.where(~in_memory), "token")
    joined = joined.select("row", "times", (F.col("n") > 0).alias("is_known"), base.alias("base"), "spelling")
    more = joined.groupBy("row").agg(
        F.sum(F.when(F.col("is_known"), F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.col("base")).alias("more_base"), F.sum(F.col("times") * F.col("spelling")).alias("more_score")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = parts.where("token IS NULL").join(more, "row", "left").withColumn("score", F.col("score") + zero("more_score"))
    return out.select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("n_known") + zero("more_known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base")).alias("base_score"), "score", (-F.col("score") / F.log10(F.lit(2.0)) / F.greatest(F.lit(1), F.col("n_bytes"))).alias("bits_per_byte"),
    )


def _least_held(words: DataFrame, room: int) -> int:
    """How often a token must be there so that at most ``room`` are that frequent."""
    often = words.where("n > 0").groupBy("n").count().orderBy(F.desc("n")).limit(room).collect()
    least = None
    for n, count in often:
        if count > room:
            break
        least, room = n, room - count
    return least if least is not None else 2**62


def _parts(rows: DataFrame, known, tree, counts, mixer: TreeMixer) -> DataFrame:
    """For each text one row with the sums over its decisions and its held tokens, and one for each other token with how often it is there."""
    key = rows.schema["key"]
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()), T.StructField("key", key.dataType), T.StructField("held_out", T.BooleanType()), T.StructField("token", T.BinaryType()), T.StructField("times", T.IntegerType()),
            T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType()),
        ]
    )
    weights = mixer.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        held, base, spelling = known.value
        leaf, code = tree.value[0], Code(**tree.value[1])
        model, table = TreeMixer(weights), _received(counts.value)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for kept, texts in text_rows(batch, ["key", "held_out"], "text", 1_000_000):
                first, sums, scores, ids, tokens, times, owners = row, [], [], [], [], [], []
                for t in texts:
                    words = tokens_of(t)
                    found = list(map(held.get, words))
                    at = np.array([k for k in found if k is not None], np.int64)
                    if len(at) < len(words):
                        other = Counter(w for w, k in zip(words, found, strict=True) if k is None)
                        tokens += other
                        times += other.values()
                        owners += [row] * len(other)
                    ids.append(np.array([leaf.get(w, 0) for w in words], np.int64))
                    sums.append((len(words), len(t.encode()), len(at), base[at].sum()))
                    scores.append(spelling[at].sum())
                    row += 1
                n_tokens, n_bytes, n_known, bases = zip(*sums, strict=True)
                n, m = len(texts), len(tokens)
                for d, text in decided(code, ids, lambda: RUN_TOKENS):
                    scores += np.bincount(text, model.log10_of(table, d), n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(first, row), pa.int64()), kept.column(0), kept.column(1), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.array(n_tokens, pa.int64()), pa.array(n_bytes, pa.int64()),
                        pa.array(n_known, pa.int64()), pa.array(bases, pa.float64()), pa.array(scores, pa.float64()),
                    ],
                    schema.names,
                )
                if m:
                    nulls = [pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.nulls(m, kept.column(0).type), pa.nulls(m, pa.bool_()), pa.array(tokens, pa.binary()), pa.array(times, pa.int32()), *nulls], schema.names)

    return rows.select("key", "held_out", "text").mapInArrow(run, schema)
