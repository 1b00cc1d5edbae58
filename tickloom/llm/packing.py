"""Lexical retrieval packing: windows of token ids filled with documents that read alike.

Documents are sorted by their heaviest terms, with weights by counts over the whole corpus, so that
like ones come together, and are taken in that order in shards of a bounded number of documents and
ids. A shard has a BM25 inverted index over token ids, with the corpus's document counts and mean
length. A seed document fills its window with its best unused neighbours; the one that does not fit
is cut, and its rest is the next seed. What is left at the end of a shard is cut into powers of two, which
need no padding.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_rows, written
from .tokens import DEFAULT_VOCABULARY, id_bound, word_bpe

WINDOW = 2048
#: A shard is closed at this many documents or ids, whichever comes first.
SHARD_DOCS = 2048
SHARD_IDS = 4_000_000
#: A document is dealt to a shard by its terms of largest BM25 weight, the commonest of them first.
QUERY_TERMS = 16
#: Terms that more than one in so many documents of a shard have are held as rows of weights, up to so many bytes.
DENSE, DENSE_BYTES = 16, 12 << 20
#: So many neighbours are put in order first.
FIRST_BEST = 16
#: Documents whose terms are counted together, and about how many ids these have at most.
BATCH_DOCS, BATCH_IDS = 256, 400_000
#: Characters that are encoded together, scaled as the memory for known words is.
BATCH_CHARS = 2_400_000
K1, B = 1.2, 0.75
#: Sequence ids are the partition's number times this, plus a counter.
PER_PARTITION = 1 << 36


def term_counts(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents whose ids lie in a row: how many distinct ids each has, and these, in order, with how often each is there."""
    narrow = ids.dtype.itemsize == 2 and len(lengths) <= 1 << 16
    kind, shift = (np.uint32, 16) if narrow else (np.uint64, 32)
    keys = np.repeat(np.arange(len(lengths), dtype=kind) << kind(shift), lengths)
    keys |= ids
    keys.sort()
    first = np.ones(len(keys) + 1, bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:-1])
    at = np.flatnonzero(first)
    keys = keys[at[:-1]]
    return np.bincount((keys >> kind(shift)).astype(np.int64), minlength=len(lengths)), (keys & kind((1 << shift) - 1)).astype(ids.dtype), np.diff(at)


def lengths_of(docs: list[np.ndarray]) -> np.ndarray:
    return np.fromiter(map(len, docs), np.int64, len(docs))


def runs_of(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Documents in runs of a bounded number of documents and ids (a longer document stands alone)."""
    ends = lengths.cumsum()
    a = 0
    while a < len(lengths):
        room = ends[a] - lengths[a] + BATCH_IDS
        b = min(a + BATCH_DOCS, max(a + 1, int(np.searchsorted(ends, room, "right"))), len(lengths))
        yield a, b
        a = b


class Corpus:
    """How many documents there are, their mean length, and how many have each term."""

    def __init__(self, n: int, mean: float, df: np.ndarray):
        self.n, self.mean, self.df = n, mean, df
        self.idf = np.where(df > 1, np.log1p((n - df + 0.5) / (df + 0.5)), 0)  # one: nobody else has it
        self.rank = np.empty(len(df), ">u4")
        self.rank[np.argsort(-df, kind="stable")] = np.arange(len(df))

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Corpus:
        return cls(len(docs), float(np.mean([len(d) for d in docs])), np.bincount(np.concatenate([np.unique(d) for d in docs])))

    def weights(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray | float) -> np.ndarray:
        return self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))

    def places(self, docs: list[np.ndarray]) -> list[bytes]:
        """Where each document stands in the order of all: the ranks of its heaviest terms, the commonest first."""
        length = lengths_of(docs)
        sizes, term, tf = term_counts(np.concatenate(docs), length)
        light, rank = -self.weights(term, tf, np.repeat(length, sizes).astype(float)), self.rank[term]
        out, start = [], 0
        for stop in sizes.cumsum().tolist():
            best = light[start:stop].argsort(kind="stable")[:QUERY_TERMS] + start
            out.append(np.sort(rank[best[light[best] < 0]]).tobytes())
            start = stop
        return out


class Index:
    """BM25 over the documents of a shard; terms are token ids. Without a corpus the shard is one."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None):
        n = len(docs)
        length = lengths_of(docs)
        sizes, term, tf = term_counts(np.concatenate(docs), length)
        doc = np.repeat(np.arange(n), sizes)
        df = np.bincount(term)
        weight = (corpus or Corpus.of(docs)).weights(term, tf, length.astype(float)[doc])
        self.n, self.docs, self.starts = n, np.arange(n), np.concatenate([[0], sizes.cumsum()])
        self.term, self.weight = term, weight
        order = np.argsort(term, kind="stable")
        self.posting_doc, self.posting_weight = doc[order], weight[order]
        self.posting_at = np.concatenate([[0], df.cumsum()])
        # The commonest terms are rows of weights over all documents, which are added up faster than postings.
        common = np.argsort(-df, kind="stable")[: DENSE_BYTES // (4 * max(1, n))]
        common = common[df[common] * DENSE > n]
        self.row_of, self.wanted = np.full(len(df), -1), np.zeros(len(df), bool)
        self.row_of[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), n), np.float32)
        for k, t in enumerate(common.tolist()):
            at = slice(self.posting_at[t], self.posting_at[t + 1])
            self.rows[k, self.posting_doc[at]] = self.posting_weight[at]

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best first; ties by place."""
        return np.fromiter(self.best_first(seed, unused), np.int64)

    def best_first(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """The neighbours one by one. Rough scores tell which are looked at first, exact ones put them in order."""
        a, b = self.starts[seed], self.starts[seed + 1]
        terms = self.term[a:b][self.weight[a:b] > 0]
        if not len(terms):
            return
        docs, rough = self._rough(terms, unused)
        most, rounding = FIRST_BEST, 1e-6 + len(terms) * 2.0**-22
        while len(docs):
            bound = float(np.partition(rough, -most)[-most]) if len(docs) > 2 * most else 0.0
            near = np.flatnonzero(rough >= bound)
            scores = self._exact(terms, docs[near])
            sure = scores >= bound * (1 + rounding)  # nothing else can come before these
            yield from docs[near[sure]][np.argsort(-scores[sure], kind="stable")].tolist()
            left = np.ones(len(docs), bool)
            left[near[sure]] = False
            docs, rough, most = docs[left], rough[left], 8 * most

    def _rough(self, terms: np.ndarray, unused: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unused documents that have one of the terms, by place, and their scores in 32 bits."""
        if 5 * np.count_nonzero(unused) < 4 * self.n:
            self._drop(unused)
        row = self.row_of[terms]
        rare = terms[row < 0]
        start = self.posting_at[rare]
        size = self.posting_at[rare + np.int64(1)] - start
        at = np.repeat(start - (size.cumsum() - size), size)
        at += np.arange(len(at))
        scores = np.bincount(self.posting_doc[at], self.posting_weight[at], self.n).astype(np.float32)
        scores += np.add.reduce(self.rows.take(row[row >= 0], axis=0), axis=0)
        found = np.flatnonzero((scores > 0) & unused[self.docs])
        return self.docs[found], scores[found]

    def _exact(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The scores of documents: sums over the terms in order."""
        size = self.starts[docs + 1] - self.starts[docs]
        at = np.repeat(self.starts[docs] - (size.cumsum() - size), size)
        at += np.arange(len(at))
        self.wanted[terms] = True
        held = np.flatnonzero(self.wanted[self.term[at]])
        self.wanted[terms] = False
        return np.bincount(np.repeat(np.arange(len(docs)), size)[held], self.weight[at[held]], len(docs))

    def _drop(self, unused: np.ndarray) -> None:
        """Used documents go from the postings and rows; ``docs`` are those that are left."""
        left = unused[self.docs]
        held = left[self.posting_doc]
        self.posting_at = np.concatenate([[0], held.cumsum()])[self.posting_at]
        self.posting_doc, self.posting_weight = (left.cumsum() - 1)[self.posting_doc[held]], self.posting_weight[held]
        self.rows, self.docs = self.rows.take(np.flatnonzero(left), axis=1), self.docs[left]
        self.n = len(self.docs)


def plan(docs: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces of a shard: (document, start, length, sequence, offset). Every id is in one piece."""
    index = Index(docs, corpus)
    unused = np.ones(len(docs), bool)
    pieces: list[list[int]] = []
    fill, sequence, next_free = 0, 0, 0

    def put(doc: int, start: int) -> int:
        """Add the rest of a document up to the end of the window; where it stopped."""
        nonlocal fill, sequence
        length = min(len(docs[doc]) - start, window - fill)
        pieces.append([doc, start, length, sequence, fill])
        fill += length
        if fill == window:
            fill, sequence = 0, sequence + 1
        return start + length

    seed, at = -1, 0
    while True:
        if seed < 0:  # no rest of a cut document: the next unused one is the seed
            while next_free < len(docs) and not unused[next_free]:
                next_free += 1
            if next_free == len(docs):
                break
            seed, at = next_free, 0
            unused[seed] = False
        while at < len(docs[seed]):
            at = put(seed, at)
        last, seed = seed, -1
        if fill:
            for other in index.best_first(last, unused):
                unused[other] = False
                stop = put(other, 0)
                if not fill:
                    if stop < len(docs[other]):
                        seed, at = other, stop
                    break
    if fill:  # the last window of the shard: runs of powers of two
        tail = [p for p in pieces if p[3] == sequence]
        del pieces[len(pieces) - len(tail) :]
        room, offset = 1 << (fill.bit_length() - 1), 0
        left = fill
        for doc, start, length, _, _ in tail:
            while length:
                take = min(length, room - offset)
                pieces.append([doc, start, take, sequence, offset])
                start, length, offset, left = start + take, length - take, offset + take, left - take
                if offset == room:
                    sequence, offset = sequence + 1, 0
                    room = 1 << (left.bit_length() - 1) if left else 0
    return [tuple(p) for p in pieces]


def id_type(vocabulary: str, end_id: int) -> str:
    """16 bits for the ids that are written and dealt if the vocabulary and the end id allow, else 32."""
    return "<u2" if max(id_bound(vocabulary), end_id + 1) <= 1 << 16 else "<u4"


def as_ids(docs: DataFrame, key: str, text: str, end_id: int, vocabulary: str, cache_share: float, narrow: str) -> DataFrame:
    """``key``, ``ids`` (unsigned, little-endian, of type ``narrow``; closed by the end id), ``row`` (a number of its own).

    Each task adds one row without ids and number, but with ``df``: how many of its documents have each id (unsigned 32-bit).
    """
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("ids", T.BinaryType()), T.StructField("row", T.LongType()), T.StructField("df", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, width = word_bpe(vocabulary, cache_share), np.dtype(narrow).itemsize
        gc.disable()
        row, df, key_type = TaskContext.get().partitionId() * PER_PARTITION, np.zeros(0, np.int64), pa.null()
        for batch in batches:
            key_type = batch.schema.field(0).type
            for rows, texts in text_rows(batch, ["key"], "__text", int(BATCH_CHARS * cache_share)):
                found, ends = bpe.encode_all(texts, narrow)
                closed = np.insert(found, ends, end_id)
                bounds = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
                for a, b in runs_of(np.diff(bounds)):
                    at = bounds[a : b + 1]
                    more = np.bincount(term_counts(closed[at[0] : at[-1]], np.diff(at))[1])
                    if len(more) > len(df):
                        df, more = more, df
                    df[: len(more)] += more
                ids = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(closed)])
                yield pa.RecordBatch.from_arrays([rows.column(0), ids, pa.array(range(row, row + len(texts)), pa.int64()), pa.nulls(len(texts), pa.binary())], schema.names)
                row += len(texts)
        if len(df):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, key_type), pa.array([b""]), pa.nulls(1, pa.int64()), pa.array([df.astype("<u4").tobytes()])], schema.names)

    return docs.select(F.col(key).alias("key"), F.col(text).alias("__text")).mapInArrow(run, schema)


def corpus_of(rows: DataFrame, narrow: str) -> tuple[Corpus, int]:
    """The corpus of all documents, and how many ids it has. Its size is the vocabulary's."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                more = np.frombuffer(raw.as_py(), "<u4").astype(np.int64)
                if len(more) > len(df):
                    df, more = more, df
                df[: len(more)] += more
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(df[term], pa.int64())], ["term", "df"])

    n, total = rows.agg(F.count("row"), F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()
    counts = rows.where("df IS NOT NULL").select("df").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(max([0, *counts["term"].to_pylist()]) + 1, np.int64)
    df[counts["term"].to_numpy()] = counts["df"].to_numpy()
    total //= np.dtype(narrow).itemsize
    return Corpus(n, total / max(1, n), df), total


def in_order(rows: DataFrame, corpus, shards: int, narrow: str) -> DataFrame:
    """The rows in ranges of their places. Equal places are parted by the row's number, so none is too large for a range."""
    schema = T.StructType([*rows.schema, T.StructField("place", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(raw.as_py(), narrow) for raw in batch.column(1)]
            places = [p for a, b in runs_of(lengths_of(ids)) for p in corpus.value.places(ids[a:b])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.binary())], schema.names)

    return rows.mapInArrow(run, schema).repartitionByRange(shards, "place", "row").sortWithinPartitions("place", "row")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", end_id: int = 1, window: int = WINDOW, vocabulary: str = DEFAULT_VOCABULARY, cache_share: float = 1.0) -> DataFrame:
    """One row per piece: the key, ``start``, ``length``, ``ids`` (unsigned 32-bit, little-endian),
    ``doc_tokens``, ``sequence_id``, ``offset``.

    Every row is a document: its ids, then the end id; NULL and empty texts are the end id alone.
    Sequences are full windows but for the powers of two at the end of a shard. An empty table
    gives no rows. Repeated rows are documents of their own. ``cache_share`` scales the memory for known words and what is encoded together.
    """
    schema = T.StructType(
        [docs.schema[key]] + [T.StructField(n, t) for n, t in (("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()))]
    )
    narrow = id_type(vocabulary, end_id)
    rows = written(as_ids(docs, key, text, end_id, vocabulary, cache_share, narrow), "ids")
    found, total = corpus_of(rows, narrow)
    rows = rows.where("row IS NOT NULL").drop("df")
    corpus = docs.sparkSession.sparkContext.broadcast(found)
    shards = max(1, -(-found.n // SHARD_DOCS), -(-total // SHARD_IDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_bpe.cache_clear()  # a worker that has encoded texts no longer needs its caches
        gc.disable()
        first = TaskContext.get().partitionId() * PER_PARTITION
        kept: list[pa.RecordBatch] = []
        ids: list[np.ndarray] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal first
            keys = pa.Table.from_batches(kept).column(0).combine_chunks()
            pieces = np.array(plan(ids, window, corpus.value), np.int64)
            for a in range(0, len(pieces), 2000):
                doc, start, length, sequence, offset = pieces[a : a + 2000].T
                raw = [ids[d][s : s + n].astype("<u4").tobytes() for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
                sizes = np.array([len(ids[d]) for d in doc.tolist()], np.int64)
                columns = [keys.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(raw, pa.binary()), pa.array(sizes), pa.array(sequence + first), pa.array(offset)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)
            first += int(pieces[-1][3]) + 1

        for batch in batches:
            at = 0
            for k, raw in enumerate(batch.column(1)):
                ids.append(np.frombuffer(raw.as_py(), narrow))
                size += len(ids[-1])
                if len(ids) == SHARD_DOCS or size >= SHARD_IDS:
                    kept.append(batch.select([0]).slice(at, k + 1 - at))
                    at = k + 1
                    yield from close()
                    kept, ids, size = [], [], 0
            if at < batch.num_rows:
                kept.append(batch.select([0]).slice(at))
        if ids:
            yield from close()

    return in_order(rows, corpus, shards, narrow).select("key", "ids").mapInArrow(run, schema)


def digest(docs: DataFrame, cache_share: float = 1.8) -> DataFrame:
    return pack(docs, cache_share=cache_share).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
