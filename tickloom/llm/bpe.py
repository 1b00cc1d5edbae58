"""Byte-level BPE with the ranks of a vocabulary file.

Texts are cut at single spaces; each distinct chunk is split by the published pattern once, and
its pieces are merged together with those of other chunks: pieces of similar length are the rows
of one padded matrix, and in every round each row merges its leftmost pair of lowest rank. Pair
ranks come from an open-addressing table; rows that are finished leave the matrix.
"""

from __future__ import annotations

import base64
import gc
import heapq
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_rows

DEFAULT_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Longest piece in bytes of each bucket of matrix rows; longer pieces are merged with a heap.
WIDTHS = (4, 8, 12, 16, 24, 32, 64)
WIDTH_OF = [next(w for w in WIDTHS if n <= w) for n in range(WIDTHS[-1] + 1)]
MATRIX_ROWS = 1 << 15
CACHE_CHUNKS = 300_000
#: Marks that the pattern cuts off after a run of letters.
MARKS = frozenset(".,;:!?")
NONE = np.int32(2**31 - 1)


class PairTable:
    """Rank of the merge of two token ids: linear probing over a power-of-two table."""

    def __init__(self, ranks: dict[bytes, int]):
        found: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        self.bits = max(4, (len(found) * 6).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        keys = np.fromiter(found, np.int64, len(found))
        values = np.fromiter(found.values(), np.int32, len(found))
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]  # of several for one slot, one stays
            won = self.keys[slot] == keys
            self.ranks[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; padding (-1) on either side gives NONE."""
        shape = left.shape
        real = ((left >= 0) & (right >= 0)).ravel()
        out = np.full(real.shape, NONE, np.int32)
        where = np.flatnonzero(real)
        keys = left.ravel()[where].astype(np.int64) << 32 | right.ravel()[where].astype(np.int64)
        slot = self._slot(keys)
        while len(keys):
            seen = self.keys[slot]
            hit = seen == keys
            out[where[hit]] = self.ranks[slot[hit]]
            on = ~hit & (seen != -1)
            where, keys, slot = where[on], keys[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out.reshape(shape)


class ByteBpe:
    """Encodes and decodes texts; ids travel as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces_of = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.words = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.words[rank] = token
        self.inner: dict[str, bytes | None] = {}  # chunks after a space
        self.head: dict[str, bytes | None] = {}  # chunks at the start of a text

    @cached_property
    def pairs(self) -> PairTable:
        return PairTable(self.ranks)  # decoding does without

    # -- pieces -------------------------------------------------------------------------------

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        buckets: dict[int, list[tuple[str, bytes]]] = {w: [] for w in WIDTHS}
        for p in pieces:
            raw = p.encode()
            if (whole := self.ranks.get(raw)) is not None:
                out[p] = whole.to_bytes(4, "little")
            elif len(raw) > WIDTHS[-1]:
                out[p] = self._merge_long(raw)
            else:
                buckets[WIDTH_OF[len(raw)]].append((p, raw))
        for width, rows in buckets.items():
            for at in range(0, len(rows), MATRIX_ROWS):
                part = rows[at : at + MATRIX_ROWS]
                out.update(zip((p for p, _ in part), self._merge_matrix([raw for _, raw in part], width), strict=True))
        return out

    def _merge_matrix(self, rows: list[bytes], width: int) -> list[bytes]:
        result: list[bytes] = [b""] * len(rows)
        padded = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
        length = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.where(np.arange(width) < length[:, None], self.first[padded], np.int32(-1))
        rank = self.pairs(ids[:, :-1], ids[:, 1:])
        place = np.arange(len(rows))
        while len(place):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(place), np.int64)
            best = rank[np.arange(len(place)), at] if rank.shape[1] else np.full(len(place), NONE)
            done = best == NONE
            if done.any():
                ended = ids[done]
                counts = (ended >= 0).sum(axis=1) * 4
                flat = ended[ended >= 0].astype("<u4").tobytes()
                stops = counts.cumsum()
                for k, a, b in zip(place[done].tolist(), (stops - counts).tolist(), stops.tolist(), strict=True):
                    result[k] = flat[a:b]
                going = ~done
                place, ids, rank, at, best = place[going], ids[going], rank[going], at[going], best[going]
                if not len(place):
                    break
            n, w = ids.shape
            row = np.arange(n)
            ids[row, at] = best
            stay = np.ones((n, w), bool)
            stay[row, at + 1] = False
            ids = ids[stay].reshape(n, w - 1)  # the right id of the pair goes: every row loses one place
            stay = np.ones((n, w - 1), bool)
            stay[row, np.minimum(at + 1, w - 2)] = False
            last = at + 1 > w - 2  # the pair was the last one of the row
            stay[last, w - 2] = False
            rank = rank[stay].reshape(n, w - 2)
            right = np.minimum(at + 1, w - 2)
            fresh = self.pairs(ids[row, at], np.where(at + 1 <= w - 2, ids[row, right], np.int32(-1)))
            has = at < w - 2
            rank[row[has], at[has]] = fresh[has]
            has = at > 0
            rank[row[has], at[has] - 1] = self.pairs(ids[row[has], at[has] - 1], ids[row[has], at[has]])
        return result

    def _merge_long(self, raw: bytes) -> bytes:
        """The same merges for one long piece, in n log n steps."""
        ids = self.first[np.frombuffer(raw, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        arr = np.array(ids, np.int32)
        ranks = self.pairs(arr[:-1], arr[1:]).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        words, lookup = self.words, self.ranks.get
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the two has changed since
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                k = after[j]
                if (s := lookup(words[r] + words[ids[k]])) is not None:
                    heapq.heappush(heap, (s, i, r, ids[k]))
            if (k := before[i]) >= 0 and (s := lookup(words[ids[k]] + words[r])) is not None:
                heapq.heappush(heap, (s, k, ids[k], r))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    # -- texts --------------------------------------------------------------------------------

    def encode(self, texts: list[str]) -> list[bytes]:
        """A chunk between single spaces splits the same in every text if neither of its ends is white space."""
        cut = [t.split(" ") for t in texts]
        self._learn(self.head, {c[0] for c in cut}, "")
        every: set[str] = set()
        for c in cut:
            every.update(c)
        self._learn(self.inner, every, " ")
        inner, head = self.inner.__getitem__, self.head
        out: list[bytes] = []
        whole: dict[int, list[str]] = {}
        for k, chunks in enumerate(cut):
            try:
                out.append(b"".join([head[chunks[0]], *map(inner, chunks[1:])]))
            except TypeError:  # white space beside a space: split the whole text
                out.append(b"")
                whole[k] = self.pieces_of(texts[k])
        if whole:
            ids = self.encode_pieces({p for pieces in whole.values() for p in pieces}).__getitem__
            for k, pieces in whole.items():
                out[k] = b"".join(map(ids, pieces))
        return out

    def _learn(self, cache: dict[str, bytes | None], chunks: set[str], lead: str) -> None:
        if len(cache) > CACHE_CHUNKS:
            cache.clear()
        fresh: dict[str, list[str]] = {}
        for c in chunks.difference(cache):
            if c.isalpha():
                fresh[c] = [lead + c]
            elif not c and not lead:
                cache[c] = b""
            elif not c or c[0].isspace() or c[-1].isspace():
                cache[c] = None
            elif c[-1] in MARKS and c[:-1].isalpha():
                if known := cache.get(c[:-1]):
                    cache[c] = known + self.ranks[c[-1].encode()].to_bytes(4, "little")
                else:
                    fresh[c] = [lead + c[:-1], c[-1]]
            else:
                fresh[c] = self.pieces_of(lead + c)
        ids = self.encode_pieces({p for pieces in fresh.values() for p in pieces})
        for c, pieces in fresh.items():
            cache[c] = ids[pieces[0]] if len(pieces) == 1 else b"".join([ids[p] for p in pieces])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ranks: str = DEFAULT_RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The kept columns and ``ids`` (binary, unsigned 32-bit little-endian), one row per input row.

    NULL and empty texts give no ids. Special tokens in a text are ordinary text. Repeated rows
    give repeated rows. No shuffle; a worker holds a few MB of text and a bounded chunk cache.
    """
    names = list(keep)
    schema = T.StructType([*docs.select(*names).schema, T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks, pattern)
        gc.disable()  # nothing here is cyclic, and full collections would walk the chunk cache
        for batch in batches:
            for kept, texts in text_rows(batch, names, "__text", 2_000_000):
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(bpe.encode(texts), pa.binary())], [*names, "ids"])

    return docs.select(*names, F.col(text).alias("__text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str = "ids", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """All columns and ``decoded``, the bytes that the ids stand for (NULL ids: no bytes)."""
    schema = T.StructType([*encoded.schema, T.StructField("decoded", T.BinaryType())])
    pattern = public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raw = [bpe.decode(x or b"") for x in part.column(part.schema.get_field_index(ids)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def hex_sha256(column: str) -> Column:
    return F.sha2(F.col(column), 256)


def round_trip(docs: DataFrame) -> DataFrame:
    """Encode every whole text, decode the ids, and give the digests of both."""
    both = decode(encode(docs))
    return both.select(
        "doc_id", F.expr("CAST(octet_length(ids) / 4 AS BIGINT)").alias("n_tokens"),
        hex_sha256("ids").alias("ids_sha256"), hex_sha256("decoded").alias("decoded_sha256"),
    )
