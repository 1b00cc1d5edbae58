"""Token ids of the lower-casing word vocabulary, by the tokenizers library.

White space never is part of a token there, so a text is the sequence of its chunks between ASCII
white space, and each distinct chunk is encoded once per worker while its cache has room. Chunks of common Latin letters go
to the library's BPE model piece by piece; any other chunk goes through the whole library call. A text of
such chunks alone is lower-cased first, so that a word has one chunk in either case.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

DEFAULT_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Bytes that a worker holds of known chunks and pieces, each counted with what Python adds to it.
CHUNK_BYTES, PIECE_BYTES, ENTRY_BYTES = 144 << 20, 16 << 20, 180
#: Marks that the pattern cuts off after a run of letters.
MARKS = frozenset(".,;:!?")
MARK_BYTES = frozenset(m.encode() for m in MARKS)
#: Characters that the vocabulary's normalizer only lower-cases, one by one.
SIMPLE = re.compile("[\x21-\x7eÀ-ÖØ-öø-įı-ňŊ-ž]+")
SIMPLE_TEXT = re.compile("[\t-\r \x21-\x7eÀ-ÖØ-öø-įı-ňŊ-ž]*")
#: The pattern of the vocabulary file (a fixed value).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else one from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in prints]
    return {b: b for b in prints} | {b: 256 + k for k, b in enumerate(other)}


class _Known(dict):
    """Ids of known chunks; an unknown one is handed to ``learn``."""

    def __init__(self, learn: Callable[[bytes], bytes]):
        super().__init__()
        self.learn = learn

    def __missing__(self, chunk: bytes) -> bytes:
        return self.learn(chunk)


class WordBpe:
    """``cache_share`` scales the bytes that are held of known chunks and pieces."""

    def __init__(self, path: str, cache_share: float = 1.0):
        self.most_chunk_bytes, self.most_piece_bytes = CHUNK_BYTES * cache_share, PIECE_BYTES * cache_share
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = _byte_letters()
        self.chunks = _Known(self._learn)
        self.pieces: dict[str, bytes] = {}
        self.chunk_bytes = self.piece_bytes = 0

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if SIMPLE_TEXT.fullmatch(text):
            text = text.lower()
        return b"".join(map(self.chunks.__getitem__, text.encode().split()))

    def encode_all(self, texts: list[str], kind: str = "<u4") -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts in a row (unsigned, of type ``kind``), and where those of each text end. Each distinct chunk is looked up once."""
        texts = [t.lower() if SIMPLE_TEXT.fullmatch(t) else t for t in texts]
        words = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = words.flatten().dictionary_encode()
        chunks = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        ids = [self.chunks[c] if c else b"" for c in chunks]  # white space at either end of a text gives an empty chunk
        width = np.dtype(kind).itemsize
        starts = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4 * width, out=starts[1:])
        known = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(starts), pa.py_buffer(np.frombuffer(b"".join(ids), "<u4").astype(kind))])
        taken = known.take(coded.indices)
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) // width if len(taken) else np.zeros(1, np.int64)
        found = np.frombuffer(taken.buffers()[2], kind, ends[-1]) if ends[-1] else np.empty(0, kind)
        return found, ends[words.offsets.to_numpy()[1:] - words.offsets[0].as_py()]

    def _learn(self, chunk: bytes) -> bytes:
        if chunk.isalpha() and chunk.islower():  # ASCII letters: a piece by themselves
            ids = self._tokenized(chunk.decode())
        elif chunk[-1:] in MARK_BYTES and chunk[:-1].isalpha():
            ids = self.chunks[chunk[:-1].lower()] + self._piece(chunk[-1:].decode())
        else:
            ids = self._chunk(chunk.decode())
        if self.chunk_bytes > self.most_chunk_bytes:
            self.chunks.clear()
            self.chunk_bytes = 0
        self.chunks[chunk] = ids
        self.chunk_bytes += len(chunk) + len(ids) + ENTRY_BYTES
        return ids

    def _tokenized(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if SIMPLE.fullmatch(chunk):
            low = chunk.lower()
            if low.isalpha():
                return self._piece(low)
            if low[-1] in MARKS and low[:-1].isalpha():
                return self._piece(low[:-1]) + self._piece(low[-1])
            if "<|" not in chunk:
                return b"".join(map(self._piece, PIECES.findall(low)))
        return array("I", self.library.encode(chunk, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        known = self.pieces.get(piece)
        if known is None:
            if self.piece_bytes > self.most_piece_bytes:
                self.pieces.clear()
                self.piece_bytes = 0
            mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            known = self.pieces[piece] = self._tokenized(mapped)
            self.piece_bytes += len(piece) + len(known) + ENTRY_BYTES
        return known


@lru_cache(maxsize=2)
def word_bpe(path: str, cache_share: float = 1.0) -> WordBpe:
    return WordBpe(path, cache_share)


@lru_cache(maxsize=2)
def id_bound(path: str) -> int:
    """All ids of the vocabulary are below it."""
    return 1 + max(Tokenizer.from_file(path).get_vocab().values())
