"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over hashed character n-grams
tells the languages with a 1 from those with a 0: its weight of a gram is the logarithm of the gram's
share in the ones over that in the zeros, every language counting alike, and its margin for a text is
the mean weight of the text's grams. A text's margins are compared with all codewords; each bit's
logistic loss counts by how reliable that classifier was on that language's own training texts. The
word of least loss wins; a text is ambiguous if another one is close.

Up to seven languages get the exhaustive code (every split of the languages is a bit), more get the
best of random codes, by the least distance of two words. Counts and reliabilities are taken over all
training rows. To the driver come a row per language and 65,536 rows of weights, whatever the data.

Defined cases: a text that is NULL or has no letter is ``und`` with score 0; so is every text if there
are no training rows; with one language every other text is that. Texts are used whole; rows without a
label do not train; an empty table has no rows. Other columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

UNDETERMINED = "und"
ORDERS = (1, 2, 3)  #: lengths of grams
BUCKETS = 1 << 16
SMOOTH = 0.5  #: added to every count
SCALE = 10.0  #: of the mean weights, so that the losses of clear and unclear texts differ
EXHAUSTIVE = 7  #: languages up to which every split is a bit
MOST_BITS = 128
TRIED_CODES = 200
CLOSE = 0.5  #: a text is ambiguous if the second least loss exceeds the least by less
RUN_CHARS = 1_000_000  #: characters that a task turns into grams at a time
HELD_LANGUAGES = 64  #: languages that a task counts side by side
GAP = 32  #: a space stands for each run of anything but letters
_MIX = np.uint64(0x9E3779B97F4A7C15)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Grams:
    """The hashed grams of several texts, order by order, and where each text's grams begin."""

    buckets: list[np.ndarray]
    starts: list[np.ndarray]
    sizes: np.ndarray  # grams of each text


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For every code point the lower-case letter that it counts as, or a space."""
    out = np.full(sys.maxunicode + 1, GAP, np.uint64)
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def grams_of(texts: list[str]) -> Grams:
    """Grams of lower-cased words with a space around them; every text needs a letter."""
    given = np.array([len(t) + 2 for t in texts], np.int64)
    codes = letters()[np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    first = np.cumsum(given) - given
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != GAP) | (codes[:-1] != GAP)
    keep[first] = True
    codes, lengths = codes[keep], np.add.reduceat(keep.astype(np.int64), first)
    ends = np.repeat(np.cumsum(lengths), lengths)
    left = ends - np.arange(len(codes))
    out = Grams([], [], np.zeros(len(texts), np.int64))
    value = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        value[: len(codes) - n + 1] = (value[: len(codes) - n + 1] + codes[n - 1 :] + np.uint64(n)) * _MIX
        if n in ORDERS:
            out.buckets.append((value[left >= n] >> np.uint64(48)).astype(np.int64))
            counts = np.maximum(lengths - n + 1, 0)
            out.starts.append(np.cumsum(counts) - counts)
            out.sizes += counts
    return out


def _texts(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None], Grams | None, np.ndarray]]:
    """Runs of rows: the rows, their texts, the grams of those with a letter and which those are."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        at = 0
        for part in slices([t or "" for t in texts], RUN_CHARS):
            known = np.flatnonzero([has_letter(t) for t in part])
            yield batch.slice(at, len(part)), part, grams_of([part[i] for i in known]) if len(known) else None, known
            at += len(part)


# -------------------------------------------------------------------------------- training


def _gram_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def handed_on() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(counts[used])], ["lang", "bucket", "n"]
            )
        held.clear()

    for rows, _, grams, known in _texts(batches, 0):
        if grams is None:
            continue
        langs = rows.column(1).take(pa.array(known)).to_pylist()
        for buckets, starts in zip(grams.buckets, grams.starts):
            stops = [*starts[1:], len(buckets)]
            spans: dict[str, list[np.ndarray]] = {}
            for lang, lo, hi in zip(langs, starts, stops):
                spans.setdefault(lang, []).append(buckets[lo:hi])
            for lang, found in spans.items():
                counts = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                counts += np.bincount(np.concatenate(found), minlength=BUCKETS)
        if len(held) > HELD_LANGUAGES:
            yield from handed_on()
    yield from handed_on()


def codewords(n: int, seed: int = 12) -> np.ndarray:
    """A row of -1 and 1 per language, no two alike."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        splits = np.arange(1, 2 ** (n - 1))  # the last language is always on the zero side
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    bits = min(MOST_BITS, max(15, 10 * int(np.ceil(np.log2(n)))))
    rng = np.random.default_rng(seed)
    best, least = None, -1
    for _ in range(TRIED_CODES):
        words = rng.choice([-1.0, 1.0], (n, bits))
        agree = words @ words.T
        np.fill_diagonal(agree, -bits)
        far = (bits - agree.max()) / 2
        if far > least and (np.abs(words.sum(0)) < n).all():
            best, least = words, far
    if least < 1:
        raise ValueError(f"no code of {bits} bits tells {n} languages apart")
    return best


def _weights(langs: list[str], totals: np.ndarray, code: np.ndarray):
    """Per bucket the weights of all bits, from its counts by language."""
    place = {lang: i for i, lang in enumerate(langs)}
    ones, zeros = (code > 0).astype(float), (code < 0).astype(float)
    ones, zeros = ones / np.maximum(ones.sum(0), 1), zeros / np.maximum(zeros.sum(0), 1)
    whole = totals + SMOOTH * BUCKETS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros((batch.num_rows, len(langs)))
            for row, entries in enumerate(batch.column(1).to_pylist()):
                for e in entries:
                    counts[row, place[e["lang"]]] = e["n"]
            share = (counts + SMOOTH) / whole
            weights = np.log(share @ ones) - np.log(share @ zeros) if len(langs) > 1 else np.zeros((batch.num_rows, code.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(weights.astype(np.float32)), pa.list_(pa.float32()))], ["bucket", "w"])

    return run


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # bits x buckets
    trust: np.ndarray  # languages x bits, rows sum to 1

    def margins(self, grams: Grams) -> np.ndarray:
        out = np.empty((len(grams.sizes), self.code.shape[1]))
        for b, weights in enumerate(self.weights):
            total = np.zeros(len(grams.sizes))
            for buckets, starts in zip(grams.buckets, grams.starts):
                total += np.add.reduceat(weights[buckets], starts, dtype=np.float64)
            out[:, b] = SCALE * total / grams.sizes
        return out

    def losses(self, margins: np.ndarray) -> np.ndarray:
        right, wrong = np.logaddexp(0, -margins), np.logaddexp(0, margins)
        return right @ (self.trust * (self.code > 0)).T + wrong @ (self.trust * (self.code < 0)).T


def _hits(model: Model):
    """Per language and bit: how many training texts have the bit right."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {lang: i for i, lang in enumerate(model.langs)}
        hits, seen = np.zeros(model.code.shape), np.zeros(len(model.langs))
        for rows, _, grams, known in _texts(batches, 0):
            if grams is not None:
                at = np.array([place[x] for x in rows.column(1).take(pa.array(known)).to_pylist()])
                np.add.at(hits, at, model.margins(grams) * model.code[at] > 0)
                np.add.at(seen, at, 1)
        lang = np.repeat(np.arange(len(model.langs)), model.code.shape[1])
        bit = np.tile(np.arange(model.code.shape[1]), len(model.langs))
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang.astype(np.int32)), pa.array(bit.astype(np.int32)), pa.array(hits.ravel()), pa.array(seen[lang])], ["lang", "bit", "hits", "seen"]
        )

    return run


def fit(rows: DataFrame) -> Model:
    """A model of ``text`` and ``lang`` of all rows that have both."""
    train = rows.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = train.mapInArrow(_gram_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).persist()
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    code = codewords(len(langs))
    model = Model(langs, code, np.zeros((code.shape[1], BUCKETS), np.float32), np.full(code.shape, 1 / max(code.shape[1], 1)))
    if len(langs) > 1:
        step = _weights(langs, np.array([totals[x] for x in langs], float), code)
        by_bucket = counts.groupBy("bucket").agg(F.collect_list(F.struct("lang", "n")).alias("counts"))
        for r in by_bucket.mapInArrow(step, "bucket int, w array<float>").collect():
            model.weights[:, r["bucket"]] = r["w"]
        hits = np.zeros(code.shape)
        for r in train.mapInArrow(_hits(model), "lang int, bit int, hits double, seen double").groupBy("lang", "bit").agg(F.sum("hits").alias("h"), F.sum("seen").alias("n")).collect():
            hits[r["lang"], r["bit"]] = (r["h"] + 1) / (r["n"] + 2)
        model.trust = hits / hits.sum(1, keepdims=True)
    counts.unpersist()
    return model


# ------------------------------------------------------------------------------ prediction


def _predicted(model: Model, names: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts, grams, known in _texts(batches, len(names)):
            lang = np.array([UNDETERMINED] * len(texts), object)
            score, gap, close = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if grams is not None and model.langs:
                losses = model.losses(model.margins(grams))
                order = np.argsort(losses, axis=1, kind="stable")
                picked = np.arange(len(known))
                least = losses[picked, order[:, 0]]
                second = losses[picked, order[:, 1]] if len(model.langs) > 1 else np.full(len(known), np.inf)
                odds = np.exp(least[:, None] - losses)
                lang[known] = np.array(model.langs, object)[order[:, 0]]
                score[known] = 1 / odds.sum(1)
                gap[known] = np.minimum(second - least, 1e9)
                close[known] = second - least < CLOSE
            kept = [rows.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score), pa.array(gap), pa.array(close)], [*names, "lang_pred", "score", "gap", "ambiguous"])

    return run


def predict(model: Model, docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns with ``lang_pred``, ``score`` (0 to 1, the winner's share of the odds), ``gap`` (the
    loss by which the second language is behind) and ``ambiguous``. Only the text decides."""
    rows = docs.select(*keep, "text")
    added = "lang_pred string, score double, gap double, ambiguous boolean"
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(_predicted(model, keep), f"{kept}, {added}")


def digest(docs: DataFrame) -> DataFrame:
    """Languages of all documents, learned from those whose key's crc32 is not divisible by 5 (a NULL key trains)."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    return predict(fit(rows.where(~F.col("held_out"))), rows, ["doc_id", "held_out"])
