"""Token operators against the public libraries, and against hand-packed expectations."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tickloom.llm import bpe, flat_ids, packing, tokens
from tickloom.llm.tokens import DEFAULT_VOCABULARY, WordBpe


@pytest.fixture(scope="module")
def library():
    with open(bpe.DEFAULT_RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(DEFAULT_VOCABULARY)


def as_bytes(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


CODER = bpe.ByteBpe(bpe.DEFAULT_RANKS)
WORDS = WordBpe(DEFAULT_VOCABULARY)
HARD = st.text(alphabet="ab 's\n\t  \x1c\x85éßǅΣİ日😀1²,.!|<>endoftext", max_size=80)


@settings(max_examples=150, deadline=None)
@given(st.lists(HARD, max_size=4))
def test_byte_bpe_equals_library(library, texts):
    got = CODER.encode(texts)
    assert got == [as_bytes(library.encode_ordinary(t)) for t in texts]
    assert [CODER.decode(g).decode() for g in got] == texts


@pytest.mark.parametrize("text", ["a" * 700, "ab" * 400 + "é" * 300, " " * 500, "zq" * 33, "\n\n  x \n"])
def test_long_pieces_equal_library(library, text):
    assert CODER.encode([text]) == [as_bytes(library.encode_ordinary(text))]


@settings(max_examples=150, deadline=None)
@given(HARD)
def test_word_bpe_equals_library(words, text):
    assert WORDS.encode(text) == as_bytes(words.encode(text, add_special_tokens=False).ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(HARD, max_size=6))
def test_texts_encoded_together_equal_library(words, texts):
    ids, ends = WORDS.encode_all(texts)
    found = [words.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [k for f in found for k in f] and np.diff(ends, prepend=0).tolist() == [len(f) for f in found]


def test_a_full_cache_of_words_is_emptied():
    small = tokens.WordBpe(tokens.DEFAULT_VOCABULARY, cache_share=1e-5)
    texts = [" ".join(f"Word{k % 50}x{j}, word{j}." for j in range(30)) for k in range(60)]
    assert [small.encode(t) for t in texts] == [WORDS.encode(t) for t in texts]
    assert len(small.chunks) < 20


def test_lookups_in_rows_and_postings_are_the_same(monkeypatch):
    """Scores over rows of common terms, postings and what is left of them equal sums over all postings."""
    rng = np.random.default_rng(4)
    docs = [(rng.zipf(1.3, rng.integers(1, 200)) % 500).astype("<u2") for _ in range(300)]
    plain, unused = packing.Index(docs), np.ones(300, bool)
    weight = np.zeros((500, 300))
    for t in range(500):
        at = slice(*plain.posting_at[t : t + 2]) if t + 1 < len(plain.posting_at) else slice(0)
        weight[t, plain.posting_doc[at]] = plain.posting_weight[at]
    dropping = packing.Index(docs)
    monkeypatch.setattr(packing, "DENSE_BYTES", 0)
    sparse = packing.Index(docs)
    assert len(plain.rows) and not len(sparse.rows)
    for seed in rng.permutation(300).tolist():
        unused[seed] = False
        terms, _ = np.unique(docs[seed], return_counts=True)
        scores = np.add.accumulate(weight[terms[weight[terms, seed] > 0]], axis=0)[-1] if (weight[terms, seed] > 0).any() else np.zeros(300)
        found = np.flatnonzero((scores > 0) & unused)
        want = found[np.argsort(-scores[found], kind="stable")].tolist()
        assert dropping.neighbours(seed, unused).tolist() == sparse.neighbours(seed, unused).tolist() == want
    assert dropping.n < 10


def test_round_trip_of_odd_rows(odd, library):
    rows = bpe.round_trip(odd).collect()
    assert len(rows) == odd.count()
    expected = sorted((str(r["doc_id"]), hashlib.sha256(as_bytes(library.encode_ordinary(r["text"] or ""))).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in odd.collect())
    assert sorted((str(r["doc_id"]), r["ids_sha256"], r["decoded_sha256"]) for r in rows) == expected
    assert bpe.round_trip(odd.limit(0)).count() == 0


def flat_expected(rows, words):
    start, out = 0, []
    for key, text in rows:
        ids = as_bytes([*words.encode(text or "", add_special_tokens=False).ids, 2])
        out.append((key, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


def test_flat_ids_of_documents(documents, words):
    got = sorted(tuple(r) for r in flat_ids.stored(documents.repartition(5)).collect())
    rows = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    assert got == flat_expected(rows, words)


def test_flat_ids_of_odd_rows(odd, words):
    got = sorted((tuple(r) for r in flat_ids.stored(odd).collect()), key=lambda r: r[1])
    rows = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == flat_expected(rows, words)
    assert flat_ids.stored(odd.limit(0)).count() == 0


def check_packing(pieces, documents, words, window=2048):
    full = {}
    for key, text in documents:
        full.setdefault(key, []).append(as_bytes([*words.encode(text or "", add_special_tokens=False).ids, 1]))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        assert any(zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])]) == p["ids_crc32"] and p["doc_tokens"] == len(ids) // 4 for ids in full[p["doc_id"]])
    for key, ids in full.items():
        assert sum(p["length"] for p in by_doc[key]) == sum(len(i) // 4 for i in ids)
        if len(ids) == 1:
            own = sorted(by_doc[key], key=lambda p: p["start"])
            assert [p["start"] for p in own] == [0, *np.cumsum([p["length"] for p in own])[:-1]]
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == [0, *np.cumsum([p["length"] for p in own])[:-1]]
        n = sum(p["length"] for p in own)
        assert n <= window and n & (n - 1) == 0  # full, or a power of two: no padding at all


def test_packing_of_documents(documents, words):
    check_packing(packing.digest(documents.repartition(3)).collect(), [(r["doc_id"], r["text"]) for r in documents.collect()], words)


def test_packing_of_odd_rows(odd, words):
    check_packing(packing.digest(odd).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()], words)
    assert packing.digest(odd.limit(0)).count() == 0


def test_ids_are_written_and_dealt_in_16_bits_if_they_fit(odd, words, monkeypatch):
    kept, plain = [], packing.written
    monkeypatch.setattr(packing, "written", lambda df, what: kept.append(plain(df, what)) or kept[-1])
    narrow = packing.pack(odd).agg({"length": "sum"}).first()[0]
    assert sum(len(r["ids"]) for r in kept[0].collect()) == 2 * narrow
    wide = packing.pack(odd, end_id=70_000)  # beyond 16 bits
    assert wide.agg({"length": "sum"}).first()[0] == narrow and sum(len(r["ids"]) for r in kept[1].collect()) == 4 * narrow
    ends = [np.frombuffer(r["ids"], "<u4")[-1] for r in wide.collect() if r["start"] + r["length"] == r["doc_tokens"]]
    assert len(ends) == odd.count() and set(ends) == {70_000}


def test_neighbours_are_the_best_by_bm25():
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 90, rng.integers(5, packing.QUERY_TERMS)).astype("<u4") for _ in range(60)]
    index = packing.Index(docs)
    n, mean = len(docs), np.mean([len(d) for d in docs])
    df = {t: sum(t in d for d in docs) for t in range(90)}

    def weight(t, d):
        tf = int((d == t).sum())
        return np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean)) if df[t] > 1 else 0.0

    for seed in range(10):
        terms = sorted(set(docs[seed].tolist()), key=lambda t: -weight(t, docs[seed]))[: packing.QUERY_TERMS]
        scores = np.array([sum(weight(t, d) for t in terms) for d in docs])
        found = index.neighbours(seed, np.arange(n) != seed)
        order = [k for k in np.argsort(-scores, kind="stable") if scores[k] > 0 and k != seed]
        assert np.allclose(scores[found], scores[order])


def test_all_terms_of_a_seed_are_looked_up():
    rng = np.random.default_rng(7)
    docs = [rng.integers(0, 400, rng.integers(40, 120)).astype("<u4") for _ in range(80)]
    index = packing.Index(docs)
    n, mean = len(docs), np.mean([len(d) for d in docs])
    df = [sum(t in d for d in docs) for t in range(400)]
    for seed in range(10):
        scores = np.zeros(n)
        for t in set(docs[seed].tolist()):
            tf = np.array([(d == t).sum() for d in docs])
            scores += np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * np.array([len(d) for d in docs]) / mean)) * (df[t] > 1)
        found = index.neighbours(seed, np.arange(n) != seed)
        order = [k for k in np.argsort(-scores, kind="stable") if scores[k] > 0 and k != seed]
        assert len(found) == len(order) and np.allclose(scores[found], scores[order])


def test_like_documents_meet_in_a_shard(spark, monkeypatch):
    """Ten topics, dealt in turn: shards in the order of rows would mix them all."""
    monkeypatch.setattr(packing, "SHARD_DOCS", 20)
    rng = np.random.default_rng(11)
    words = [f"{a}{b}" for a in ("river", "stone", "cloud", "bread", "horse", "paper", "glass", "music", "north", "wheel") for b in ("s", "ing", "ed", "er", "like", "less", "ful", "man", "land", "way")]
    rows = [(i, " ".join(words[10 * (i % 10) + k] for k in rng.integers(0, 10, 60))) for i in range(200)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), window=512).select("doc_id", "length", "doc_tokens", "sequence_id").collect()
    topics, sizes = {}, {}
    for p in pieces:
        topics.setdefault(p["sequence_id"], set()).add(p["doc_id"] % 10)
        sizes[p["sequence_id"]] = sizes.get(p["sequence_id"], 0) + p["length"]
    assert sum(sizes.values()) == sum({p["doc_id"]: p["doc_tokens"] for p in pieces}.values())
    mixed = [len(t) for k, t in topics.items() if sizes[k] == 512]
    assert mixed and np.mean(mixed) < 2.5, np.mean(mixed)


def test_documents_of_each_term_are_counted_where_they_are_encoded(documents):
    """Each task writes one row of counts, so no further pass over the ids is needed; places come for many documents at once."""
    rows = packing.as_ids(documents.repartition(3), "doc_id", "text", 1, tokens.DEFAULT_VOCABULARY, 0.2, "<u2").cache()
    assert rows.where("df IS NOT NULL").count() == 3
    found, total = packing.corpus_of(rows, "<u2")
    docs = [np.frombuffer(r["ids"], "<u2") for r in rows.where("row IS NOT NULL").collect()]
    plain = packing.Corpus.of(docs)
    assert (found.n, total) == (len(docs), sum(map(len, docs))) and np.array_equal(found.df, plain.df)
    for ids, place in zip(docs[:50], found.places(docs[:50]), strict=True):
        term, tf = np.unique(ids, return_counts=True)
        weight = found.weights(term, tf, float(len(ids)))
        best = np.argsort(-weight, kind="stable")[: packing.QUERY_TERMS]
        assert place == np.sort(found.rank[term[best[weight[best] > 0]]]).tobytes()


def test_neighbours_come_in_order_though_few_are_sorted_at_a_time():
    """Copies of equal score, by place, and more neighbours than are looked at first."""
    rng = np.random.default_rng(9)
    docs = [rng.integers(0, 60, rng.integers(10, 60)).astype("<u2") for _ in range(150)] * 2
    index, unused = packing.Index(docs), np.ones(300, bool)
    for seed in range(20):
        unused[seed] = False
        terms = np.unique(docs[seed])
        scores = index._exact(terms, np.arange(300))
        found = np.flatnonzero((scores > 0) & unused)
        assert list(index.best_first(seed, unused)) == found[np.argsort(-scores[found], kind="stable")].tolist()


def test_long_documents_are_not_counted_together():
    lengths = np.array([packing.BATCH_IDS * 3, 5, packing.BATCH_IDS - 5, 1, *[2] * 600])
    parts = list(packing.runs_of(lengths))
    assert parts[:2] == [(0, 1), (1, 3)] and parts[-1][1] == len(lengths) and all(a < b for a, b in parts)
    assert [a for a, _ in parts[1:]] == [b for _, b in parts[:-1]] and max(b - a for a, b in parts) == packing.BATCH_DOCS
