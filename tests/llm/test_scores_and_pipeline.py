"""Scores against plain counts, and the pipeline against brute force."""

import math
import pickle
import zlib
from collections import Counter

import numpy as np
from odd_rows import ODD_TEXTS, SF
from pyspark.sql import functions as F
from test_near_dup import brute

import corpus_pipeline
from tickloom.llm import line_dedup, line_rules, lm_score
from tickloom.llm.common import written


def base_scores(rows):
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in rows]
    counts = Counter()
    tokens = [(t or "").encode().lower().split() + [b""] for _, t in rows]
    for h, w in zip(held, tokens, strict=True):
        if not h:
            counts.update(w)
    total, distinct = sum(counts.values()), len(counts)
    return held, tokens, counts, [sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w) for w in tokens], total


def check(rows, out):
    held, tokens, counts, base, total = base_scores(rows)
    expected = sorted((str(k), h, len(w), sum(x in counts for x in w), total, round(b, 6)) for (k, _), h, w, b in zip(rows, held, tokens, base, strict=True))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == expected
    assert all(r["score"] < 0 and math.isfinite(r["score"]) and math.isfinite(r["bits_per_byte"]) for r in out)


def test_scores_of_documents(spark, documents):
    out = lm_score.scored(documents).collect()
    check([(r["doc_id"], r["text"]) for r in documents.collect()], out)


def test_held_out_texts_score_better_than_base(spark):
    out = lm_score.scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_scores_of_odd_rows(spark, odd):
    check(ODD_TEXTS, lm_score.scored(odd).collect())
    assert lm_score.scored(odd.limit(0)).count() == 0
    alone = lm_score.scored(odd.where("doc_id = 4"), held=(odd["doc_id"] == 4)).collect()
    assert alone[0]["train_tokens"] == 0 and alone[0]["n_known"] == 0 and alone[0]["score"] < 0


def test_spelling_is_a_distribution():
    """The predictions of all bytes after any context add up to one, as each bit's two do."""
    rng = np.random.default_rng(0)
    table = rng.integers(0, 30, (len(lm_score.ORDERS) << lm_score.TABLE_BITS, 2)).astype(np.float32)
    mixer = lm_score.Mixer(rng.normal(0.2, 0.1, (lm_score.GATES, lm_score.INPUTS)), rng.integers(0, 50, (256 * lm_score.REFINED, 2)).astype(float))
    # One-byte words are a byte and a space; all second bytes after "a" share the cost of "a".
    whole = mixer.log10_of(table, [b""])[0]
    assert whole < 0
    bits = lm_score.Bits([b"ab", b""])
    assert bits.flat.tolist() == [97, 98, 32, 10] and bits.place.tolist() == [0, 1, 2, 0]


def test_online_mixing_learns():
    words = [bytes(w) for w in (b"theon", b"theer", b"inthe", b"erand", b"thand", b"onthe") for _ in range(30)]
    bits = lm_score.Bits(words)
    table = np.zeros((len(lm_score.ORDERS) << lm_score.TABLE_BITS, 2), np.float32)
    for _, node, value in bits.steps():
        for which in range(len(lm_score.ORDERS)):
            np.add.at(table, ((which << lm_score.TABLE_BITS) + bits.slots(which, node), value), 1)
    model = lm_score.Mixer()
    before = model.log10_of(table, words).sum()
    for _ in range(20):
        model.learn(table, words, 0.4, True)
    assert model.log10_of(table, words).sum() > before
    assert model.log10_of(table, [b"theon"])[0] > model.log10_of(table, [b"xqzwv"])[0] + 3


def test_pipeline_stages(spark, documents):
    rules = {r["doc_id"]: r["clean_text"] for r in line_rules.judged(documents).collect() if r["kept"]}
    first = written(corpus_pipeline.quality(spark, documents, SF), "first")
    assert {r["doc_id"]: r["text"] for r in first.collect()} == rules and first.columns == documents.columns
    second = written(corpus_pipeline.site_lines(spark, first, SF), "second")
    lines = {r["doc_id"]: r["clean_text"] for r in line_dedup.dedup(first).collect()}
    assert {r["doc_id"]: r["text"] for r in second.collect()} == lines
    third = corpus_pipeline.near_copies(spark, second, SF)
    expected = {k for k, _, c in brute(sorted(lines.items()), 5) if k == c}
    assert {r["doc_id"]: r["text"] for r in third.collect()} == {k: lines[k] for k in expected}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {p["doc_id"] for p in pieces} == expected


def test_pipeline_of_odd_rows(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == odd.columns, name
    rows = docs.collect()
    assert all(r["kept"] == "k" and r["clean_text"] == "c" for r in rows)
    assert all(stage(spark, odd.limit(0), SF).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_scores_do_not_depend_on_what_is_held(documents, monkeypatch):
    few = documents.orderBy("doc_id").limit(60)
    scores = lambda: {r["doc_id"]: r["score"] for r in lm_score.scored(few).collect()}
    all_held = scores()
    monkeypatch.setattr(lm_score, "HELD_TOKENS", 20)
    some_held = scores()
    assert all(abs(some_held[k] - s) <= 1e-6 * abs(s) for k, s in all_held.items())


def test_scores_depend_on_the_order_of_words(spark):
    """Training texts always have "b" after "a"; a held-out text with that order is more likely than the same words in reverse."""
    schema = "doc_id long, text string"
    rows = [(k, " ".join(["red apple", "green leaf", "blue sky"][(k + i) % 3] for i in range(40))) for k in range(60)]
    rows += [(100, "red apple green leaf blue sky"), (101, "sky blue leaf green apple red"), (102, None)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    out = {r["doc_id"]: r for r in lm_score.scored(docs, held=F.col("doc_id") >= 100).collect()}
    assert out[100]["score"] > out[101]["score"] + 3
    assert abs(out[100]["base_score"] - out[101]["base_score"]) < 1e-9


def test_every_occurrence_counts(spark):
    words = spark.createDataFrame([(bytearray(b"ab"), 5, 5), (bytearray(b"cd"), 1, 1), (bytearray(b"ef"), 0, 1)], "token binary, n long, times long")
    once = spark.createDataFrame([(bytearray(b"ab"), 1, 1), (bytearray(b"cd"), 1, 1)], "token binary, n long, times long")
    bits = sum(len(w) + 1 for w in (b"ab", b"cd")) * 8 * len(lm_score.ORDERS)
    assert lm_score.count_bits(once).sum() == bits
    assert lm_score.count_bits(words).sum() == bits + 4 * 3 * 8 * len(lm_score.ORDERS)


def test_tables_of_a_small_corpus_are_sent_small(spark):
    words = spark.createDataFrame([(bytearray(b"ab"), 5, 5), (bytearray(b"cd"), 1, 1)], "token binary, n long, times long")
    table = lm_score.count_bits(words)
    sent = lm_score._sent(table)
    assert len(pickle.dumps(sent)) < 20_000 < table.nbytes // 1000
    assert np.array_equal(lm_score._received(sent), table)
    full = np.ones((300, 2), np.float32)
    assert np.array_equal(lm_score._received(lm_score._sent(full)), full)


def test_tree_decisions():
    """Ways lead to their leaves, what a text had is counted in it alone, and runs of a long text hand it on."""
    code = lm_score.Code.of([4, 9, 2, 1, 30])
    ways = {tuple(zip(code.node[a : a + n].tolist(), code.value[a : a + n].tolist(), strict=True)) for a, n in zip(code.start, code.length, strict=True)}
    assert len(ways) == 5 and min(code.length) == code.length[4] == 1 and abs(sum(2.0**-n for n in code.length.tolist()) - 1) < 1e-12
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 5, n) for n in (7, 0, 30, 2 * lm_score.RUN_TOKENS + 5, 4)]
    for room in (1, 20, 10**9):
        seen = [[] for _ in texts]
        for d, text in lm_score.decided(code, texts, lambda room=room: room):
            for t, *rest in zip(text.tolist(), d.node.tolist(), d.value.tolist(), *d.had.tolist(), *[e.tolist() for e in d.entries], strict=True):
                seen[t].append(rest)
        for ids, rows in zip(texts, seen, strict=True):
            had = np.zeros((2, code.nodes))
            assert len(rows) == code.length[ids].sum()
            for node, value, zeros, ones, *_ in rows:
                assert (zeros, ones) == (had[0, node], had[1, node])
                had[value, node] += 1
            whole = lm_score.Decisions(code, ids, np.zeros(len(ids), np.int64))
            assert [r[4:] for r in rows] == np.transpose(whole.entries).tolist()
    mixer = lm_score.TreeMixer(rng.normal(0.3, 0.1, (lm_score.TREE_GATES, lm_score.TREE_INPUTS)))
    table = rng.integers(0, 9, (code.nodes + (lm_score.WAYS << lm_score.WAY_BITS), 2)).astype(np.float32)
    after = [10 ** mixer.log10_of(table, d)[d.owner == 1].sum() for d in (lm_score.Decisions(code, np.array([4, k]), np.zeros(2, np.int64)) for k in range(5))]
    assert abs(sum(after) - 1) < 1e-5
