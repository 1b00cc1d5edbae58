"""Components of near copies against all pairs compared on their full sets."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tickloom.llm import near_dup


def brute(rows, k, percent=80):
    """Component (smallest key) and set size of each row, from all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (key, _) in enumerate(rows):
        r = find(i)
        low[r] = min(low.get(r, (True, 0)), (key is not None, key if key is not None else 0)) if r in low else (key is not None, key if key is not None else 0)
    return sorted(((key, len(sets[i]), low[find(i)][1] if low[find(i)][0] else None) for i, (key, _) in enumerate(rows)), key=str)


def got(df, words):
    out = near_dup.near_duplicates(df, words=words).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str)


@pytest.mark.parametrize("words", [4, 5])
def test_documents(documents, words):
    assert got(documents, words) == brute([(r["doc_id"], r["text"]) for r in documents.collect()], words)


def test_odd_rows(odd):
    assert got(odd, 5) == brute([(r["doc_id"], r["text"]) for r in odd.collect()], 5)
    assert near_dup.near_duplicates(odd.limit(0)).count() == 0


def test_a_large_group_of_near_copies_and_chains(spark):
    """Copies of one text with few edits each, chains in which only neighbours are near, and a shared passage."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for _ in range(150):
        t = list(base)
        for _ in range(rng.randrange(0, 6)):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        rows.append(t)
    chain = [rng.choice(vocabulary) for _ in range(160)]
    for _ in range(25):
        rows.append(list(chain))
        chain = chain[6:] + [rng.choice(vocabulary) for _ in range(6)]
    for _ in range(60):
        rows.append(passage + [rng.choice(vocabulary) for _ in range(rng.randrange(5, 120))])
    rng.shuffle(rows)
    texts = [(i, " ".join(t)) for i, t in enumerate(rows)]
    assert got(spark.createDataFrame(texts, "doc_id long, text string"), 4) == brute(texts, 4)


def test_texts_that_only_share_a_passage_are_not_sent(spark, monkeypatch):
    """They meet in buckets, but their signatures differ; only the planted copies go to the exact comparison."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(23)]
    texts = [" ".join(passage + [f"w{rng.random()}" for _ in range(10)]) for _ in range(80)]
    texts += [t + f" end{k}" for k, t in enumerate(texts[:6])]
    sent, compared = [], near_dup.verified

    def counted(pairs, *rest):
        sent.append(pairs.count())
        return compared(pairs, *rest)

    monkeypatch.setattr(near_dup, "verified", counted)
    rows = list(enumerate(texts))
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 4) == brute(rows, 4)
    assert 6 <= sum(sent) <= 20, sent


def test_texts_that_are_nearly_alike_enough_make_no_list_of_pairs(spark, monkeypatch):
    """Every pair is just below the threshold and every signature agrees: rows grow with the texts, not with their pairs."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(passage + [f"w{rng.random()}" for _ in range(9)]) for _ in range(300)]
    texts += [t + " end" for t in texts[:5]]
    sizes, plain = [], near_dup.written

    def counted(df, what):
        out = plain(df, what)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "written", counted)
    rows = list(enumerate(texts))
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 4) == brute(rows, 4)
    assert max(sizes) <= 65 * len(texts) < len(texts) ** 2 / 4, sizes


def test_only_wanted_texts_are_shuffled(spark, monkeypatch):
    docs = spark.createDataFrame([(k if k else None, f"text {k}") for k in range(3000)], "doc_id long, text string")
    ids = [None, 1, 2, 2, 77, 2999]
    wanted = spark.createDataFrame([(k, i) for i, k in enumerate(ids)], "id long, n long")
    out = near_dup.with_texts(wanted, docs, "doc_id", "text")
    assert sorted((r["n"], r["text"]) for r in out.collect()) == [(i, f"text {k or 0}") for i, k in enumerate(ids)]
    passed = []
    monkeypatch.setattr(type(docs), "join", lambda self, *rest, plain=type(docs).join, **more: passed.append(plain(self, *rest, **more)) or passed[-1])
    near_dup.with_texts(wanted, docs, "doc_id", "text")
    assert passed[0].count() == 5


def test_a_class_brings_its_signature_once_to_all_of_its_places(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 2)
    classes = spark.createDataFrame([(bytearray(b"%d" % k), bytearray(b"s%d" % k)) for k in range(5)], "cls binary, sig binary")
    rows = [(b"x", k, True, True) for k in range(5)] + [(b"y", 0, True, False), (b"y", 1, False, True)]
    places = spark.createDataFrame([(bytearray(of), bytearray(b"%d" % k), 9, bytearray(b"r%d" % k), s, v) for of, k, s, v in rows], "of binary, cls binary, n long, root binary, stay boolean, visit boolean")
    out = [(bytes(r["of"]), int(r["cls"]), r["block"], r["side"]) for r in near_dup._dealt(places, classes).collect() if bytes(r["sig"]) == b"s" + bytes(r["cls"]) and bytes(r["root"]) == b"r" + bytes(r["cls"])]
    assert sorted(k for of, k, _, side in out if (of, side) == (b"x", 0)) == [0, 1, 2, 3, 4]
    assert sorted((k, block) for of, k, block, side in out if (of, side) == (b"x", 1)) == [(k, b) for k in range(5) for b in range(3)]
    assert sorted(x for x in out if x[0] == b"y") == [(b"y", 0, 0, 0), (b"y", 1, 0, 1)]


def test_circulant_signature_estimates_jaccard():
    rng = random.Random(3)
    a = [f"a{rng.random()}" for _ in range(600)]
    b = a[:500] + [f"b{rng.random()}" for _ in range(100)]
    x, y = near_dup.shingle_sets([" ".join(a), " ".join(b)], 1)
    same = (near_dup.signature(x) == near_dup.signature(y)).mean()
    assert abs(same - 500 / 700) < 0.12


def test_one_of_each_keeps_whole_rows(odd):
    out = near_dup.one_of_each(odd)
    assert out.columns == odd.columns
    keys = [r["doc_id"] for r in out.collect()]
    assert keys.count(7) == 0 and keys.count(6) == 1 and keys.count(None) == 1 and {1, 2, 3, 4, 5, 9, 10} <= set(keys)


def test_texts_that_stay_are_not_shuffled(spark, monkeypatch):
    """Single rows that stay pass by the bitmaps; only repeated keys and colliding hashes are looked up. With a few bits all rows are."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(12))
    rows = [(k, words(k), "a") for k in range(400)] + [(k + 1000, words(k), "copy") for k in range(100)] + [(None, words(999), "null")]
    rows += [(7, words(7), "a"), (8, words(8000), "other text"), (1001, words(1), "copy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more string").repartition(4)
    want = sorted([r for r in rows if r[2] != "copy"][:-2] + [rows[-2]], key=str)
    looked_up, semi = [], near_dup.among

    def seen(found, bits, column, how="left_semi"):
        out = semi(found, bits, column, how)
        if "more" in found.columns and how == "left_semi":
            looked_up.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "among", seen)
    assert sorted([tuple(r) for r in near_dup.one_of_each(docs).collect()], key=str) == want
    assert looked_up[0] <= 406 and looked_up[1] <= 8
    monkeypatch.setattr(near_dup, "KEY_BITS", 8)
    assert sorted([tuple(r) for r in near_dup.one_of_each(docs).collect()], key=str) == want
    assert looked_up[-1] > 300


def test_buckets_of_one_class_are_dropped_before_the_shuffle(spark, monkeypatch):
    classes = near_dup.sketches(spark.createDataFrame([(k, f"a{k} b{k} c{k} d{k} e{k // 2}") for k in range(200)], "doc_id long, text string"), "doc_id", "text", 1)
    classes = classes.withColumn("low", F.col("id")).cache()
    passed, semi = [], near_dup.among
    monkeypatch.setattr(near_dup, "among", lambda *a: passed.append(semi(*a).count()) or semi(*a))
    shared = near_dup._shared(classes).collect()
    rows = [(r["cls"], b) for r in classes.withColumn("bands", near_dup.buckets_of()).collect() for b in r["bands"]]
    often = Counter(b for _, b in rows)
    assert sorted((r["cls"], r["band"]) for r in shared) == sorted(x for x in rows if often[x[1]] > 1)
    assert len(shared) <= passed[0] < len(rows) / 10
