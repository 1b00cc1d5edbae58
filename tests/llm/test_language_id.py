"""Language identification: the code, the classifiers against plain Python, held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pytest

from tickloom.llm import language_id as L


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8, 30, 200])
def test_codewords_are_apart(n):
    code = L.codewords(n)
    assert code.shape[0] == n and (L.codewords(n) == code).all()
    far = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(far, default=1) >= (2 ** (n - 2) if 2 <= n <= 7 else 1)
    assert n == 1 or all(-n < s < n for s in code.sum(0))  # no bit is the same for all


def test_grams_against_plain_python():
    texts = ["Ab c!", "ÉÀ 12 x", "z"]
    grams = L.grams_of(texts)
    plain = {}
    for text, spaced in zip(texts, [" ab c ", " éà x ", " z "]):
        plain[text] = [spaced[i : i + n] for n in L.ORDERS for i in range(len(spaced) - n + 1)]
    assert [len(plain[t]) for t in texts] == grams.sizes.tolist()
    bucket = {}
    for k, n in enumerate(L.ORDERS):
        for text, lo, hi in zip(texts, grams.starts[k], [*grams.starts[k][1:], len(grams.buckets[k])]):
            for g, b in zip([g for g in plain[text] if len(g) == n], grams.buckets[k][lo:hi]):
                assert bucket.setdefault(g, b) == b
    assert len(set(bucket.values())) == len(bucket)


def brute(train, texts):
    """Weights, margins, trust and losses in plain loops over the same buckets."""
    langs = sorted({lang for _, lang in train})
    code = L.codewords(len(langs))
    flat = lambda t: np.concatenate(L.grams_of([t]).buckets).tolist()
    counts = {lang: {} for lang in langs}
    for text, lang in train:
        for b in flat(text):
            counts[lang][b] = counts[lang].get(b, 0) + 1
    total = {lang: sum(counts[lang].values()) + L.SMOOTH * L.BUCKETS for lang in langs}

    def weight(b, bit):
        share = {s: [(counts[x].get(b, 0) + L.SMOOTH) / total[x] for x, c in zip(langs, code[:, bit]) if c == s] for s in (1, -1)}
        return math.log(sum(share[1]) / len(share[1])) - math.log(sum(share[-1]) / len(share[-1]))

    def margins(text):
        found = flat(text)
        return [L.SCALE * sum(weight(b, bit) for b in found) / len(found) for bit in range(code.shape[1])]

    trust = []
    for i, lang in enumerate(langs):
        own = [margins(t) for t, x in train if x == lang]
        trust.append([(sum(m[b] * code[i][b] > 0 for m in own) + 1) / (len(own) + 2) for b in range(code.shape[1])])
    out = []
    for text in texts:
        m = margins(text)
        losses = [sum(t / sum(trust[i]) * math.log1p(math.exp(-code[i][b] * m[b])) for b, t in enumerate(trust[i])) for i in range(len(langs))]
        odds = [math.exp(min(losses) - x) for x in losses]
        out.append((langs[losses.index(min(losses))], 1 / sum(odds)))
    return out


def test_equals_plain_loops(spark):
    rng = random.Random(5)
    pieces = {"aa": ["the", "ing", "tion"], "bb": ["der", "sch", "ung"], "cc": ["que", "eau", "ment"]}
    train = [(" ".join(rng.choice(p) for _ in range(6)), lang) for lang, p in pieces.items() for _ in range(4)]
    texts = ["the queen", "schung der tion", "eau", "ment ing ment"]
    df = spark.createDataFrame(train, "text string, lang string").repartition(3)
    model = L.fit(df)
    out = L.predict(model, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).orderBy("doc_id").collect()
    for r, (lang, score) in zip(out, brute(train, texts)):
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-4


def test_held_out_accuracy_and_no_leak(spark, documents):
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    out = L.digest(documents).collect()
    assert len(out) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) >= 0.95
    blind = documents.withColumn("lang", documents.lang).replace({v: "zz" for v in ["src0"]}, subset=["source"])
    from pyspark.sql import functions as F

    hidden = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(None)).otherwise(F.col("lang"))
    again = {r["doc_id"]: r["lang_pred"] for r in L.digest(blind.withColumn("lang", hidden)).collect()}
    assert again == {r["doc_id"]: r["lang_pred"] for r in out}


def test_ambiguous_between_two(spark):
    train = [("the thing that", "en"), ("der ding das", "de")] * 5
    model = L.fit(spark.createDataFrame(train, "text string, lang string"))
    rows = spark.createDataFrame([(1, "the thing that"), (2, "xyz")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in L.predict(model, rows, ["doc_id"]).collect()}
    assert out[1]["lang_pred"] == "en" and not out[1]["ambiguous"] and out[2]["ambiguous"]


def test_odd_rows(spark, odd):
    out = L.digest(odd).collect()  # no labels at all
    assert len(out) == odd.count() and {(r["lang_pred"], r["score"]) for r in out} == {("und", 0.0)}
    from pyspark.sql import functions as F

    out = L.digest(odd.withColumn("lang", F.lit("xx"))).collect()
    assert sorted(r["doc_id"] or 0 for r in out if r["lang_pred"] == "und") == [1, 2, 3] and {r["lang_pred"] for r in out} == {"und", "xx"}
    assert L.digest(odd.limit(0)).count() == 0
