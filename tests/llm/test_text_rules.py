"""Line rules, site line frequency and fingerprints against plain Python and SQL."""

import hashlib
import math
import re

import pytest
import xxhash
from check_queries import connect, differences
from odd_rows import SF
from pyspark.sql import functions as F

from tickloom.llm import line_dedup, line_rules, multiset_hash, queries


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert differences(queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLES[name]).df()) == []


def repeated(words):
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)})


def test_measures_of_odd_rows(odd):
    out = line_rules.judged(odd.drop("n")).collect()
    assert len(out) == odd.count()
    for r in out:
        words = (r["text"] or "").encode().split()
        lines = [x for x in (r["text"] or "").split("\n") if x.encode().split()]
        assert r["n_words"] == len(words) and r["n_repeat_words"] == repeated(words)
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", r["text"] or ""))
        assert r["base_failed"] == (len(words) < 50 or 100 * repeated(words) > 50 * len(words))
    assert line_rules.judged(odd.limit(0)).count() == 0


def test_lines_that_go(spark):
    text = "\n".join(["Home | News | Sport | About | Contact", "A full sentence that says something and ends.", "", "Read more", "All rights reserved.", "word### word### word###", "He said “yes.”"])
    r = line_rules.clean(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["clean_text"] == "A full sentence that says something and ends.\n\nHe said “yes.”"
    assert r["n_removed"] == 4 and r["n_lines"] == 7


def test_quality_labels(spark, documents):
    """Every document labelled bad goes, and every good one of fifty words stays."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = line_rules.judged(documents).join(labels, "doc_id").collect()
    assert not [r["doc_id"] for r in rows if r["quality"] == 1 and not r["base_failed"] and not r["kept"]]
    assert not [r["doc_id"] for r in rows if r["quality"] == 0 and r["kept"]]


def test_site_lines(spark):
    rows = [(i, "a", f"Own line {i}.\nOn every page.\n\nNow and then {i % 20}.") for i in range(40)]
    rows += [(100 + i, "b", "On every page.\nCopies of one page.") for i in range(30)] + [(200, None, None), (201, None, "")]
    out = {r["doc_id"]: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert len(out) == len(rows)
    assert out[3]["clean_text"] == "Own line 3.\n\nNow and then 3." and out[3]["n_dropped"] == 1 and out[3]["n_lines"] == 3
    assert out[105]["clean_text"] == "On every page.\nCopies of one page."  # one page in thirty copies
    assert out[200]["clean_text"] == "" and out[200]["n_lines"] == 0


def test_site_lines_of_odd_rows(odd):
    assert line_dedup.digest(odd).count() == odd.count() and line_dedup.digest(odd.limit(0)).count() == 0


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text):
    pieces = ["\n" + x for x in text.split("\n")] + [x for x in re.split(r"(?<=[.!?])[ \t]+|\n", text) if x]
    out = [len(pieces)]
    for j in range(multiset_hash.HASHES):
        hashes = []
        for p in pieces:
            first = xxhash.xxh64_intdigest(p.encode(), seed=42)
            hashes.append(xxhash_int(j, first))
        for s in range(multiset_hash.SHIFTS):
            total = 0
            for h in hashes:
                total = (total + ((h >> s) & multiset_hash.ONES)) & multiset_hash.LANES
            out.append(total)
    return out


def xxhash_int(value, seed):
    """The engine's hash of an int after another column."""
    mask = (1 << 64) - 1
    h = (seed + 0x27D4EB2F165667C5 + 4) & mask
    h ^= ((value & 0xFFFFFFFF) * 0x9E3779B185EBCA87) & mask
    h = ((h << 23 | h >> 41) & mask) * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9 & mask
    h = ((h ^ (h >> 33)) * 0xC2B2AE3D27D4EB4F) & mask
    h = ((h ^ (h >> 29)) * 0x165667B19E3779F9) & mask
    return h ^ (h >> 32)


def expected_edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = {}
    for i, (key, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        out[key] = (len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest())
    return out


def test_fingerprints_of_documents(documents):
    rows = multiset_hash.edited(documents).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    expected = expected_edits(list(texts.items()))
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in rows} == expected
    for r in rows[:40]:
        assert list(r["fp"]) == fingerprint(texts[r["doc_id"]])
    assert sum(r["near_edited"] for r in rows) / len(rows) > 0.35 > 0.2 > sum(r["near_next"] for r in rows) / len(rows)
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))


def plain_likeness(a, b):
    """Cosine of the sums of the pieces' bits as -1 and 1, over all lanes."""

    def vector(text):
        pieces = ["\n" + x for x in text.split("\n")] + [x for x in re.split(r"(?<=[.!?])[ \t]+|\n", text) if x]
        out = {}
        for p in pieces:
            first = xxhash.xxh64_intdigest(p.encode(), seed=42)
            for j in range(multiset_hash.HASHES):
                h = xxhash_int(j, first)
                for s in range(multiset_hash.SHIFTS):
                    for k in range(multiset_hash.SIDE_BY_SIDE):
                        out[j, s, k] = out.get((j, s, k), 0) + 2 * (h >> (s + k * multiset_hash.SHIFTS) & 1) - 1
        return [out[x] for x in sorted(out)]

    x, y = vector(a), vector(b)
    if x == y:
        return 1.0
    size = math.sqrt(sum(v * v for v in x) * sum(v * v for v in y))
    return min(1.0, max(0.0, sum(v * w for v, w in zip(x, y)) / size)) if size else 0.0


def test_likeness_against_plain_vectors(spark, documents):
    texts = sorted(((r["doc_id"], r["text"]) for r in documents.limit(25).collect()), reverse=True)
    rows = {r["doc_id"]: r for r in multiset_hash.digest(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, (key, text) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        half = len(text) // 2
        assert math.isclose(rows[key]["near_next"], plain_likeness(text, after), abs_tol=1e-9)
        assert math.isclose(rows[key]["near_edited"], plain_likeness(text, text[: len(text) - half] + after[:half]), abs_tol=1e-9)


def test_likeness_of_a_line_that_stands_very_often(spark):
    many = "The same line.\n" * 20_000 + "\n".join(f"Own line {i}." for i in range(5))
    rows = spark.createDataFrame([(2, many), (1, many[::-1][:40])], "doc_id long, text string")
    out = {r["doc_id"]: r for r in multiset_hash.digest(rows).collect()}
    assert out[2]["near_edited"] > 0.99


def test_fingerprints_of_odd_rows(odd):
    rows = multiset_hash.digest(odd).collect()
    lone = [(r["doc_id"], r["text"]) for r in odd.collect()]
    expected = expected_edits(lone)
    assert len(rows) == len(lone)
    assert all((r["n_chars"], r["edited_sha256"]) == expected[r["doc_id"]] for r in rows if r["doc_id"] != 7)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (6, 7)}) == 1
    assert multiset_hash.digest(odd.limit(0)).count() == 0


def test_fingerprints_add_and_take_out(spark):
    rows = spark.createDataFrame([("One two.\nThree four.\nFive.", "Five.\nOne two.\nThree four.", "One two.\nFive.", "Three four.")], "a string, b string, c string, d string")
    for c in "abcd":
        rows = multiset_hash.with_fingerprint(rows, c, f"f{c}")
    r = rows.select(
        (F.col("fa") == F.col("fb")).alias("order"), (multiset_hash.insert(F.col("fc"), F.col("fd")) == F.col("fa")).alias("insert"), (multiset_hash.delete(F.col("fa"), F.col("fd")) == F.col("fc")).alias("delete"), (F.col("fa") == F.col("fc")).alias("other")
    ).first()
    assert r["order"] and r["insert"] and r["delete"] and not r["other"]
