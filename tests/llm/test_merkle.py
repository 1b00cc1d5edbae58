"""The manifest against a plain tree built in Python."""

import hashlib
import zlib

import duckdb
from pyspark.sql import functions as F

from tickloom.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row[n] for n in merkle.FIELDS[:-1]] + [text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def walk_up(tree, i, start):
    """The siblings left and right at every level, and the digests on the way when the node is ``start``."""
    proof, made = [], []
    for nodes in tree[:-1]:
        lo = i - i % 16
        left, right = nodes[lo:i], nodes[i + 1 : lo + 16]
        proof += left + right
        start = H(*left, start, *right)
        made.append(start)
        i //= 16
    return proof, made


def expected(rows):
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (held := sorted(sources[s], key=lambda x: x[:3]), levels([x[2] for x in held])) for s in names}
    forest = levels([trees[s][1][-1][0] for s in names])
    root = forest[-1][0]
    out = []
    for k, s in enumerate(names):
        held, tree = trees[s]
        for i, (_, _, digest, r) in enumerate(held):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            now = leaf(r, r["text"] and r["text"].translate(lower)) if tampered else digest
            proof, made = walk_up(tree, i, now)
            more, upper = walk_up(forest, k, made[-1] if made else now)
            folded = (made + upper or [now])[-1]
            out.append((r["doc_id"], digest, tree[-1][0], root, H(*proof, *more), folded, folded == root))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, pos int, tree string")


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_deep_trees_and_many_sources(spark):
    rows = [(i, "hot", "en", i, f"Text {i}", 0, "x") for i in range(9000, 0, -1)]
    rows += [(20_000 + i, f"s{i}é", None, None, None if i % 7 == 0 else "No\nCaps" * (i % 3), 1, "y") for i in range(300)]
    rows += [(30_000 + i, "pair", "en", 1, "B") for i in range(16)] + [(40_000 + i, "seventeen", "de", 1, "C") for i in range(17)]
    rows += [(50_000 + i, "block", "de", 1, "C") for i in range(256)] + [(60_000 + i, "over", "de", 1, "Cc") for i in range(257)]
    rows = [r if len(r) == 7 else (*r, 2, "z") for r in rows]
    docs = frame(spark, rows).repartition(7)
    plain = [dict(zip(docs.columns, r)) for r in rows]
    assert collected(merkle.audited(docs)) == expected(plain)


def test_odd_rows(spark, odd):
    rows = [r.asDict() for r in odd.collect()]
    rows += [dict(rows[0], doc_id=None, source=None, text="t")] * 40 + [dict(rows[0], doc_id=None, source="", text="t")]
    docs = spark.createDataFrame(rows, odd.schema)
    assert collected(merkle.audited(docs)) == expected(rows)
    assert merkle.audited(odd.limit(0)).count() == 0


def test_one_row(spark):
    [r] = merkle.audited(frame(spark, [(1, None, None, None, None, 0, "")])).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] == H("1:1", "-", "-", "-", "-") and r["proof_sha256"] == H()


def test_versions_share_all_other_nodes(spark):
    rows = [(i, "a" if i % 3 else "b", "en", 1, f"T{i}", 0, "") for i in range(2000)]
    docs = frame(spark, rows)
    changed = F.col("doc_id").isin(5, 777)
    made = {}
    for r in merkle.versions(docs, changed, F.lit("new")).collect():
        made.setdefault(r["doc_id"], {})[r["level"]] = (r["digest"], r["root"])
    assert set(made) == {5, 777}
    for key, nodes in made.items():
        edited = [dict(zip(docs.columns, r)) for r in rows]
        base = {H0 for H0 in (leaf(r, r["text"]) for r in edited)}
        edited[key]["text"] = "new"
        root = expected(edited)[0][3]
        assert all(r == root for _, r in nodes.values()) and nodes[max(nodes)][0] == root
        assert nodes[0][0] == leaf(edited[key], "new") and nodes[0][0] not in base
        assert len(nodes) == 5  # leaf, three levels of its source, the root of all


def test_sql(spark, documents):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS FROM '/root/testdata/sf0.001/documents.parquet'")
    assert collected(merkle.audited(documents)) == sorted(con.execute(merkle.audit_sql("documents")).fetchall(), key=str)
