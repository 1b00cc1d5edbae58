"""Merkle manifest of a table with a version of the tree for every changed row, by path copying.

Every row is a leaf. The leaves of a source, in ascending key order, form a tree in which 16
consecutive nodes have one parent; the sources' roots form the tree of the whole table. The base
tree is built in aligned blocks of 256 nodes (two levels): a block is one row, its root is a node of
the next round, and the rounds end when every tree has one block left. No task holds more than a
block, however many rows a source has.

A changed leaf makes a version. It shares every node of the base tree but the ancestors of its leaf,
and only those are copied: inside the aligned block first, then on through the upper levels. For
that, each upper block hands the siblings on the way to the root down to its children (one row per
child, so a join of unique keys), and the versions of a block are continued beside it: there are as
many tasks for versions as there are blocks, and none holds all versions of an upper node.

Defined cases: NULL fields count as ``-``; rows without a key come first in their source; equal keys
are ordered by their leaves, equal rows are leaves of their own; a NULL source is a tree of its own,
the first; an empty table has no rows and no root. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

FAN = 16
LEVELS = 2  #: levels of a block
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROW_BITS = 33  #: bits of the row number in a generated row id


def digest_of(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(replaced: dict[str, Column] | None = None) -> Column:
    columns = {n: F.col(n) for n in FIELDS} | (replaced or {})
    return digest_of(F.concat(*[_field(columns[n]) for n in FIELDS]))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with ``tree``) and their place ``pos`` in the order of their tree.

    Rows are dealt by ranges of the order, so a tree of any size is spread; a row's place is its place
    in the partition and the number of rows of its tree before that partition. A last running number
    in the order splits even a mass of equal rows.
    """
    ids = F.monotonically_increasing_id()
    dealt = rows.withColumn("_tie", ids).repartitionByRange("tree", *order, "_tie").sortWithinPartitions("tree", *order, "_tie").drop("_tie")
    placed = dealt.withColumn("_id", ids).withColumns(
        {"_part": F.shiftright("_id", ROW_BITS), "_row": F.col("_id").bitwiseAND((1 << ROW_BITS) - 1)}
    )
    placed = written(placed.drop("_id"), "merkle-order")
    runs = placed.groupBy("_part", "tree").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select("_part", "tree", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(shifts, ["_part", "tree"]).withColumn("pos", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def _parents(nodes: Column) -> Column:
    last = ((F.size(nodes) - 1) / FAN).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda g: digest_of(_joined(F.slice(nodes, g * FAN + 1, F.lit(FAN)))))


def blocks(nodes: DataFrame) -> DataFrame:
    """The nodes (``tree, pos, digest, held``) in aligned blocks, one row each: ``tree, block, nodes,
    above`` (the parents of its nodes), ``digest`` (its root) and ``more``, false if it is all that its
    tree has at this height. ``held`` is what a leaf carries along.

    The first node of block 1 is also sent to block 0 as a mark, which thereby knows that it is not alone.
    """
    entry = F.struct("pos", "digest", "held").alias("entry")
    own = nodes.select("tree", F.floor(F.col("pos") / BLOCK).alias("block"), entry)
    marks = nodes.where(F.col("pos") == BLOCK).select("tree", F.lit(0).cast("long").alias("block"), entry)
    grouped = own.unionByName(marks).groupBy("tree", "block").agg(F.array_sort(F.collect_list("entry")).alias("all"))
    more = (F.col("block") > 0) | (F.size("all") > BLOCK)
    rows = grouped.select("tree", "block", more.alias("more"), F.slice("all", 1, BLOCK).alias("nodes"))
    rows = rows.withColumn("digests", F.col("nodes")["digest"])
    rows = rows.withColumn("above", _parents(F.col("digests")))
    n = F.size("nodes")
    root = F.when(~F.col("more") & (n == 1), F.col("digests")[0]).when(~F.col("more") & (n <= FAN), F.col("above")[0])
    return rows.select("tree", "block", "more", "nodes", "above", root.otherwise(_parents(F.col("above"))[0]).alias("digest"))


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of all rounds, lowest first, each written once."""
    rounds = [written(blocks(nodes), "merkle-blocks")]
    while not rounds[-1].where("more").isEmpty():
        upper = rounds[-1].where("more")
        held = F.lit(None).cast(rounds[-1].schema["nodes"].dataType.elementType["held"].dataType)
        above = upper.select("tree", F.col("block").alias("pos"), "digest", held.alias("held"))
        rounds.append(written(blocks(above), "merkle-blocks"))
    return rounds


def _step(nodes: Column, at: Column) -> Column:
    """The digests left and right of a node among the children of its parent."""
    first = at - at % FAN
    left = F.slice(nodes, first + 1, at - first)
    return F.struct(_joined(left).alias("left"), _joined(F.slice(nodes, at + 2, first + FAN - 1 - at)).alias("right"))


def _steps(at: Column) -> Column:
    """The siblings of a block's node, level by level, to the block's root."""
    n, digests = F.size("nodes"), F.col("nodes")["digest"]
    low, high = _step(digests, at), _step(F.col("above"), (at / FAN).cast("int"))
    none = F.array().cast("array<struct<left:string,right:string>>")
    alone = ~F.col("more")
    return F.when(alone & (n == 1), none).when(alone & (n <= FAN), F.array(low)).otherwise(F.array(low, high))


def descended(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest blocks with ``path``, the siblings on the way from the block's root to the top, and the
    other columns of ``tops`` (``tree, path`` and what else all nodes of a tree get)."""
    extra = [n for n in tops.columns if n not in ("tree", "path")]
    below = None
    for level in reversed(rounds):
        done = level.where(~F.col("more")).join(tops, "tree")
        if below is not None:
            done = done.unionByName(level.where("more").join(below, ["tree", "block"]))
        paths = F.transform("nodes", lambda e, j: F.struct(e["pos"].alias("block"), F.concat(_steps(j), F.col("path")).alias("path")))
        below = done.select("tree", F.explode(paths).alias("child"), *extra).select("tree", "child.*", *extra)
    return done


def _climb(start: Column, steps: Column) -> Column:
    """The copies of a node's ancestors, lowest first, when the node is ``start``."""
    none = F.array().cast("array<string>")
    above = lambda made, s: digest_of(F.concat(s["left"], F.coalesce(F.try_element_at(made, F.lit(-1)), start), s["right"]))
    return F.aggregate(steps, none, lambda made, s: F.concat(made, F.array(above(made, s))))


def manifest(docs: DataFrame, changed: Column, new_text: Column) -> DataFrame:
    """Per row: ``doc_id, leaf, subroot, root, proof_sha256`` of the base tree, ``changed_leaf`` (NULL if
    the row is not changed) and ``copies``, the digests of the nodes that the row's version has of its
    own, from the leaf's parent to the version's root (for an unchanged row they are the base nodes).

    ``changed`` says which rows are changed, ``new_text`` is their text then.
    """
    leaves = docs.select(
        "doc_id", F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), "source")).alias("tree"),
        leaf_digest().alias("digest"), F.when(changed, leaf_digest({"text": new_text})).alias("changed"),
    )
    placed = numbered(written(leaves, "merkle-leaves"), ["doc_id", "digest"])
    trees = climbed(placed.select("tree", "pos", "digest", F.struct("doc_id", "changed").alias("held")))
    roots = trees[0].where(~F.col("more")).select("tree", "digest")
    for level in trees[1:]:
        roots = roots.unionByName(level.where(~F.col("more")).select("tree", "digest"))
    sources = numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    forest = climbed(sources.select("tree", "pos", "digest", F.col("name").alias("held")))
    none = F.array().cast("array<struct<left:string,right:string>>")
    top = forest[-1].where(~F.col("more")).select("tree", none.alias("path"), F.col("digest").alias("root"))
    whole = descended(forest, top)
    tops = whole.select(
        F.explode(F.transform("nodes", lambda e, j: F.struct(e["held"].alias("tree"), e["digest"].alias("subroot"), F.concat(_steps(j), F.col("path")).alias("path")))).alias("s"), "root",
    ).select("s.*", "root")

    def row(e: Column, j: Column) -> Column:
        steps = F.concat(_steps(j), F.col("path"))
        siblings = _joined(F.transform(steps, lambda s: F.concat(s["left"], s["right"])))
        return F.struct(
            e["held"]["doc_id"].alias("doc_id"), e["digest"].alias("leaf"), e["held"]["changed"].alias("changed_leaf"),
            digest_of(siblings).alias("proof_sha256"), _climb(F.coalesce(e["held"]["changed"], e["digest"]), steps).alias("copies"),
        )

    rows = descended(trees, tops).select("subroot", "root", F.explode(F.transform("nodes", row)).alias("r"))
    return rows.select("r.doc_id", "r.leaf", "subroot", "root", "r.proof_sha256", "r.changed_leaf", "r.copies")


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def audited(docs: DataFrame) -> DataFrame:
    """The manifest with the rows tampered with whose key's crc32 is divisible by 5 (their A-Z lower-cased)."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = manifest(docs, tampered, lowered(F.col("text")))
    folded = F.coalesce(F.try_element_at("copies", F.lit(-1)), "changed_leaf", "leaf")
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


def versions(docs: DataFrame, changed: Column, new_text: Column) -> DataFrame:
    """The nodes of the versions that are not shared with the base tree: ``doc_id, level, digest, root``.

    Level 0 is the changed leaf, the last level the version's root, also given as ``root``.
    """
    rows = manifest(docs, changed, new_text).where(F.col("changed_leaf").isNotNull())
    own = F.concat(F.array("changed_leaf"), "copies")
    return rows.select("doc_id", F.posexplode(own).alias("level", "digest"), F.element_at(own, -1).alias("root"))


def audit_sql(documents: str, source_levels: int = 7, root_levels: int = 6) -> str:
    """DuckDB SQL for :func:`audited`, for trees of up to 16 ^ levels leaves."""
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join(part(c) for c in FIELDS[:-1])} || {part(text)})"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    out = [f"""d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {leaf(low)} END AS changed FROM {documents}),
    a0 AS (SELECT doc_id, coalesce('s' || source, '') AS tree, leaf, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, coalesce(changed, leaf) AS f, '' AS proof FROM d)"""]

    def level(prev: str, here: str, keep: str) -> str:
        """One level of siblings, folded digests and parents; a tree with one node stays as it is."""
        return f"""{here}n AS (SELECT DISTINCT tree, i, h FROM {prev}),
        {here}c AS (SELECT tree, count(*) AS n FROM {here}n GROUP BY tree),
        {here}p AS (SELECT tree, i // 16 AS g, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {here}n GROUP BY tree, i // 16),
        {here}s AS (SELECT tree, i, coalesce(string_agg(h, '' ORDER BY i) OVER (PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(h, '' ORDER BY i) OVER (PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {here}n),
        {here} AS (SELECT {keep}, tree, CASE WHEN n = 1 THEN x.i ELSE x.i // 16 END AS i, CASE WHEN n = 1 THEN x.h ELSE p.h END AS h,
        CASE WHEN n = 1 THEN f ELSE sha256(l || f || r) END AS f, CASE WHEN n = 1 THEN proof ELSE proof || l || r END AS proof
        FROM {prev} x JOIN {here}c c USING (tree) JOIN {here}s s USING (tree, i) JOIN {here}p p ON p.tree = x.tree AND p.g = x.i // 16)""".replace(" tree, CASE", " x.tree, CASE")

    last = "a0"
    for k in range(1, source_levels + 1):
        out.append(level(last, f"a{k}", "doc_id, leaf"))
        last = f"a{k}"
    out.append(f"b0 AS (SELECT doc_id, leaf, h AS subroot, '' AS tree, dense_rank() OVER (ORDER BY tree) - 1 AS i, h, f, proof FROM {last})")
    last = "b0"
    for k in range(1, root_levels + 1):
        out.append(level(last, f"b{k}", "doc_id, leaf, subroot"))
        last = f"b{k}"
    body = ", ".join(out)
    return f"WITH {body} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM {last}"


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text's UTF-8 bytes, bit by bit."""
    byte = f"list_transform(range(1, strlen({text}) + 1), lambda k: CAST(('0x' || substr(hex(encode({text})), 2 * k - 1, 2)) AS BIGINT))"
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {byte}), lambda c, b: {bits}), 4294967295)"
