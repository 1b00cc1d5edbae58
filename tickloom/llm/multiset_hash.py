"""Homomorphic multiset hash of paragraphs: wide vectors added lane by lane modulo a power of two.

Each paragraph (a line) and each of its sentences is hashed to 186 bits, one for each lane of a
wide vector, and the vectors of a text are added modulo 2^30. So the fingerprint of a text does not
depend on the order of its paragraphs, and paragraphs are added to it or taken out of it without
reading the rest. Texts with many paragraphs or sentences in common have vectors in like
directions, and their cosine is the likeness. Built-in functions only.

A fingerprint is an array of 94 longs: how many pieces there are, then 93 longs of two lanes each.
Lanes have 30 bits, more than the pieces that a text can have, and a free bit above them that takes
the carry before it is cleared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import or_empty

HASHES, SHIFTS, SIDE_BY_SIDE = 3, 31, 2
ONES = sum(1 << (SHIFTS * k) for k in range(SIDE_BY_SIDE))
LANE = 1 << (SHIFTS - 1)
LANES = (LANE - 1) * ONES
SENTENCE_GAP = r"(?<=[.!?])[ \t]+|\n"


def pieces(text: Column) -> Column:
    """The lines of a text, marked as such, and its sentences."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("\n"), x))
    return F.concat(lines, F.filter(F.split(text, SENTENCE_GAP), lambda x: x != ""))


def _hashes(j: int) -> Column:
    return F.transform("__pieces", lambda p: F.xxhash64(p, F.lit(j)))


def _lanes(hashes: str) -> Column:
    """Two lanes are added at once, for each shift of the hashes."""
    return F.transform(F.sequence(F.lit(0), F.lit(SHIFTS - 1)), lambda s: F.aggregate(F.col(hashes), F.lit(0).cast("long"), lambda a, h: _step(a, h, s)))


def _step(total: Column, h: Column, shift: Column) -> Column:
    bits = F.call_function("shiftrightunsigned", h, shift).bitwiseAND(F.lit(ONES))
    return (total + bits).bitwiseAND(F.lit(LANES))


def with_fingerprint(rows: DataFrame, text: str, out: str) -> DataFrame:
    """All columns and the fingerprint of a text column."""
    step = rows.withColumn("__pieces", pieces(or_empty(text)))
    step = step.withColumns({f"__h_{j}": _hashes(j) for j in range(HASHES)})
    total = F.concat(F.array(F.size("__pieces").cast("long")), *[_lanes(f"__h_{j}") for j in range(HASHES)])
    return step.withColumn(out, total).drop("__pieces", *[f"__h_{j}" for j in range(HASHES)])


def insert(a: Column, b: Column) -> Column:
    """The fingerprint of two texts' paragraphs together."""
    return F.transform(F.zip_with(a, b, lambda x, y: x + y), lambda x, i: F.when(i == 0, x).otherwise(x.bitwiseAND(F.lit(LANES))))


def delete(a: Column, b: Column) -> Column:
    """The fingerprint after taking out paragraphs whose fingerprint is ``b``."""
    borrow = F.lit(LANE * ONES)  # the free bit of each lane
    return F.transform(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda s, i: F.when(i == 0, s["x"] - s["y"]).otherwise((s["x"] + borrow - s["y"]).bitwiseAND(F.lit(LANES))))


def directions(fp: Column) -> Column:
    """The lanes as numbers around zero: ones less zeros, exact while they differ by less than 2^30."""

    def centred(x: Column, k: int) -> Column:
        ones = F.shiftright(x, SHIFTS * k).bitwiseAND(F.lit(LANE - 1))
        return F.pmod(ones * 2 - F.element_at(fp, 1) + LANE, F.lit(2 * LANE)) - LANE

    return F.flatten(F.transform(F.slice(fp, 2, HASHES * SHIFTS), lambda x: F.array(*[centred(x, k) for k in range(SIDE_BY_SIDE)])))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def likeness(rows: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """All columns and the cosine of two fingerprints between 0 and 1; equal ones have 1."""
    step = rows.withColumn("__a", directions(F.col(a))).withColumn("__b", directions(F.col(b)))
    step = step.withColumn("__ab", _dot(F.col("__a"), F.col("__b"))).withColumn("__n", _dot(F.col("__a"), F.col("__a")) * _dot(F.col("__b"), F.col("__b")))
    near = F.when(F.col(a) == F.col(b), 1.0).when(F.col("__n") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__ab") / F.sqrt("__n")))).otherwise(0.0)
    return step.withColumn(out, near).drop("__a", "__b", "__ab", "__n")


def as_text(fp: Column) -> Column:
    """Hexadecimal: the number of pieces, a dash, and 16 digits for every two lanes."""
    return F.concat(F.hex(F.element_at(fp, 1)), F.lit("-"), F.array_join(F.transform(F.slice(fp, 2, HASHES * SHIFTS), lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def in_order(docs: DataFrame, key: str, text: str, per_partition: int = 4) -> tuple[DataFrame, Window]:
    """``key``, ``text`` in ranges of the key, and the window that has each row's next one after it.

    Rows are dealt into many key ranges. The first row of the range below (for the lowest range:
    the first row of all) is also dealt to a range as its guest, after its own rows, so the next
    row is always at hand. Only range borders and the largest key of each range reach the driver.
    Order is by descending key, NULL last, then by a hash of the text.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) * per_partition
    low = -(2**63)
    rows = docs.select(F.col(key).alias("key"), or_empty(text).alias("text")).withColumn("at", F.coalesce(F.col("key").cast("long"), F.lit(low))).withColumn("tie", F.xxhash64("text"))
    shares = F.array(*[F.lit(k / n) for k in range(1, n)])
    borders = sorted(set(docs.select(F.percentile_approx(F.coalesce(F.col(key).cast("long"), F.lit(low)), shares, F.lit(10 * n))).first()[0] or []))
    step = F.lit(0)
    if borders:
        step = F.size(F.filter(F.array(*[F.lit(b) for b in borders]), lambda b: b < F.col("at")))
    rows = rows.withColumn("range", step)
    tops = sorted(tuple(r) for r in rows.groupBy("range").agg(F.max(F.struct("at", "tie")).alias("top")).select("range", "top.at", "top.tie").collect())
    if tops:
        above = {r: tops[(k + 1) % len(tops)][0] for k, (r, _, _) in enumerate(tops)}
        by = {r: (a, t, above[r]) for r, a, t in tops}
        column = lambda i: F.array(*[F.lit(by.get(r, (0, 0, 0))[i]).cast("long") for r in range(tops[-1][0] + 1)])[F.col("range")]
        guest = (F.col("at") == column(0)) & (F.col("tie") == column(1))
        own = F.struct(F.col("range").cast("long").alias("range"), F.lit(0).alias("guest"))
        visit = F.struct(column(2).alias("range"), F.lit(1).alias("guest"))
        rows = rows.withColumn("place", F.explode(F.when(guest, F.array(own, visit)).otherwise(F.array(own))))
        rows = rows.select("key", "text", "at", "tie", "place.range", "place.guest")
    else:
        rows = rows.withColumn("range", F.lit(0).cast("long")).withColumn("guest", F.lit(0))
    return rows, Window.partitionBy("range").orderBy(F.asc("guest"), F.desc("at"), F.desc("tie"))


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, ``n_chars``, ``edited_sha256``, ``fp`` and ``edited_fp``
    (arrays), ``near_edited``, ``near_next``.

    The edited text has the first half of the next text (descending key; after the last the first)
    in place of as much of its own end. NULL text is empty; a lone row is its own next one;
    repeated rows follow one another; an empty table gives no rows.
    """
    rows, order = in_order(docs, key, text)
    n = F.char_length("text")
    half = F.expr("CAST(char_length(text) DIV 2 AS INT)")
    step = rows.withColumn("next", F.lead("text").over(order)).withColumn("edit", F.when(F.col("guest") == 0, F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))).otherwise(""))
    step = step.withColumn("n_chars", n.cast("long")).withColumn("edited_sha256", F.sha2("edit", 256))
    step = with_fingerprint(with_fingerprint(step, "text", "fp"), "edit", "edited_fp").drop("text", "next", "edit")
    step = step.withColumn("next_fp", F.lead("fp").over(order)).where("guest = 0")
    out = likeness(likeness(step, "fp", "edited_fp", "near_edited"), "fp", "next_fp", "near_next")
    return out.select(F.col("key").alias(key), "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next")


def digest(docs: DataFrame) -> DataFrame:
    out = edited(docs)
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")
