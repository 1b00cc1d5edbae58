"""Site-relative line frequency: lines that stand on too large a share of a site's pages go.

Built-in functions only. Lines are counted as hashes, with partial counts before the shuffle, so a
site with a third of all pages is one row per line and task. What comes out of the counts, a short
list of line hashes per site, is written once; Spark sees its size and decides on a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import or_empty, written
from .line_rules import HAS_WORD

#: A line goes if it is on more than this share of the pages of its site ...
RATIO = 0.1
#: ... and on this many pages at least; tiny sites tell nothing.
MIN_PAGES = 5


def _line_id(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def frequent_lines(docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per site with such lines: ``site`` and ``bad``, the ids of its boilerplate lines.

    Pages of a site with equal texts count once, above and below the line: copies of a page make
    none of its lines boilerplate. ``bad`` holds at most (distinct lines per page) / ratio ids.
    A NULL site is the site of empty name.
    """
    pages = docs.select(or_empty(site).alias("site"), or_empty(text).alias("text"))
    pages = pages.select("site", F.xxhash64("text").alias("page"), F.array_distinct(F.filter(F.split("text", "\n"), lambda x: x.rlike(HAS_WORD))).alias("lines"))
    totals = pages.select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("total"))
    lines = pages.select("site", "page", F.explode("lines").alias("line")).select("site", "page", _line_id(F.col("line")).alias("id"))
    counts = lines.select("site", "id.a", "id.b", "page").distinct().groupBy("site", "a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = counts.join(totals, "site").where(F.col("n") > F.lit(ratio) * F.col("total"))
    return often.groupBy("site").agg(F.collect_list(F.struct("a", "b")).alias("bad"))


def dedup(docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """All columns, and ``clean_text``, ``n_lines`` (lines with a word) and ``n_dropped``.

    ``clean_text`` is the text without the boilerplate lines of its site; lines without a word
    stay. NULL and empty texts give an empty ``clean_text``. Every input row gives one row.
    """
    bad = written(frequent_lines(docs, site, text, ratio, min_pages), "site-lines")
    joined = docs.join(bad.withColumnRenamed("site", "__site").withColumnRenamed("bad", "__bad"), or_empty(site) == F.col("__site"), "left")
    lines = F.split(or_empty(text), "\n")
    stay = F.when(F.col("__bad").isNull(), lines).otherwise(F.filter(lines, lambda x: ~x.rlike(HAS_WORD) | ~F.array_contains("__bad", _line_id(x))))
    out = joined.withColumn("__stay", stay)
    return (
        out.withColumn("n_lines", F.size(F.filter(lines, lambda x: x.rlike(HAS_WORD))).cast("long"))
        .withColumn("n_dropped", (F.size(lines) - F.size("__stay")).cast("long"))
        .withColumn("clean_text", F.array_join("__stay", "\n"))
        .drop("__site", "__bad", "__stay")
    )


def digest(docs: DataFrame) -> DataFrame:
    out = dedup(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.char_length("clean_text").cast("long").alias("clean_chars"), F.sha2("clean_text", 256).alias("clean_sha256"))


def dedup_sql(source: str, columns: str, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """DuckDB SQL of ``dedup`` over a table with a source column; ``columns``: what to select at the end."""
    return f"""
WITH paged AS (SELECT row_number() OVER () AS rid, coalesce(source, '') AS site, coalesce({text}, '') AS whole, * FROM {source}),
page_lines AS (SELECT DISTINCT site, whole, unnest(string_split(whole, chr(10))) AS line FROM paged),
line_counts AS (SELECT site, line, count(DISTINCT whole) AS n FROM page_lines WHERE regexp_matches(line, '{HAS_WORD}') GROUP BY site, line),
bad_lines AS (SELECT site, list(line) AS bad FROM line_counts JOIN (SELECT site, count(DISTINCT whole) AS total FROM paged GROUP BY site) USING (site)
  WHERE n >= {min_pages} AND n > {ratio}::DOUBLE * total GROUP BY site),
lined AS (SELECT paged.*, string_split(whole, chr(10)) AS every_line, coalesce(bad, []) AS bad FROM paged LEFT JOIN bad_lines USING (site)),
stripped AS (SELECT *, list_filter(every_line, lambda l: NOT list_contains(bad, l)) AS stay FROM lined),
cleaned AS (SELECT *, array_to_string(stay, chr(10)) AS clean_text,
  len(list_filter(every_line, lambda l: regexp_matches(l, '{HAS_WORD}')))::BIGINT AS n_lines, (len(every_line) - len(stay))::BIGINT AS n_dropped FROM stripped)
SELECT {columns} FROM cleaned"""


DIGEST_SQL = dedup_sql("documents", "doc_id, n_lines, n_dropped, length(clean_text)::BIGINT AS clean_chars, sha256(clean_text) AS clean_sha256")
