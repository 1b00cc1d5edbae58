"""Line-first cleaning: rules judge each line, failing lines go, then documents that lost too much go.

Built-in functions only: one pass over each row, no shuffle. The patterns are written in the common
part of the two engines' regular expressions, so that the checking SQL uses the same text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, or_empty

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
HAS_WORD = r"[^\x20\x09-\x0D]"
#: A line that ends a sentence, perhaps inside quotes or brackets.
ENDS = r"""[.!?:;…。！？]["'”’»)\]]*[\x20\x09-\x0D]*\z"""
#: Marks doubled after one another, as left by bad extraction or shouting.
DOUBLED = r"([!?#*$%&<>]{2,})"
#: Marks between the entries of menus and link lists.
SEPARATORS = "|»›·•"
BOILERPLATE = (
    r"(?i)(all rights reserved|cookie|enable javascript|javascript (is|must)|privacy policy|terms (of|and) (use|service|conditions)"
    r"|lorem ipsum|subscribe (to|now)|sign (in|up)|log ?in|click here|read more|share (this|on)|skip to (main )?content"
    r"|back to top|powered by|newsletter|licen[cs]ed under|released under the|under the terms of the|©)"
)


@dataclass(frozen=True)
class Rules:
    """Thresholds. A line of fewer than ``menu_words`` words must end a sentence; one of at most
    ``phrase_words`` words must not hold a boilerplate phrase; separators may be at most one in
    ``separator_words`` words (from ``separators`` on), doubled marks one in ``doubled_words``.
    A document goes if more than ``lost_percent`` per cent of the characters of its words went."""

    menu_words: int = 10
    phrase_words: int = 20
    separators: int = 3
    separator_words: int = 4
    doubled_words: int = 4
    lost_percent: int = 50


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, WORD_GAP), "")).cast("long")


def n_of(text: Column, marks: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, marks, ""))).cast("long")


def word_chars(text: Column) -> Column:
    return n_of(text, SPACES) * -1 + F.char_length(text)


def passes(line: Column, rules: Rules) -> Column:
    """Whether a line stays; lines without a word stay as the layout they are."""
    words = n_words(line)
    ends = line.rlike(ENDS)
    phrase = (words <= rules.phrase_words) & line.rlike(BOILERPLATE)
    marks = n_of(line, SEPARATORS)
    menu = (marks >= rules.separators) & (marks * rules.separator_words >= words)
    doubled = F.size(F.regexp_extract_all(line, F.lit(DOUBLED), F.lit(1))) * rules.doubled_words >= words
    return ~line.rlike(HAS_WORD) | ~((~ends & (words < rules.menu_words)) | phrase | menu | doubled)


def clean(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """All columns, and ``clean_text``, ``n_lines``, ``n_removed``, ``lost_chars``, ``keeps``.

    ``clean_text`` is the lines that stay, in order, joined by line feeds; ``keeps`` is false if too
    much of the text went. NULL and empty texts lose nothing and keep. Repeated rows are judged
    alike. A name already taken by an input column is replaced.
    """
    whole = or_empty(text)
    lines = F.split(whole, "\n")
    out = docs.withColumn("__lines", lines).withColumn("__stay", F.filter("__lines", lambda x: passes(x, rules)))
    out = out.withColumn("clean_text", F.array_join("__stay", "\n"))
    lost = word_chars(whole) - word_chars(F.col("clean_text"))
    return (
        out.withColumn("n_lines", F.size("__lines").cast("long"))
        .withColumn("n_removed", (F.size("__lines") - F.size("__stay")).cast("long"))
        .withColumn("lost_chars", lost)
        .withColumn("keeps", lost * 100 <= word_chars(whole) * rules.lost_percent)
        .drop("__lines", "__stay")
    )


def repeated_words(docs: DataFrame, words: str, out: str) -> DataFrame:
    """``out``: how many words lie in a 3-word window that occurs at least twice among ``words``.

    Windows are sorted by hash within the row, so a long text costs n log n, and a text without
    any repeated window is not sorted at all.
    """
    w = F.col(words)
    tri = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))).otherwise(F.array().cast("array<bigint>"))
    step = docs.withColumn("__tri", tri)
    step = step.withColumn(
        "__sorted",
        F.when(F.size(F.array_distinct("__tri")) < F.size("__tri"), F.sort_array(F.transform("__tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    s = F.col("__sorted")
    again = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(s, j + 1)["h"]).eqNullSafe(True))
    step = step.withColumn("__at", F.sort_array(F.transform(again, lambda x: x["i"])))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(
        "__at", start, lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).cast("long").alias("n"), x.alias("last")), lambda a: a["n"]
    )
    return step.withColumn(out, F.coalesce(covered, F.lit(0).cast("long"))).drop("__tri", "__sorted", "__at")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns and the counts of words, symbols, repeated lines and repeated words of the whole text."""
    whole = or_empty(text)
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(HAS_WORD))
    step = docs.withColumn("__words", F.array_remove(F.split(whole, WORD_GAP), "")).withColumn("__full", lines)
    step = (
        step.withColumn("n_words", F.size("__words").cast("long"))
        .withColumn("word_chars", word_chars(whole).cast("long"))
        .withColumn("n_symbols", n_of(whole, SYMBOLS))
        .withColumn("n_dup_lines", (F.size("__full") - F.size(F.array_distinct("__full"))).cast("long"))
    )
    return repeated_words(step, "__words", "n_repeat_words").drop("__words", "__full")


BASE_FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"


def judged(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """All columns, the measures, ``clean_text`` and its counts, ``base_failed`` and ``kept``."""
    return measures(clean(docs, text, rules), text).withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & F.col("keeps"))


def kept(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``judged`` that are kept.

    The row number in the condition holds the filter above the columns it reads: pushed below them,
    their expressions would be written out inside one another.
    """
    out = judged(docs, text, rules).withColumn("__at", F.monotonically_increasing_id())
    return out.where(F.col("kept") & (F.col("__at") >= 0)).drop("__at")


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_marks(expr: str, marks: str) -> str:
    return f"(length({expr}) - length(translate({expr}, {_sql_text(marks)}, '')))"


def judged_sql(source: str, rules: Rules = Rules(), extra: str = "", keep: str = "") -> str:
    """DuckDB SQL of ``judged`` over a table with doc_id and text; ``extra``: more columns of the source."""
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    chars = lambda e: f"length(translate({e}, {spaces}, ''))"
    words = lambda e: f"list_filter(string_split_regex({e}, {_sql_text(WORD_GAP)}), lambda w: w <> '')"
    fails = (
        f"((NOT regexp_matches(l, {_sql_text(ENDS)}) AND len({words('l')}) < {rules.menu_words})"
        f" OR (len({words('l')}) <= {rules.phrase_words} AND regexp_matches(l, {_sql_text(BOILERPLATE)}))"
        f" OR ({_sql_marks('l', SEPARATORS)} >= {rules.separators} AND {_sql_marks('l', SEPARATORS)} * {rules.separator_words} >= len({words('l')}))"
        f" OR len(regexp_extract_all(l, {_sql_text(DOUBLED)})) * {rules.doubled_words} >= len({words('l')}))"
    )
    stays = f"(NOT regexp_matches(l, {_sql_text(HAS_WORD)}) OR NOT {fails})"
    return f"""
WITH judged_source AS (SELECT row_number() OVER () AS rid, doc_id{extra}, coalesce(text, '') AS whole FROM {source}),
lined AS (SELECT *, list_filter(string_split(whole, chr(10)), lambda l: regexp_matches(l, {_sql_text(HAS_WORD)})) AS full_lines,
  array_to_string(list_filter(string_split(whole, chr(10)), lambda l: {stays}), chr(10)) AS clean_text, {words('whole')} AS words FROM judged_source),
windows AS (SELECT rid, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS tri
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM lined WHERE len(words) >= 3)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS n FROM windows) WHERE n >= 2),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
measured AS (SELECT doc_id{extra}, whole, clean_text, len(words)::BIGINT AS n_words, {chars('whole')}::BIGINT AS word_chars,
  {_sql_marks('whole', SYMBOLS)}::BIGINT AS n_symbols, (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words FROM lined LEFT JOIN covered USING (rid)),
based AS (SELECT *, {BASE_FAILED} AS base_failed FROM measured)
SELECT doc_id{keep}, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND ({chars('whole')} - {chars('clean_text')}) * 100 <= {chars('whole')} * {rules.lost_percent}) AS kept
FROM based"""
