"""Queries over news, pages, social posts and their alignment to bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sentiment as N
from ..sources import news as S
from ..streaming.live import workspace
from . import datasets as D
from .market_queries import bound
from .oracles.base import bars_cte, frame, full, lag, mean, rnd, std
from .registry import day, query, rounded

DATE = "CAST(date AS VARCHAR) AS day"
NEWS = """news AS (SELECT 'Brand#' || CAST(doc_id % 25 + 1 AS VARCHAR) AS symbol,
  DATE '1996-01-01' + CAST(floor(doc_id / 25) AS INTEGER) % 30 AS date, source, split_part(text, chr(10), 1) AS title, text AS summary, doc_id AS item_id FROM documents)"""


def on_date():
    return F.col("date").cast("string").alias("day")


#: The texts are invented prose, in which hardly any word of the lexicon stands; frequent words of it get
#: valences too, so that every rule has something to work on.
PROSE = (
    ("ther", 0.5, 0.125, 0.25), ("tion", 0.25, 0.25, 0.125), ("ble", -0.5, -0.125, 0.25), ("ing", 0.75, 0.125, 0.5),
    ("ly", -0.25, -0.25, 0.125), ("ed", -0.75, -0.125, 0.5), ("ment", 0.5, 0.25, 0.25), ("sch", -0.5, -0.25, 0.25),
)
WORDS = (*N.LEXICON, *PROSE)


def lexicon_sql() -> str:
    rows = ", ".join(f"('{w}', {v}::DOUBLE, {p}::DOUBLE, {s}::DOUBLE)" for w, v, p, s in WORDS)
    return f"lex(word, valence, polarity, subjectivity) AS (VALUES {rows})"


def listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def negates(b: str) -> str:
    return f"({b} IN ({listed(N.NEGATIONS)}) OR {b} LIKE '%n''t')"


PUSHED = " + ".join(f"CASE WHEN b{d} IN ({listed(N.BOOSTERS)}) THEN {N.STEP * share}::DOUBLE WHEN b{d} IN ({listed(N.DAMPERS)}) THEN {-N.STEP * share}::DOUBLE ELSE 0 END" for d, share in zip((1, 2, 3), N.NEARNESS))
KEYS = "item_id, symbol, date, source"
SCORED = f"""{NEWS}, {lexicon_sql()},
wl AS (SELECT {KEYS}, title || ' ' || summary AS body, list_filter(regexp_split_to_array(title || ' ' || summary, '[^A-Za-z'']+'), lambda w: regexp_matches(w, '[A-Za-z]')) AS ws FROM news),
wk AS (SELECT *, list_transform(ws, lambda w: lower(w)) AS low, len(list_filter(ws, lambda w: NOT (length(w) > 1 AND upper(w) = w))) > 0 AS mixed,
  least(length(regexp_replace(body, '[^!]', '', 'g')), {N.MOST_EXCLAMATIONS}) AS loud_marks, length(regexp_replace(body, '[^?]', '', 'g')) AS asks FROM wl),
wb AS (SELECT *, coalesce(list_position(low, '{N.CONTRAST}'), 0) AS but FROM wk),
ti AS (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM wb),
tk AS (SELECT {KEYS}, low[i] AS word, mixed AND length(ws[i]) > 1 AND upper(ws[i]) = ws[i] AS loud, {', '.join(f"CASE WHEN i > {d} THEN low[i - {d}] ELSE '' END AS b{d}" for d in (1, 2, 3))},
  CASE WHEN but = 0 OR i = but THEN 1.0::DOUBLE WHEN i < but THEN {N.BEFORE_CONTRAST}::DOUBLE ELSE {N.AFTER_CONTRAST}::DOUBLE END AS weight FROM ti),
hv AS (SELECT t.*, (valence + sign(valence) * (CASE WHEN loud THEN {N.EMPHASIS}::DOUBLE ELSE 0 END + {PUSHED}))
  * CASE WHEN {' OR '.join(negates(f'b{d}') for d in (1, 2, 3))} THEN {N.NEGATED}::DOUBLE ELSE 1 END * weight AS v,
  greatest(-1.0, least(1.0, polarity * CASE WHEN {negates('b1')} THEN {N.POLARITY_NEGATED}::DOUBLE WHEN b1 IN ({listed(N.BOOSTERS)}) THEN {N.INTENSIFIED}::DOUBLE ELSE 1 END)) AS pol,
  subjectivity AS sub FROM tk t JOIN lex USING (word)),
hs AS (SELECT {KEYS}, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS pos, sum(CASE WHEN v < 0 THEN 1 - v ELSE 0 END) AS neg, count(*) FILTER (v <> 0) AS hits, avg(pol) AS mood, avg(sub) AS sub FROM hv GROUP BY ALL),
sx AS (SELECT {', '.join(f'k.{x}' for x in KEYS.split(', '))}, coalesce(s, 0) AS s, coalesce(pos, 0) AS pos0, coalesce(neg, 0) AS neg0, len(ws) - coalesce(hits, 0) AS neu, coalesce(mood, 0) AS mood, coalesce(sub, 0) AS sub,
  loud_marks * {N.EXCLAMATION}::DOUBLE + CASE WHEN asks > 3 THEN {N.MANY_QUESTIONS}::DOUBLE WHEN asks > 1 THEN asks * {N.QUESTION}::DOUBLE ELSE 0 END AS extra FROM wb k LEFT JOIN hs USING ({KEYS})),
sm AS (SELECT *, s + sign(s) * extra AS total, pos0 + CASE WHEN pos0 > neg0 THEN extra ELSE 0 END AS pos, neg0 + CASE WHEN neg0 > pos0 THEN extra ELSE 0 END AS neg FROM sx),
sc AS (SELECT {KEYS}, total / sqrt(total * total + 15) AS vader_compound, {', '.join(f'coalesce({x} / nullif(pos + neg + neu, 0), 0) AS vader_{y}' for x, y in (('pos', 'positive'), ('neg', 'negative'), ('neu', 'neutral')))},
  mood AS textblob_polarity, sub AS textblob_subjectivity, 0.6::DOUBLE * total / sqrt(total * total + 15) + 0.4::DOUBLE * mood AS sentiment_score FROM sm)"""
SCORE_DIGITS = {n: 6 for n in N.SCORES}


def cols_sql(cols: dict[str, int]) -> str:
    return ", ".join(f"{rnd(n, d)} AS {n}" for n, d in cols.items())


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return N.news_scores(D.news(spark, sf), N.lexicon_table(spark, WORDS), ("item_id", "symbol", "date", "source"))


@query("text_sentiment", f"WITH {SCORED} SELECT item_id, {cols_sql(SCORE_DIGITS)} FROM sc")
def text_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scores(spark, sf), SCORE_DIGITS, ["item_id"])


DAILY = f"""{SCORED}, dl AS (SELECT symbol, date, {', '.join(f'avg({n}) AS {n}' for n in N.SCORES)}, count(*) AS news_count, stddev_samp(sentiment_score) AS sentiment_volatility,
avg(CAST(sentiment_score > 0.1 AS DOUBLE)) AS positive_ratio, avg(CAST(sentiment_score < -0.1 AS DOUBLE)) AS negative_ratio FROM sc GROUP BY symbol, date)"""
DAILY_DIGITS = {**SCORE_DIGITS, "sentiment_volatility": 5, "positive_ratio": 6, "negative_ratio": 6}


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return N.sentiment_daily(scores(spark, sf))


@query("sentiment_daily", f"WITH {DAILY} SELECT symbol, {DATE}, news_count, {cols_sql(DAILY_DIGITS)} FROM dl")
def sentiment_daily(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(daily(spark, sf), DAILY_DIGITS, ["symbol", on_date(), "news_count"])


@query("sentiment_cached", f"WITH {DAILY} SELECT symbol, {DATE}, news_count, {cols_sql(DAILY_DIGITS)} FROM dl")
def sentiment_cached(spark: SparkSession, sf: str) -> DataFrame:
    """The second call reads what the first one wrote for the day."""
    path = workspace(spark, "sentiment-cache")
    N.sentiment_cached(daily(spark, sf), path, "1996-01-30")
    return rounded(N.sentiment_cached(daily(spark, sf), path, "1996-01-30"), DAILY_DIGITS, ["symbol", on_date(), "news_count"])


SOCIAL = """social AS (SELECT 'Brand#' || CAST(conv_id % 25 + 1 AS VARCHAR) AS symbol, DATE '1996-01-01' + CAST(floor(conv_id / 25) AS INTEGER) % 30 AS date,
  avg((length(text) % 61) / 100.0::DOUBLE - 0.3::DOUBLE) AS social_sentiment_score, count(*) AS social_mention_count,
  avg(CAST(role = 'user' AS DOUBLE)) AS social_engagement FROM conversations GROUP BY 1, 2)"""
SOCIAL_DIGITS = {"social_sentiment_score": 6, "social_engagement": 6}


@query("social_daily", f"WITH {SOCIAL} SELECT symbol, {DATE}, social_mention_count, {cols_sql(SOCIAL_DIGITS)} FROM social")
def social_daily(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.social_daily(D.social_posts(spark, sf)), SOCIAL_DIGITS, ["symbol", on_date(), "social_mention_count"])


SCORE_NAMES = [*N.SCORES, "news_count", "sentiment_volatility", "positive_ratio", "negative_ratio", "social_sentiment_score", "social_mention_count", "social_engagement"]
MERGED = f"""{DAILY}, {SOCIAL}, mg AS (SELECT symbol, date, {', '.join(f'coalesce({n}, 0) AS {n}' for n in SCORE_NAMES)} FROM dl FULL JOIN social USING (symbol, date))"""
MERGED_DIGITS = {**DAILY_DIGITS, **SOCIAL_DIGITS}


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return N.news_social_outer(daily(spark, sf), S.social_daily(D.social_posts(spark, sf)))


@query("news_social_outer", f"WITH {MERGED} SELECT symbol, {DATE}, news_count, social_mention_count, {cols_sql(MERGED_DIGITS)} FROM mg")
def news_social_outer(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(merged(spark, sf), MERGED_DIGITS, ["symbol", on_date(), "news_count", "social_mention_count"])


def on(expr: str) -> str:
    return expr.replace("ORDER BY ts", "ORDER BY date")


COMBINED = f"""{MERGED}, c0 AS (SELECT *, 0.7::DOUBLE * sentiment_score + 0.3::DOUBLE * social_sentiment_score AS combined_sentiment FROM mg),
c1 AS (SELECT *, {on(mean('combined_sentiment', 5))} AS sentiment_momentum, {on(std('sentiment_score', 10))} AS news_sentiment_volatility,
  {on(std('social_sentiment_score', 10))} AS social_sentiment_volatility,
  CASE WHEN combined_sentiment <= -0.2 THEN 'negative' WHEN combined_sentiment <= 0.2 THEN 'neutral' ELSE 'positive' END AS sentiment_regime FROM c0),
cb AS (SELECT *, sentiment_momentum - {on(lag('sentiment_momentum'))} AS sentiment_acceleration FROM c1)"""
COMBINED_DIGITS = {n: 5 for n in ("combined_sentiment", "sentiment_momentum", "sentiment_acceleration", "news_sentiment_volatility", "social_sentiment_volatility")}


def combined(spark: SparkSession, sf: str) -> DataFrame:
    # one row per symbol and calendar day, so the calendar of the news bounds a symbol
    return N.sentiment_combined(merged(spark, sf), group_rows=30)


@query("sentiment_combined", f"WITH {COMBINED} SELECT symbol, {DATE}, {cols_sql(COMBINED_DIGITS)} FROM cb")
def sentiment_combined(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(combined(spark, sf), COMBINED_DIGITS, ["symbol", on_date()])


@query("sentiment_regime", f"WITH {COMBINED} SELECT symbol, {DATE}, sentiment_regime FROM cb")
def sentiment_regime(spark: SparkSession, sf: str) -> DataFrame:
    return combined(spark, sf).select("symbol", on_date(), "sentiment_regime")


MARKET_DIGITS = {n: 5 for n in ("combined_sentiment_mean", "combined_sentiment_std", "positive_ratio_mean", "negative_ratio_mean")}


@query(
    "sentiment_market",
    f"""WITH {COMBINED}, mk AS (SELECT date, avg(combined_sentiment) AS combined_sentiment_mean, stddev_samp(combined_sentiment) AS combined_sentiment_std,
    CAST(sum(news_count) AS BIGINT) AS news_count_sum, CAST(sum(social_mention_count) AS BIGINT) AS social_mention_count_sum,
    avg(positive_ratio) AS positive_ratio_mean, avg(negative_ratio) AS negative_ratio_mean FROM cb GROUP BY date)
    SELECT {DATE}, news_count_sum, social_mention_count_sum, {cols_sql(MARKET_DIGITS)} FROM mk""",
)
def sentiment_market(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(N.sentiment_market(combined(spark, sf)), MARKET_DIGITS, [on_date(), "news_count_sum", "social_mention_count_sum"])


ASOF = f"""WITH {bars_cte()}, {COMBINED}, al AS (SELECT b.symbol, b.ts, cb.* EXCLUDE (symbol, date) FROM bars b ASOF LEFT JOIN cb ON b.symbol = cb.symbol AND b.ts >= cb.date)"""
DAY_SQL = "CAST(CAST(ts AS DATE) AS VARCHAR) AS day"
ASOF_DIGITS = {"combined_sentiment": 5, "sentiment_score": 6, "positive_ratio": 6}


@query("asof_sentiment", f"{ASOF} SELECT symbol, {DAY_SQL}, news_count, sentiment_regime, {cols_sql(ASOF_DIGITS)} FROM al")
def asof_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    out = N.asof_sentiment(D.bars(spark, sf).select("symbol", "ts"), combined(spark, sf))
    return rounded(out, ASOF_DIGITS, ["symbol", day(), "news_count", "sentiment_regime"])


DIGITS = 7


def feature_sql() -> str:
    cols = {}
    for n in N.ALIGNED:
        cols[f"sentiment_{n}"] = n
        for w in N.WINDOWS:
            cols[f"sentiment_{n}_ma_{w}"] = mean(n, w)
            cols[f"sentiment_{n}_std_{w}"] = full(n, w, frame(f"stddev_samp({n})", w))
    cols["sentiment_momentum_5d"] = mean("combined_sentiment", 5)
    cols |= {f"sentiment_{n}": n for n in N.ACTIVITY}
    inner = ", ".join(f"{e} AS {n}" for n, e in cols.items())
    outer = ", ".join(rnd(f"coalesce({n}, 0)", DIGITS) + f" AS {n}" for n in cols)
    return f"""{ASOF}, ft AS (SELECT symbol, ts, combined_sentiment AS mood, {inner} FROM al), f2 AS (SELECT *, sentiment_momentum_5d - {lag('sentiment_momentum_5d')} AS acc FROM ft)
    SELECT symbol, {DAY_SQL}, {outer}, {rnd('coalesce(acc, 0)', DIGITS)} AS sentiment_acceleration,
    CAST(coalesce(mood > 0.1, false) AS INTEGER) AS sentiment_regime_positive, CAST(coalesce(mood < -0.1, false) AS INTEGER) AS sentiment_regime_negative FROM f2"""


def features(spark: SparkSession, sf: str) -> DataFrame:
    return N.sentiment_features(D.bars(spark, sf), combined(spark, sf), **bound(spark, sf))


FLAGS = ("sentiment_regime_positive", "sentiment_regime_negative")


@query("sentiment_features", feature_sql())
def sentiment_features(spark: SparkSession, sf: str) -> DataFrame:
    out = features(spark, sf)
    return rounded(out, {n: DIGITS for n in N.SENTIMENT_FEATURES if n not in FLAGS}, ["symbol", day(), *FLAGS])


@query("attach_sentiment", f"{ASOF} SELECT symbol, {DAY_SQL}, close, {rnd('coalesce(combined_sentiment, 0)', 5)} AS sentiment_combined_sentiment FROM al JOIN bars USING (symbol, ts)")
def attach_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    bars = D.bars(spark, sf).select("symbol", "ts", "close")
    out = N.attach(bars, features(spark, sf).select("symbol", "ts", "sentiment_combined_sentiment"))
    return rounded(out, {"sentiment_combined_sentiment": 5}, ["symbol", day(), "close"])


# ------------------------------------------------------------------------ news and pages


def feed(spark: SparkSession, sf: str) -> DataFrame:
    return D.news(spark, sf).withColumn("published", F.unix_date("date").cast("bigint") * 86_400 + F.col("item_id") % 86_400)


RECENT = """WHERE epoch(date) + item_id % 86400 >= epoch(TIMESTAMP '1996-01-30' - INTERVAL 10 DAY)"""


@query("news_recent", f"WITH {NEWS} SELECT symbol, {DATE}, source, title, md5(summary) AS summary_md5 FROM news {RECENT}")
def news_recent(spark: SparkSession, sf: str) -> DataFrame:
    out = S.news_recent(feed(spark, sf), "1996-01-30", 10)
    return out.select("symbol", on_date(), "source", "title", F.md5("summary").alias("summary_md5"))


PAGES = r"""heads AS (SELECT page_id, url, regexp_extract_all(html, '(?s)<h1(?:\s[^>]*)?>(.*?)</h1>', 1)[1:10] AS hs FROM pages),
hl AS (SELECT page_id, url, unnest(hs) AS raw, unnest(range(len(hs))) AS place FROM heads),
ht AS (SELECT page_id, url, CAST(place AS INTEGER) AS place, replace(replace(replace(replace(replace(trim(regexp_replace(regexp_replace(raw, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS title FROM hl)"""


@query("page_headlines", f"WITH {PAGES} SELECT page_id, url, place, title FROM ht WHERE title <> ''")
def page_headlines(spark: SparkSession, sf: str) -> DataFrame:
    return S.page_headlines(D.table(spark, sf, "pages"), tag="h1", css_class=None)


@query("news_union", f"WITH {NEWS}, {PAGES} SELECT title, source FROM news UNION ALL SELECT title, 'pages' AS source FROM ht WHERE title <> ''")
def news_union(spark: SparkSession, sf: str) -> DataFrame:
    pages = page_headlines(spark, sf).select("title", F.lit("pages").alias("source"))
    return S.news_union(D.news(spark, sf).select("title", "source"), pages)


