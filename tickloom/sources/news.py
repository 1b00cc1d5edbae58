"""News, pages and social posts as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def news_recent(items: DataFrame, as_of: str, days_back: int = 30, source: str | None = None) -> DataFrame:
    """Items of the last days; ``published`` holds epoch seconds."""
    at = F.timestamp_seconds("published")
    recent = items.where(at >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days_back)))
    return recent.select(
        "symbol",
        F.to_date(at).alias("date"),
        (F.lit(source) if source else F.col("source")).alias("source"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("summary", F.lit("")).alias("summary"),
    )


def news_union(*providers: DataFrame) -> DataFrame:
    out = providers[0]
    for more in providers[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def page_headlines(
    pages: DataFrame, tag: str = "h3", css_class: str | None = "article__headline", per_page: int | None = None
) -> DataFrame:
    """Texts of the headline elements of each page (of the first ``per_page`` if given), empty ones skipped."""
    attrs = rf"[^>]*class=[\"'][^\"']*\b{css_class}\b[^\"']*[\"'][^>]*" if css_class else r"(?:\s[^>]*)?"
    pattern = rf"(?s)<{tag}{attrs}>(.*?)</{tag}>"
    found = F.regexp_extract_all("html", F.lit(pattern), 1)
    if per_page is not None:
        found = F.slice(found, 1, per_page)
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", "<[^>]+>", ""), r"\s+", " "))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return (
        pages.select("page_id", "url", F.posexplode(found).alias("place", "raw"))
        .select("page_id", "url", "place", text.alias("title"))
        .where(F.col("title") != "")
    )


def social_daily(posts: DataFrame) -> DataFrame:
    """Posts ``(symbol, date, score, engaged)`` to one row per symbol and day."""
    return posts.groupBy("symbol", "date").agg(
        F.avg("score").alias("social_sentiment_score"),
        F.count(F.lit(1)).alias("social_mention_count"),
        F.avg("engaged").alias("social_engagement"),
    )
