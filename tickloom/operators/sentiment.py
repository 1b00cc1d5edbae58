"""Lexicon sentiment of texts, daily aggregates, and their alignment to bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.asof import ERA, asof_join, era_for
from ..functions.scalars import flag, ratio
from ..functions.series import Axis, as_series

# The default lexicon of market news (word, valence -4..4, polarity -1..1, subjectivity 0..1).
LEXICON = (
    ("beat", 1.5, 0.25, 0.25), ("beats", 1.5, 0.25, 0.25), ("best", 3.25, 1.0, 0.25), ("boost", 1.75, 0.5, 0.25), ("bullish", 2.5, 0.5, 0.75),
    ("confident", 2.25, 0.5, 0.75), ("excellent", 2.75, 1.0, 1.0), ("gain", 2.5, 0.5, 0.25), ("gains", 1.5, 0.5, 0.25), ("good", 2.0, 0.75, 0.5),
    ("great", 3.0, 0.75, 0.75), ("growth", 1.5, 0.25, 0.25), ("happy", 2.75, 0.75, 1.0), ("improve", 2.0, 0.5, 0.25), ("improved", 2.0, 0.5, 0.25),
    ("opportunity", 1.75, 0.25, 0.25), ("optimistic", 1.25, 0.5, 0.75), ("outperform", 2.0, 0.5, 0.25), ("positive", 2.5, 0.25, 0.5), ("profit", 2.0, 0.5, 0.25),
    ("profits", 2.0, 0.5, 0.25), ("rally", 1.5, 0.25, 0.25), ("record", 0.75, 0.125, 0.25), ("rise", 1.25, 0.25, 0.25), ("strong", 2.25, 0.5, 0.75),
    ("success", 2.75, 0.5, 0.25), ("surge", 1.75, 0.25, 0.25), ("upgrade", 1.75, 0.25, 0.25), ("win", 2.75, 0.75, 0.5), ("wins", 2.75, 0.5, 0.5),
    ("bad", -2.5, -0.75, 0.75), ("bankrupt", -2.5, -0.75, 0.25), ("bearish", -2.5, -0.5, 0.75), ("concern", -1.25, -0.25, 0.25), ("crash", -2.0, -0.5, 0.25),
    ("crisis", -3.0, -0.5, 0.25), ("decline", -1.25, -0.25, 0.25), ("default", -1.5, -0.25, 0.25), ("disappointing", -2.25, -0.75, 0.75), ("downgrade", -1.75, -0.25, 0.25),
    ("fail", -2.5, -0.5, 0.25), ("fall", -1.5, -0.25, 0.25), ("fear", -2.25, -0.5, 0.75), ("fraud", -2.75, -0.75, 0.5), ("idiot", -2.25, -0.75, 0.75),
    ("lawsuit", -1.0, -0.25, 0.125), ("loss", -1.25, -0.5, 0.25), ("losses", -1.75, -0.5, 0.25), ("miss", -0.75, -0.25, 0.25), ("negative", -2.75, -0.25, 0.5),
    ("plunge", -1.75, -0.5, 0.25), ("poor", -2.0, -0.5, 0.5), ("recession", -1.75, -0.5, 0.25), ("risk", -1.0, -0.25, 0.5), ("stupid", -2.5, -0.75, 1.0),
    ("trash", -1.5, -0.5, 0.5), ("weak", -2.0, -0.5, 0.75), ("worry", -1.75, -0.25, 0.5), ("worst", -3.0, -1.0, 1.0), ("worthless", -2.0, -0.75, 1.0),
)
NEGATIONS = ("not", "no", "never", "none", "nor", "neither", "cannot", "without", "hardly", "nothing")
BOOSTERS = ("very", "extremely", "highly", "really", "hugely", "remarkably", "sharply", "strongly", "particularly", "especially")
DAMPERS = ("slightly", "somewhat", "barely", "partly", "marginally", "scarcely", "almost", "kinda")
CONTRAST = "but"
# Published constants of the valence method.
NEGATED, NORMALISE = -0.74, 15.0
STEP, NEARNESS, EMPHASIS = 0.293, (1.0, 0.95, 0.9), 0.733
BEFORE_CONTRAST, AFTER_CONTRAST = 0.5, 1.5
EXCLAMATION, MOST_EXCLAMATIONS, QUESTION, MANY_QUESTIONS = 0.292, 4, 0.18, 0.96
# Of the polarity method: a negation and an intensifier directly before a word.
POLARITY_NEGATED, INTENSIFIED = -0.5, 1.3
FILTERED = 20_000  #: lexicons up to this many words are looked up before words become rows
SCORES = (
    "vader_compound", "vader_positive", "vader_negative", "vader_neutral",
    "textblob_polarity", "textblob_subjectivity", "sentiment_score",
)


def lexicon_table(spark: SparkSession, rows: Sequence[tuple] = LEXICON) -> DataFrame:
    """An inline table, so that its size is known and Spark broadcasts it by itself."""
    values = ", ".join(f"('{w}', {v}D, {p}D, {s}D)" for w, v, p, s in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(word, valence, polarity, subjectivity)")


def text_sentiment(items: DataFrame, text, lexicon: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores of each text, one row per ``keys`` (which are unique); empty texts score 0 everywhere.

    Each word of the lexicon (a table ``word, valence, polarity, subjectivity`` of any size) counts with
    its valence, changed by its surroundings: a word in capitals in a text that is not all capitals is
    stronger, boosters and dampers among the three words before it make it stronger or weaker, less so
    the farther they are, a negation among them turns it round, and the first ``but`` of a text weighs
    what follows above what comes before. Exclamation and question marks strengthen the sum.

    The surroundings are array expressions over the words. Only words of the lexicon become rows, by a
    look-up that needs no join while the lexicon is small.
    """
    raw = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(raw, "[^A-Za-z']+"), lambda w: w.rlike("[A-Za-z]"))
    shout = lambda w: (F.length(w) > 1) & (F.upper(w) == w)
    step = items.select(*keys, raw.alias("_text"), words.alias("_words"))
    step = step.select(
        *keys, "_words", F.transform("_words", F.lower).alias("_low"), F.exists("_words", lambda w: ~shout(w)).alias("_mixed"),
        F.least(F.length(F.regexp_replace("_text", "[^!]", "")), F.lit(MOST_EXCLAMATIONS)).alias("_loud"), F.length(F.regexp_replace("_text", "[^?]", "")).alias("_asks"),
    )
    step = step.withColumn("_but", F.array_position("_low", CONTRAST))
    before = lambda i, d: F.coalesce(F.get("_low", i - d), F.lit(""))
    token = lambda w, i: F.struct(
        w.alias("word"), (F.col("_mixed") & shout(F.get("_words", i))).alias("loud"), *[before(i, d).alias(f"b{d}") for d in (1, 2, 3)],
        F.when(F.col("_but") == 0, 1.0).when(i + 1 < F.col("_but"), BEFORE_CONTRAST).when(i + 1 > F.col("_but"), AFTER_CONTRAST).otherwise(1.0).alias("weight"),
    )
    known = [r["word"] for r in lexicon.select("word").limit(FILTERED + 1).collect()]
    tokens = F.transform("_low", token)
    if len(known) <= FILTERED:
        tokens = F.filter(tokens, lambda t: t["word"].isin(known))
    plain = [F.size("_low").alias("n"), "_loud", "_asks"]
    rows = step.select(*keys, *plain, F.explode_outer(tokens).alias("t")).select(*keys, "n", "_loud", "_asks", "t.*")
    hit = rows.join(lexicon, "word", "left")
    sign = F.signum(F.col("valence"))
    near = [F.col(f"b{d}") for d in (1, 2, 3)]
    pushed = F.lit(0.0)
    for b, share in zip(near, NEARNESS):
        pushed = pushed + F.when(b.isin(*BOOSTERS), STEP * share).when(b.isin(*DAMPERS), -STEP * share).otherwise(0.0)
    negates = lambda b: b.isin(*NEGATIONS) | b.endswith("n't")
    turned = F.when(negates(near[0]) | negates(near[1]) | negates(near[2]), NEGATED).otherwise(1.0)
    valence = (F.col("valence") + sign * (F.when(F.col("loud"), EMPHASIS).otherwise(0.0) + pushed)) * turned * F.col("weight")
    v = F.coalesce(valence, F.lit(0.0))
    bent = F.when(negates(near[0]), POLARITY_NEGATED).when(near[0].isin(*BOOSTERS), INTENSIFIED).otherwise(1.0)
    sums = hit.groupBy(*keys).agg(
        F.sum(v).alias("sum"),
        F.sum(F.when(v > 0, v + 1).otherwise(0.0)).alias("pos"),
        F.sum(F.when(v < 0, 1 - v).otherwise(0.0)).alias("neg"),
        (F.max("n") - F.sum(flag(v != 0))).cast("double").alias("neu"),
        F.avg(F.when(F.col("polarity").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("polarity") * bent)))).alias("polarity"),
        F.avg("subjectivity").alias("subjectivity"), F.max("_loud").alias("loud"), F.max("_asks").alias("asks"),
    )
    asked = F.when(F.col("asks") > 3, MANY_QUESTIONS).when(F.col("asks") > 1, F.col("asks") * QUESTION).otherwise(0.0)
    extra = F.col("loud") * EXCLAMATION + asked
    sums = sums.withColumn("total", F.col("sum") + F.signum("sum") * extra)
    sums = sums.withColumns({"pos": F.col("pos") + F.when(F.col("pos") > F.col("neg"), extra).otherwise(0.0), "neg": F.col("neg") + F.when(F.col("neg") > F.col("pos"), extra).otherwise(0.0)})
    mass = F.col("pos") + F.col("neg") + F.col("neu")
    compound = F.col("total") / F.sqrt(F.col("total") * F.col("total") + NORMALISE)
    mood = F.coalesce(F.col("polarity"), F.lit(0.0))
    zero = F.lit(0.0)
    return sums.select(
        *keys,
        compound.alias("vader_compound"),
        F.coalesce(ratio("pos", mass), zero).alias("vader_positive"),
        F.coalesce(ratio("neg", mass), zero).alias("vader_negative"),
        F.coalesce(ratio("neu", mass), zero).alias("vader_neutral"),
        mood.alias("textblob_polarity"),
        F.coalesce(F.col("subjectivity"), zero).alias("textblob_subjectivity"),
        (compound * 0.6 + mood * 0.4).alias("sentiment_score"),
    )


def news_scores(news: DataFrame, lexicon: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores of title and summary together."""
    return text_sentiment(news, F.concat_ws(" ", "title", "summary"), lexicon, keys)


def sentiment_daily(scores: DataFrame) -> DataFrame:
    s = F.col("sentiment_score")
    return scores.groupBy("symbol", "date").agg(
        *[F.avg(n).alias(n) for n in SCORES],
        F.count(F.lit(1)).alias("news_count"),
        F.stddev_samp(s).alias("sentiment_volatility"),
        F.avg((s > 0.1).cast("double")).alias("positive_ratio"),
        F.avg((s < -0.1).cast("double")).alias("negative_ratio"),
    )


def news_social_outer(daily: DataFrame, social: DataFrame) -> DataFrame:
    return daily.join(social, ["symbol", "date"], "full").na.fill(0)


def sentiment_combined(merged: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Weighted sentiment with momentum, acceleration, volatilities and regime per day."""
    s = as_series(merged, lookback=12, group_rows=group_rows, axis=Axis(order=("date",)))
    a = s.axis
    s = s.add({"combined_sentiment": F.col("sentiment_score") * 0.7 + F.col("social_sentiment_score") * 0.3})
    s = s.add(
        {
            "sentiment_momentum": a.mean("combined_sentiment", 5),
            "news_sentiment_volatility": a.std("sentiment_score", 10),
            "social_sentiment_volatility": a.std("social_sentiment_score", 10),
            "sentiment_regime": regime(F.col("combined_sentiment")),
        }
    )
    return s.add({"sentiment_acceleration": a.diff("sentiment_momentum")}).tidy()


def regime(x):
    """Bins (-inf, -0.2], (-0.2, 0.2], (0.2, inf)."""
    return F.when(x <= -0.2, "negative").when(x <= 0.2, "neutral").when(x > 0.2, "positive")


def sentiment_market(combined: DataFrame, symbols: Sequence[str] | None = None) -> DataFrame:
    """Market-wide mood per day."""
    if symbols is not None:
        combined = combined.where(F.col("symbol").isin(list(symbols)))
    return combined.groupBy("date").agg(
        F.avg("combined_sentiment").alias("combined_sentiment_mean"),
        F.stddev_samp("combined_sentiment").alias("combined_sentiment_std"),
        F.sum("news_count").alias("news_count_sum"),
        F.sum("social_mention_count").alias("social_mention_count_sum"),
        F.avg("positive_ratio").alias("positive_ratio_mean"),
        F.avg("negative_ratio").alias("negative_ratio_mean"),
    )


ALIGNED = (*SCORES, "social_sentiment_score", "combined_sentiment")
ACTIVITY = ("news_count", "social_mention_count", "positive_ratio", "negative_ratio")
WINDOWS = (5, 10, 20)
SENTIMENT_FEATURES = (
    [f"sentiment_{n}{x}" for n in ALIGNED for x in ("", *[f"_{k}_{w}" for w in WINDOWS for k in ("ma", "std")])]
    + ["sentiment_momentum_5d", "sentiment_acceleration", "sentiment_regime_positive", "sentiment_regime_negative"]
    + [f"sentiment_{n}" for n in ACTIVITY]
)


def asof_sentiment(bars: DataFrame, combined: DataFrame, era_seconds: int | None = ERA) -> DataFrame:
    """The last sentiment day at or before each bar, as a whole row."""
    right = combined.withColumn("ts", F.col("date").cast("timestamp")).drop("date")
    return asof_join(bars, right, era_seconds=era_seconds)


def sentiment_features(
    bars: DataFrame, combined: DataFrame, group_rows: int | None = None, era_seconds: int | None = None
) -> DataFrame:
    """71 sentiment columns per bar; nothing stays NULL."""
    right = combined.select("symbol", "date", *ALIGNED, *ACTIVITY)
    joined = asof_sentiment(bars.select("symbol", "ts"), right, era_seconds or era_for(group_rows))
    s = as_series(joined, lookback=21, group_rows=group_rows)
    a, cols = s.axis, {}
    for n in ALIGNED:
        cols[f"sentiment_{n}"] = F.col(n)
        for w in WINDOWS:
            cols[f"sentiment_{n}_ma_{w}"] = a.mean(n, w)
            cols[f"sentiment_{n}_std_{w}"] = a.std(n, w)
    mood = F.col("combined_sentiment")
    cols["sentiment_momentum_5d"] = a.mean("combined_sentiment", 5)
    cols["sentiment_regime_positive"] = flag(mood > 0.1)
    cols["sentiment_regime_negative"] = flag(mood < -0.1)
    cols |= {f"sentiment_{n}": F.col(n).cast("double") for n in ACTIVITY}
    s = s.add(cols)
    s = s.add({"sentiment_acceleration": a.diff("sentiment_momentum_5d")})
    return s.tidy().select("symbol", "ts", *SENTIMENT_FEATURES).na.fill(0)


def sentiment_cached(daily: DataFrame, path: str, as_of: str) -> DataFrame:
    """The daily table of one day, computed once and then read back.

    A folder counts as written once its writer has left its mark of success; what a run that broke
    off has left there is written anew.
    """
    spark = daily.sparkSession
    folder = f"{path}/as_of={as_of}"
    if not is_complete(spark, folder):
        daily.write.mode("overwrite").parquet(folder)
    return spark.read.schema(daily.schema).parquet(folder)


def is_complete(spark: SparkSession, folder: str) -> bool:
    """Whether a batch writer has finished with a folder, on any file system that the session reads."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def attach(bars: DataFrame, extra: DataFrame) -> DataFrame:
    """Columns of ``extra`` next to the bars with the same key."""
    return bars.join(extra, ["symbol", "ts"], "left")


