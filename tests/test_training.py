"""Training and backtest in one call."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import sentiment as N
from tickloom.operators.catalogue import families
from tickloom.operators.symbol_models import VOTERS
from tickloom.operators.training import train_and_backtest


def test_what_gives_the_bars_runs_once(spark, bars, tmp_path):
    """Bars come from all trades, so their work must not be done again for each step that reads them."""
    passed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    n = bars.count()
    counted = bars.mapInArrow(count, bars.schema)
    days = bars.groupBy("symbol").agg(F.to_date(F.min("ts")).alias("date"))
    mood = days.select("symbol", "date", *[F.lit(0.25).alias(c) for c in (*N.ALIGNED, *N.ACTIVITY)])
    names = [f.name for f in families()[:2]]
    out = train_and_backtest(counted, str(tmp_path), {"logistic": VOTERS["logistic"]}, names, mood, group_rows=2000).collect()
    assert sorted(r["symbol"] for r in out) == ["AAA", "BBB"]
    assert passed.value == n
