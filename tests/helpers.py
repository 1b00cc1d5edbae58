"""What several test modules use; nothing is imported from ``conftest``, whose name is not unique."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"


def walk(n: int, seed: int, symbol: str) -> pd.DataFrame:
    """A price path with zero-range bars and repeated closes in it."""
    rng = np.random.default_rng(seed)
    close = np.round(100 + np.cumsum(rng.normal(0, 1, n)), 2).clip(5)
    flat = rng.random(n) < 0.15
    opened = np.where(flat, close, np.round(close + rng.normal(0, 0.5, n), 2))
    high = np.where(flat, close, np.maximum(opened, close) + np.round(rng.random(n), 2))
    low = np.where(flat, close, np.minimum(opened, close) - np.round(rng.random(n), 2))
    ts = [datetime(2020, 1, 1) + timedelta(days=int(i + i // 50 * 3)) for i in range(n)]
    return pd.DataFrame(
        {"symbol": symbol, "ts": ts, "open": opened, "high": high, "low": low, "close": close,
         "volume": rng.integers(1, 500, n).astype(float)}
    )


def ordered(df) -> pd.DataFrame:
    return df.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
