"""Feature families, targets, backtests, sentiment, models."""


def load_all() -> None:
    """Import every module that registers feature families."""
    from . import bands, candles, oscillators, price, psar, stats, suite, trend, volume  # noqa: F401
