"""Registered queries and the SQL that checks them."""


def load_queries() -> None:
    """Import every module that registers queries."""
    from . import market_queries, ml_queries, news_queries, registry, stream_queries  # noqa: F401
