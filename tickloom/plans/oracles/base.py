"""Building blocks of the SQL texts: bars, frames, recursive averages, rounding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

W = "PARTITION BY symbol ORDER BY ts"


def bars_cte(keyed: str = "brand") -> str:
    join = (
        "JOIN part ON l_partkey = p_partkey" if keyed == "brand" else "JOIN supplier ON l_suppkey = s_suppkey"
    )
    name = "p_brand" if keyed == "brand" else "s_name"
    key = "ROW(l_orderkey, l_linenumber, l_partkey, l_suppkey)"
    return f"""bars AS MATERIALIZED (
  SELECT {name} AS symbol, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts,
         arg_min(round(l_extendedprice * 100), {key}) AS open, max(round(l_extendedprice * 100)) AS high,
         min(round(l_extendedprice * 100)) AS low, arg_max(round(l_extendedprice * 100), {key}) AS close,
         sum(l_quantity) AS volume
  FROM lineitem {join} GROUP BY 1, 2)"""


DAY = "CAST(CAST(ts AS DATE) AS VARCHAR) AS day"


def rnd(x: str, digits: int) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def frame(agg: str, n: int) -> str:
    return f"{agg} OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(x: str, n: int, value: str) -> str:
    return f"CASE WHEN {frame(f'count({x})', n)} = {n} THEN {value} END"


def mean(x: str, n: int) -> str:
    return full(x, n, frame(f"avg({x})", n))


def total(x: str, n: int) -> str:
    return full(x, n, frame(f"sum({x})", n))


def std(x: str, n: int) -> str:
    return full(x, n, frame(f"stddev_samp({x})", n))


def top(x: str, n: int) -> str:
    return full(x, n, frame(f"max({x})", n))


def bottom(x: str, n: int) -> str:
    return full(x, n, frame(f"min({x})", n))


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({W})"


def running(agg: str) -> str:
    return f"{agg} OVER ({W} ROWS UNBOUNDED PRECEDING)"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def change(x: str, k: int = 1) -> str:
    return f"({div(x, lag(x, k))} - 1)"


def yes(cond: str) -> str:
    return f"coalesce({cond}, false)"


class Levels:
    """A chain of CTEs, each adding columns to the one before."""

    def __init__(self, bars: str | None = None):
        self.ctes = [
            bars or bars_cte(),
            f"l0 AS MATERIALIZED (SELECT *, row_number() OVER ({W}) - 1 AS rn FROM bars)",
        ]
        self.n = 0

    def add(self, cols: Mapping[str, str]) -> Levels:
        exprs = ", ".join(f"{e} AS {n}" for n, e in cols.items())
        self.ctes.append(f"l{self.n + 1} AS MATERIALIZED (SELECT *, {exprs} FROM l{self.n})")
        self.n += 1
        return self

    def ema(self, specs: Mapping[str, tuple]) -> Levels:
        """``name: (column, alpha, need[, 'mean'[, before]])`` by a recursive CTE over the rows."""
        seeds = {}
        for n, (x, _a, need, *rest) in specs.items():
            seen = running(f"count({x})")
            start = f"CASE WHEN {seen} = {need} THEN {frame(f'avg({x})', need)} END" if rest[:1] == ["mean"] else x
            seeds |= {f"st_{n}": start, f"cn_{n}": seen}
        self.add(seeds)
        src, rec = f"l{self.n}", f"e{self.n}"
        first = ", ".join(f"CAST(st_{n} AS DOUBLE) AS y_{n}" for n in specs)
        step = ", ".join(
            f"CASE WHEN p.y_{n} IS NULL THEN x.st_{n} ELSE (1 - {a!r}) * p.y_{n} + {a!r} * x.{x} END"
            for n, (x, a, *_rest) in specs.items()
        )
        names = ", ".join(f"y_{n}" for n in specs)
        self.ctes.append(
            f"{rec}(symbol, rn, {names}) AS (SELECT symbol, rn, {first} FROM {src} WHERE rn = 0 UNION ALL "
            f"SELECT x.symbol, x.rn, {step} FROM {rec} p JOIN {src} x ON x.symbol = p.symbol AND x.rn = p.rn + 1)"
        )
        outs = []
        for n, (_x, _a, need, *rest) in specs.items():
            before = rest[1] if len(rest) > 1 else "NULL"
            outs.append(f"CASE WHEN cn_{n} >= {need} THEN y_{n} ELSE {before} END AS {n}")
        self.ctes.append(
            f"l{self.n + 1} AS MATERIALIZED (SELECT a.*, {', '.join(outs)} FROM {src} a JOIN {rec} r ON a.symbol = r.symbol AND a.rn = r.rn)"
        )
        self.n += 1
        return self

    def sql(self, cols: Sequence[str], digits, head: str = f"symbol, {DAY}") -> str:
        """Final text; ``digits(column)`` is the rounding or None for exact columns."""
        out = []
        for n in cols:
            d = digits(n)
            out.append(n if d is None else f"{rnd(n, d)} AS {n}")
        return f"WITH RECURSIVE {', '.join(self.ctes)} SELECT {head}, {', '.join(out)} FROM l{self.n}"


def span(n: int) -> float:
    return 2.0 / (n + 1)
