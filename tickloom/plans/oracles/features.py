"""SQL of the feature families and of the indicator suite."""

from __future__ import annotations

from collections.abc import Callable

from .base import (
    Levels, bottom, change, div, frame, full, lag, mean, running, span, std, top, total, yes,
)
from .rounding import digits_of

TEXT: dict[str, Callable[[], tuple[Levels, list[str]]]] = {}
YEAR = "sqrt(252.0)"
TP = "((high + low + close) / 3.0)"
PC = lag("close")
TR = f"greatest(high - low, abs(high - {PC}), abs(low - {PC}))"


def text(fn):
    TEXT[fn.__name__] = fn
    return fn


def one(cols: dict[str, str]) -> tuple[Levels, list[str]]:
    return Levels().add(cols), list(cols)


@text
def price_returns():
    cols = {}
    for k in (1, 2, 3, 5, 10, 20, 50, 100):
        cols[f"return_{k}d"] = change("close", k)
        cols[f"log_return_{k}d"] = f"ln({div('close', lag('close', k))})"
    return one(cols)


@text
def price_ratios():
    return one({
        "high_low_ratio": div("high", "low"), "close_open_ratio": div("close", "open"),
        "high_close_ratio": div("high", "close"), "low_close_ratio": div("low", "close"),
        "price_position": div("close - low", "high - low"),
    })


@text
def gaps():
    return one({"gap_up": div(f"open - {PC}", PC), "gap_down": div(f"{PC} - open", PC)})


@text
def momentum():
    cols = {f"roc_{k}": change("close", k) for k in (5, 10, 20, 30, 50)}
    cols |= {f"momentum_{k}": change("close", k) for k in (5, 10, 20, 30)}
    cols |= {f"proc_{k}": div(f"close - {lag('close', k)}", lag("close", k)) for k in (5, 10, 20, 30)}
    return one(cols)


@text
def calendar():
    d = "CAST(ts AS DATE)"
    end = f"{d} = last_day({d})"
    return one({
        "day_of_week": f"CAST(isodow({d}) - 1 AS INTEGER)", "week_of_year": f"CAST(weekofyear({d}) AS INTEGER)",
        "month": f"CAST(month({d}) AS INTEGER)", "quarter": f"CAST(quarter({d}) AS INTEGER)", "year": f"CAST(year({d}) AS INTEGER)",
        "is_month_end": f"CAST({end} AS INTEGER)",
        "is_quarter_end": f"CAST({end} AND month({d}) IN (3, 6, 9, 12) AS INTEGER)",
        "is_year_end": f"CAST({end} AND month({d}) = 12 AS INTEGER)",
        "day_sin": f"sin(2 * pi() * (isodow({d}) - 1) / 7)", "day_cos": f"cos(2 * pi() * (isodow({d}) - 1) / 7)",
        "month_sin": f"sin(2 * pi() * month({d}) / 12)", "month_cos": f"cos(2 * pi() * month({d}) / 12)",
    })


@text
def microstructure():
    return one({
        "spread_proxy": div("high - low", "close"), "price_impact": div(change("close"), change("volume")),
        "tick_direction": f"CASE WHEN {yes('close > open')} THEN 1 ELSE -1 END",
    })


@text
def candles():
    body, upper, lower = "abs(close - open)", "(high - greatest(open, close))", "(least(open, close) - low)"
    share, po = div(body, "high - low"), lag("open")
    hammer = f"{lower} > 2 * {body} AND {upper} < {body}"
    rules = {
        "doji": f"{share} < 0.1", "doji_strong": f"{share} < 0.05", "doji_weak": f"{share} < 0.15",
        "hammer": hammer, "hanging_man": f"{hammer} AND close < open",
        "shooting_star": f"{upper} > 2 * {body} AND {lower} < {body}",
        "bullish_engulfing": f"close > open AND {PC} < {po} AND open < {PC} AND close > {po}",
        "bearish_engulfing": f"close < open AND {PC} > {po} AND open > {PC} AND close < {po}",
    }
    return one({n: yes(f"({r})") for n, r in rules.items()})


@text
def rolling_stats():
    cols = {}
    for n in (5, 10, 20, 50):
        cols[f"std_{n}"] = std("close", n)
        cols[f"skew_{n}"] = full("close", n, f"coalesce({frame('skewness(close)', n)}, 0)")
        cols[f"kurt_{n}"] = full("close", n, f"coalesce({frame('kurtosis(close)', n)}, 0)")
        cols[f"quantile_25_{n}"] = full("close", n, frame("quantile_cont(close, 0.25)", n))
        cols[f"quantile_75_{n}"] = full("close", n, frame("quantile_cont(close, 0.75)", n))
    return one(cols)


@text
def zscores():
    return one({f"zscore_{n}": div(f"close - {mean('close', n)}", std("close", n)) for n in (20, 50)})


@text
def volatility():
    lv = Levels().add({"ret": change("close")})
    cols = {f"volatility_{n}": f"{std('ret', n)} * {YEAR}" for n in (5, 10, 20, 50)}
    return lv.add({n: f"({e})" for n, e in cols.items()}), list(cols)


@text
def range_vol():
    hl, co = f"ln({div('high', 'low')})", f"ln({div('close', 'open')})"
    return one({
        "parkinson_vol": f"sqrt({hl} * {hl} / (4 * ln(2)))",
        "gk_vol": f"0.5 * {hl} * {hl} - (2 * ln(2) - 1) * {co} * {co}",
    })


def mads(lv: Levels, x: str, windows) -> Levels:
    lv.add({f"m_{n}": frame(f"avg({x})", n) for n in windows} | {f"li_{n}": frame(f"list({x})", n) for n in windows})
    return lv.add({
        f"mad_{n}": full(x, n, f"list_sum(list_transform(li_{n}, lambda v: abs(v - m_{n}))) / {n}.0") for n in windows
    })


@text
def dispersion():
    ns = (5, 10, 20, 30)
    lv = mads(Levels().add({"ret": change("close")}), "close", ns)
    cols = {}
    for n in ns:
        cols[f"hist_vol_{n}"] = f"({std('ret', n)}) * {YEAR}"
        cols[f"avg_dev_{n}"] = f"mad_{n}"
        cols[f"cv_{n}"] = div(std("close", n), mean("close", n))
    return lv.add(cols), list(cols)


@text
def volume_ratios():
    cols = {}
    for n in (5, 10, 20, 50):
        cols[f"volume_ma_{n}"] = mean("volume", n)
        cols[f"volume_ratio_{n}"] = div("volume", mean("volume", n))
    return one(cols)


def vw(price: str, n: int) -> str:
    return div(total(f"{price} * volume", n), total("volume", n))


@text
def volume_price():
    return one({"volume_price_trend": f"volume * {change('close')}", "volume_weighted_price": vw("close", 20)})


def obv_named(name: str):
    lv = Levels().add({"sv": f"CASE WHEN close < {PC} THEN -volume ELSE volume END"})
    return lv.add({name: running("sum(sv)")}), [name]


@text
def obv():
    return obv_named("obv")


@text
def volume_roc():
    return one({f"volume_roc_{k}": change("volume", k) for k in (5, 10, 20, 30)})


@text
def volume_smoothing():
    lv = Levels().add({"flow": f"volume * {change('close')}"})
    # the adjusted mean is a seeded recursion on the pair (weighted sum, sum of weights)
    lv.add({"one": "1.0"})
    specs, ns = {}, (5, 10, 20, 30)
    for n in ns:
        specs[f"num_{n}"] = ("volume", span(n), 1)
        specs[f"den_{n}"] = ("one", span(n), 1)
    src = lv.n
    names = ", ".join(f"num_{n}, den_{n}" for n in ns)
    first = ", ".join("CAST(volume AS DOUBLE), CAST(1 AS DOUBLE)" for _ in ns)
    step = ", ".join(f"x.volume + (1 - {span(n)!r}) * p.num_{n}, 1 + (1 - {span(n)!r}) * p.den_{n}" for n in ns)
    lv.ctes.append(
        f"adj(symbol, rn, {names}) AS (SELECT symbol, rn, {first} FROM l{src} WHERE rn = 0 UNION ALL "
        f"SELECT x.symbol, x.rn, {step} FROM adj p JOIN l{src} x ON x.symbol = p.symbol AND x.rn = p.rn + 1)"
    )
    lv.ctes.append(f"l{src + 1} AS MATERIALIZED (SELECT a.*, {names} FROM l{src} a JOIN adj r ON a.symbol = r.symbol AND a.rn = r.rn)")
    lv.n += 1
    cols = {}
    for n in ns:
        cols[f"volume_sma_{n}"] = mean("volume", n)
        cols[f"volume_ema_{n}"] = f"num_{n} / den_{n}"
        cols[f"vpt_{n}"] = total("flow", n)
    return lv.add(cols), list(cols)


def mfi_named(names: dict[str, int]):
    lv = Levels().add({"tp": TP}).add({"dtp": f"tp - {lag('tp')}"})
    lv.add({"inn": "CASE WHEN dtp > 0 THEN tp * volume ELSE 0 END", "outt": "CASE WHEN dtp < 0 THEN tp * volume ELSE 0 END"})
    lv.add({f"p{n}": total("inn", n) for n in names.values()} | {f"q{n}": total("outt", n) for n in names.values()})
    cols = {
        name: f"CASE WHEN q{n} = 0 AND p{n} > 0 THEN 100 ELSE 100 - 100 / (1 + {div(f'p{n}', f'q{n}')}) END"
        for name, n in names.items()
    }
    return lv.add(cols), list(cols)


@text
def mfi():
    return mfi_named({f"mfi_{n}": n for n in (7, 14, 21, 30)})


def force_named(names: dict[str, int]):
    lv = Levels().add({"fo": f"(close - {PC}) * volume"})
    return lv.ema({name: ("fo", span(n), n) for name, n in names.items()}), list(names)


@text
def force_index():
    return force_named({f"force_index_{n}": n for n in (1, 5, 10, 20)})


EASE = div(f"((high - {lag('high')}) + (low - {lag('low')})) * (high - low)", "2 * volume") + " * 1e8"


@text
def eom():
    return one({f"eom_{n}": EASE for n in (5, 10, 20)})


@text
def vwap():
    return one({f"vwap_{n}": vw("close", n) for n in (5, 10, 20, 30)})


@text
def bollinger_grid():
    ns = (10, 15, 20, 25, 30)
    lv = Levels().add({f"m_{n}": mean("close", n) for n in ns} | {f"s_{n}": full("close", n, frame("stddev_pop(close)", n)) for n in ns})
    cols = {}
    for n in ns:
        for d in ("1.5", "2.0", "2.5"):
            u, lo, tag = f"(m_{n} + {d} * s_{n})", f"(m_{n} - {d} * s_{n})", f"{n}_{d.replace('.', '_')}"
            cols |= {f"bb_upper_{tag}": u, f"bb_lower_{tag}": lo, f"bb_middle_{tag}": f"m_{n}",
                     f"bb_width_{tag}": div(f"{u} - {lo}", f"m_{n}"), f"bb_position_{tag}": div(f"close - {lo}", f"{u} - {lo}")}
    return lv.add(cols), list(cols)


@text
def atr():
    ns = (7, 14, 21, 30)
    lv = Levels().add({"tr": TR}).ema({f"atr_{n}": ("tr", 1.0 / n, n, "mean", "0.0") for n in ns})
    return lv.add({f"atr_{n}_ratio": div(f"atr_{n}", "close") for n in ns}), [x for n in ns for x in (f"atr_{n}", f"atr_{n}_ratio")]


@text
def donchian():
    cols = {}
    for n in (10, 20, 30, 50):
        u, lo = f"({top('high', n)})", f"({bottom('low', n)})"
        cols |= {f"donchian_upper_{n}": u, f"donchian_lower_{n}": lo, f"donchian_middle_{n}": f"({u} + {lo}) / 2",
                 f"donchian_position_{n}": div(f"close - {lo}", f"{u} - {lo}")}
    return one(cols)


MIXES = {"middle": "high + low + close", "upper": "4 * high - 2 * low + close", "lower": "-2 * high + 4 * low + close"}


@text
def keltner_grid():
    cols = {}
    for n in (10, 20, 30):
        for m in ("1_5", "2_0", "2_5"):
            for p in ("upper", "lower", "middle"):
                cols[f"keltner_{p}_{n}_{m}"] = frame(f"avg({MIXES[p]})", n) + " / 3.0"
    return one(cols)


def rsi_levels(names: dict[str, int]) -> Levels:
    lv = Levels().add({"dc": f"close - {PC}"})
    lv.add({"up": "CASE WHEN dc > 0 THEN dc ELSE 0.0 END", "dn": "CASE WHEN dc < 0 THEN -dc ELSE 0.0 END"})
    lv.ema({f"u_{n}": ("up", 1.0 / n, n) for n in names.values()} | {f"d_{n}": ("dn", 1.0 / n, n) for n in names.values()})
    return lv.add({
        name: f"CASE WHEN d_{n} = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + {div(f'u_{n}', f'd_{n}')}) END" for name, n in names.items()
    })


@text
def rsi():
    ns = (7, 9, 14, 21, 28)
    lv = rsi_levels({f"rsi_{n}": n for n in ns})
    lv.add({f"rsi_{n}_change": f"rsi_{n} - {lag(f'rsi_{n}')}" for n in ns} | {f"rsi_{n}_ma": mean(f"rsi_{n}", 5) for n in ns})
    return lv, [f"rsi_{n}{x}" for n in ns for x in ("", "_change", "_ma")]


def stoch(n: int, c="close", h="high", lo="low") -> str:
    return div(f"100.0 * ({c} - ({bottom(lo, n)}))", f"({top(h, n)}) - ({bottom(lo, n)})")


@text
def stochastic_grid():
    ks = (5, 9, 14, 21)
    lv, cols = Levels().add({f"k_{k}": stoch(k) for k in ks}), {}
    for k in ks:
        for d in (3, 5, 9):
            cols |= {f"stoch_k_{k}_{d}": f"k_{k}", f"stoch_d_{k}_{d}": mean(f"k_{k}", d)}
    return lv.add(cols), list(cols)


def wr(n: int) -> str:
    return div(f"-100.0 * (({top('high', n)}) - close)", f"({top('high', n)}) - ({bottom('low', n)})")


@text
def williams_r():
    return one({f"williams_r_{n}": wr(n) for n in (7, 14, 21, 28)})


def cci_named(names: dict[str, int]):
    lv = mads(Levels().add({"tp": TP}), "tp", tuple(names.values()))
    cols = {name: div(f"tp - ({mean('tp', n)})", f"0.015 * mad_{n}") for name, n in names.items()}
    return lv.add(cols), list(cols)


@text
def cci():
    return cci_named({f"cci_{n}": n for n in (10, 14, 20, 30)})


def uo_named(names: dict[str, tuple[int, int, int]]):
    ns = sorted({n for t in names.values() for n in t})
    lv = Levels().add({"pc": PC}).add({"bp": "close - least(low, coalesce(pc, low))", "tr": "greatest(high, coalesce(pc, high)) - least(low, coalesce(pc, low))"})
    lv.add({f"a_{n}": div(total("bp", n), total("tr", n)) for n in ns})
    cols = {name: f"100.0 * (4 * a_{x} + 2 * a_{y} + a_{z}) / 7.0" for name, (x, y, z) in names.items()}
    return lv.add(cols), list(cols)


@text
def ultimate_osc():
    sets = [(x, y, z) for x in (7, 14) for y in (14, 21) for z in (28, 42)]
    return uo_named({f"ultimate_osc_{x}_{y}_{z}": (x, y, z) for x, y, z in sets})


AO = f"({mean('(high + low) / 2', 5)}) - ({mean('(high + low) / 2', 34)})"


@text
def awesome_osc():
    return one({"awesome_osc": AO})


@text
def trend_strength():
    cols = {}
    for n in (20, 50, 100):
        m = f"({mean('close', n)})"
        cols[f"trend_strength_{n}"] = div("close", m)
        cols[f"trend_direction_{n}"] = f"CASE WHEN {yes(f'close > {m}')} THEN 1 ELSE -1 END"
    return one(cols)


@text
def detrended():
    return one({f"detrended_price_{n}": f"close - ({mean('close', n)})" for n in (20, 50)})


def adx_named(adx: str, pos: str, neg: str, n: int = 14):
    lv = Levels().add({"pc": PC, "dh": f"high - {lag('high')}", "dl": f"{lag('low')} - low"})
    lv.add({
        "tr": "CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END",
        "pdm": "CASE WHEN dh IS NULL THEN NULL WHEN dh > dl AND dh > 0 THEN dh ELSE 0.0 END",
        "ndm": "CASE WHEN dh IS NULL THEN NULL WHEN dl > dh AND dl > 0 THEN dl ELSE 0.0 END",
    })
    lv.ema({f"w{x}": (x, 1.0 / n, n, "mean") for x in ("tr", "pdm", "ndm")})
    for name, x in ((pos, "wpdm"), (neg, "wndm")):
        lv.add({name: f"CASE WHEN wtr IS NOT NULL THEN coalesce({div(f'100.0 * {x}', 'wtr')}, 0) END"})
    lv.add({"dx": f"CASE WHEN {pos} IS NOT NULL THEN coalesce({div(f'100.0 * abs({pos} - {neg})', f'{pos} + {neg}')}, 0) END"})
    return lv.ema({adx: ("dx", 1.0 / n, n, "mean")}), [adx, pos, neg]


@text
def adx():
    return adx_named("adx", "adx_pos", "adx_neg")


def macd_named(sets: dict[str, tuple[int, int]], names, x="close", percent=False):
    ns = sorted({n for p in sets.values() for n in p})
    lv = Levels().ema({f"e_{n}": (x, span(n), n) for n in ns})
    lv.add({
        names(t)[0]: f"100.0 * {div(f'e_{f} - e_{w}', f'e_{w}')}" if percent else f"e_{f} - e_{w}" for t, (f, w) in sets.items()
    })
    lv.ema({names(t)[1]: (names(t)[0], span(9), 9) for t in sets})
    lv.add({names(t)[2]: f"{names(t)[0]} - {names(t)[1]}" for t in sets})
    return lv, [c for t in sets for c in names(t)]


@text
def macd_grid():
    return macd_named({f"{f}_{w}": (f, w) for f in (8, 12, 16) for w in (21, 26, 30)}, lambda t: (f"macd_{t}", f"macd_signal_{t}", f"macd_diff_{t}"))


@text
def ppo_grid():
    return macd_named({f"{f}_{w}": (f, w) for f in (6, 12, 18) for w in (26, 35, 50)}, lambda t: (f"ppo_{t}", f"ppo_signal_{t}", f"ppo_hist_{t}"), percent=True)


@text
def moving_averages():
    ns = (3, 7, 13, 17, 21, 34, 55, 89, 144, 233)
    lv = Levels().ema({f"ema_{n}": ("close", span(n), n) for n in ns})
    lv.add({f"sma_{n}": mean("close", n) for n in ns} | {
        f"wma_{n}": full("close", n, f"({frame('sum(rn * close)', n)} - (rn - {n}) * {frame('sum(close)', n)}) / {n * (n + 1) / 2}") for n in ns
    })
    cols = {}
    for n in ns:
        for k in ("sma", "ema"):
            cols[f"price_above_{k}_{n}"] = f"CAST({yes(f'close > {k}_{n}')} AS INTEGER)"
            cols[f"{k}_{n}_slope"] = f"{k}_{n} - {lag(f'{k}_{n}', 5)}"
    lv.add(cols)
    return lv, [x for n in ns for x in (f"sma_{n}", f"ema_{n}", f"wma_{n}", f"price_above_sma_{n}", f"price_above_ema_{n}", f"sma_{n}_slope", f"ema_{n}_slope")]


def mid(n: int) -> str:
    return f"(({top('high', n)}) + ({bottom('low', n)})) / 2"


@text
def ichimoku():
    lv = Levels().add({"ichimoku_conversion": mid(9), "ichimoku_base": mid(26), "ichimoku_b": mid(52)})
    lv.add({"ichimoku_a": "(ichimoku_conversion + ichimoku_base) / 2"}).add({"ichimoku_span": "ichimoku_a - ichimoku_b"})
    return lv, ["ichimoku_a", "ichimoku_b", "ichimoku_base", "ichimoku_conversion", "ichimoku_span"]


def psar_levels(sets: dict[str, tuple[float, float]]) -> Levels:
    """Stop-and-reverse by a recursive CTE; each parameter set adds its own state columns."""
    lv = Levels().add({"h1": lag("high"), "h2": lag("high", 2), "lo1": lag("low"), "lo2": lag("low", 2)})
    src = lv.n
    for i, (name, (step, limit)) in enumerate(sets.items()):
        raw = "(p.stop + p.pace * (p.ext - p.stop))"
        turned = f"(CASE WHEN p.up THEN x.low < {raw} ELSE x.high > {raw} END)"
        held = (
            f"(CASE WHEN p.up THEN CASE WHEN x.lo2 < {raw} THEN x.lo2 WHEN x.lo1 < {raw} THEN x.lo1 ELSE {raw} END "
            f"ELSE CASE WHEN x.h2 > {raw} THEN x.h2 WHEN x.h1 > {raw} THEN x.h1 ELSE {raw} END END)"
        )
        further = "(CASE WHEN p.up THEN x.high > p.ext ELSE x.low < p.ext END)"
        lv.ctes.append(
            f"s{i}(symbol, rn, up, pace, ext, stop) AS ("
            f"SELECT symbol, rn, true, {step}::DOUBLE, (SELECT f.high FROM l{src} f WHERE f.symbol = o.symbol AND f.rn = 0), close "
            f"FROM l{src} o WHERE rn = least(1, (SELECT max(rn) FROM l{src} g WHERE g.symbol = o.symbol)) "
            f"UNION ALL SELECT x.symbol, x.rn, p.up <> {turned}, "
            f"CASE WHEN {turned} THEN {step} WHEN {further} THEN least(p.pace + {step}, {limit}) ELSE p.pace END, "
            f"CASE WHEN {turned} THEN CASE WHEN p.up THEN x.low ELSE x.high END "
            f"WHEN {further} THEN CASE WHEN p.up THEN x.high ELSE x.low END ELSE p.ext END, "
            f"CASE WHEN {turned} THEN p.ext ELSE {held} END "
            f"FROM s{i} p JOIN l{src} x ON x.symbol = p.symbol AND x.rn = p.rn + 1)"
        )
        lv.ctes.append(
            f"l{lv.n + 1} AS MATERIALIZED (SELECT a.*, coalesce(r.stop, a.close) AS {name}, CASE WHEN a.rn >= 2 THEN r.up END AS {name}_up "
            f"FROM l{lv.n} a LEFT JOIN s{i} r ON a.symbol = r.symbol AND a.rn = r.rn)"
        )
        lv.n += 1
    return lv


@text
def psar_grid():
    sets = {f"psar_{round(s * 100)}_{round(m * 100)}": (s, m) for s in (0.02, 0.04, 0.06) for m in (0.1, 0.2, 0.3)}
    return psar_levels(sets), list(sets)


@text
def fallback_set():
    ns = (5, 10, 20, 50, 100, 200)
    lv = rsi_levels({"rsi_14": 14, "rsi_21": 21})
    lv.ema({f"ema_{n}": ("close", span(n), n) for n in ns} | {"f12": ("close", span(12), 12), "f26": ("close", span(26), 26)})
    lv.add({f"sma_{n}": mean("close", n) for n in ns} | {"macd": "f12 - f26", "stoch_k": stoch(14), "williams_r": wr(14), "bb_mid": mean("close", 20), "dev": full("close", 20, frame("stddev_pop(close)", 20))})
    lv.ema({"macd_signal": ("macd", span(9), 9)})
    lv.add({"macd_diff": "macd - macd_signal", "stoch_d": mean("stoch_k", 3), "bb_high": "bb_mid + 2 * dev", "bb_low": "bb_mid - 2 * dev"})
    lv.add({"bb_width": div("bb_high - bb_low", "bb_mid"), "bb_position": div("close - bb_low", "bb_high - bb_low")})
    return lv, ["rsi_14", "rsi_21", "stoch_k", "stoch_d", "williams_r", "macd", "macd_signal", "macd_diff"] + [
        f"{p}_{n}" for n in ns for p in ("sma", "ema")] + ["bb_high", "bb_low", "bb_mid", "bb_width", "bb_position"]


# ------------------------------------------------------------------------------- suite

CLV = f"coalesce({div('(close - low) - (high - close)', 'high - low')}, 0)"


@text
def ta_adi():
    lv = Levels().add({"mfv": f"{CLV} * volume"})
    return lv.add({"volume_adi": running("sum(mfv)")}), ["volume_adi"]


@text
def ta_obv():
    return obv_named("volume_obv")


@text
def ta_cmf():
    lv = Levels().add({"mfv": f"{CLV} * volume"})
    return lv.add({"volume_cmf": div(total("mfv", 20), total("volume", 20))}), ["volume_cmf"]


@text
def ta_fi():
    return force_named({"volume_fi": 13})


@text
def ta_eom():
    lv = Levels().add({"volume_em": EASE})
    return lv.add({"volume_sma_em": mean("volume_em", 14)}), ["volume_em", "volume_sma_em"]


@text
def ta_vpt():
    lv = Levels().add({"flow": f"volume * {change('close')}"})
    return lv.add({"volume_vpt": running("sum(flow)")}), ["volume_vpt"]


@text
def ta_vwap():
    return one({"volume_vwap": vw(TP, 14)})


@text
def ta_mfi():
    return mfi_named({"volume_mfi": 14})


@text
def ta_nvi():
    lv = Levels().add({"st": f"CASE WHEN volume < {lag('volume')} THEN 1 + {change('close')} ELSE 1.0 END"})
    return lv.add({"volume_nvi": f"1000.0 * {running('product(st)')}"}), ["volume_nvi"]


def outside(h: str, lo: str, a: str, b: str) -> dict[str, str]:
    return {a: f"CAST({yes(f'close > {h}')} AS DOUBLE)", b: f"CAST({yes(f'close < {lo}')} AS DOUBLE)"}


@text
def ta_bb():
    v = "volatility_bb"
    lv = Levels().add({f"{v}m": mean("close", 20), "dev": full("close", 20, frame("stddev_pop(close)", 20))})
    lv.add({f"{v}h": f"{v}m + 2 * dev", f"{v}l": f"{v}m - 2 * dev"})
    lv.add({f"{v}w": f"100 * {div(f'{v}h - {v}l', f'{v}m')}", f"{v}p": div(f"close - {v}l", f"{v}h - {v}l")} | outside(f"{v}h", f"{v}l", f"{v}hi", f"{v}li"))
    return lv, [f"{v}{x}" for x in ("m", "h", "l", "w", "p", "hi", "li")]


@text
def ta_kc():
    v = "volatility_kc"
    lv = Levels().add({"mx_c": MIXES["middle"], "mx_h": MIXES["upper"], "mx_l": MIXES["lower"]})
    lv.add({f"{v}c": f"({mean('mx_c', 10)}) / 3.0", f"{v}h": f"({mean('mx_h', 10)}) / 3.0", f"{v}l": f"({mean('mx_l', 10)}) / 3.0"})
    lv.add({f"{v}w": f"100 * {div(f'{v}h - {v}l', f'{v}c')}", f"{v}p": div(f"close - {v}l", f"{v}h - {v}l")} | outside(f"{v}h", f"{v}l", f"{v}hi", f"{v}li"))
    return lv, [f"{v}{x}" for x in ("c", "h", "l", "w", "p", "hi", "li")]


@text
def ta_dc():
    v = "volatility_dc"
    lv = Levels().add({f"{v}l": bottom("low", 20), f"{v}h": top("high", 20), "mm": mean("close", 20)})
    lv.add({f"{v}m": f"{v}l + ({v}h - {v}l) / 2", f"{v}w": f"100 * {div(f'{v}h - {v}l', 'mm')}", f"{v}p": div(f"close - {v}l", f"{v}h - {v}l")})
    return lv, [f"{v}{x}" for x in ("l", "h", "m", "w", "p")]


@text
def ta_atr():
    return Levels().add({"tr": TR}).ema({"volatility_atr": ("tr", 0.1, 10, "mean", "0.0")}), ["volatility_atr"]


@text
def ta_ui():
    lv = Levels().add({"pk": frame("max(close)", 14)}).add({"dr": "pow(100.0 * (close - pk) / pk, 2)"})
    return lv.add({"volatility_ui": f"sqrt({mean('dr', 14)})"}), ["volatility_ui"]


@text
def ta_macd():
    return macd_named({"": (12, 26)}, lambda _: ("trend_macd", "trend_macd_signal", "trend_macd_diff"))


@text
def ta_ma():
    lv = Levels().ema({"trend_ema_fast": ("close", span(12), 12), "trend_ema_slow": ("close", span(26), 26)})
    lv.add({"trend_sma_fast": mean("close", 12), "trend_sma_slow": mean("close", 26)})
    return lv, ["trend_sma_fast", "trend_sma_slow", "trend_ema_fast", "trend_ema_slow"]


@text
def ta_vortex():
    lv = Levels().add({"tr": TR, "vp": f"abs(high - {lag('low')})", "vm": f"abs(low - {lag('high')})"})
    v = "trend_vortex_ind"
    lv.add({f"{v}_pos": div(total("vp", 14), total("tr", 14)), f"{v}_neg": div(total("vm", 14), total("tr", 14))})
    return lv.add({f"{v}_diff": f"{v}_pos - {v}_neg"}), [f"{v}_{x}" for x in ("pos", "neg", "diff")]


@text
def ta_trix():
    lv = Levels().ema({"x1": ("close", span(15), 15)}).ema({"x2": ("x1", span(15), 15)}).ema({"x3": ("x2", span(15), 15)})
    return lv.add({"trend_trix": f"100 * {change('x3')}"}), ["trend_trix"]


@text
def ta_mass():
    lv = Levels().add({"hl": "high - low"}).ema({"x1": ("hl", span(9), 9)}).ema({"x2": ("x1", span(9), 9)}).add({"ms": div("x1", "x2")})
    return lv.add({"trend_mass_index": total("ms", 25)}), ["trend_mass_index"]


@text
def ta_dpo():
    return one({"trend_dpo": f"{lag('close', 11)} - ({mean('close', 20)})"})


@text
def ta_kst():
    terms = ((10, 10), (15, 10), (20, 10), (30, 15))
    lv = Levels().add({f"r{r}": change("close", r) for r, _ in terms})
    lv.add({"trend_kst": "100 * (" + " + ".join(f"{i} * ({mean(f'r{r}', n)})" for i, (r, n) in enumerate(terms, 1)) + ")"})
    lv.add({"trend_kst_sig": mean("trend_kst", 9)})
    return lv.add({"trend_kst_diff": "trend_kst - trend_kst_sig"}), ["trend_kst", "trend_kst_sig", "trend_kst_diff"]


@text
def ta_ichimoku():
    v = "trend_ichimoku"
    lv = Levels().add({f"{v}_conv": mid(9), f"{v}_base": mid(26), f"{v}_b": mid(52)}).add({f"{v}_a": f"({v}_conv + {v}_base) / 2"})
    lv.add({f"trend_visual_ichimoku_{x}": lag(f"{v}_{x}", 26) for x in "ab"})
    return lv, [f"{v}_{x}" for x in ("conv", "base", "a", "b")] + ["trend_visual_ichimoku_a", "trend_visual_ichimoku_b"]


@text
def ta_stc():
    def filled(x: str) -> str:
        return f"last_value({x} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"

    lv = Levels().ema({"f": ("close", span(23), 23), "w": ("close", span(50), 50)}).add({"ln": "f - w"})
    lv.add({"r1": stoch(10, "ln", "ln", "ln")}).add({"k1": filled("r1")}).ema({"d1": ("k1", span(3), 3)})
    lv.add({"r2": stoch(10, "d1", "d1", "d1")}).add({"k2": filled("r2")}).ema({"trend_stc": ("k2", span(3), 3)})
    return lv, ["trend_stc"]


@text
def ta_adx():
    return adx_named("trend_adx", "trend_adx_pos", "trend_adx_neg")


@text
def ta_cci():
    return cci_named({"trend_cci": 20})


@text
def ta_aroon():
    lv = Levels().add({"hi": frame("list(high)", 25), "li": frame("list(low)", 25)})
    lv.add({
        "trend_aroon_up": full("close", 25, "list_position(hi, list_max(hi)) / 25.0 * 100"),
        "trend_aroon_down": full("close", 25, "list_position(li, list_min(li)) / 25.0 * 100"),
    })
    return lv.add({"trend_aroon_ind": "trend_aroon_up - trend_aroon_down"}), ["trend_aroon_up", "trend_aroon_down", "trend_aroon_ind"]


@text
def ta_psar():
    lv = psar_levels({"st": (0.02, 0.2)})
    lv.add({
        "trend_psar_up": "CASE WHEN st_up THEN st END", "trend_psar_down": "CASE WHEN NOT st_up THEN st END",
        "trend_psar_up_indicator": f"CAST({yes(f'st_up AND NOT coalesce({lag('st_up')}, false)')} AS DOUBLE)",
        "trend_psar_down_indicator": f"CAST({yes(f'NOT st_up AND coalesce({lag('st_up')}, true)')} AS DOUBLE)",
    })
    return lv, ["trend_psar_up", "trend_psar_down", "trend_psar_up_indicator", "trend_psar_down_indicator"]


@text
def ta_rsi():
    return rsi_levels({"momentum_rsi": 14}), ["momentum_rsi"]


@text
def ta_stochrsi():
    v = "momentum_stoch_rsi"
    lv = rsi_levels({"r": 14}).add({v: div(f"r - ({bottom('r', 14)})", f"({top('r', 14)}) - ({bottom('r', 14)})")})
    return lv.add({f"{v}_k": mean(v, 3)}).add({f"{v}_d": mean(f"{v}_k", 3)}), [v, f"{v}_k", f"{v}_d"]


@text
def ta_tsi():
    lv = Levels().add({"d": f"close - {PC}"}).add({"da": "abs(d)"})
    lv.ema({"d1": ("d", span(25), 25), "a1": ("da", span(25), 25)}).ema({"d2": ("d1", span(13), 13), "a2": ("a1", span(13), 13)})
    return lv.add({"momentum_tsi": f"100 * {div('d2', 'a2')}"}), ["momentum_tsi"]


@text
def ta_uo():
    return uo_named({"momentum_uo": (7, 14, 28)})


@text
def ta_stoch():
    lv = Levels().add({"momentum_stoch": stoch(14)})
    return lv.add({"momentum_stoch_signal": mean("momentum_stoch", 3)}), ["momentum_stoch", "momentum_stoch_signal"]


@text
def ta_wr():
    return one({"momentum_wr": wr(14)})


@text
def ta_ao():
    return one({"momentum_ao": AO})


@text
def ta_roc():
    return one({"momentum_roc": f"100 * {change('close', 12)}"})


def ppo_named(x: str, v: str):
    return macd_named({"": (12, 26)}, lambda _: (v, f"{v}_signal", f"{v}_hist"), x=x, percent=True)


@text
def ta_ppo():
    return ppo_named("close", "momentum_ppo")


@text
def ta_pvo():
    return ppo_named("volume", "momentum_pvo")


@text
def ta_kama():
    lv = Levels().add({"sp": f"abs(close - {PC})", "nt": f"abs(close - {lag('close', 10)})"})
    lv.add({"sc": f"pow(coalesce({div('nt', frame('sum(sp)', 10))}, 0) * (2.0/3 - 2.0/31) + 2.0/31, 2)"})
    src = lv.n
    lv.ctes.append(
        f"ka(symbol, rn, y) AS (SELECT symbol, rn, CAST(close AS DOUBLE) FROM l{src} WHERE rn = 10 UNION ALL "
        f"SELECT x.symbol, x.rn, p.y + x.sc * (x.close - p.y) FROM ka p JOIN l{src} x ON x.symbol = p.symbol AND x.rn = p.rn + 1)"
    )
    lv.ctes.append(f"l{src + 1} AS (SELECT a.*, y AS momentum_kama FROM l{src} a LEFT JOIN ka ON a.symbol = ka.symbol AND a.rn = ka.rn)")
    lv.n += 1
    return lv, ["momentum_kama"]


@text
def ta_returns():
    first = "first_value(close) OVER (PARTITION BY symbol ORDER BY ts)"
    return one({"others_dr": f"100 * {change('close')}", "others_dlr": f"100 * ln({div('close', PC)})", "others_cr": f"100 * ({div('close', first)} - 1)"})


def feature_sql(name: str) -> str:
    levels, cols = TEXT[name]()
    return levels.sql(cols, lambda c: digits_of(name, c))


def suite_sql(names: list[str]) -> str:
    """All suite columns side by side, one subquery per indicator."""
    out = f"SELECT * FROM ({feature_sql(names[0])})"
    for n in names[1:]:
        out += f" JOIN ({feature_sql(n)}) USING (symbol, day)"
    return out
