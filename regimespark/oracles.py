"""Building blocks of the DuckDB SQL that the registered queries are held against.

Exponential means are recursive here and closed-form windows in Spark, so that the two check
each other.
"""

from __future__ import annotations

W = "PARTITION BY symbol ORDER BY ts"


#: Added to the events' values, which are small, so that returns are of a market's size.
LEVEL = 10_000.0


def bars(width: str = "15 minutes", name: str = "b") -> list[str]:
    v = f"(value + {LEVEL}::DOUBLE)"
    return [
        f"{name}0 AS MATERIALIZED (SELECT event_type AS symbol, time_bucket(INTERVAL '{width}', ts) AS ts, arg_min({v}, ts) AS open, max({v}) AS high, min({v}) AS low, "
        f"arg_max({v}, ts) AS close, count(*)::DOUBLE AS volume FROM events WHERE value IS NOT NULL GROUP BY 1, 2)",
        f"{name} AS MATERIALIZED (SELECT *, row_number() OVER ({W}) - 1 AS rn FROM {name}0 WHERE low > 0)",
    ]


def sql(*parts) -> str:
    """WITH RECURSIVE the given CTEs (strings or lists of them), the last part being the query."""
    flat = [x for p in parts[:-1] for x in ([p] if isinstance(p, str) else p)]
    return "WITH RECURSIVE " + ",\n".join(flat) + "\n" + parts[-1]


def roll(f: str, x: str, k: int, skip: int = 0) -> str:
    frame = f"({W} ROWS BETWEEN {k - 1 + skip} PRECEDING AND {skip} PRECEDING)"
    return f"CASE WHEN count({x}) OVER {frame} = {k} THEN {f}({x}) OVER {frame} END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({W})"


def lead(x: str, k: int = 1) -> str:
    return f"lead({x}, {k}) OVER ({W})"


def upto(f: str, x: str) -> str:
    return f"{f}({x}) OVER ({W} ROWS UNBOUNDED PRECEDING)"


def ffill(x: str) -> str:
    return f"last_value({x} IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING)"


def zscore(x: str, k: int) -> str:
    frame = f"({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {frame} = {k} THEN ({x} - avg({x}) OVER {frame}) / nullif(stddev_pop({x}) OVER {frame}, 0) END"


def ewm(name: str, src: str, x: str, a: float) -> list[str]:
    """CTE name(symbol, rn, y, n): the recursive mean, and the number of values so far."""
    return [
        f"{name}_x AS MATERIALIZED (SELECT symbol, rn, {x} AS x FROM {src} WHERE {x} IS NOT NULL)",
        f"{name}_s AS MATERIALIZED (SELECT symbol, min(rn) AS s FROM {name}_x GROUP BY 1)",
        f"{name}(symbol, rn, y, n) AS (SELECT v.symbol, v.rn, v.x, 1 FROM {name}_x v JOIN {name}_s s ON v.symbol = s.symbol AND v.rn = s.s "
        f"UNION ALL SELECT v.symbol, v.rn, {1 - a!r} * e.y + {a!r} * v.x, e.n + 1 FROM {name} e JOIN {name}_x v ON v.symbol = e.symbol AND v.rn = e.rn + 1)",
    ]


def plus(name: str, src: str, *added: tuple[str, str, int]) -> str:
    """CTE of src with columns from exponential means: (ewm CTE, column, least number of values)."""
    cols = ", ".join(f"CASE WHEN {e}.n >= {m} THEN {e}.y END AS {c}" for e, c, m in added)
    joins = " ".join(f"LEFT JOIN {e} ON {e}.symbol = {src}.symbol AND {e}.rn = {src}.rn" for e, _, _ in added)
    return f"{name} AS MATERIALIZED (SELECT {src}.*, {cols} FROM {src} {joins})"


def true_range(name: str = "t", src: str = "b") -> str:
    c = lag("close")
    return f"{name} AS MATERIALIZED (SELECT *, greatest(high - low, abs(high - {c}), abs(low - {c})) AS true_range FROM {src})"


def atr(k: int = 14, name: str = "a", src: str = "b") -> list[str]:
    """CTE `name`: src with true_range and atr_k."""
    return [true_range(f"{name}_t", src), *ewm(f"{name}_e", f"{name}_t", "true_range", 1 / k), plus(name, f"{name}_t", (f"{name}_e", f"atr_{k}", k))]


def rsi(k: int = 14, name: str = "r", src: str = "b") -> list[str]:
    d = f"(close - {lag('close')})"
    return [
        f"{name}_d AS MATERIALIZED (SELECT *, {d} AS d FROM {src})", f"{name}_g AS MATERIALIZED (SELECT *, CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0.0 END AS g, CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0.0 END AS l FROM {name}_d)",
        *ewm(f"{name}_eg", f"{name}_g", "g", 1 / k), *ewm(f"{name}_el", f"{name}_g", "l", 1 / k), plus(f"{name}_p", src, (f"{name}_eg", "_g", k), (f"{name}_el", "_l", k)),
        f"{name} AS MATERIALIZED (SELECT * EXCLUDE (_g, _l), coalesce(100 - 100 / (1 + _g / nullif(_l, 0)), 50) AS rsi_{k} FROM {name}_p)",
    ]


def adx(name: str = "x", src: str = "a") -> list[str]:
    """CTE `name`: src (with atr_14) and plus_di, minus_di, adx_14."""
    up, down = f"(high - {lag('high')})", f"({lag('low')} - low)"
    return [
        f"{name}_m AS MATERIALIZED (SELECT *, CASE WHEN {up} > {down} AND {up} > 0 THEN {up} ELSE 0 END AS pu, CASE WHEN {down} > {up} AND {down} > 0 THEN {down} ELSE 0 END AS pd FROM {src})",
        *ewm(f"{name}_u", f"{name}_m", "pu", 1 / 14), *ewm(f"{name}_v", f"{name}_m", "pd", 1 / 14), plus(f"{name}_p", src, (f"{name}_u", "pu", 14), (f"{name}_v", "pd", 14)),
        f"{name}_i AS MATERIALIZED (SELECT * EXCLUDE (pu, pd), 100 * pu / nullif(atr_14, 0) AS plus_di, 100 * pd / nullif(atr_14, 0) AS minus_di FROM {name}_p)",
        f"{name}_d AS MATERIALIZED (SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx FROM {name}_i)",
        *ewm(f"{name}_e", f"{name}_d", "dx", 1 / 14), plus(name, f"{name}_i", (f"{name}_e", "adx_14", 14)),
    ]


def emas(name: str, src: str, *spans: int, x: str = "close") -> list[str]:
    parts = [c for s in spans for c in ewm(f"{name}_{s}", src, x, 2 / (s + 1))]
    return [*parts, plus(name, src, *((f"{name}_{s}", f"ema_{s}", 0) for s in spans))]


def hurst(name: str = "hu", src: str = "b") -> list[str]:
    import math

    lags = range(2, 21)
    xs = [math.log(k) for k in lags]
    mean = sum(xs) / len(xs)
    scale = sum((x - mean) ** 2 for x in xs)
    diffs = ", ".join(f"power(ln(close) - lag(ln(close), {k}) OVER ({W}), 2) AS d{k}" for k in lags)
    means = ", ".join(f"{roll('avg', f'd{k}', 100)} AS m{k}" for k in lags)
    total = " + ".join(f"{(x - mean) / scale!r} * ln(sqrt(CASE WHEN m{k} > 0 THEN m{k} END))" for k, x in zip(lags, xs, strict=True))
    drop = ", ".join([*(f"m{k}" for k in lags), *(f"d{k}" for k in lags)])
    return [f"{name}_d AS MATERIALIZED (SELECT *, {diffs} FROM {src})", f"{name}_m AS MATERIALIZED (SELECT *, {means} FROM {name}_d)", f"{name} AS MATERIALIZED (SELECT * EXCLUDE ({drop}), {total} AS hurst_100 FROM {name}_m)"]


def rank(x: str, k: int) -> str:
    """Average-tie rank of the last of k values, over k."""
    frame = f"({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    seen = f"list({x}) OVER {frame}"
    return f"CASE WHEN count({x}) OVER {frame} = {k} THEN (len(list_filter({seen}, lambda v: v < {x})) + (len(list_filter({seen}, lambda v: v = {x})) + 1) / 2) / {k} END"


def show(src: str, cols: list[str], digits: int = 6) -> str:
    return f"SELECT symbol, ts, {', '.join(f'round({c}, {digits}) AS {c}' for c in cols)} FROM {src}"
