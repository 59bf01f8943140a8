"""Rule signals and signal transforms: a `signal` in [-1, 1] on each bar."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import ffill, lag, series
from . import indicators as ind


def _held(df: DataFrame, value) -> DataFrame:
    return df.withColumn("signal", F.coalesce(ffill(value), F.lit(0.0)))


def buy_and_hold(df: DataFrame) -> DataFrame:
    return df.withColumn("signal", F.lit(1.0))


def ma_crossover(df: DataFrame, fast: int = 50, slow: int = 200) -> DataFrame:
    out = ind.ema(df, fast, slow)
    return out.withColumn("signal", F.signum(F.col(f"ema_{fast}") - F.col(f"ema_{slow}"))).select(*df.columns, "signal")


def rsi_mean_reversion(df: DataFrame, window: int = 14, lower: float = 30, upper: float = 70) -> DataFrame:
    out, r = ind.rsi(df, window), F.col(f"rsi_{window}")
    value = F.when(r < lower, 1.0).when(r > upper, -1.0).when((r > 45) & (r < 55), 0.0)
    return _held(out, value).select(*df.columns, "signal")


def donchian_breakout(df: DataFrame, window: int = 55) -> DataFrame:
    out, p = ind.donchian(df, window), f"dc_{window}"
    value = F.when(F.col("close") > F.col(f"{p}_upper"), 1.0).when(F.col("close") < F.col(f"{p}_lower"), -1.0)
    return _held(out, value).select(*df.columns, "signal")


def volatility_filtered_trend(df: DataFrame, fast: int = 50, slow: int = 200, floor: float = 20) -> DataFrame:
    out = ind.directional_index(ma_crossover(df, fast, slow))
    return out.withColumn("signal", F.when(F.col("adx_14") >= floor, F.col("signal")).otherwise(0.0)).select(*df.columns, "signal")


RULES = {
    "buy_and_hold": buy_and_hold, "ma_crossover": ma_crossover, "rsi_mean_reversion": rsi_mean_reversion,
    "donchian_breakout": donchian_breakout, "volatility_filtered_trend": volatility_filtered_trend,
}


def rule(name: str, df: DataFrame) -> DataFrame:
    if name not in RULES:
        raise KeyError(f"unknown rule {name!r}; there are {sorted(RULES)}")
    return RULES[name](df)


def stacked(df: DataFrame, names) -> DataFrame:
    """The signals of several rules under each other, all from one pass over the bars; symbols become rule|symbol."""
    out = df
    for n in names:
        out = rule(n, out).withColumnRenamed("signal", f"_{n}")
    made = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"_{n}").cast("double").alias("signal")) for n in names))
    return out.select(*df.columns, F.explode(made).alias("_s")).select(F.concat("_s.rule", F.lit("|"), "symbol").alias("symbol"), *[c for c in df.columns if c != "symbol"], "_s.signal")


def stacked_rule(symbol: str):
    return F.substring_index(symbol, "|", 1)


def stacked_symbol(symbol: str):
    return F.regexp_replace(symbol, r"^[^|]*\|", "")


def from_probabilities(df: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Long or short where the probability reaches the threshold; a tie goes long."""
    p, q = F.col("p_long"), F.col("p_short")
    return df.withColumn("signal", F.when((p >= threshold) & (p >= q), 1.0).when((q >= threshold) & (q > p), -1.0).otherwise(0.0))


def session_filter(df: DataFrame, hours) -> DataFrame:
    """The signal changes within the given hours only and is frozen outside; all hours if none are given."""
    return _held(df, F.when(F.hour("ts").isin(list(hours)), F.col("signal"))) if hours else df


def min_holding(df: DataFrame, bars: int) -> DataFrame:
    """A position stays for at least `bars` bars, then takes the signal of the day.

    Sequential by nature: sorted bars stream through in Arrow batches, the position and the bar from
    which it may change are carried from batch to batch, and only runs of equal signals are looped over.
    """
    if bars <= 1:
        return df
    df = df.withColumn("signal", F.col("signal").cast("double"))
    at = df.columns.index("signal")

    def hold(batches):
        symbol, now, free, done = None, 0.0, 0, 0
        for batch in batches:
            x = batch.column(at).to_numpy(zero_copy_only=False)
            keys = pc.dictionary_encode(batch.column("symbol"), null_encoding="encode")
            codes = keys.indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (codes[1:] != codes[:-1])][: len(x)])
            held = np.empty(len(x))
            for a, b in zip(starts, np.r_[starts[1:], len(x)]):
                own = (keys.dictionary[codes[a]].as_py(),)
                if own != symbol:
                    symbol, now, free, done = own, 0.0, 0, -a
                turn = b if x[a] == now else a if now == 0 else min(max(a, free - done), b)
                held[a:turn], held[turn:b] = now, x[a]
                if turn < b:
                    now, free = x[a], turn + done + bars
            done += len(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(held), *batch.columns[at + 1 :]], schema=batch.schema)

    return df.repartition("symbol").sortWithinPartitions("symbol", "ts").mapInArrow(hold, df.schema)


def _turns(x: np.ndarray, bars: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the first later row with another signal, and the row on which a position taken there is next given up (both may lie past the end)."""
    n = len(x)
    change = np.flatnonzero(x[1:] != x[:-1]) + 1
    other = np.append(change, n)[np.searchsorted(change, np.arange(n), "right")]
    # taken at i, it may change from i + bars on, a flat one at once; there, or where the signal first differs
    free = np.where(x == 0, np.arange(n) + 1, np.arange(n) + bars)
    at = np.minimum(free, n - 1) if n else free
    nxt = np.where(free >= n, free, np.where(x[at] != x, free, other[at]))
    return other, nxt


_HELD = "symbol string, range long, n long, value array<double>, other array<long>, out array<double>, till array<long>, out2 array<double>, till2 array<long>"
_ENTRY = "symbol string, range long, now double, free long"


def _range_map(x: np.ndarray, bars: int):
    """How a range answers whatever position enters it: for the first `bars` rows and one, their signals, the first later row
    with another signal, and of both the position that leaves the range if one is taken there, and the rows for which it is still held."""
    n = len(x)
    other, nxt = _turns(x, bars)
    last = np.arange(n)
    for i in range(n - 1, -1, -1):
        if nxt[i] < n:
            last[i] = last[nxt[i]]
    some = np.arange(min(bars + 1, n))
    leave = lambda i: (x[last[i]], np.maximum(0, np.where(x[last[i]] == 0, last[i] + 1, last[i] + bars) - n))
    second = np.minimum(other[some], n - 1)
    return (x[some], other[some], *leave(some), *leave(second))


def _through(now: float, free: int, n: int, value, other, out, till, out2, till2) -> tuple[float, int]:
    """The position and its rows still held after a range, from those before it."""
    free = 0 if now == 0 else free
    if free >= n:
        return now, free - n
    if value[free] != now:
        return out[free], till[free]
    return (now, 0) if other[free] >= n else (out2[free], till2[free])


def min_holding_in_ranges(rows: DataFrame, bars: int) -> DataFrame:
    """min_holding of rows (symbol, range, rn, signal, ...) cut into ranges that run side by side.

    Each range says what leaves it for whatever enters it (a table of bars + 1 rows); these maps
    are followed from range to range, a row each, and ranges are then worked through from the
    position that really enters them.
    """
    if bars <= 1:
        return rows
    rows = rows.withColumn("signal", F.coalesce(F.col("signal").cast("double"), F.lit(0.0)))
    arrow = pa.schema([("symbol", pa.string()), ("range", pa.int64()), ("n", pa.int64()), *((c, pa.list_(pa.float64() if c in ("value", "out", "out2") else pa.int64())) for c in ("value", "other", "out", "till", "out2", "till2"))])

    def summary(table: pa.Table) -> pa.Table:
        table = table.sort_by("rn")
        x = table.column("signal").to_numpy()
        head = [table.column("symbol")[0].as_py(), table.column("range")[0].as_py(), len(x)]
        return pa.table([pa.array([v if i < 3 else v.tolist()], f.type) for i, (v, f) in enumerate(zip([*head, *_range_map(x, bars)], arrow, strict=True))], schema=arrow)

    def follow(table: pa.Table) -> pa.Table:
        now, free, out = 0.0, 0, []
        for r in table.sort_by("range").to_pylist():
            out.append((r["symbol"], r["range"], now, free))
            now, free = _through(now, free, r["n"], *(r[c] for c in arrow.names[3:]))
        kinds = (pa.string(), pa.int64(), pa.float64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["symbol", "range", "now", "free"])

    def hold(table: pa.Table, entry: pa.Table) -> pa.Table:
        table = table.sort_by("rn")
        x, held = table.column("signal").to_numpy(), np.empty(len(table))
        other, nxt = _turns(x, bars)
        now, free = (entry.column(c)[0].as_py() for c in ("now", "free"))
        at = min(0 if now == 0 else free, len(x))
        if at < len(x) and x[at] == now:
            at = other[at]
        held[:at] = now
        while at < len(x):
            held[at : nxt[at]] = x[at]
            at = nxt[at]
        i = table.column_names.index("signal")
        return table.set_column(i, "signal", pa.array(held))

    maps = rows.select("symbol", "range", "rn", "signal").groupBy("symbol", "range").applyInArrow(summary, _HELD)
    entries = maps.groupBy("symbol").applyInArrow(follow, _ENTRY)
    return rows.groupBy("symbol", "range").cogroup(entries.groupBy("symbol", "range")).applyInArrow(hold, rows.schema)


def volatility_scalar(df: DataFrame, target: float, window: int = 100, bars_per_year: float = 6240, cap: float = 3.0) -> DataFrame:
    """`scalar`: target volatility over that of the bars before, at most `cap`, 0 while unknown."""
    from ..functions.windows import ratio

    out = ind.realised_volatility(df, window)
    value = ratio(F.lit(target), F.col(f"realised_vol_{window}") * bars_per_year**0.5)
    out = out.withColumn("_s", value)
    return out.withColumn("scalar", F.coalesce(F.least(lag("_s"), F.lit(cap)), F.lit(0.0))).select(*df.columns, "scalar")


def sized_at_entry(df: DataFrame, side: str = "side", scalar: str = "scalar") -> DataFrame:
    """`size`: the scalar of the bar on which the present side was taken; 0 when flat."""
    s = F.col(side)
    entry = (s != F.coalesce(F.lag(side).over(series()), F.lit(0.0))) & (s != 0)
    return df.withColumn("size", F.when(s == 0, 0.0).otherwise(F.coalesce(ffill(F.when(entry, F.col(scalar))), F.lit(0.0))))
