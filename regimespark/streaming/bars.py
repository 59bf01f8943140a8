"""Streaming forms of bars and the holding rule: an extension beside the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.bars import COLUMNS, WIDTHS


def stream_bars(ticks: DataFrame, timeframe: str, symbol, price, order, lateness: str = "10 minutes") -> DataFrame:
    """Bars of a stream of ticks with a TIMESTAMP ts; a bar is final once the watermark has passed it."""
    rows = ticks.select(symbol.alias("symbol"), "ts", price.alias("p"), order.alias("k")).withWatermark("ts", lateness)
    grouped = rows.groupBy("symbol", F.window("ts", WIDTHS[timeframe.upper()]).alias("w"))
    out = grouped.agg(F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.count("*").cast("double").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("ts"), *COLUMNS[2:])


def stream_min_holding(signals: DataFrame, bars: int) -> DataFrame:
    """(symbol, ts, signal) with positions kept for at least `bars` bars; state is the position and its age."""

    def step(key, batches: Iterator, state: GroupState):
        import pandas as pd

        now, held = state.get if state.exists else (0.0, 0)
        table = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for x in table["signal"]:
            held += 1
            if (now == 0 or held > bars) and x != now:
                now, held = x, 1
            out.append(now)
        state.update((now, held))
        yield table.assign(signal=out)[["symbol", "ts", "signal"]]

    schema = "symbol string, ts timestamp, signal double"
    return signals.select("symbol", "ts", "signal").groupBy("symbol").applyInPandasWithState(step, schema, "now double, held long", "append", GroupStateTimeout.NoTimeout)
