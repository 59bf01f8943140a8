"""Pricing of signals: costs, equity, trades. Signals of a bar are acted on at the open of a later one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import numbered_apart, with_halo
from ..functions.ranges import running as carried
from ..functions.storage import stored
from ..functions.windows import lag, lead, numbered, running
from .signals import min_holding, min_holding_in_ranges, session_filter, sized_at_entry, volatility_scalar


def run(df: DataFrame, *, capital: float = 10_000.0, friction_bps: float = 2.5, size: float = 1.0, delay: int = 1, hold: int = 24, bars_per_year: int = 6_240, target: float | None = None, target_window: int = 100, leverage: float = 3.0, hours=()) -> DataFrame:
    """Bars with a signal → side, position, strategy_return, equity, drawdown and the benchmark's, for each bar.

    friction_bps is paid on what is traded; positions change `delay` bars after the signal and stay for `hold` bars at
    least; with a yearly volatility `target` they are sized at entry, up to `leverage`; signals change within `hours` only.
    """
    out = df.select("symbol", "ts", "open", "close", F.least(F.greatest(F.coalesce("signal", F.lit(0.0)), F.lit(-1.0)), F.lit(1.0)).alias("signal"))
    out = min_holding(session_filter(out, hours), hold)
    out = out.withColumn("side", F.coalesce(lag("signal", delay), F.lit(0.0)) if delay else F.col("signal"))
    if target:
        out = sized_at_entry(volatility_scalar(out, target, target_window, bars_per_year, leverage))
        out = out.withColumn("position", F.col("side") * F.col("size") * size)
    else:
        out = out.withColumn("position", F.col("side") * size)
    rate = friction_bps / 1e4
    out = out.withColumns({"bar_return": F.coalesce(lead("open") / F.col("open") - 1, F.lit(0.0)), "cost": F.abs(F.col("position") - F.coalesce(lag("position"), F.lit(0.0))) * rate})
    out = out.withColumns({
        "strategy_return": F.col("position") * F.col("bar_return") - F.col("cost"),
        "benchmark_return": F.col("bar_return") - F.when(lag("ts").isNull(), rate).otherwise(0.0),
    })
    out = out.withColumns({n: capital * F.product(1 + F.col(r)).over(running()) for n, r in (("equity", "strategy_return"), ("benchmark_equity", "benchmark_return"))})
    out = out.withColumns({"drawdown": F.col("equity") / F.max("equity").over(running()) - 1, "benchmark_drawdown": F.col("benchmark_equity") / F.max("benchmark_equity").over(running()) - 1})
    return out.select("symbol", "ts", "open", "side", "position", "cost", "strategy_return", "equity", "drawdown", "benchmark_return", "benchmark_equity", "benchmark_drawdown")


def run_in_ranges(df: DataFrame, range_rows: int, *, capital: float = 10_000.0, friction_bps: float = 2.5, size: float = 1.0, delay: int = 1, hold: int = 24, bars_per_year: int = 6_240, target: float | None = None, target_window: int = 100, leverage: float = 3.0, hours=()) -> DataFrame:
    """run() with every symbol cut into ranges of `range_rows` bars that are priced side by side."""
    value = F.least(F.greatest(F.coalesce("signal", F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))
    rows = numbered_apart(df.select("symbol", "ts", "open", "close", value.alias("signal"))).withColumn("range", F.expr(f"rn div {range_rows}"))
    if hours:
        inside = rows.withColumn("_s", F.when(F.hour("ts").isin(list(hours)), F.col("signal")))
        rows = carried(inside, [("signal", "last", "_s")]).withColumn("signal", F.coalesce("signal", F.lit(0.0))).drop("_s")
    rows = stored(min_holding_in_ranges(rows, hold))
    back = max(delay + 1, target_window + 2 if target else 1)
    near = with_halo(rows.drop("range"), range_rows, back, 1)
    w = Window.partitionBy("symbol", "range").orderBy("rn")
    near = near.withColumns({"side": F.coalesce(F.lag("signal", delay).over(w), F.lit(0.0)) if delay else F.col("signal"), "bar_return": F.coalesce(F.lead("open").over(w) / F.col("open") - 1, F.lit(0.0))})
    if target:
        frame = w.rowsBetween(1 - target_window, 0)
        near = near.withColumn("_r", F.log("close") - F.log(F.lag("close").over(w)))
        near = near.withColumn("_v", F.when(F.count("_r").over(frame) == target_window, F.stddev_pop("_r").over(frame)))
        near = near.withColumn("_x", F.lit(target) / F.nullif(F.col("_v") * bars_per_year**0.5, F.lit(0.0)))
        entered = (F.col("side") != F.coalesce(F.lag("side").over(w), F.lit(0.0))) & (F.col("side") != 0)
        near = near.withColumn("_scalar", F.when(entered, F.coalesce(F.least(F.lag("_x").over(w), F.lit(leverage)), F.lit(0.0)))).where("core")
        near = carried(near, [("_size", "last", "_scalar")]).withColumn("position", F.when(F.col("side") == 0, 0.0).otherwise(F.col("side") * F.coalesce("_size", F.lit(0.0)) * size))
        near = with_halo(stored(near.select("symbol", "ts", "rn", "open", "side", "position", "bar_return")), range_rows, 1)
    else:
        near = near.withColumn("position", F.col("side") * size)
    rate = friction_bps / 1e4
    near = near.withColumn("cost", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0))) * rate).where("core")
    near = near.withColumns({"strategy_return": F.col("position") * F.col("bar_return") - F.col("cost"), "benchmark_return": F.col("bar_return") - F.when(F.col("rn") == 0, rate).otherwise(0.0)})
    near = near.withColumns({"_g": 1 + F.col("strategy_return"), "_b": 1 + F.col("benchmark_return")})
    out = carried(near, [("_e", "product", "_g"), ("_be", "product", "_b")])
    out = stored(out.withColumns({"equity": capital * F.col("_e"), "benchmark_equity": capital * F.col("_be")}))
    out = carried(out, [("_top", "max", "equity"), ("_btop", "max", "benchmark_equity")])
    out = out.withColumns({"drawdown": F.col("equity") / F.col("_top") - 1, "benchmark_drawdown": F.col("benchmark_equity") / F.col("_btop") - 1})
    return out.select("symbol", "ts", "open", "side", "position", "cost", "strategy_return", "equity", "drawdown", "benchmark_return", "benchmark_equity", "benchmark_drawdown")


def trades(result: DataFrame) -> DataFrame:
    """Round trips: runs of one side; the return runs from entry to the bar before the exit."""
    rows = numbered(result)
    rows = rows.withColumn("run", F.sum(F.when(F.col("side") != F.coalesce(lag("side"), F.lit(0.0)), 1).otherwise(0)).over(running()))
    runs = rows.groupBy("symbol", "run").agg(
        F.min("ts").alias("ts"), F.max("ts").alias("last_ts"), F.first("side").alias("side"), F.min_by("open", "ts").alias("entry_price"), F.max_by("open", "ts").alias("last_price"), F.count("*").alias("bars"),
        F.product(1 + F.col("strategy_return")).alias("growth"),
    )
    runs = runs.withColumns({"exit_time": F.coalesce(lead("ts"), F.col("last_ts")), "exit_price": F.coalesce(lead("entry_price"), F.col("last_price"))})
    side = F.when(F.col("side") > 0, "long").otherwise("short")
    return runs.where("side <> 0").select("symbol", F.col("ts").alias("entry_time"), "exit_time", side.alias("side"), "entry_price", "exit_price", "bars", (F.col("growth") - 1).alias("return"))


def longest_underwater(result: DataFrame, equity: str = "equity") -> DataFrame:
    """(symbol, longest_drawdown_bars): the longest stretch under a former peak."""
    under = F.col(equity) < F.max(equity).over(running())
    rows = result.withColumn("_u", F.when(under, 1).otherwise(0)).withColumn("_g", F.sum(1 - F.col("_u")).over(running()))
    return rows.groupBy("symbol", "_g").agg(F.sum("_u").alias("n")).groupBy("symbol").agg(F.max("n").cast("double").alias("longest_drawdown_bars"))


def indexed(result: DataFrame, equity: str = "equity") -> DataFrame:
    """Equity as a percentage of its first value."""
    return result.withColumn("indexed_equity", F.col(equity) / F.first(equity).over(running()) * 100)


def signal_changes(df: DataFrame) -> DataFrame:
    """Bars on which a position is entered."""
    before = lag("signal")
    return df.withColumn("_b", before).where((F.col("signal") != 0) & (F.col("_b").isNull() | (F.col("signal") != F.col("_b")))).drop("_b")
