"""Performance metrics of return streams, one row for each symbol (or other key)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The names of the metrics.
TRADE_METRICS = ["trades", "trade_win_rate", "avg_win", "avg_loss", "avg_trade_bars", "payoff_ratio"]
METRICS = [
    "total_return", "cagr", "annualised_volatility", "sharpe", "sortino", "calmar", "max_drawdown", "longest_drawdown_bars", "profit_factor", "hit_rate", "skew", "kurtosis",
    "var_95", "cvar_95", "bars", "exposure", "annual_turnover", *TRADE_METRICS,
]


def performance(result: DataFrame, bars_per_year: int = 6_240, trades: DataFrame | None = None, returns: str = "strategy_return", equity: str = "equity", position: str | None = "position", key: str = "symbol", risk_free: float = 0.0) -> DataFrame:
    """The 23 metrics; what lacks its inputs is NULL."""
    w = Window.partitionBy(key).orderBy("ts")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = result.where(F.col(returns).isNotNull()).withColumn("_r", F.col(returns))
    rows = rows.withColumn("_e", F.col(equity) if equity in result.columns else F.product(1 + F.col("_r")).over(upto))
    rows = rows.withColumn("_dd", F.col("_e") / F.max("_e").over(upto) - 1).withColumn("_n", F.row_number().over(w))
    # rows since the last peak; the tail's limit beside each row, so that one scan is enough
    rows = rows.withColumns({"_u": F.col("_n") - F.last(F.when(F.col("_dd") < 0, None).otherwise(F.col("_n")), ignorenulls=True).over(upto), "_v": F.percentile("_r", F.lit(0.05)).over(Window.partitionBy(key))})
    if position:
        rows = rows.withColumn("_p", F.coalesce(position, F.lit(0.0))).withColumn("_turn", F.abs(F.col("_p") - F.lag("_p").over(w)))
    r, n = F.col("_r"), F.count("_r")
    sigma, down = F.stddev_pop("_r"), F.stddev_pop(F.when(r < 0, r))
    root = float(bars_per_year) ** 0.5
    growth = F.max_by("_e", "ts") / F.min_by("_e", "ts")
    exposure = F.avg(F.when(F.col("_p") != 0, 1.0).otherwise(0.0)) if position else F.lit(None).cast("double")
    turnover = F.avg("_turn") * bars_per_year if position else F.lit(None).cast("double")
    flat = F.max("_r") == F.min("_r")
    out = rows.groupBy(key).agg(
        (growth - 1).alias("total_return"), (F.pow(growth, F.lit(float(bars_per_year)) / n) - 1).alias("cagr"), (sigma * root).alias("annualised_volatility"),
        ((F.avg("_r") - risk_free / bars_per_year) / F.nullif(sigma, F.lit(0.0)) * root).alias("sharpe"), F.when(F.count(F.when(r < 0, 1)) > 1, F.avg("_r") / F.nullif(down, F.lit(0.0)) * root).alias("sortino"),
        F.min("_dd").alias("max_drawdown"), (F.sum(F.when(r > 0, r).otherwise(0.0)) / F.nullif(-F.sum(F.when(r < 0, r).otherwise(0.0)), F.lit(0.0))).alias("profit_factor"),
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("hit_rate"), F.when(n > 2, F.when(flat, 0.0).otherwise(F.skewness("_r") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))).alias("skew"),
        F.when(n > 3, F.when(flat, 0.0).otherwise(((n + 1) * F.kurtosis("_r") + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)))).alias("kurtosis"),
        F.first("_v").alias("var_95"), F.avg(F.when(r <= F.col("_v"), r)).alias("cvar_95"), F.max("_u").cast("double").alias("longest_drawdown_bars"), n.cast("double").alias("bars"), exposure.alias("exposure"), turnover.alias("annual_turnover"),
    )
    out = out.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")))
    if trades is not None:
        out = out.join(trade_metrics(trades, key), key, "left")
    else:
        out = out.withColumns({m: F.lit(None).cast("double") for m in TRADE_METRICS})
    return out.select(key, *METRICS)


def trade_metrics(trades: DataFrame, key: str = "symbol") -> DataFrame:
    t = F.col("return")
    win, loss = F.avg(F.when(t > 0, t)), F.avg(F.when(t <= 0, t))
    return trades.groupBy(key).agg(
        F.count("*").cast("double").alias("trades"), F.avg(F.when(t > 0, 1.0).otherwise(0.0)).alias("trade_win_rate"), F.coalesce(win, F.lit(0.0)).alias("avg_win"), F.coalesce(loss, F.lit(0.0)).alias("avg_loss"),
        F.avg("bars").alias("avg_trade_bars"), F.abs(win / F.nullif(loss, F.lit(0.0))).alias("payoff_ratio"),
    )


def drawdown_span(result: DataFrame, equity: str = "equity") -> DataFrame:
    """(symbol, max_drawdown, peak, trough): the deepest decline and when it began and ended."""
    upto = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = result.withColumn("_top", F.max(equity).over(upto)).withColumn("_dd", F.col(equity) / F.col("_top") - 1)
    rows = rows.withColumn("_at", F.max(F.when(F.col(equity) == F.col("_top"), F.struct(F.col(equity).alias("e"), (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t")))).over(upto))
    found = rows.groupBy("symbol").agg(F.min(F.struct("_dd", "ts", "_at")).alias("m"))
    return found.select("symbol", F.col("m._dd").alias("max_drawdown"), F.timestamp_micros(-F.col("m._at.t")).cast("timestamp_ntz").alias("peak"), F.col("m.ts").alias("trough"))


def stacked(named: dict[str, DataFrame]) -> DataFrame:
    """One-row metric tables under each other, with their names."""
    return reduce(DataFrame.unionByName, [df.withColumn("name", F.lit(n)) for n, df in named.items()])


#: How metrics are shown: shares in percent with two decimals, counts without, ratios with three.
PERCENT = {"total_return", "cagr", "annualised_volatility", "max_drawdown", "hit_rate", "var_95", "cvar_95", "exposure", "trade_win_rate", "avg_win", "avg_loss"}
COUNTS = {"bars", "trades", "longest_drawdown_bars"}


def formatted(metrics: DataFrame) -> DataFrame:
    """Metrics as display strings; what is missing or not finite is n/a."""

    def shown(m: str):
        value = F.col(m).cast("double")
        text = F.format_string("%.2f%%", value * 100) if m in PERCENT else F.format_string("%,.0f" if m in COUNTS else "%.3f", value)
        return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "n/a").otherwise(text).alias(m)

    return metrics.select("symbol", *map(shown, METRICS))
