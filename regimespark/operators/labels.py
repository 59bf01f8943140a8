"""Forward-looking labels on bars; rows without a label are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import lead, series
from . import indicators as ind
from .signals import rule

LABEL = ["label", "forward_return", "holding_bars", "barrier_hit"]


def directional(df: DataFrame, horizon: int = 24, atr_window: int = 14, deadband: float = 0.25) -> DataFrame:
    """Sign of the return over `horizon` bars, 0 inside a band of `deadband` ATRs."""
    out = ind.atr(df, atr_window).withColumn("forward_return", lead("close", horizon) / F.col("close") - 1)
    band, r = deadband * F.col(f"atr_{atr_window}") / F.col("close"), F.col("forward_return")
    label = F.when(r > band, 1).when(r < -band, -1).otherwise(0)
    out = out.where(r.isNotNull() & band.isNotNull())
    return out.select(*df.columns, label.alias("label"), "forward_return", F.lit(float(horizon)).alias("holding_bars"), F.lit("time").alias("barrier_hit"))


def _first(values: str, level, above: bool):
    """Position (from 1) of the first of the coming bars that reaches the level; 0 if none does."""
    return F.array_position(F.transform(values, (lambda y: y >= level) if above else (lambda y: y <= level)), True).cast("int")


def _ahead(df: DataFrame, horizon: int, atr_window: int) -> DataFrame:
    w = series().rowsBetween(1, horizon)
    out = ind.atr(df, atr_window)
    out = out.withColumns({"_hs": F.collect_list("high").over(w), "_ls": F.collect_list("low").over(w), "_end": lead("close", horizon)})
    return out.where((F.col(f"atr_{atr_window}") > 0) & (F.col("close") > 0) & F.col("_end").isNotNull())


def triple_barrier(df: DataFrame, horizon: int = 24, atr_window: int = 14, take_profit: float = 1.0, stop_loss: float = 1.0) -> DataFrame:
    """Which of an upper, a lower and a time barrier is met first; both in one bar count as the lower."""
    out, a = _ahead(df, horizon, atr_window), F.col(f"atr_{atr_window}")
    out = out.withColumns({"_u": F.col("close") + take_profit * a, "_d": F.col("close") - stop_loss * a})
    out = out.withColumns({"_iu": _first("_hs", F.col("_u"), True), "_id": _first("_ls", F.col("_d"), False)})
    up, down = F.col("_iu"), F.col("_id")
    hit = F.when((up == 0) & (down == 0), "time").when(up == down, "both").when((down == 0) | ((up > 0) & (up < down)), "upper").otherwise("lower")
    out = out.withColumn("barrier_hit", hit)
    upper, time = F.col("barrier_hit") == "upper", F.col("barrier_hit") == "time"
    exit_price = F.when(time, F.col("_end")).when(upper, F.col("_u")).otherwise(F.col("_d"))
    held = F.when(time, horizon).when(upper, up).otherwise(down).cast("double")
    label = F.when(time, 0).when(upper, 1).otherwise(-1)
    return out.select(*df.columns, label.alias("label"), (exit_price / F.col("close") - 1).alias("forward_return"), held.alias("holding_bars"), "barrier_hit")


def meta(df: DataFrame, primary: str = "ma_crossover", horizon: int = 24, atr_window: int = 14, take_profit: float = 1.0, stop_loss: float = 1.0) -> DataFrame:
    """Whether a rule's trade would win: its side if so, else 0; only bars on which it proposes one."""
    out = _ahead(rule(primary, df).withColumnRenamed("signal", "primary"), horizon, atr_window).where("primary <> 0")
    a, side, close = F.col(f"atr_{atr_window}"), F.signum("primary"), F.col("close")
    out = out.withColumns({"_tp": close + side * take_profit * a, "_sl": close - side * stop_loss * a})
    long = F.col("primary") > 0
    out = out.withColumns({
        "_ip": F.when(long, _first("_hs", F.col("_tp"), True)).otherwise(_first("_ls", F.col("_tp"), False)),
        "_is": F.when(long, _first("_ls", F.col("_sl"), False)).otherwise(_first("_hs", F.col("_sl"), True)),
    })
    win, lose = F.col("_ip"), F.col("_is")
    hit = F.when((win == 0) & (lose == 0), "time").when(win == lose, "both").when((lose == 0) | ((win > 0) & (win < lose)), "profit").otherwise("stop")
    out = out.withColumn("barrier_hit", hit)
    profit, time = F.col("barrier_hit") == "profit", F.col("barrier_hit") == "time"
    exit_price = F.when(time, F.col("_end")).when(profit, F.col("_tp")).otherwise(F.col("_sl"))
    won = profit | (time & ((F.col("_end") - close) * F.col("primary") > 0))
    held = F.when(time, horizon).when(profit, win).otherwise(lose).cast("double")
    label = F.when(won, F.col("primary").cast("int")).otherwise(0)
    return out.select(*df.columns, label.alias("label"), ((exit_price / close - 1) * F.col("primary")).alias("forward_return"), held.alias("holding_bars"), "barrier_hit", "primary")


METHODS = {"directional": directional, "triple_barrier": triple_barrier, "meta": meta}


def build_labels(df: DataFrame, method: str = "triple_barrier", **params) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown labelling method {method!r}; there are {sorted(METHODS)}")
    return METHODS[method](df, **params)


def distribution(labels: DataFrame) -> DataFrame:
    """Count and share of each label of each symbol."""
    counts = labels.groupBy("symbol", "label").agg(F.count("*").alias("bars"))
    from pyspark.sql import Window

    return counts.withColumn("share", F.col("bars") / F.sum("bars").over(Window.partitionBy("symbol")))


def barrier_shares(labels: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    counts = labels.groupBy("symbol", "barrier_hit").agg(F.count("*").alias("bars"))
    return counts.withColumn("share", F.col("bars") / F.sum("bars").over(Window.partitionBy("symbol")))


def summary(labels: DataFrame) -> DataFrame:
    """Shares of the sides, mean holding and mean forward return of each symbol."""
    def share(v):
        return F.avg(F.when(F.col("label") == v, 1.0).otherwise(0.0))

    return labels.groupBy("symbol").agg(
        F.count("*").alias("samples"), share(1).alias("long_share"), share(0).alias("flat_share"), share(-1).alias("short_share"), F.avg("holding_bars").alias("mean_holding_bars"), (F.avg("forward_return") * 1e4).alias("mean_forward_return_bps")
    )
