"""Technical indicators: each takes bars and adds columns. All are causal."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import ewm, ffill, frame, framed, lag, ratio, rolling, running, span, trailing



def true_range(df: DataFrame) -> DataFrame:
    before = lag("close")
    return df.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def atr(df: DataFrame, *windows: int) -> DataFrame:
    """atr_w for each window (14 if none is given), all by one sort."""
    missing = [w for w in windows or (14,) if f"atr_{w}" not in df.columns]
    if not missing:
        return df
    out = ewm(df if "true_range" in df.columns else true_range(df), [(f"atr_{w}", "true_range", 1 / w, w) for w in missing])
    return out if "true_range" in df.columns else out.drop("true_range")


def rsi(df: DataFrame, window: int = 14) -> DataFrame:
    """50 in the warm-up and where there are no losses."""
    name = f"rsi_{window}"
    if name in df.columns:
        return df
    step = F.col("close") - lag("close")
    df = df.withColumns({"_gain": F.greatest(step, F.when(step.isNotNull(), 0.0)), "_loss": F.greatest(-step, F.when(step.isNotNull(), 0.0))})
    df = ewm(df, [("_g", "_gain", 1 / window, window), ("_l", "_loss", 1 / window, window)])
    return df.withColumn(name, F.coalesce(100 - 100 / (1 + ratio("_g", "_l")), F.lit(50.0))).drop("_gain", "_loss", "_g", "_l")


def ema(df: DataFrame, *windows: int, column: str = "close") -> DataFrame:
    return ewm(df, [(f"ema_{w}", column, span(w), 0) for w in windows])


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = ewm(df, [("_fast", "close", span(fast), 0), ("_slow", "close", span(slow), 0)]).withColumn("macd_line", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    return ewm(df, [("macd_signal", "macd_line", span(signal), 0)]).withColumn("macd_hist", F.col("macd_line") - F.col("macd_signal"))


def stochastic(df: DataFrame, window: int = 14, smooth: int = 3) -> DataFrame:
    low, high = rolling(F.min, "low", window), rolling(F.max, "high", window)
    df = df.withColumn("stoch_k", 100 * ratio(F.col("close") - low, high - low))
    return df.withColumn("stoch_d", rolling(F.avg, "stoch_k", smooth))


def williams_r(df: DataFrame, window: int = 14) -> DataFrame:
    low, high = rolling(F.min, "low", window), rolling(F.max, "high", window)
    return df.withColumn("williams_r", -100 * ratio(high - F.col("close"), high - low))


def cci(df: DataFrame, window: int = 20) -> DataFrame:
    df = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3).withColumn("_tps", F.collect_list("_tp").over(trailing(window)))
    mean = F.aggregate("_tps", F.lit(0.0), lambda a, x: a + x) / window
    spread = F.aggregate(F.transform("_tps", lambda x: F.abs(x - mean)), F.lit(0.0), lambda a, x: a + x) / window
    return df.withColumn("cci_20" if window == 20 else f"cci_{window}", F.when(F.size("_tps") == window, ratio(F.col("_tp") - mean, 0.015 * spread))).drop("_tp", "_tps")


def directional_index(df: DataFrame, window: int = 14) -> DataFrame:
    """plus_di, minus_di and adx; movements of the first bar count as 0."""
    if "adx_14" in df.columns and window == 14:
        return df
    df = direction(ewm(*movements(df, window)), window)
    return ewm(df, [(f"adx_{window}", "_dx", 1 / window, window)]).drop("_dx")


def movements(df: DataFrame, window: int = 14):
    """df with the movements that directions rest on, and the means that they need."""
    up, down = F.col("high") - lag("high"), lag("low") - F.col("low")
    out = (df if "true_range" in df.columns else true_range(df)).withColumns({"_up": F.when((up > down) & (up > 0), up).otherwise(0.0), "_down": F.when((down > up) & (down > 0), down).otherwise(0.0)})
    return out, [("_pu", "_up", 1 / window, window), ("_pd", "_down", 1 / window, window), (f"atr_{window}", "true_range", 1 / window, window)]


def direction(df: DataFrame, window: int = 14) -> DataFrame:
    """plus_di, minus_di and _dx, of which adx is the mean, from the means of movements."""
    df = df.withColumns({"plus_di": 100 * ratio("_pu", f"atr_{window}"), "minus_di": 100 * ratio("_pd", f"atr_{window}")})
    return df.withColumn("_dx", 100 * ratio(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di"))).drop("_up", "_down", "_pu", "_pd")


def bollinger(df: DataFrame, window: int = 20, n_std: float = 2.0) -> DataFrame:
    mid, dev = rolling(F.avg, "close", window), rolling(F.stddev_pop, "close", window)
    df = df.withColumns({"bb_mid": mid, "bb_upper": mid + n_std * dev, "bb_lower": mid - n_std * dev})
    width = F.col("bb_upper") - F.col("bb_lower")
    return df.withColumns({"bb_width": ratio(width, "bb_mid"), "bb_position": ratio(F.col("close") - F.col("bb_lower"), width)})


def keltner(df: DataFrame, window: int = 20, multiplier: float = 1.5) -> DataFrame:
    df = atr(ema(df, window), window)
    mid, reach = F.col(f"ema_{window}"), multiplier * F.col(f"atr_{window}")
    return df.withColumns({"kc_mid": mid, "kc_upper": mid + reach, "kc_lower": mid - reach})


def donchian(df: DataFrame, window: int = 20) -> DataFrame:
    """Channel of the bars before, so that a bar can break it."""
    high, low = rolling(F.max, "high", window, 1), rolling(F.min, "low", window, 1)
    p = f"dc_{window}"
    df = df.withColumns({f"{p}_upper": high, f"{p}_lower": low})
    return df.withColumn(f"{p}_position", ratio(F.col("close") - F.col(f"{p}_lower"), F.col(f"{p}_upper") - F.col(f"{p}_lower")))


def on_balance_volume(df: DataFrame) -> DataFrame:
    move = F.coalesce(F.signum(F.col("close") - lag("close")), F.lit(0.0)) * F.col("volume")
    return df.withColumn("_move", move).withColumn("obv", F.sum("_move").over(running())).drop("_move")


def money_flow_index(df: DataFrame, window: int = 14) -> DataFrame:
    df = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    step = F.col("_tp") - lag("_tp")
    df = df.withColumns({"_in": F.when(step > 0, F.col("_tp") * F.col("volume")).otherwise(0.0), "_out": F.when(step < 0, F.col("_tp") * F.col("volume")).otherwise(0.0)})
    flow = ratio(rolling(F.sum, "_in", window), rolling(F.sum, "_out", window))
    return df.withColumn(f"mfi_{window}", F.coalesce(100 - 100 / (1 + flow), F.lit(50.0))).drop("_tp", "_in", "_out")


def accumulation_distribution(df: DataFrame) -> DataFrame:
    share = F.coalesce(ratio((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), F.col("high") - F.col("low")), F.lit(0.0))
    return df.withColumn("_flow", share * F.col("volume")).withColumn("adl", F.sum("_flow").over(running())).drop("_flow")


def log_return(df: DataFrame, name: str = "_r") -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.log("close") - F.log(lag("close")))


def realised_volatility(df: DataFrame, *windows: int) -> DataFrame:
    out = log_return(df)
    out = out.withColumns({f"realised_vol_{w}": rolling(F.stddev_pop, "_r", w) for w in windows})
    return out if "_r" in df.columns else out.drop("_r")


def parkinson_volatility(df: DataFrame, *windows: int) -> DataFrame:
    df = df.withColumn("_hl", F.pow(F.log(F.col("high") / F.col("low")), 2.0))
    return df.withColumns({f"parkinson_vol_{w}": F.sqrt(rolling(F.avg, "_hl", w) / (4 * math.log(2))) for w in windows}).drop("_hl")


def hurst(df: DataFrame, window: int = 100, max_lag: int = 20) -> DataFrame:
    """Slope of log root-mean-square difference on log lag: a fixed linear combination of rolling means."""
    name = f"hurst_{window}"
    if name in df.columns:
        return df
    lags = range(2, max_lag + 1)
    xs = [math.log(k) for k in lags]
    mean = sum(xs) / len(xs)
    scale = sum((x - mean) ** 2 for x in xs)

    def slope(v):
        out = np.zeros(len(v))
        for k, x in zip(lags, xs, strict=True):
            d = (v[:, k:] - v[:, :-k])[:, -window:]
            square = np.einsum("ij,ij->i", d, d) / window
            out += np.log(np.where(square > 0, square, np.nan)) / 2 * ((x - mean) / scale)
        return out

    size = window + max_lag
    return df.withColumn("_lp", F.log("close")).withColumn(name, framed(slope, size)(frame("_lp", size))).drop("_lp")


def swing_points(df: DataFrame, left: int = 5, right: int = 5) -> DataFrame:
    """Flags and last prices of swing highs and lows, known `right` bars after them."""
    k = left + right + 1
    top, bottom = rolling(F.max, "high", k), rolling(F.min, "low", k)
    high, low = lag("high", right), lag("low", right)
    df = df.withColumns({"swing_high": F.when(high >= top, 1.0).otherwise(0.0), "swing_low": F.when(low <= bottom, 1.0).otherwise(0.0), "_h": high, "_l": low})
    df = df.withColumns({"last_swing_high": ffill(F.when(F.col("swing_high") == 1, F.col("_h"))), "last_swing_low": ffill(F.when(F.col("swing_low") == 1, F.col("_l")))})
    return df.drop("_h", "_l")
