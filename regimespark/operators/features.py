"""Feature blocks. Each adds its columns to the bars; build_features chains them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import HALO, in_ranges
from ..functions.storage import stored
from ..functions.windows import ewm, ffill, frame, lag, numbered, percent_rank, ratio, rolling, rolling_autocorr, rolling_kurt, rolling_skew, span, zscore
from . import indicators as ind

OHLCV = ["symbol", "ts", "open", "high", "low", "close", "volume"]
HORIZONS, VOL_WINDOWS, TREND_WINDOWS = (1, 3, 5, 10, 20, 50), (14, 50, 200), (20, 50, 200)
DESCRIPTORS = ["trend_strength", "vol_percentile", "momentum_score", "mean_reversion_score"]


def _kept(df: DataFrame, before: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*before.columns, *[n for n in names if n not in before.columns])


def _atr14():
    return F.nullif(F.col("atr_14"), F.lit(0.0))


def returns_block(df: DataFrame, horizons=HORIZONS) -> DataFrame:
    out = df.withColumn("_lc", F.log("close")).withColumn("ret_1", F.log("close") - F.log(lag("close")))
    steps = [h for h in horizons if h != 1]
    out = out.withColumns({f"ret_{h}": F.col("_lc") - lag("_lc", h) for h in steps} | {"_seen": frame("ret_1", 50)})
    out = out.withColumns({f"ret_{h}_norm": ratio(f"ret_{h}", rolling(F.stddev_pop, "ret_1", 3 * h) * math.sqrt(h)) for h in steps})
    up = F.when(F.col("ret_1") > 0, 1.0).otherwise(0.0)
    # the pairs of a window of 50 returns are the 49 inside it
    out = out.withColumns({"ret_skew_50": rolling_skew("ret_1", 50, "_seen"), "ret_kurt_50": rolling_kurt("ret_1", 50, "_seen"), "ret_autocorr_50": rolling_autocorr("ret_1", 50, "_seen"), "up_bar_ratio_20": rolling(F.avg, up, 20)})
    names = ["ret_1", *(n for h in steps for n in (f"ret_{h}", f"ret_{h}_norm")), "ret_skew_50", "ret_kurt_50", "ret_autocorr_50", "up_bar_ratio_20"]
    return _kept(out, df, names)


def trend_block(df: DataFrame, windows=TREND_WINDOWS) -> DataFrame:
    # two levels of means, each by one sort: of the bars, then of what follows from these
    out, means = ind.movements(df)
    out = ewm(out, [*means, *((f"ema_{w}", "close", span(w), 0) for w in windows), ("_fast", "close", span(12), 0), ("_slow", "close", span(26), 0)])
    out = ind.direction(out).withColumn("macd_line", F.col("_fast") - F.col("_slow"))
    out = ewm(out, [("adx_14", "_dx", 1 / 14, 14), ("macd_signal", "macd_line", span(9), 0)])
    out = ind.hurst(out.withColumn("macd_hist", F.col("macd_line") - F.col("macd_signal")))
    cols = {}
    for w in windows:
        cols[f"ema_{w}_dist_atr"] = (F.col("close") - F.col(f"ema_{w}")) / _atr14()
        cols[f"ema_{w}_slope_atr"] = (F.col(f"ema_{w}") - lag(f"ema_{w}", max(2, w // 4))) / _atr14()
    ordered = sorted(windows)
    for a, b in zip(ordered, ordered[1:], strict=False):
        cols[f"ema_{a}_{b}_spread_atr"] = (F.col(f"ema_{a}") - F.col(f"ema_{b}")) / _atr14()
    cols["di_balance"] = ratio(F.col("plus_di") - F.col("minus_di"), F.col("plus_di") + F.col("minus_di"))
    cols["macd_hist_atr"] = F.col("macd_hist") / _atr14()
    cols["macd_cross"] = F.signum(F.col("macd_line") - F.col("macd_signal"))
    return _kept(out.withColumns(cols), df, [*cols, "adx_14", "hurst_100"])


def momentum_block(df: DataFrame) -> DataFrame:
    out = ind.cci(ind.williams_r(ind.stochastic(ind.rsi(ind.rsi(df, 14), 50))))
    cols = {"rsi_14_delta": F.col("rsi_14") - lag("rsi_14", 5)} | {f"roc_{k}": (F.col("close") / lag("close", k) - 1) * 100 for k in (12, 48)}
    return _kept(out.withColumns(cols), df, ["rsi_14", "rsi_50", "rsi_14_delta", "stoch_k", "stoch_d", "williams_r", "cci_20", "roc_12", "roc_48"])


def volatility_block(df: DataFrame, windows=VOL_WINDOWS) -> DataFrame:
    out = ind.bollinger(ind.parkinson_volatility(ind.realised_volatility(df, *windows), *windows))
    out = ind.atr(out, *dict.fromkeys([14, *windows]))
    # windows of the same closes in another order have the same width
    out = out.withColumn("_width", F.round("bb_width", 10))
    short, long = min(windows), max(windows)
    cols = {f"atr_{w}_rel": F.col(f"atr_{w}") / F.col("close") for w in windows}
    cols |= {
        "vol_term_structure": ratio(f"realised_vol_{short}", f"realised_vol_{long}"), "vol_of_vol": rolling(F.stddev_pop, f"realised_vol_{short}", long),
        "bb_squeeze": percent_rank("_width", long), "gap_atr": (F.col("open") - lag("close")) / _atr14(), "bar_range_atr": (F.col("high") - F.col("low")) / _atr14(),
    }
    names = [n for w in windows for n in (f"atr_{w}_rel", f"realised_vol_{w}", f"parkinson_vol_{w}")]
    return _kept(out.withColumns(cols), df, [*names, "vol_term_structure", "vol_of_vol", "bb_width", "bb_position", "bb_squeeze", "gap_atr", "bar_range_atr"])


def structure_block(df: DataFrame) -> DataFrame:
    out = ind.swing_points(ind.atr(df if "rn" in df.columns else numbered(df)))
    names = []
    for w in (20, 55, 200):
        out = ind.donchian(out, w).withColumn(f"dc_{w}_width_atr", F.nullif(F.col(f"dc_{w}_upper") - F.col(f"dc_{w}_lower"), F.lit(0.0)) / _atr14())
        names += [f"dc_{w}_position", f"dc_{w}_width_atr"]
    high, low = F.col("last_swing_high"), F.col("last_swing_low")
    cols = {"dist_swing_high_atr": (high - F.col("close")) / _atr14(), "dist_swing_low_atr": (F.col("close") - low) / _atr14(), "swing_position": ratio(F.col("close") - low, high - low)}
    cols |= {f"bars_since_{x}": (F.col("rn") - ffill(F.when(F.col(x) == 1, F.col("rn")))).cast("double") for x in ("swing_high", "swing_low")}
    return _kept(out.withColumns(cols), df, [*names, *cols])


def volume_block(df: DataFrame) -> DataFrame:
    out = ind.money_flow_index(ind.accumulation_distribution(ind.on_balance_volume(df)))
    out = out.withColumns({"_o": F.col("obv") - lag("obv", 20), "_a": F.col("adl") - lag("adl", 20), "_f": (F.col("close") - lag("close")) * F.col("volume")})
    cols = {"obv_slope_20": zscore("_o", 200), "adl_slope_20": zscore("_a", 200), "force_index_z": zscore("_f", 100), "volume_z_50": zscore("volume", 50), "volume_ratio_20": ratio("volume", rolling(F.avg, "volume", 20))}
    return _kept(out.withColumns(cols), df, ["obv_slope_20", "adl_slope_20", "mfi_14", "force_index_z", "volume_z_50", "volume_ratio_20"])


def session_block(df: DataFrame) -> DataFrame:
    """Cyclic hour and weekday (of a five-day week), and the overlap of two sessions, 13 to 17 h."""
    hour, day = F.hour("ts").cast("double"), F.weekday("ts").cast("double")
    turn = 2 * math.pi
    cols = {"hour_sin": F.sin(hour * turn / 24), "hour_cos": F.cos(hour * turn / 24), "weekday_sin": F.sin(day * turn / 5), "weekday_cos": F.cos(day * turn / 5)}
    return df.withColumns(cols | {"is_london_ny_overlap": F.when((hour >= 13) & (hour < 17), 1.0).otherwise(0.0)})


def descriptor_block(df: DataFrame) -> DataFrame:
    out = ind.hurst(ind.rsi(ind.realised_volatility(ind.ema(ind.atr(df), 20, 100), 20)))
    out = out.withColumn("_rv", F.round("realised_vol_20", 12))
    cols = {
        "trend_strength": (F.col("ema_20") - F.col("ema_100")) / _atr14(), "vol_percentile": percent_rank("_rv", 500),
        "momentum_score": (F.col("rsi_14") - 50) / 50, "mean_reversion_score": 0.5 - F.col("hurst_100"),
    }
    return _kept(out.withColumns(cols), df, DESCRIPTORS)


BLOCKS = {"returns": returns_block, "trend": trend_block, "momentum": momentum_block, "volatility": volatility_block, "structure": structure_block, "volume": volume_block, "session": session_block}


def feature_columns(df: DataFrame) -> list[str]:
    """Model inputs: everything but keys and bars."""
    return [x for x in df.columns if x not in {*OHLCV, "rn"}]


def build_features(bars: DataFrame, blocks=tuple(BLOCKS), warmup: int = 300, windows: dict | None = None, range_rows: int | None = None) -> DataFrame:
    """Bars with all features, blocks with the windows given by their names: the warm-up is cut, gaps after it are filled forward, and rows that still lack one are dropped.

    With `range_rows`, the blocks work on ranges of so many bars side by side, each with HALO bars before it; warm-up and gaps
    remain those of whole symbols. Multiples of the blocks of exponential means keep these where they are.
    """
    unknown = set(blocks) - set(BLOCKS)
    if unknown:
        raise ValueError(f"unknown feature blocks: {sorted(unknown)}")

    def work(df: DataFrame) -> DataFrame:
        df = numbered(df)
        for name in blocks:
            df = BLOCKS[name](df, windows[name]) if windows and name in windows else BLOCKS[name](df)
        return descriptor_block(df)

    df = bars.select(*OHLCV)
    df = work(df) if range_rows is None else numbered(stored(in_ranges(df, lambda b: work(b).drop("rn"), range_rows, HALO)))
    names = feature_columns(df)
    df = df.where(F.col("rn") >= warmup)
    df = df.withColumns({n: ffill(F.when(F.abs(n) < float("inf"), F.col(n))) for n in names})
    return df.dropna("any", subset=names).drop("rn")


def build_features_in_ranges(bars: DataFrame, range_rows: int, halo: int = HALO, **options) -> DataFrame:
    """build_features with every symbol cut into ranges that are worked on side by side, each with `halo` bars before it.

    A swing level that is older than `halo` bars is not seen.
    """
    return in_ranges(bars.select(*OHLCV), lambda b: build_features(b, **options), range_rows, halo)


def feature_catalogue(spark, blocks=tuple(BLOCKS)) -> DataFrame:
    """Blocks and the columns each adds."""
    empty = spark.createDataFrame([], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    rows = [(b, n) for b in blocks for n in BLOCKS[b](empty).columns if n not in empty.columns]
    return spark.createDataFrame(rows, "block string, feature string")
