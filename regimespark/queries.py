"""Registered queries over the given tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles as o
from .functions.storage import stored
from .functions.windows import numbered, percent_rank, zscore
from .operators import backtest, classification, features, folds, labels, metrics, regimes, signals, significance
from .operators import indicators as ind
from .sources import bars as src

QUERIES = {}
ORACLE_SQL = {}
#: The SQL of each feature block, unrounded, and its columns.
FEATURE_SQL = {}


def register(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return add


def show(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.select("symbol", "ts", *(F.round(c, digits).alias(c) for c in cols))


def m15(spark: SparkSession, d: str) -> DataFrame:
    return src.from_events(spark, d, "M15", o.LEVEL)


# ---------------------------------------------------------------- bars and sources

H1_SQL = "SELECT symbol, ts, open, high, low, close, volume FROM "


@register("bars_from_events", o.sql(o.bars(), H1_SQL + "b"))
def _(spark, d):
    return m15(spark, d)


_RESAMPLE = "arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume"


@register("bars_resample_h1", o.sql(o.bars("5 minutes"), f"SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, {_RESAMPLE} FROM b GROUP BY 1, 2"))
def _(spark, d):
    return src.resample(src.from_events(spark, d, "M5", o.LEVEL), "H1")


@register("bars_resample_h4", o.sql(o.bars("5 minutes"), f"SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS ts, {_RESAMPLE} FROM b GROUP BY 1, 2"))
def _(spark, d):
    return src.resample(src.from_events(spark, d, "M5", o.LEVEL), "H4")


_DAILY = """d0 AS MATERIALIZED (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, arg_min(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) AS open,
 max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY 1, 2),
d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM d0 WHERE low > 0)"""


@register("bars_resample_w1", o.sql(_DAILY, f"SELECT symbol, (date_trunc('week', ts) + INTERVAL 6 DAYS)::TIMESTAMP AS ts, {_RESAMPLE} FROM d GROUP BY 1, 2"))
def _(spark, d):
    return src.resample(src.from_orders(spark, d), "W1")


@register("bars_resample_mn1", o.sql(_DAILY, f"SELECT symbol, date_trunc('month', ts)::TIMESTAMP AS ts, {_RESAMPLE} FROM d GROUP BY 1, 2"))
def _(spark, d):
    return src.resample(src.from_orders(spark, d), "MN1")


@register(
    "bars_from_lineitem",
    """SELECT l_returnflag AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, arg_min(l_extendedprice, struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber)) AS open,
    max(l_extendedprice) AS high, min(l_extendedprice) AS low, arg_max(l_extendedprice, struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber)) AS close, sum(l_quantity)::DOUBLE AS volume
    FROM lineitem GROUP BY 1, 2 HAVING min(l_extendedprice) > 0""",
)
def _(spark, d):
    return src.from_lineitem(spark, d)


@register(
    "bars_clean_dedupe",
    """SELECT symbol, ts, round(b.open, 6) AS open, round(b.high, 6) AS high, round(b.low, 6) AS low, round(b.close, 6) AS close, b.volume AS volume FROM (
    SELECT l_returnflag AS symbol, l_shipdate::TIMESTAMP AS ts, arg_max(struct_pack(open := l_extendedprice::DOUBLE, high := l_extendedprice::DOUBLE * (1 + l_tax::DOUBLE), low := l_extendedprice::DOUBLE * (1 - l_discount::DOUBLE),
    close := l_extendedprice::DOUBLE, volume := l_quantity::DOUBLE), struct_pack(a := l_orderkey, b := l_linenumber)) AS b FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2) WHERE b.low > 0 AND b.high >= b.low""",
)
def _(spark, d):
    """Every line of an order as a bar of its return flag and time: of equal times the last line stays, and invalid bars go."""
    price = F.col("l_extendedprice").cast("double")
    high, low = price * (1 + F.col("l_tax").cast("double")), price * (1 - F.col("l_discount").cast("double"))
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), price.alias("open"), high.alias("high"), low.alias("low"), price.alias("close"), F.col("l_quantity").cast("double").alias("volume"), "l_orderkey", "l_linenumber")
    return src.cleaned(rows, "l_orderkey", "l_linenumber").withColumns({c: F.round(c, 6) for c in ("open", "high", "low", "close")})


@register("bars_window", o.sql(o.bars(), "n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM b WHERE ts >= '2024-01-05' AND ts <= '2024-01-20')", H1_SQL + "n WHERE k <= 200"))
def _(spark, d):
    return src.between(m15(spark, d), "2024-01-05", "2024-01-20", 200)


@register(
    "dataset_describe",
    o.sql(
        o.bars(), f"g AS (SELECT *, date_diff('second', {o.lag('ts')}, ts)::DOUBLE AS gap, ln(close) - ln({o.lag('close')}) AS r FROM b)",
        "m AS (SELECT symbol, quantile_cont(gap, 0.5) AS median_gap FROM g GROUP BY 1)",
        """SELECT g.symbol, count(*) AS bars, min(ts) AS start, max(ts) AS "end", any_value(m.median_gap) AS median_gap, round(count(*) FILTER (WHERE gap > 1.5 * m.median_gap) / count(*) * 100, 6) AS missing_pct,
        round(avg(r) * 1e4, 6) AS mean_return_bps, round(stddev_samp(r) * 1e4, 6) AS volatility_bps, round(skewness(r), 6) AS skew, round(kurtosis(r), 6) AS kurtosis, round(max(high / low - 1) * 100, 6) AS max_range_pct
        FROM g JOIN m ON g.symbol = m.symbol GROUP BY 1""",
    ),
)
def _(spark, d):
    out = src.describe(m15(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("missing_pct", "mean_return_bps", "volatility_bps", "skew", "kurtosis", "max_range_pct")})


@register("return_quantiles", o.sql(o.bars(), f"r AS (SELECT symbol, ln(close) - ln({o.lag('close')}) AS r FROM b)", "q AS (SELECT symbol, unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q FROM (SELECT DISTINCT symbol FROM b))",
    "SELECT q.symbol, q.q::DOUBLE AS q, round((SELECT quantile_cont(r.r, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) FROM r WHERE r.symbol = q.symbol)[list_position([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99], q.q)], 9) AS value FROM q"))
def _(spark, d):
    qs = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    rows = ind.log_return(m15(spark, d), "r").groupBy("symbol").agg(F.percentile("r", F.array(*map(F.lit, qs))).alias("v"))
    return rows.select("symbol", F.posexplode("v").alias("i", "value")).select("symbol", F.element_at(F.array(*map(F.lit, qs)), F.col("i") + 1).alias("q"), F.round("value", 9).alias("value"))


@register("return_histogram", o.sql(o.bars(), f"r AS (SELECT symbol, ln(close) - ln({o.lag('close')}) AS r FROM b)", "m AS (SELECT symbol, min(r) AS lo, max(r) AS hi FROM r GROUP BY 1)",
    "SELECT r.symbol, least(59, floor((r.r - lo) / (hi - lo) * 60))::INT AS bin, count(*) AS bars FROM r JOIN m ON r.symbol = m.symbol WHERE r.r IS NOT NULL GROUP BY 1, 2"))
def _(spark, d):
    rows = ind.log_return(m15(spark, d), "r").where("r IS NOT NULL")
    lim = rows.groupBy("symbol").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    b = F.least(F.lit(59), F.floor((F.col("r") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 60)).cast("int")
    return rows.join(lim, "symbol").groupBy("symbol", b.alias("bin")).agg(F.count("*").alias("bars"))


# ---------------------------------------------------------------- indicators


def indicator(name: str, f, cols: list[str], *ctes, digits: int = 6):
    """Register f(bars) showing cols against the CTEs, of which the last has the same columns; columns in price units are shown with 4 digits."""
    last = [x for p in ctes for x in ([p] if isinstance(p, str) else p)][-1].split(" AS")[0].split("(")[0]
    if name.startswith("feat_"):
        FEATURE_SQL[name] = cols, o.sql(o.bars(), *ctes, f"SELECT symbol, ts, {', '.join(cols)} FROM {last}")
    register(name, o.sql(o.bars(), *ctes, o.show(last, cols, digits)))(lambda spark, d: show(f(m15(spark, d)), cols, digits))


def cte(name: str, cols: str, frm: str = "b") -> str:
    return f"{name} AS MATERIALIZED (SELECT *, {cols} FROM {frm})"


_R = f"ln(close) - ln({o.lag('close')})"
_TP = "(high + low + close) / 3"
indicator("ind_true_range_atr", lambda b: ind.atr(ind.true_range(b)), ["true_range", "atr_14"], o.atr(), digits=4)
indicator("ind_rsi", lambda b: ind.rsi(ind.rsi(b), 50), ["rsi_14", "rsi_50"], o.rsi(14, "r1"), o.rsi(50, "r2", "r1"))
_MACD = [*o.emas("mm", "b", 12, 26), cte("ml", "ema_12 - ema_26 AS macd_line", "mm"), *o.ewm("ms", "ml", "macd_line", 0.2), o.plus("mp", "ml", ("ms", "macd_signal", 0)), cte("mc", "macd_line - macd_signal AS macd_hist", "mp")]
indicator("ind_macd", ind.macd, ["macd_line", "macd_signal", "macd_hist"], _MACD, digits=4)
_LO, _HI = o.roll("min", "low", 14), o.roll("max", "high", 14)
_STOCH = [cte("sk", f"100 * (close - {_LO}) / nullif({_HI} - {_LO}, 0) AS stoch_k"), cte("st", f"{o.roll('avg', 'stoch_k', 3)} AS stoch_d", "sk")]
indicator("ind_stochastic", ind.stochastic, ["stoch_k", "stoch_d"], _STOCH)
_WILL = f"-100 * ({_HI} - close) / nullif({_HI} - {_LO}, 0) AS williams_r"
indicator("ind_williams_r", ind.williams_r, ["williams_r"], cte("w", _WILL))
_CCI = [
    cte("ci0", f"{_TP} AS tp"), cte("ci1", f"CASE WHEN count(tp) OVER f = 20 THEN list(tp) OVER f END AS tps, avg(tp) OVER f AS m", "ci0 WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)".replace(" WINDOW", " WINDOW")),
    cte("ci", "(tp - m) / nullif(0.015 * list_avg(list_transform(tps, lambda x: abs(x - m))), 0) AS cci_20", "ci1"),
]
indicator("ind_cci", ind.cci, ["cci_20"], _CCI)
indicator("ind_adx", ind.directional_index, ["plus_di", "minus_di", "adx_14"], o.atr(), o.adx())
_BB = [cte("bb0", f"{o.roll('avg', 'close', 20)} AS bb_mid, {o.roll('stddev_pop', 'close', 20)} AS sd"), cte("bb1", "bb_mid + 2 * sd AS bb_upper, bb_mid - 2 * sd AS bb_lower", "bb0"),
       cte("bb", "(bb_upper - bb_lower) / nullif(bb_mid, 0) AS bb_width, (close - bb_lower) / nullif(bb_upper - bb_lower, 0) AS bb_position", "bb1")]
indicator("ind_bollinger", ind.bollinger, ["bb_mid", "bb_upper", "bb_lower", "bb_width", "bb_position"], _BB)
indicator("ind_keltner", ind.keltner, ["kc_mid", "kc_upper", "kc_lower"], o.atr(20), o.emas("k", "a", 20), cte("kc", "ema_20 AS kc_mid, ema_20 + 1.5 * atr_20 AS kc_upper, ema_20 - 1.5 * atr_20 AS kc_lower", "k"), digits=4)


def _dc(k: int, frm: str, name: str) -> list[str]:
    return [cte(f"{name}_0", f"{o.roll('max', 'high', k, 1)} AS dc_{k}_upper, {o.roll('min', 'low', k, 1)} AS dc_{k}_lower", frm), cte(name, f"(close - dc_{k}_lower) / nullif(dc_{k}_upper - dc_{k}_lower, 0) AS dc_{k}_position", f"{name}_0")]


indicator("ind_donchian", ind.donchian, ["dc_20_upper", "dc_20_lower", "dc_20_position"], _dc(20, "b", "dc"))
_OBV = [cte("ob0", f"coalesce(sign(close - {o.lag('close')}), 0) * volume AS mv"), cte("ob", f"{o.upto('sum', 'mv')} AS obv", "ob0")]
indicator("ind_obv", ind.on_balance_volume, ["obv"], _OBV)
_MFI = [cte("mf0", f"{_TP} AS tp"), cte("mf1", f"CASE WHEN tp > {o.lag('tp')} THEN tp * volume ELSE 0 END AS fi, CASE WHEN tp < {o.lag('tp')} THEN tp * volume ELSE 0 END AS fo", "mf0"),
        cte("mf", f"coalesce(100 - 100 / (1 + ({o.roll('sum', 'fi', 14)}) / nullif({o.roll('sum', 'fo', 14)}, 0)), 50) AS mfi_14", "mf1")]
indicator("ind_mfi", ind.money_flow_index, ["mfi_14"], _MFI)
_ADL = [cte("ad0", "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume AS fl"), cte("ad", f"{o.upto('sum', 'fl')} AS adl", "ad0")]
indicator("ind_adl", ind.accumulation_distribution, ["adl"], _ADL)
indicator("ind_realised_vol", lambda b: ind.realised_volatility(b, 20), ["realised_vol_20"], cte("rv0", f"{_R} AS r"), cte("rv", f"{o.roll('stddev_pop', 'r', 20)} AS realised_vol_20", "rv0"))
indicator("ind_parkinson", lambda b: ind.parkinson_volatility(b, 14), ["parkinson_vol_14"], cte("pk0", "power(ln(high / low), 2) AS hl"), cte("pk", f"sqrt(({o.roll('avg', 'hl', 14)}) / (4 * ln(2))) AS parkinson_vol_14", "pk0"))
indicator("ind_zscore", lambda b: b.withColumn("z", zscore("close", 100)), ["z"], cte("zs", f"{o.zscore('close', 100)} AS z"))
indicator("ind_pct_rank", lambda b: b.withColumn("p", percent_rank("close", 100)), ["p"], cte("pr", f"{o.rank('close', 100)} AS p"))
indicator("ind_hurst", ind.hurst, ["hurst_100"], o.hurst())
_SW = [cte("sw0", f"{o.lag('high', 5)} AS ch, {o.lag('low', 5)} AS cl, {o.roll('max', 'high', 11)} AS mh, {o.roll('min', 'low', 11)} AS ml"),
       cte("sw1", "CASE WHEN ch >= mh THEN 1.0 ELSE 0.0 END AS swing_high, CASE WHEN cl <= ml THEN 1.0 ELSE 0.0 END AS swing_low", "sw0"),
       cte("sw", f"{o.ffill('CASE WHEN swing_high = 1 THEN ch END')} AS last_swing_high, {o.ffill('CASE WHEN swing_low = 1 THEN cl END')} AS last_swing_low", "sw1")]
indicator("ind_swings", ind.swing_points, ["swing_high", "swing_low", "last_swing_high", "last_swing_low"], _SW)
indicator("ind_ema_overlay", lambda b: ind.ema(b, 20, 50, 200), ["ema_20", "ema_50", "ema_200"], o.emas("e", "b", 20, 50, 200), digits=4)

# ---------------------------------------------------------------- features

_HS = [3, 5, 10, 20, 50]
_RET = ["ret_1", *(n for h in _HS for n in (f"ret_{h}", f"ret_{h}_norm")), "up_bar_ratio_20"]
indicator(
    "feat_returns", features.returns_block, _RET, cte("f0", f"{_R} AS ret_1, " + ", ".join(f"ln(close) - ln({o.lag('close', h)}) AS ret_{h}" for h in _HS)),
    cte("f1", ", ".join(f"ret_{h} / (nullif({o.roll('stddev_pop', 'ret_1', 3 * h)}, 0) * sqrt({h})) AS ret_{h}_norm" for h in _HS) + f", {o.roll('avg', '(CASE WHEN ret_1 > 0 THEN 1.0 ELSE 0.0 END)', 20)} AS up_bar_ratio_20", "f0"),
)
_F50 = f"(PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING)"
indicator(
    "feat_return_moments", lambda b: features.returns_block(b), ["ret_skew_50", "ret_kurt_50", "ret_autocorr_50"], cte("f0", f"{_R} AS r"), cte("f1", f"{o.lag('r')} AS p, CASE WHEN count(r) OVER {_F50} = 50 THEN list(r) OVER {_F50} END AS rs", "f0"),
    f"f2 AS (SELECT symbol, ts, CASE WHEN rs IS NOT NULL THEN skewness(r) OVER {_F50} END AS ret_skew_50, CASE WHEN rs IS NOT NULL THEN kurtosis(r) OVER {_F50} END AS ret_kurt_50, "
    "CASE WHEN rs IS NOT NULL THEN (SELECT corr(x, y) FROM (SELECT unnest(rs[2:]) AS x, unnest(rs[:49]) AS y)) END AS ret_autocorr_50 FROM f1)",
)
_TREND = [*(f"ema_{w}_{k}_atr" for w in (20, 50, 200) for k in ("dist", "slope")), "ema_20_50_spread_atr", "ema_50_200_spread_atr", "adx_14", "di_balance", "macd_hist_atr", "macd_cross", "hurst_100"]
indicator(
    "feat_trend", features.trend_block, _TREND, o.atr(), o.adx("x", "a"), o.hurst("hu", "x"), o.emas("e", "hu", 20, 50, 200, 12, 26), cte("ml", "ema_12 - ema_26 AS macd_line", "e"), o.ewm("ms", "ml", "macd_line", 0.2), o.plus("mp", "ml", ("ms", "macd_signal", 0)),
    cte("tr", ", ".join(f"(close - ema_{w}) / nullif(atr_14, 0) AS ema_{w}_dist_atr, (ema_{w} - {o.lag(f'ema_{w}', max(2, w // 4))}) / nullif(atr_14, 0) AS ema_{w}_slope_atr" for w in (20, 50, 200))
        + ", (ema_20 - ema_50) / nullif(atr_14, 0) AS ema_20_50_spread_atr, (ema_50 - ema_200) / nullif(atr_14, 0) AS ema_50_200_spread_atr, (plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS di_balance, (macd_line - macd_signal) / nullif(atr_14, 0) AS macd_hist_atr, sign(macd_line - macd_signal)::DOUBLE AS macd_cross", "mp"),
)
indicator(
    "feat_momentum", features.momentum_block, ["rsi_14", "rsi_50", "rsi_14_delta", "stoch_k", "stoch_d", "williams_r", "cci_20", "roc_12", "roc_48"], o.rsi(14, "r1"), o.rsi(50, "r2", "r1"),
    cte("m1", f"100 * (close - {_LO}) / nullif({_HI} - {_LO}, 0) AS stoch_k, {_WILL}, rsi_14 - {o.lag('rsi_14', 5)} AS rsi_14_delta, (close / {o.lag('close', 12)} - 1) * 100 AS roc_12, (close / {o.lag('close', 48)} - 1) * 100 AS roc_48, {_TP} AS tp", "r2"),
    cte("m2", f"{o.roll('avg', 'stoch_k', 3)} AS stoch_d, CASE WHEN count(tp) OVER f = 20 THEN list(tp) OVER f END AS tps, avg(tp) OVER f AS m", "m1 WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)"),
    cte("m3", "(tp - m) / nullif(0.015 * list_avg(list_transform(tps, lambda x: abs(x - m))), 0) AS cci_20", "m2"),
)
_VW = (14, 50, 200)
indicator(
    "feat_volatility", features.volatility_block,
    [*(n for w in _VW for n in (f"atr_{w}_rel", f"realised_vol_{w}", f"parkinson_vol_{w}")), "vol_term_structure", "vol_of_vol", "bb_width", "bb_position", "bb_squeeze", "gap_atr", "bar_range_atr"],
    cte("v0", f"{_R} AS r, power(ln(high / low), 2) AS hl"), o.true_range("v1", "v0"), *(o.ewm(f"va{w}", "v1", "true_range", 1 / w) for w in _VW), o.plus("v2", "v1", *((f"va{w}", f"atr_{w}", w) for w in _VW)),
    cte("v3", ", ".join(f"atr_{w} / close AS atr_{w}_rel, {o.roll('stddev_pop', 'r', w)} AS realised_vol_{w}, sqrt(({o.roll('avg', 'hl', w)}) / (4 * ln(2))) AS parkinson_vol_{w}" for w in _VW) + f", {o.roll('avg', 'close', 20)} AS mid, {o.roll('stddev_pop', 'close', 20)} AS sd, (open - {o.lag('close')}) / nullif(atr_14, 0) AS gap_atr, (high - low) / nullif(atr_14, 0) AS bar_range_atr", "v2"),
    cte("v4", f"realised_vol_14 / nullif(realised_vol_200, 0) AS vol_term_structure, {o.roll('stddev_pop', 'realised_vol_14', 200)} AS vol_of_vol, 4 * sd / nullif(mid, 0) AS bb_width, (close - mid + 2 * sd) / nullif(4 * sd, 0) AS bb_position", "v3"),
    cte("v5", f"{o.rank('round(bb_width, 10)', 200)} AS bb_squeeze", "v4"),
)
indicator(
    "feat_structure", features.structure_block, [*(n for w in (20, 55, 200) for n in (f"dc_{w}_position", f"dc_{w}_width_atr")), "dist_swing_high_atr", "dist_swing_low_atr", "swing_position", "bars_since_swing_high", "bars_since_swing_low"],
    o.atr(), _dc(20, "a", "s1"), _dc(55, "s1", "s2"), _dc(200, "s2", "s3"), cte("s4", f"{o.lag('high', 5)} AS ch, {o.lag('low', 5)} AS cl, {o.roll('max', 'high', 11)} AS mh, {o.roll('min', 'low', 11)} AS ml", "s3"),
    cte("s5", f"{o.ffill('CASE WHEN ch >= mh THEN ch END')} AS sh, {o.ffill('CASE WHEN cl <= ml THEN cl END')} AS sl, (rn - {o.ffill('CASE WHEN ch >= mh THEN rn END')})::DOUBLE AS bars_since_swing_high, (rn - {o.ffill('CASE WHEN cl <= ml THEN rn END')})::DOUBLE AS bars_since_swing_low", "s4"),
    cte("s6", ", ".join(f"(dc_{w}_upper - dc_{w}_lower) / nullif(atr_14, 0) / (CASE WHEN dc_{w}_upper <> dc_{w}_lower THEN 1 END) AS dc_{w}_width_atr" for w in (20, 55, 200)) + ", (sh - close) / nullif(atr_14, 0) AS dist_swing_high_atr, (close - sl) / nullif(atr_14, 0) AS dist_swing_low_atr, (close - sl) / nullif(sh - sl, 0) AS swing_position", "s5"),
)
indicator(
    "feat_volume", features.volume_block, ["obv_slope_20", "adl_slope_20", "mfi_14", "force_index_z", "volume_z_50", "volume_ratio_20"], _MFI,
    cte("u0", f"coalesce(sign(close - {o.lag('close')}), 0) * volume AS mv, coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume AS fl, (close - {o.lag('close')}) * volume AS fc", "mf"),
    cte("u1", f"{o.upto('sum', 'mv')} AS obv, {o.upto('sum', 'fl')} AS adl", "u0"), cte("u2", f"obv - {o.lag('obv', 20)} AS os, adl - {o.lag('adl', 20)} AS al", "u1"),
    cte("u3", f"{o.zscore('os', 200)} AS obv_slope_20, {o.zscore('al', 200)} AS adl_slope_20, {o.zscore('fc', 100)} AS force_index_z, {o.zscore('volume', 50)} AS volume_z_50, volume / nullif({o.roll('avg', 'volume', 20)}, 0) AS volume_ratio_20", "u2"),
)
indicator(
    "feat_session", features.session_block, ["hour_sin", "hour_cos", "weekday_sin", "weekday_cos", "is_london_ny_overlap"], cte("h0", "hour(ts)::DOUBLE AS h, (isodow(ts) - 1)::DOUBLE AS wd"),
    cte("h1", "sin(2 * pi() * h / 24) AS hour_sin, cos(2 * pi() * h / 24) AS hour_cos, sin(2 * pi() * wd / 5) AS weekday_sin, cos(2 * pi() * wd / 5) AS weekday_cos, CASE WHEN h >= 13 AND h < 17 THEN 1.0 ELSE 0.0 END AS is_london_ny_overlap", "h0"),
)
_DESC = [*o.atr(), *o.rsi(14, "r", "a"), *o.hurst("hu", "r"), *o.emas("e", "hu", 20, 100), cte("de0", f"{_R} AS r1", "e"), cte("de1", f"{o.roll('stddev_pop', 'r1', 20)} AS rv", "de0"),
         cte("de", f"(ema_20 - ema_100) / nullif(atr_14, 0) AS trend_strength, {o.rank('round(rv, 12)', 500)} AS vol_percentile, (rsi_14 - 50) / 50 AS momentum_score, 0.5 - hurst_100 AS mean_reversion_score", "de1")]
indicator("feat_descriptors", features.descriptor_block, features.DESCRIPTORS, _DESC)


_FEATURES = [c for cols, _ in FEATURE_SQL.values() for c in cols]
_MATRIX = [
    *o.bars(), *(f"{name} AS MATERIALIZED ({text})" for name, (_, text) in FEATURE_SQL.items()),
    f"fm0 AS MATERIALIZED (SELECT b.*, {', '.join(_FEATURES)} FROM b {' '.join(f'JOIN {name} USING (symbol, ts)' for name in FEATURE_SQL)})",
    f"fm1 AS MATERIALIZED (SELECT symbol, ts, open, high, low, close, volume, {', '.join(o.ffill(f'CASE WHEN isfinite({c}) THEN {c} END') + f' AS {c}' for c in _FEATURES)} FROM fm0 WHERE rn >= 300)",
    f"fm AS MATERIALIZED (SELECT * FROM fm1 WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _FEATURES)})",
]


@register("feat_matrix", o.sql(_MATRIX, o.show("fm", ["open", "high", "low", "close", "volume", *_FEATURES])))
def _(spark, d):
    """All blocks side by side, without the warm-up and without gaps."""
    return show(features.build_features(m15(spark, d)), ["open", "high", "low", "close", "volume", *_FEATURES])


@register("feat_summary", o.sql(
    _MATRIX, f"fl AS (UNPIVOT (SELECT {', '.join(_FEATURES)} FROM fm) ON {', '.join(_FEATURES)} INTO NAME feature VALUE value)",
    "SELECT feature, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std, round(min(value), 5) AS min, round(quantile_cont(value, 0.5), 5) AS median, round(max(value), 5) AS max FROM fl GROUP BY 1"))
def _(spark, d):
    """Mean, spread, least, median and greatest of every feature."""
    df = features.build_features(m15(spark, d))
    names = features.feature_columns(df)
    long = df.unpivot(["symbol"], names, "feature", "value").groupBy("feature")
    stats = {"mean": F.avg("value"), "std": F.stddev_samp("value"), "min": F.min("value"), "median": F.percentile("value", F.lit(0.5)), "max": F.max("value")}
    return long.agg(*(F.round(x, 5).alias(n) for n, x in stats.items()))


# ---------------------------------------------------------------- labels


@register("label_directional", o.sql(
    o.bars(), o.atr(), cte("l0", f"{o.lead('close', 24)} / close - 1 AS forward_return, 0.25 * atr_14 / close AS band", "a"),
    "SELECT symbol, ts, CASE WHEN forward_return > band THEN 1 WHEN forward_return < -band THEN -1 ELSE 0 END::INT AS label, round(forward_return, 6) AS forward_return FROM l0 WHERE forward_return IS NOT NULL AND band IS NOT NULL"))
def _(spark, d):
    return labels.directional(m15(spark, d)).select("symbol", "ts", "label", F.round("forward_return", 6).alias("forward_return"))


_TB = [
    *o.atr(),
    "tb0 AS MATERIALIZED (SELECT a.symbol, a.ts, a.rn, a.close, a.close + a.atr_14 AS u, a.close - a.atr_14 AS dn, min(CASE WHEN n.high >= a.close + a.atr_14 THEN n.rn - a.rn END) AS iu, min(CASE WHEN n.low <= a.close - a.atr_14 THEN n.rn - a.rn END) AS id,"
    " max(CASE WHEN n.rn = a.rn + 24 THEN n.close END) AS e FROM a JOIN b n ON n.symbol = a.symbol AND n.rn BETWEEN a.rn + 1 AND a.rn + 24 WHERE a.atr_14 > 0 GROUP BY ALL)",
    "tb1 AS MATERIALIZED (SELECT *, CASE WHEN iu IS NULL AND id IS NULL THEN 'time' WHEN iu = id THEN 'both' WHEN id IS NULL OR iu < id THEN 'upper' ELSE 'lower' END AS barrier_hit FROM tb0 WHERE e IS NOT NULL)",
    "tb AS MATERIALIZED (SELECT symbol, ts, rn, barrier_hit, CASE barrier_hit WHEN 'time' THEN 0 WHEN 'upper' THEN 1 ELSE -1 END::INT AS label, CASE barrier_hit WHEN 'time' THEN e WHEN 'upper' THEN u ELSE dn END / close - 1 AS forward_return,"
    " CASE barrier_hit WHEN 'time' THEN 24 WHEN 'upper' THEN iu ELSE id END::DOUBLE AS holding_bars FROM tb1)",
]


@register("label_triple_barrier", o.sql(o.bars(), _TB, "SELECT symbol, ts, label, round(forward_return, 6) AS forward_return, holding_bars, barrier_hit FROM tb"))
def _(spark, d):
    return labels.triple_barrier(m15(spark, d)).select("symbol", "ts", "label", F.round("forward_return", 6).alias("forward_return"), "holding_bars", "barrier_hit")


def crossover(name: str = "s", frm: str = "b", fast: int = 50, slow: int = 200) -> list[str]:
    return [*o.emas(f"{name}_e", frm, fast, slow), cte(name, f"sign(ema_{fast} - ema_{slow})::DOUBLE AS signal", f"{name}_e")]


_META = [
    *o.atr(), *crossover("s", "a"),
    "me0 AS MATERIALIZED (SELECT a.symbol, a.ts, a.close, a.signal AS p, a.close + a.signal * a.atr_14 AS tp, a.close - a.signal * a.atr_14 AS sl,"
    " min(CASE WHEN (a.signal > 0 AND n.high >= a.close + a.signal * a.atr_14) OR (a.signal < 0 AND n.low <= a.close + a.signal * a.atr_14) THEN n.rn - a.rn END) AS iw,"
    " min(CASE WHEN (a.signal > 0 AND n.low <= a.close - a.signal * a.atr_14) OR (a.signal < 0 AND n.high >= a.close - a.signal * a.atr_14) THEN n.rn - a.rn END) AS il,"
    " max(CASE WHEN n.rn = a.rn + 24 THEN n.close END) AS e FROM s a JOIN b n ON n.symbol = a.symbol AND n.rn BETWEEN a.rn + 1 AND a.rn + 24 WHERE a.atr_14 > 0 AND a.signal <> 0 GROUP BY ALL)",
    "me1 AS MATERIALIZED (SELECT *, CASE WHEN iw IS NULL AND il IS NULL THEN 'time' WHEN iw = il THEN 'both' WHEN il IS NULL OR iw < il THEN 'profit' ELSE 'stop' END AS barrier_hit FROM me0 WHERE e IS NOT NULL)",
]


@register("label_meta", o.sql(
    o.bars(), _META,
    "SELECT symbol, ts, CASE WHEN barrier_hit = 'profit' OR (barrier_hit = 'time' AND (e - close) * p > 0) THEN p ELSE 0 END::INT AS label, round((CASE barrier_hit WHEN 'time' THEN e WHEN 'profit' THEN tp ELSE sl END / close - 1) * p, 6) AS forward_return,"
    " CASE barrier_hit WHEN 'time' THEN 24 WHEN 'profit' THEN iw ELSE il END::DOUBLE AS holding_bars, barrier_hit, p AS \"primary\" FROM me1"))
def _(spark, d):
    return labels.meta(m15(spark, d)).select("symbol", "ts", "label", F.round("forward_return", 6).alias("forward_return"), "holding_bars", "barrier_hit", "primary")


@register("label_distribution", o.sql(o.bars(), _TB, "SELECT symbol, label, count(*) AS bars, round(count(*) / sum(count(*)) OVER (PARTITION BY symbol), 9) AS share FROM tb GROUP BY 1, 2"))
def _(spark, d):
    return labels.distribution(labels.triple_barrier(m15(spark, d))).withColumn("share", F.round("share", 9))


@register("label_barrier_shares", o.sql(o.bars(), _TB, "SELECT symbol, barrier_hit, count(*) AS bars, round(count(*) / sum(count(*)) OVER (PARTITION BY symbol), 9) AS share FROM tb GROUP BY 1, 2"))
def _(spark, d):
    return labels.barrier_shares(labels.triple_barrier(m15(spark, d))).withColumn("share", F.round("share", 9))


@register("label_summary", o.sql(
    o.bars(), _TB, "SELECT symbol, count(*) AS samples, round(avg((label = 1)::INT), 9) AS long_share, round(avg((label = 0)::INT), 9) AS flat_share, round(avg((label = -1)::INT), 9) AS short_share, round(avg(holding_bars), 6) AS mean_holding_bars,"
    " round(avg(forward_return) * 1e4, 6) AS mean_forward_return_bps FROM tb GROUP BY 1"))
def _(spark, d):
    out = labels.summary(labels.triple_barrier(m15(spark, d)))
    return out.withColumns({c: F.round(c, 9) for c in ("long_share", "flat_share", "short_share")} | {c: F.round(c, 6) for c in ("mean_holding_bars", "mean_forward_return_bps")})


# ---------------------------------------------------------------- signals


_RSI_SIG = [*o.rsi(14, "r"), cte("s", f"coalesce({o.ffill('CASE WHEN rsi_14 < 30 THEN 1.0 WHEN rsi_14 > 70 THEN -1.0 WHEN rsi_14 > 45 AND rsi_14 < 55 THEN 0.0 END')}, 0)::DOUBLE AS signal", "r")]
_DC_SIG = [*_dc(55, "b", "dc"), cte("s", f"coalesce({o.ffill('CASE WHEN close > dc_55_upper THEN 1.0 WHEN close < dc_55_lower THEN -1.0 END')}, 0)::DOUBLE AS signal", "dc")]
_ADX_SIG = [*o.atr(), *o.adx("x", "a"), *crossover("s0", "x"), "s AS MATERIALIZED (SELECT * EXCLUDE (signal), CASE WHEN adx_14 >= 20 THEN signal ELSE 0.0 END AS signal FROM s0)"]
_RULE_SQL = {"buy_and_hold": [cte("s", "1.0::DOUBLE AS signal")], "ma_crossover": crossover(), "rsi_mean_reversion": _RSI_SIG, "donchian_breakout": _DC_SIG, "volatility_filtered_trend": _ADX_SIG}

for _name, _ctes in _RULE_SQL.items():
    register(f"sig_{_name}", o.sql(o.bars(), _ctes, "SELECT symbol, ts, signal::DOUBLE AS signal FROM s"))(lambda spark, d, name=_name: signals.rule(name, m15(spark, d)).select("symbol", "ts", "signal"))

_PROB = [*o.rsi(14, "r"), cte("p", "rsi_14 / 100 AS p_long, 1 - rsi_14 / 100 AS p_short", "r")]


def probabilities(spark, d):
    """Class probabilities read off the RSI, which need no model."""
    return ind.rsi(m15(spark, d)).withColumns({"p_long": F.col("rsi_14") / 100, "p_short": 1 - F.col("rsi_14") / 100})


@register("sig_threshold", o.sql(o.bars(), _PROB, "SELECT symbol, ts, CASE WHEN p_long >= 0.55 AND p_long >= p_short THEN 1.0 WHEN p_short >= 0.55 AND p_short > p_long THEN -1.0 ELSE 0.0 END::DOUBLE AS signal FROM p"))
def _(spark, d):
    return signals.from_probabilities(probabilities(spark, d)).select("symbol", "ts", "signal")


@register("sig_position_mix", o.sql(o.bars(), _PROB, "m AS (SELECT symbol, CASE WHEN p_long >= 0.55 AND p_long >= p_short THEN 'long' WHEN p_short >= 0.55 AND p_short > p_long THEN 'short' ELSE 'flat' END AS side FROM p)",
    "SELECT symbol, side, count(*) AS bars, round(count(*) / sum(count(*)) OVER (PARTITION BY symbol), 9) AS share FROM m GROUP BY 1, 2"))
def _(spark, d):
    return classification.position_mix(signals.from_probabilities(probabilities(spark, d))).withColumn("share", F.round("share", 9))


@register("sig_changes", o.sql(o.bars(), crossover(), cte("c", f"{o.lag('signal')} AS before", "s"), "SELECT symbol, ts, signal FROM c WHERE signal <> 0 AND (before IS NULL OR before <> signal)"))
def _(spark, d):
    return backtest.signal_changes(signals.ma_crossover(m15(spark, d))).select("symbol", "ts", "signal")


@register("bt_session_filter", o.sql(o.bars(), crossover(), f"SELECT symbol, ts, coalesce({o.ffill('CASE WHEN hour(ts) IN (8, 9, 10, 11, 12, 13, 14, 15, 16) THEN signal END')}, 0)::DOUBLE AS signal FROM s"))
def _(spark, d):
    return signals.session_filter(signals.ma_crossover(m15(spark, d)), range(8, 17)).select("symbol", "ts", "signal")


def held(frm: str = "s", name: str = "h", bars: int = 24) -> str:
    stay = f"m.now <> 0 AND m.held < {bars}"
    return (
        f"{name}(symbol, rn, now, held) AS (SELECT symbol, rn, signal, 1 FROM {frm} WHERE rn = 0 UNION ALL SELECT s.symbol, s.rn, CASE WHEN {stay} THEN m.now ELSE s.signal END,"
        f" CASE WHEN {stay} THEN m.held + 1 WHEN s.signal <> m.now THEN 1 ELSE m.held + 1 END FROM {name} m JOIN {frm} s ON s.symbol = m.symbol AND s.rn = m.rn + 1)"
    )


@register("bt_min_hold", o.sql(o.bars(), _RSI_SIG, held(), "SELECT s.symbol, s.ts, h.now AS signal FROM s JOIN h ON s.symbol = h.symbol AND s.rn = h.rn"))
def _(spark, d):
    return signals.min_holding(signals.rsi_mean_reversion(m15(spark, d)), 24).select("symbol", "ts", "signal")


@register("bt_vol_target", o.sql(o.bars(), cte("v0", f"{_R} AS r"), cte("v1", f"0.1 / nullif(({o.roll('stddev_pop', 'r', 100)}) * sqrt(24960), 0) AS sc", "v0"), f"SELECT symbol, ts, round(coalesce(least({o.lag('sc')}, 3.0), 0), 6)::DOUBLE AS scalar FROM v1"))
def _(spark, d):
    return show(signals.volatility_scalar(m15(spark, d), 0.1, 100, 24_960), ["scalar"])


# ---------------------------------------------------------------- backtest

M15_YEAR = src.bars_per_year("M15")


def priced(rule_ctes: list[str]) -> list[str]:
    """CTEs from a rule's CTE s to q: the priced bars."""
    return [
        *rule_ctes, held(), "p0 AS MATERIALIZED (SELECT s.symbol, s.ts, s.rn, s.open, h.now FROM s JOIN h ON s.symbol = h.symbol AND s.rn = h.rn)",
        f"p1 AS MATERIALIZED (SELECT *, coalesce({o.lag('now')}, 0)::DOUBLE AS side, coalesce({o.lead('open')} / open - 1, 0) AS bar_return FROM p0)",
        f"p2 AS MATERIALIZED (SELECT *, side AS position, abs(side - coalesce({o.lag('side')}, 0)) * 0.00025 AS cost FROM p1)",
        "p3 AS MATERIALIZED (SELECT *, position * bar_return - cost AS strategy_return, bar_return - CASE WHEN rn = 0 THEN 0.00025 ELSE 0 END AS benchmark_return FROM p2)",
        f"p4 AS MATERIALIZED (SELECT *, 10000 * {o.upto('product', '1 + strategy_return')} AS equity, 10000 * {o.upto('product', '1 + benchmark_return')} AS benchmark_equity FROM p3)",
        f"q AS MATERIALIZED (SELECT *, equity / {o.upto('max', 'equity')} - 1 AS drawdown, benchmark_equity / {o.upto('max', 'benchmark_equity')} - 1 AS benchmark_drawdown FROM p4)",
    ]


_PRICED = priced(crossover())


def crossover_result(spark, d):
    return backtest.run(signals.ma_crossover(m15(spark, d)), bars_per_year=M15_YEAR)


_EQ = ["position", "cost", "strategy_return", "equity", "drawdown"]


@register("bt_equity", o.sql(o.bars(), _PRICED, "SELECT symbol, ts, position, round(cost, 8) AS cost, round(strategy_return, 8) AS strategy_return, round(equity, 4) AS equity, round(drawdown, 8) AS drawdown FROM q"))
def _(spark, d):
    return crossover_result(spark, d).select("symbol", "ts", "position", *(F.round(c, 4 if c == "equity" else 8).alias(c) for c in _EQ[1:]))


@register("bt_benchmark", o.sql(o.bars(), _PRICED, "SELECT symbol, ts, round(benchmark_return, 8) AS benchmark_return, round(benchmark_equity, 4) AS benchmark_equity, round(benchmark_drawdown, 8) AS benchmark_drawdown FROM q"))
def _(spark, d):
    return crossover_result(spark, d).select("symbol", "ts", F.round("benchmark_return", 8).alias("benchmark_return"), F.round("benchmark_equity", 4).alias("benchmark_equity"), F.round("benchmark_drawdown", 8).alias("benchmark_drawdown"))


@register("bt_sized", o.sql(
    o.bars(), crossover(), held(), "p0 AS MATERIALIZED (SELECT s.symbol, s.ts, s.rn, s.open, s.close, h.now FROM s JOIN h ON s.symbol = h.symbol AND s.rn = h.rn)", cte("p1", f"coalesce({o.lag('now')}, 0)::DOUBLE AS side, {_R} AS r", "p0"),
    cte("p2", f"5.0 / nullif(({o.roll('stddev_pop', 'r', 100)}) * sqrt({M15_YEAR}), 0) AS sc0, {o.lag('side')} AS before", "p1"), cte("p3", f"coalesce(least({o.lag('sc0')}, 3.0), 0) AS sc", "p2"),
    f"SELECT symbol, ts, round(side * CASE WHEN side = 0 THEN 0 ELSE coalesce({o.ffill('CASE WHEN side <> 0 AND (before IS NULL OR before <> side) THEN sc END')}, 0) END, 6)::DOUBLE AS position FROM p3"))
def _(spark, d):
    return show(backtest.run(signals.ma_crossover(m15(spark, d)), bars_per_year=M15_YEAR, target=5.0), ["position"])


_TRADES = [
    cte("t0", f"sum(CASE WHEN side <> before THEN 1 ELSE 0 END) OVER ({o.W} ROWS UNBOUNDED PRECEDING) AS run", f"(SELECT *, coalesce({o.lag('side')}, 0) AS before FROM q)"),
    "t1 AS MATERIALIZED (SELECT symbol, run, min(ts) AS entry_time, max(ts) AS last_ts, any_value(side) AS side, arg_min(open, ts) AS entry_price, arg_max(open, ts) AS last_price, count(*) AS bars, product(1 + strategy_return) AS g FROM t0 GROUP BY 1, 2)",
    "t2 AS MATERIALIZED (SELECT *, coalesce(lead(entry_time) OVER w, last_ts) AS exit_time, coalesce(lead(entry_price) OVER w, last_price) AS exit_price FROM t1 WINDOW w AS (PARTITION BY symbol ORDER BY entry_time))",
    "tr AS MATERIALIZED (SELECT symbol, entry_time, exit_time, CASE WHEN side > 0 THEN 'long' ELSE 'short' END AS side, entry_price, exit_price, bars, g - 1 AS ret FROM t2 WHERE side <> 0)",
]


@register("bt_trades", o.sql(o.bars(), _PRICED, _TRADES, 'SELECT * EXCLUDE (ret), round(ret, 8) AS "return" FROM tr'))
def _(spark, d):
    return backtest.trades(crossover_result(spark, d)).withColumn("return", F.round("return", 8))


@register("bt_drawdown", o.sql(
    o.bars(), _PRICED, "m AS (SELECT symbol, min(drawdown) AS dd, arg_min(ts, struct_pack(a := drawdown, b := ts)) AS trough FROM q GROUP BY 1)",
    "SELECT m.symbol, round(any_value(dd), 8) AS max_drawdown, arg_max(q.ts, struct_pack(a := q.equity, b := -epoch_us(q.ts))) AS peak, any_value(trough) AS trough FROM m JOIN q ON q.symbol = m.symbol AND q.ts <= m.trough GROUP BY 1"))
def _(spark, d):
    return metrics.drawdown_span(crossover_result(spark, d)).withColumn("max_drawdown", F.round("max_drawdown", 8))


def metric_ctes(year: int = M15_YEAR) -> list[str]:
    """CTE k: the 23 metrics by symbol, from q and tr."""
    root = f"sqrt({year})"
    return [
        f"g0 AS MATERIALIZED (SELECT *, strategy_return AS r, abs(position - {o.lag('position')}) AS turn, sum(CASE WHEN drawdown < 0 THEN 0 ELSE 1 END) OVER ({o.W} ROWS UNBOUNDED PRECEDING) AS g FROM q)",
        "g1 AS (SELECT symbol, max(u)::DOUBLE AS longest_drawdown_bars FROM (SELECT symbol, g, count(*) FILTER (WHERE drawdown < 0) AS u FROM g0 GROUP BY 1, 2) GROUP BY 1)",
        "g2 AS (SELECT symbol, quantile_cont(r, 0.05) AS var_95 FROM g0 GROUP BY 1)", "g3 AS (SELECT g0.symbol, avg(r) AS cvar_95 FROM g0 JOIN g2 ON g0.symbol = g2.symbol WHERE r <= var_95 GROUP BY 1)",
        f"""g4 AS (SELECT symbol, arg_max(equity, ts) / arg_min(equity, ts) AS gr, stddev_pop(r) * {root} AS annualised_volatility, avg(r) / nullif(stddev_pop(r), 0) * {root} AS sharpe,
        CASE WHEN count(*) FILTER (WHERE r < 0) > 1 THEN avg(r) / nullif(stddev_pop(r) FILTER (WHERE r < 0), 0) * {root} END AS sortino, min(drawdown) AS max_drawdown, sum(greatest(r, 0)) / nullif(-sum(least(r, 0)), 0) AS profit_factor,
        avg((r > 0)::INT) AS hit_rate, skewness(r) AS skew, kurtosis(r) AS kurtosis, count(*)::DOUBLE AS bars, avg((position <> 0)::INT) AS exposure, avg(turn) * {year} AS annual_turnover FROM g0 GROUP BY 1)""",
        """g5 AS (SELECT symbol, count(*)::DOUBLE AS trades, avg((ret > 0)::INT) AS trade_win_rate, coalesce(avg(ret) FILTER (WHERE ret > 0), 0) AS avg_win, coalesce(avg(ret) FILTER (WHERE ret <= 0), 0) AS avg_loss, avg(bars) AS avg_trade_bars,
        abs(avg(ret) FILTER (WHERE ret > 0) / nullif(avg(ret) FILTER (WHERE ret <= 0), 0)) AS payoff_ratio FROM tr GROUP BY 1)""",
        f"""k AS (SELECT g4.*, gr - 1 AS total_return, power(gr, {year}::DOUBLE / g4.bars) - 1 AS cagr, CASE WHEN max_drawdown < 0 THEN (power(gr, {year}::DOUBLE / g4.bars) - 1) / abs(max_drawdown) END AS calmar, longest_drawdown_bars, var_95, cvar_95,
        trades, trade_win_rate, avg_win, avg_loss, avg_trade_bars, payoff_ratio FROM g4 JOIN g1 USING (symbol) JOIN g2 USING (symbol) LEFT JOIN g3 USING (symbol) LEFT JOIN g5 USING (symbol))""",
    ]


def _rounded(m: str) -> str:
    return f"round({m}, 6) AS {m}"


@register("bt_metrics", o.sql(o.bars(), _PRICED, _TRADES, metric_ctes(), f"SELECT symbol, {', '.join(map(_rounded, metrics.METRICS))} FROM k"))
def _(spark, d):
    result = crossover_result(spark, d)
    out = metrics.performance(result, M15_YEAR, backtest.trades(result))
    return out.select("symbol", *(F.round(m, 6).alias(m) for m in metrics.METRICS))


@register("bt_longest_drawdown", o.sql(o.bars(), _PRICED, _TRADES, metric_ctes(), "SELECT symbol, longest_drawdown_bars FROM g1"))
def _(spark, d):
    return backtest.longest_underwater(crossover_result(spark, d))


@register("bt_indexed_equity", o.sql(o.bars(), _PRICED, f"SELECT symbol, ts, round(equity / first_value(equity) OVER ({o.W}) * 100, 6) AS indexed_equity FROM q"))
def _(spark, d):
    return show(backtest.indexed(crossover_result(spark, d)), ["indexed_equity"])


# ---------------------------------------------------------------- regimes

_DESC_ROWS = [*_DESC, "dn AS MATERIALIZED (SELECT * FROM de WHERE trend_strength IS NOT NULL AND vol_percentile IS NOT NULL AND momentum_score IS NOT NULL AND mean_reversion_score IS NOT NULL)"]
_REG = [
    *_DESC_ROWS, "cu AS (SELECT symbol, quantile_cont(abs(trend_strength), 0.5) AS t, quantile_cont(vol_percentile, 0.5) AS v FROM dn GROUP BY 1)",
    "rg AS MATERIALIZED (SELECT dn.*, (CASE WHEN abs(trend_strength) > t THEN 2 ELSE 0 END + CASE WHEN vol_percentile > v THEN 1 ELSE 0 END)::INT AS regime FROM dn JOIN cu ON dn.symbol = cu.symbol)",
]


def described(spark, d):
    return features.descriptor_block(m15(spark, d)).dropna("any", subset=features.DESCRIPTORS)


def ruled(spark, d):
    df = described(spark, d)
    return regimes.RuleRegimes().fit(df).predict(df)


@register("regime_rule", o.sql(o.bars(), _REG, "SELECT symbol, ts, regime FROM rg"))
def _(spark, d):
    return ruled(spark, d).select("symbol", "ts", "regime")


_RUNS = [cte("ru0", f"CASE WHEN regime = {o.lag('regime')} THEN 0 ELSE 1 END AS ch", "rg"), cte("ru1", f"{o.upto('sum', 'ch')}::BIGINT AS run", "ru0"),
         'ru AS MATERIALIZED (SELECT symbol, run, any_value(regime) AS regime, min(ts) AS start, max(ts) AS "end", count(*) AS bars FROM ru1 GROUP BY 1, 2)']


@register("regime_runs", o.sql(o.bars(), _REG, _RUNS, "SELECT * FROM ru"))
def _(spark, d):
    return regimes.run_lengths(ruled(spark, d))


@register("regime_run_summary", o.sql(o.bars(), _REG, _RUNS, "SELECT symbol, regime, count(*) AS runs, round(avg(bars), 6) AS mean_bars, quantile_cont(bars::DOUBLE, 0.5) AS median_bars, max(bars) AS max_bars FROM ru GROUP BY 1, 2"))
def _(spark, d):
    return regimes.run_summary(regimes.run_lengths(ruled(spark, d))).withColumn("mean_bars", F.round("mean_bars", 6))


@register("regime_longest_runs", o.sql(o.bars(), _REG, _RUNS, "SELECT * FROM ru ORDER BY bars DESC, symbol, start LIMIT 12"))
def _(spark, d):
    return regimes.longest_runs(regimes.run_lengths(ruled(spark, d)))


@register("regime_persistence", o.sql(o.bars(), _REG, _RUNS, "SELECT symbol, round(avg(1 - ch), 9) AS persistence FROM ru0 GROUP BY 1"))
def _(spark, d):
    return regimes.persistence(ruled(spark, d)).withColumn("persistence", F.round("persistence", 9))


@register("regime_transitions", o.sql(
    o.bars(), _REG, cte("n0", f"{o.lead('regime')} AS nxt", "rg"), "st AS (SELECT DISTINCT symbol, regime FROM rg)", "c0 AS (SELECT symbol, regime, nxt, count(*) AS n FROM n0 WHERE nxt IS NOT NULL GROUP BY ALL)",
    """SELECT a.symbol, a.regime AS "from", z.regime AS "to", round(coalesce(coalesce(c0.n, 0) / nullif(sum(coalesce(c0.n, 0)) OVER (PARTITION BY a.symbol, a.regime), 0), 0), 9)::DOUBLE AS value
    FROM st a JOIN st z ON a.symbol = z.symbol LEFT JOIN c0 ON c0.symbol = a.symbol AND c0.regime = a.regime AND c0.nxt = z.regime"""))
def _(spark, d):
    return regimes.transitions(ruled(spark, d)).withColumn("value", F.round("value", 9))


_PROFILE = ["share", "mean_run_bars", "mean_return_bps", "volatility_bps", "annualised_return", "annualised_volatility", "return_per_unit_risk", "positive_bar_share", *features.DESCRIPTORS]


@register("regime_profile", o.sql(
    o.bars(), _REG, _RUNS, cte("pf0", f"coalesce(ln(close) - ln({o.lag('close')}), 0) AS r", "rg"), "pr AS (SELECT symbol, regime, avg(bars) AS mean_run_bars FROM ru GROUP BY 1, 2)",
    f"""pf AS (SELECT symbol, regime, count(*) AS bars, count(*) / sum(count(*)) OVER (PARTITION BY symbol) AS share, avg(r) * 1e4 AS mean_return_bps, stddev_pop(r) * 1e4 AS volatility_bps, avg(r) * {M15_YEAR} AS annualised_return,
    stddev_pop(r) * sqrt({M15_YEAR}) AS annualised_volatility, avg(r) / nullif(stddev_pop(r), 0) * sqrt({M15_YEAR}) AS return_per_unit_risk, avg((r > 0)::INT) AS positive_bar_share, {', '.join(f'avg({x}) AS {x}' for x in features.DESCRIPTORS)} FROM pf0 GROUP BY 1, 2)""",
    f"SELECT pf.symbol, pf.regime, bars, {', '.join(map(_rounded, _PROFILE))} FROM pf JOIN pr ON pf.symbol = pr.symbol AND pf.regime = pr.regime"))
def _(spark, d):
    out = regimes.profile(ruled(spark, d), bars_per_year=M15_YEAR)
    return out.select("symbol", "regime", "bars", *(F.round(c, 6).alias(c) for c in _PROFILE))


@register("regime_stability", o.sql(
    o.bars(), _REG, "tt AS (SELECT *, ts < '2024-01-20' AS early FROM rg)", "s1 AS (SELECT symbol, regime, count(*) / sum(count(*)) OVER (PARTITION BY symbol) AS x FROM tt WHERE early GROUP BY 1, 2)",
    "s2 AS (SELECT symbol, regime, count(*) / sum(count(*)) OVER (PARTITION BY symbol) AS x FROM tt WHERE NOT early GROUP BY 1, 2)",
    "SELECT symbol, regime, round(coalesce(s1.x, 0), 9) AS train_share, round(coalesce(s2.x, 0), 9) AS test_share, round(abs(coalesce(s2.x, 0) - coalesce(s1.x, 0)), 9) AS drift FROM s1 FULL JOIN s2 USING (symbol, regime)"))
def _(spark, d):
    df = ruled(spark, d)
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    out = regimes.stability(df.where(F.col("ts") < cut), df.where(F.col("ts") >= cut))
    return out.withColumns({c: F.round(c, 9) for c in ("train_share", "test_share", "drift")})


_RPERF = [
    *_REG, *[x.replace("b AS", "b AS") for x in _PRICED], "lb AS MATERIALIZED (SELECT rg.symbol, rg.ts, rg.regime, q.strategy_return AS r, q.side FROM rg JOIN q ON rg.symbol = q.symbol AND rg.ts = q.ts)",
    "rp0 AS MATERIALIZED (SELECT *, product(1 + r) OVER (PARTITION BY symbol, regime ORDER BY ts ROWS UNBOUNDED PRECEDING) AS e FROM lb)", "rp AS MATERIALIZED (SELECT *, e / max(e) OVER (PARTITION BY symbol, regime ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM rp0)",
]


@register("regime_performance", o.sql(
    o.bars(), _RPERF,
    f"SELECT symbol, regime, count(*) AS bars, round(count(*) / sum(count(*)) OVER (PARTITION BY symbol), 9) AS share, round(avg(r) / nullif(stddev_pop(r), 0) * sqrt({M15_YEAR}), 6) AS sharpe, round(avg(r) * 1e4, 6) AS return_bps, round(min(dd), 8) AS max_drawdown, round(avg((r > 0)::INT), 9) AS hit_rate, round(avg((side <> 0)::INT), 9) AS signal_rate FROM rp GROUP BY 1, 2"))
def _(spark, d):
    rows = ruled(spark, d).select("symbol", "ts", "regime").join(crossover_result(spark, d), ["symbol", "ts"])
    rows = rows.select("symbol", "ts", "regime", "strategy_return", F.col("side").alias("prediction"), F.lit(0).alias("label"))
    out = regimes.regime_performance(rows, M15_YEAR).drop("directional_precision")
    return out.withColumns({"share": F.round("share", 9), "sharpe": F.round("sharpe", 6), "return_bps": F.round("return_bps", 6), "max_drawdown": F.round("max_drawdown", 8), "hit_rate": F.round("hit_rate", 9), "signal_rate": F.round("signal_rate", 9)})


@register("regime_gmm")
def _(spark, d):
    held = described(spark, d).persist()
    out = stored(regimes.MixtureRegimes().fit(held).posterior(held).select("symbol", "ts", "posterior"))
    held.unpersist()
    return out


# ---------------------------------------------------------------- classification

_CLS = [*_TB, *crossover("s"), "cl AS MATERIALIZED (SELECT tb.symbol, tb.ts, tb.label, s.signal::INT AS prediction FROM tb JOIN s ON tb.symbol = s.symbol AND tb.rn = s.rn)"]


def classified(spark, d):
    b = m15(spark, d)
    marked = labels.triple_barrier(b).select("symbol", "ts", "label")
    return signals.ma_crossover(b).select("symbol", "ts", F.col("signal").cast("int").alias("prediction")).join(marked, ["symbol", "ts"])


_N3 = ["short", "flat", "long"]


@register("cls_confusion", o.sql(
    o.bars(), _CLS, "ac AS (SELECT unnest([-1, 0, 1])::INT AS actual, unnest(['short', 'flat', 'long']) AS class)",
    "SELECT ac.actual, ac.class, " + ", ".join(f"count(*) FILTER (WHERE prediction = {v}) AS {n}" for v, n in zip((-1, 0, 1), _N3, strict=True)) + " FROM ac LEFT JOIN cl ON cl.label = ac.actual GROUP BY 1, 2"))
def _(spark, d):
    return classification.confusion(classified(spark, d))


_CM = [
    "cm AS (SELECT " + ", ".join(f"count(*) FILTER (WHERE label = {a} AND prediction = {p})::DOUBLE AS c{i}{j}" for i, a in enumerate((-1, 0, 1)) for j, p in enumerate((-1, 0, 1))) + " FROM cl)",
    "cs AS (SELECT *, " + ", ".join(f"c{i}0 + c{i}1 + c{i}2 AS t{i}, c0{i} + c1{i} + c2{i} AS p{i}" for i in range(3)) + " FROM cm)",
    "cp AS (SELECT *, t0 + t1 + t2 AS n, c00 + c11 + c22 AS ok, t0 * p0 + t1 * p1 + t2 * p2 AS cr, " + ", ".join(f"coalesce(c{i}{i} / nullif(p{i}, 0), 0) AS pr{i}, coalesce(c{i}{i} / nullif(t{i}, 0), 0) AS re{i}, coalesce(2 * c{i}{i} / nullif(t{i} + p{i}, 0), 0) AS f{i}" for i in range(3)) + " FROM cs)",
]
_SUM = ["accuracy", "balanced_accuracy", "matthews_corrcoef", "cohen_kappa", "macro_f1", *(f"{n}_{m}" for n in _N3 for m in ("precision", "recall", "support")), "signals_taken", "signal_rate", "directional_precision", "sign_error_rate"]


@register("cls_summary", o.sql(
    o.bars(), _CLS, _CM,
    "cz AS (SELECT ok / n AS accuracy, (re0 + re1 + re2) / ((t0 > 0)::INT + (t1 > 0)::INT + (t2 > 0)::INT) AS balanced_accuracy, coalesce((ok * n - cr) / nullif(sqrt((n * n - t0 * t0 - t1 * t1 - t2 * t2) * (n * n - p0 * p0 - p1 * p1 - p2 * p2)), 0), 0) AS matthews_corrcoef,"
    " (ok * n - cr) / nullif(n * n - cr, 0) AS cohen_kappa, (f0 + f1 + f2) / 3 AS macro_f1, " + ", ".join(f"pr{i} AS {n}_precision, re{i} AS {n}_recall, t{i} AS {n}_support" for i, n in enumerate(_N3))
    + ", p0 + p2 AS signals_taken, (p0 + p2) / n AS signal_rate, (c00 + c22) / nullif(p0 + p2, 0) AS directional_precision, (c02 + c20) / nullif(p0 + p2, 0) AS sign_error_rate FROM cp)",
    "SELECT " + ", ".join(f"round({c}, 9) AS {c}" for c in _SUM) + " FROM cz"))
def _(spark, d):
    return classification.summary(classified(spark, d)).select(*(F.round(c, 9).alias(c) for c in _SUM))


@register("cls_per_class", o.sql(o.bars(), _CLS, _CM, " UNION ALL ".join(f"SELECT '{n}' AS class, round(pr{i}, 4) AS precision, round(re{i}, 4) AS recall, round(f{i}, 4) AS f1, t{i}::BIGINT AS support FROM cp" for i, n in enumerate(_N3))))
def _(spark, d):
    return classification.per_class(classified(spark, d))


@register("cls_threshold_sweep", o.sql(
    o.bars(), _TB, _PROB, "j AS MATERIALIZED (SELECT tb.label, p.p_long, p.p_short FROM tb JOIN p ON tb.symbol = p.symbol AND tb.rn = p.rn)", "th AS (SELECT 0.34::DOUBLE + i * 0.02::DOUBLE AS t FROM range(24) x(i))",
    "z AS (SELECT t, label, CASE WHEN p_short >= t AND p_short > p_long THEN -1 WHEN p_long >= t AND p_long >= p_short THEN 1 ELSE 0 END AS s FROM j, th)",
    "SELECT round(t, 3) AS threshold, round(avg((s <> 0)::INT), 9) AS signal_rate, count(*) FILTER (WHERE s <> 0) AS signals, round(avg((label = s)::INT) FILTER (WHERE s <> 0), 9) AS directional_precision, round(avg((label <> 0 AND label = -s)::INT) FILTER (WHERE s <> 0), 9) AS sign_error_rate FROM z GROUP BY t"))
def _(spark, d):
    b = labels.triple_barrier(m15(spark, d)).select("symbol", "ts", "label").join(probabilities(spark, d), ["symbol", "ts"])
    return classification.threshold_sweep(b).withColumns({c: F.round(c, 9) for c in ("signal_rate", "directional_precision", "sign_error_rate")})


@register("cls_document_length", """
WITH m AS (SELECT median(n_chars) AS c FROM documents), j AS (SELECT l.quality, (d.n_chars >= m.c)::INT AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id, m)
SELECT count(*) AS n, round(avg((quality = p)::INT), 9) AS accuracy, round(count(*) FILTER (WHERE p = 1 AND quality = 1) / nullif(count(*) FILTER (WHERE p = 1), 0), 9) AS precision, round(count(*) FILTER (WHERE p = 1 AND quality = 1) / nullif(count(*) FILTER (WHERE quality = 1), 0), 9) AS recall FROM j""")
def _(spark, d):
    """How well a document's length tells its quality label."""
    docs, marks = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars"), spark.read.parquet(f"{d}/labels.parquet")
    rows = marks.join(docs, "doc_id").crossJoin(F.broadcast(docs.agg(F.percentile("n_chars", F.lit(0.5)).alias("c")))).withColumn("p", (F.col("n_chars") >= F.col("c")).cast("int"))
    both, pred, true = (F.count(F.when(x, 1)) for x in ((F.col("p") == 1) & (F.col("quality") == 1), F.col("p") == 1, F.col("quality") == 1))
    zero = F.lit(0)
    return rows.agg(F.count("*").alias("n"), F.round(F.avg((F.col("quality") == F.col("p")).cast("int")), 9).alias("accuracy"), F.round(both / F.nullif(pred, zero), 9).alias("precision"), F.round(both / F.nullif(true, zero), 9).alias("recall"))


# ---------------------------------------------------------------- folds, significance, studies


def _fold_sql(scheme: str) -> str:
    start = "0" if scheme == "expanding" else "greatest(0, ts0 - train)"
    return o.sql(
        o.bars(), "nn AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM b GROUP BY symbol))", "pa AS (SELECT n, greatest(1, round_even(n * 0.12, 0))::BIGINT AS test, greatest(1, round_even(n * 0.25, 0))::BIGINT AS train FROM nn)",
        "f0 AS (SELECT *, i, round_even(train + i * ((n - train) / 6.0::DOUBLE), 0)::BIGINT AS ts0 FROM pa, range(6) x(i))", f"f1 AS (SELECT *, least(n, ts0 + test) AS te, {start} AS tr0, greatest({start}, ts0 - 48) AS tr1 FROM f0)",
        "f2 AS (SELECT *, (row_number() OVER (ORDER BY i) - 1)::INT AS fold FROM f1 WHERE te - ts0 >= greatest(1, test // 2) AND tr1 - tr0 >= 100)",
        "SELECT b.symbol, fold, min(ts) FILTER (WHERE rn >= tr0 AND rn < tr1) AS train_from, max(ts) FILTER (WHERE rn >= tr0 AND rn < tr1) AS train_to, min(ts) FILTER (WHERE rn >= ts0 AND rn < te) AS test_from, max(ts) FILTER (WHERE rn >= ts0 AND rn < te) AS test_to,"
        " count(*) FILTER (WHERE rn >= tr0 AND rn < tr1) AS train_bars, count(*) FILTER (WHERE rn >= ts0 AND rn < te) AS test_bars, 48::INT AS embargo_bars FROM b JOIN f2 ON rn >= tr0 AND rn < te GROUP BY 1, 2")


for _scheme in ("expanding", "rolling"):

    def _folds(spark, d, scheme=_scheme):
        b = numbered(m15(spark, d))
        n = b.groupBy("symbol").count().agg(F.min("count")).first()[0]
        return folds.describe_folds(b, folds.walk_forward(n, scheme))

    register(f"folds_{_scheme}", _fold_sql(_scheme))(_folds)


@register("sig_psr", o.sql(
    o.bars(), _PRICED, "mo AS (SELECT symbol, count(*) AS n, avg(strategy_return) / stddev_samp(strategy_return) AS s, skewness(strategy_return) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)) AS g1, kurtosis_pop(strategy_return) AS g2 FROM q GROUP BY 1)",
    "SELECT symbol, n, round(s * sqrt(n - 1) / sqrt(1 - g1 * s + g2 / 4 * s * s), 6) AS z FROM mo"))
def _(spark, d):
    return significance.psr_z(crossover_result(spark, d), bars_per_year=M15_YEAR).withColumn("z", F.round("z", 6))


@register("sig_bootstrap")
def _(spark, d):
    """Bootstrap interval of the crossover's Sharpe ratio: 1,000 replicates in blocks of 20 days on average."""
    return significance.bootstrap_interval(crossover_result(spark, d).select("symbol", "ts", "strategy_return"), bars_per_year=M15_YEAR)


def _rule_sharpes(names) -> list[str]:
    """CTE `sh`: (symbol, rule, sharpe) of several rules, each in a subquery of its own."""
    parts = []
    for n in names:
        inner = o.sql(o.bars(), priced(_RULE_SQL[n]), f"SELECT symbol, '{n}' AS rule, avg(strategy_return) / nullif(stddev_pop(strategy_return), 0) * sqrt({M15_YEAR}) AS sharpe FROM q GROUP BY 1")
        parts.append(f"SELECT * FROM ({inner})")
    return [f"sh AS MATERIALIZED ({' UNION ALL '.join(parts)})"]


def rule_sharpes(spark, d, names) -> DataFrame:
    priced_rules = backtest.run(signals.stacked(m15(spark, d), names), bars_per_year=M15_YEAR)
    found = significance.sharpe(priced_rules, M15_YEAR)
    return found.select(signals.stacked_rule("symbol").alias("rule"), signals.stacked_symbol("symbol").alias("symbol"), "sharpe")


_TREATED = ["ma_crossover", "rsi_mean_reversion", "donchian_breakout"]


@register("study_baselines", o.sql(_rule_sharpes(list(_RULE_SQL)), "SELECT symbol, rule, round(sharpe, 6) AS sharpe FROM sh"))
def _(spark, d):
    """Every rule through the same engine."""
    return rule_sharpes(spark, d, signals.RULES).withColumn("sharpe", F.round("sharpe", 6))


@register("study_compare_pairs", o.sql(
    _rule_sharpes(["buy_and_hold", *_TREATED]), "co AS (SELECT symbol, max(sharpe) AS control FROM sh WHERE rule = 'buy_and_hold' GROUP BY 1)",
    "SELECT rule, count(*) AS pairs, round(avg(sharpe - control), 6) AS mean_improvement, round(max(sharpe - control), 6) AS best_improvement, arg_max(sh.symbol, sharpe - control) AS best_symbol, count(*) FILTER (WHERE sharpe > control) AS wins FROM sh JOIN co ON sh.symbol = co.symbol WHERE rule <> 'buy_and_hold' GROUP BY 1"))
def _(spark, d):
    """Treated runs against the best control run of the same symbol."""
    runs = rule_sharpes(spark, d, ["buy_and_hold", *_TREATED])
    control = runs.where("rule = 'buy_and_hold'").groupBy("symbol").agg(F.max("sharpe").alias("control"))
    gain = F.col("sharpe") - F.col("control")
    return runs.where("rule <> 'buy_and_hold'").join(control, "symbol").groupBy("rule").agg(
        F.count("*").alias("pairs"), F.round(F.avg(gain), 6).alias("mean_improvement"), F.round(F.max(gain), 6).alias("best_improvement"), F.max_by("symbol", gain).alias("best_symbol"), F.count(F.when(gain > 0, 1)).alias("wins")
    )


@register("study_holdout_sign", o.sql(
    _rule_sharpes(["ma_crossover"]), "hs AS (SELECT count(*) AS n, count(*) FILTER (WHERE sharpe > 0) AS k, median(sharpe) AS md, avg(sharpe) AS mn FROM sh)",
    "SELECT n AS instruments, k AS positive, round(md, 6) AS median_sharpe, round(mn, 6) AS mean_sharpe, round((SELECT sum(factorial(n::INT)::DOUBLE / (factorial(i::INT)::DOUBLE * factorial((n - i)::INT)::DOUBLE)) FROM range(0, 100) x(i) WHERE i BETWEEN hs.k AND hs.n) / power(2, n), 9)::DOUBLE AS p_value FROM hs"))
def _(spark, d):
    """Across instruments: how many Sharpe ratios are positive, and how likely that is by chance."""
    m = rule_sharpes(spark, d, ["ma_crossover"]).agg(F.count("*").alias("n"), F.count(F.when(F.col("sharpe") > 0, 1)).alias("k"), F.percentile("sharpe", F.lit(0.5)).alias("md"), F.avg("sharpe").alias("mn"))
    ways = F.aggregate(F.sequence(F.col("k"), F.col("n")), F.lit(0.0), lambda a, i: a + F.exp(_log_factorial("n") - _log_factorial(i) - _log_factorial(F.col("n") - i)))
    return m.select(F.col("n").alias("instruments"), F.col("k").alias("positive"), F.round("md", 6).alias("median_sharpe"), F.round("mn", 6).alias("mean_sharpe"), F.round(ways / F.pow(F.lit(2.0), "n"), 9).alias("p_value"))


def _log_factorial(n):
    n = F.col(n) if isinstance(n, str) else n
    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1).cast("long"))), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: hourly bars of each event type, a moving-average crossover, its metrics."""
    result = backtest.run(signals.ma_crossover(src.from_events(spark, sf_dir, "H1", o.LEVEL), 10, 30), hold=6)
    return metrics.performance(result, src.bars_per_year("H1"), backtest.trades(result))


from . import study_queries  # noqa: E402, F401  registers its queries here
