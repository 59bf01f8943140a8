"""Bars: symbol, ts, open, high, low, close, volume. From events, tables and finer bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import series

COLUMNS = ["symbol", "ts", "open", "high", "low", "close", "volume"]

# Bars in a year of each timeframe, fastest first.
BARS_PER_YEAR = {"M1": 374_400, "M5": 74_880, "M15": 24_960, "M30": 12_480, "H1": 6_240, "H4": 1_560, "D1": 260, "W1": 52, "MN1": 12}
# Widths of the timeframes that are plain intervals.
WIDTHS = {"M1": "1 minute", "M5": "5 minutes", "M15": "15 minutes", "M30": "30 minutes", "H1": "1 hour", "H4": "4 hours", "D1": "1 day"}


def bars_per_year(timeframe: str) -> int:
    return BARS_PER_YEAR.get(timeframe.upper(), 6_240)


def bucket(timeframe: str, ts: str = "ts"):
    """Start of the bar that holds ts; a week is labelled by the Sunday that ends it, a month by its first day."""
    tf = timeframe.upper()
    if tf == "W1":
        return (F.date_trunc("week", ts) + F.expr("INTERVAL 6 DAYS")).cast("timestamp_ntz")
    if tf == "MN1":
        return F.date_trunc("month", ts).cast("timestamp_ntz")
    return F.window(ts, WIDTHS[tf])["start"].cast("timestamp_ntz")


def valid(df: DataFrame) -> DataFrame:
    """Bars with a high not under the low, positive prices and finite values."""
    finite = None
    for name in COLUMNS[2:]:
        ok = F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) < float("inf"))
        finite = ok if finite is None else finite & ok
    prices = (F.col("open") > 0) & (F.col("high") > 0) & (F.col("low") > 0) & (F.col("close") > 0)
    return df.where(finite & prices & (F.col("high") >= F.col("low")))


def cleaned(rows: DataFrame, *order: str) -> DataFrame:
    """Valid bars; of those with equal symbol and time the last by the given columns stays, found by an aggregation that is combined before the shuffle."""
    last = rows.where("ts IS NOT NULL").groupBy("symbol", "ts").agg(F.max_by(F.struct(*COLUMNS[2:]), F.struct(*order)).alias("_b"))
    return valid(last.select("symbol", "ts", "_b.*"))


def resample(bars: DataFrame, timeframe: str) -> DataFrame:
    """Coarser bars: first open, highest high, lowest low, last close, volume summed."""
    grouped = bars.groupBy("symbol", bucket(timeframe).alias("bar"))
    out = grouped.agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return out.withColumnRenamed("bar", "ts").select(*COLUMNS)


def tick_bars(ticks: DataFrame, timeframe: str, symbol, price, order, volume=None) -> DataFrame:
    """Bars of ticks with a ts: open and close by `order` (a unique key), volume as count or sum."""
    rows = ticks.select(symbol.alias("symbol"), "ts", price.alias("p"), order.alias("k"), (F.lit(1.0) if volume is None else volume).alias("v"))
    grouped = rows.groupBy("symbol", bucket(timeframe).alias("bar"))
    out = grouped.agg(F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.sum("v").alias("volume"))
    return valid(out.withColumnRenamed("bar", "ts").select(*COLUMNS))


def from_events(spark: SparkSession, sf_dir: str, timeframe: str = "M15", level: float = 0.0) -> DataFrame:
    """One symbol for each event type; values are movements about `level`."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return tick_bars(events, timeframe, F.col("event_type"), F.col("value") + level, F.struct("ts", "event_id"))


def from_orders(spark: SparkSession, sf_dir: str, timeframe: str = "D1") -> DataFrame:
    """One symbol for each order priority."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("ts", F.col("o_orderdate"))
    return tick_bars(orders, timeframe, F.col("o_orderpriority"), F.col("o_totalprice"), F.struct("ts", "o_orderkey"))


def from_lineitem(spark: SparkSession, sf_dir: str, timeframe: str = "D1") -> DataFrame:
    """One symbol for each return flag; volume is the quantity."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("ts", F.col("l_shipdate"))
    return tick_bars(lines, timeframe, F.col("l_returnflag"), F.col("l_extendedprice"), F.struct("ts", "l_orderkey", "l_linenumber"), F.col("l_quantity"))


def between(bars: DataFrame, start=None, end=None, last: int | None = None) -> DataFrame:
    """Bars of an inclusive window, and of these the last N of each symbol."""
    if start is not None:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        bars = bars.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    if last is not None:
        from pyspark.sql import Window

        bars = bars.withColumn("_back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("_back") <= last).drop("_back")
    return bars


def describe(bars: DataFrame) -> DataFrame:
    """One row for each symbol: bars, range, median gap, share of wide gaps, log-return moments."""
    w = series()
    rows = bars.withColumn("gap", (F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(w).cast("timestamp"))).cast("double"))
    rows = rows.withColumn("r", F.log("close") - F.log(F.lag("close").over(w))).withColumn("width", F.col("high") / F.col("low") - 1)
    n = F.count("r")
    first = rows.groupBy("symbol").agg(
        F.count("*").alias("bars"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.percentile("gap", F.lit(0.5)).alias("median_gap"), (F.avg("r") * 1e4).alias("mean_return_bps"),
        (F.stddev_samp("r") * 1e4).alias("volatility_bps"), (F.skewness("r") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))).alias("skew"),
        (((n + 1) * F.kurtosis("r") + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0))).alias("kurtosis"), (F.max("width") * 100).alias("max_range_pct"),
    )
    wide = rows.join(F.broadcast(first.select("symbol", "median_gap")), "symbol").groupBy("symbol").agg((F.count(F.when(F.col("gap") > 1.5 * F.col("median_gap"), 1)) / F.count("*") * 100).alias("missing_pct"))
    return first.join(wide, "symbol")
