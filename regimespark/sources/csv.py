"""Bars from CSV files, and a catalogue of the files from their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bars import BARS_PER_YEAR, COLUMNS, between, valid

# Header names (lower case) and the columns they stand for.
ALIASES = {
    "open": "open", "o": "open", "high": "high", "h": "high", "low": "low", "l": "low", "close": "close", "c": "close", "adj close": "close", "price": "close",
    "volume": "volume", "tick_volume": "volume", "tickvolume": "volume", "vol": "volume", "time": "timestamp", "date": "timestamp", "datetime": "timestamp", "timestamp": "timestamp",
}
# Time formats that are tried in turn.
FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy.MM.dd HH:mm:ss", "yyyy.MM.dd HH:mm", "yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy HH:mm", "yyyy-MM-dd", "yyyy.MM.dd", "yyyyMMdd"]
# Fixed value: the form of file names; symbol_timeframe, perhaps with first and last day; a file, or a folder that Spark has written.
FILE_NAME = r"(?i)(?:^|/)([A-Za-z0-9]+)_([A-Za-z0-9]+)(?:_(\d{8})_(\d{8}))?[^/]*\.csv(?:/part-[^/]*\.csv)?$"


def normalised(df: DataFrame) -> DataFrame:
    """Known columns under their canonical names; of several for one, the first. Without a time column the first column is taken for it."""
    picked: dict[str, str] = {}
    names = [c for c in df.columns if c not in ("_file", "_row")]
    for c in names:
        name = ALIASES.get(c.strip().lower())
        if name and name not in picked and not c.strip().lower().startswith("unnamed"):
            picked[name] = c
    if "timestamp" not in picked and names:
        picked["timestamp"] = names[0]
    missing = {"open", "high", "low", "close"} - set(picked)
    if missing:
        raise ValueError(f"no column for {sorted(missing)} among {names}")
    cols = [F.col(f"`{c}`").alias(n) for n, c in picked.items()]
    return df.select(*[c for c in df.columns if c in ("_file", "_row")], *cols, *([] if "volume" in picked else [F.lit("1.0").alias("volume")]))


def parsed_time(column: str, milliseconds):
    """A time from epoch seconds or milliseconds, or from text in any of FORMATS; NULL if it is none."""
    number = F.expr(f"try_cast({column} AS DOUBLE)")
    micros = F.when(milliseconds, number * 1e3).otherwise(number * 1e6).cast("long")
    texts = [F.try_to_timestamp(column, F.lit(f)) for f in FORMATS]
    return F.coalesce(F.timestamp_micros(micros), *texts).cast("timestamp_ntz")


def read_ohlcv(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Cleaned bars of CSV files: parsed, valid, of equal times the last in the file. The symbol defaults to that of the file name."""
    raw = spark.read.option("header", True).csv(path).withColumns({"_file": F.col("_metadata.file_name"), "_row": F.monotonically_increasing_id()})
    rows = normalised(raw)
    rows = rows.withColumn("symbol", F.lit(symbol) if symbol else F.upper(F.regexp_extract("_file", FILE_NAME, 1)))
    middle = rows.groupBy("symbol").agg((F.percentile(F.expr("try_cast(timestamp AS DOUBLE)"), F.lit(0.5)) > 1e11).alias("_ms"))
    rows = rows.join(F.broadcast(middle), "symbol")
    rows = rows.withColumn("ts", parsed_time("timestamp", F.coalesce("_ms", F.lit(False)))).withColumns({c: F.expr(f"try_cast({c} AS DOUBLE)") for c in COLUMNS[2:]})
    last = Window.partitionBy("symbol", "ts").orderBy(F.desc("_file"), F.desc("_row"))
    rows = rows.where("ts IS NOT NULL").withColumn("_k", F.row_number().over(last)).where("_k = 1")
    return valid(rows.select(*COLUMNS))


def catalogue(spark: SparkSession, directories: list[str]) -> DataFrame:
    """(symbol, timeframe, start, end, path, size_mb) of the CSV files whose names tell them; the first directory wins."""
    out = None
    for rank, folder in enumerate(directories):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(folder).select("path", "length", F.lit(rank).alias("rank"))
        out = files if out is None else out.unionByName(files)
    parts = [F.regexp_extract("path", FILE_NAME, i) for i in (1, 2, 3, 4)]
    rows = out.select("path", "length", "rank", F.upper(parts[0]).alias("symbol"), F.upper(parts[1]).alias("timeframe"), F.try_to_date(parts[2], "yyyyMMdd").alias("start"), F.try_to_date(parts[3], "yyyyMMdd").alias("end"))
    rows = rows.where(F.col("timeframe").isin(list(BARS_PER_YEAR)) & (F.col("symbol") != ""))
    best = Window.partitionBy("symbol", "timeframe").orderBy("rank", "path")
    return rows.withColumn("_k", F.row_number().over(best)).where("_k = 1").select("symbol", "timeframe", "start", "end", "path", F.round(F.col("length") / 1048576, 1).alias("size_mb"))


def symbols(table: DataFrame) -> list[str]:
    return [r.symbol for r in table.select("symbol").distinct().orderBy("symbol").collect()]


def timeframes(table: DataFrame, symbol: str) -> list[str]:
    """Fastest first."""
    order = list(BARS_PER_YEAR)
    return sorted((r.timeframe for r in table.where(F.col("symbol") == symbol.upper()).select("timeframe").distinct().collect()), key=order.index)


def find(table: DataFrame, symbol: str, timeframe: str):
    """The catalogue row of a dataset; the error names what there is."""
    row = table.where((F.col("symbol") == symbol.upper()) & (F.col("timeframe") == timeframe.upper())).first()
    if row is None:
        raise LookupError(f"no dataset {symbol} {timeframe}; there are {symbols(table)}")
    return row


def load(spark: SparkSession, directories: list[str], symbol: str, timeframe: str, start=None, end=None, last: int | None = None) -> DataFrame:
    """Bars of one dataset in an inclusive window."""
    bars = between(read_ohlcv(spark, find(catalogue(spark, directories), symbol, timeframe).path, symbol.upper()), start, end, last)
    if bars.isEmpty():
        raise ValueError(f"{symbol} {timeframe}: no bars between {start} and {end}")
    return bars


def export(bars: DataFrame, folder: str, timeframe: str, last: int | None = None) -> list[str]:
    """One CSV folder for each symbol, named by symbol, timeframe and range, prices with six decimals; older ones of the same symbol and timeframe go."""
    bars = between(bars, last=last)
    spark, written = bars.sparkSession, []
    fs, root = hadoop(spark, folder)
    for r in bars.groupBy("symbol").agg(F.date_format(F.min("ts"), "yyyyMMdd").alias("a"), F.date_format(F.max("ts"), "yyyyMMdd").alias("z")).collect():
        if fs.exists(root):
            for old in fs.listStatus(root):
                if old.getPath().getName().startswith(f"{r.symbol}_{timeframe}_"):
                    fs.delete(old.getPath(), True)
        path = f"{folder}/{r.symbol}_{timeframe}_{r.a}_{r.z}.csv"
        rows = bars.where(F.col("symbol") == r.symbol).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), *(F.format_string("%.6f", c).alias(c) for c in COLUMNS[2:]))
        rows.coalesce(1).sortWithinPartitions("time").write.mode("overwrite").option("header", True).csv(path)
        written.append(path)
    return written


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a folder."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where
