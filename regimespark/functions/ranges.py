"""Long series cut into time ranges, so that one symbol's bars go through many tasks.

Rows are numbered by one sort by (symbol, time) and counts of its partitions; a range is `size`
consecutive rows of a symbol. What looks back or ahead a bounded number of rows is worked out by
range, with that many rows of its neighbours beside it (`in_ranges`, `with_halo`). What runs from the first row
on is worked out in each range, and then joined with what the ranges before it add up to
(`running`): sums, products, maxima, last values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

#: Rows after which the slowest exponential mean (a weight of 1 in 200) has forgotten its start to 1e-13.
HALO = 6_000
KEY = ["symbol", "range"]


def numbered_apart(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """df with rn = 0, 1, ... within each symbol by ts, no task having a whole symbol."""
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, "symbol", "ts").sortWithinPartitions("symbol", "ts").withColumn("_at", F.monotonically_increasing_id())
    rows = stored(rows.withColumn("_part", F.shiftright("_at", 33)))
    by = Window.partitionBy("symbol").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each symbol and sorted partition that has it
    starts = rows.groupBy("symbol", "_part").agg(F.count("*").alias("_c"), F.min("_at").alias("_low"))
    starts = starts.select("symbol", "_part", (F.coalesce(F.sum("_c").over(by), F.lit(0)) - F.col("_low")).alias("_add"))
    return rows.join(starts, ["symbol", "_part"]).withColumn("rn", F.col("_at") + F.col("_add")).drop("_at", "_part", "_add")


def with_halo(rows: DataFrame, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Rows (with rn) beside `range` and whether they are of its `core`, and once more as halo of the ranges up to `before` rows later and `after` rows earlier."""
    if max(before, after) > size:
        raise ValueError(f"ranges of {size} rows are too short for {max(before, after)} rows of their neighbours")
    own, place = F.expr(f"rn div {size}"), F.col("rn") % size
    ranges = F.array_compact(F.array(own, F.when(place >= size - before, own + 1), F.when((place < after) & (own > 0), own - 1)))
    return rows.withColumn("range", F.explode(ranges)).withColumn("core", F.col("range") == own)


def in_ranges(df: DataFrame, work: Callable[[DataFrame], DataFrame], size: int, halo: int = HALO) -> DataFrame:
    """work(df) by ranges, for work by symbol whose rows depend on at most `halo` rows before them.

    Ranges take the place of symbols in work. A value carried forward is found if it is at most
    `halo` rows old.
    """
    rows = with_halo(numbered_apart(df), size, halo)
    key = F.concat_ws("|", "range", "symbol")
    first = rows.where("core").groupBy(key.alias("symbol")).agg(F.min("ts").alias("_first"))
    done = work(rows.withColumn("symbol", key).drop("range", "core", "rn"))
    kept = done.join(first, "symbol").where(F.col("ts") >= F.col("_first")).drop("_first")
    return kept.withColumn("symbol", F.regexp_replace("symbol", r"^[0-9]+\|", ""))


#: How a range's own value and what came before it give the running value.
_JOINS = {
    "sum": (F.sum, lambda own, past: F.coalesce(own + past, own, past)),
    "product": (F.product, lambda own, past: F.coalesce(own * past, own, past)),
    "max": (F.max, lambda own, past: F.greatest(own, past)),
    "last": (lambda x: F.last(x, ignorenulls=True), lambda own, past: F.coalesce(own, past)),
}


def running(rows: DataFrame, specs: Iterable[tuple[str, str, str]]) -> DataFrame:
    """rows (symbol, range, rn, ...) with running values of a symbol: (name, sum | product | max | last, column)."""
    specs = list(specs)
    local = Window.partitionBy(*KEY).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_own_{n}": _JOINS[kind][0](F.col(x)).over(local) for n, kind, x in specs})
    past = Window.partitionBy("symbol").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range; its last row has the range's own values
    ends = rows.groupBy(*KEY).agg(*(F.max_by(f"_own_{n}", "rn").alias(f"_end_{n}") for n, _, _ in specs))
    ends = ends.select(*KEY, *(_JOINS[kind][0](F.col(f"_end_{n}")).over(past).alias(f"_past_{n}") for n, kind, _ in specs))
    out = rows.join(ends, KEY)
    values = {n: _JOINS[kind][1](F.col(f"_own_{n}"), F.col(f"_past_{n}")) for n, kind, _ in specs}
    return out.withColumns(values).drop(*(f"_{p}_{n}" for p in ("own", "past") for n, _, _ in specs))
