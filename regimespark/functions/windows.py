"""Window kernels on bars keyed by `symbol` and ordered by `ts`.

Rolling values exist only where the frame is full, as NULL-skipping Spark frames would
otherwise start early. Exponential means are exact and need no UDF: see `ewm`.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["symbol"]


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def series(keys: list[str] = KEYS):
    return Window.partitionBy(*keys).orderBy("ts")


def running(keys: list[str] = KEYS):
    return series(keys).rowsBetween(Window.unboundedPreceding, 0)


def trailing(k: int, skip: int = 0):
    """The last k rows, or the k rows that end `skip` rows ago."""
    return series().rowsBetween(-(k - 1) - skip, -skip)


def full(value: Column, x: Column | str, k: int, skip: int = 0) -> Column:
    """value where all k rows of the frame have x."""
    return F.when(F.count(c(x)).over(trailing(k, skip)) == k, value)


def rolling(f, x: Column | str, k: int, skip: int = 0) -> Column:
    return full(f(c(x)).over(trailing(k, skip)), x, k, skip)


def lag(x: Column | str, k: int = 1) -> Column:
    return F.lag(c(x), k).over(series())


def lead(x: Column | str, k: int = 1) -> Column:
    return F.lead(c(x), k).over(series())


def ffill(x: Column | str) -> Column:
    return F.last(c(x), ignorenulls=True).over(running())


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is 0."""
    return c(a) / F.nullif(c(b), F.lit(0.0))


def numbered(df: DataFrame) -> DataFrame:
    """rn = 0, 1, ... within each symbol."""
    return df.withColumn("rn", F.row_number().over(series()) - 1)


def framed(f, k: int):
    """A column function of collect_list over trailing(k): f takes full frames as rows of a matrix, one call a batch; NULL where the frame is not full or f gives NaN.

    A sliding Spark aggregate is updated k times a row in the JVM, which for higher moments takes far longer than collecting the frame.
    """

    @F.arrow_udf("double")
    def kernel(seen: pa.Array) -> pa.Array:
        there = pc.equal(pc.list_value_length(seen), k).fill_null(False)
        frames = seen.filter(there).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        out = np.full(len(seen), np.nan)
        if len(frames):
            out[there.to_numpy(zero_copy_only=False)] = f(frames)
        return pa.array(out, pa.float64(), from_pandas=True)

    return kernel


def frame(x: Column | str, k: int) -> Column:
    return F.collect_list(c(x)).over(trailing(k))


def _moments(v: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    """The standardised moment of each row, and which rows are constant."""
    with np.errstate(invalid="ignore", divide="ignore"):
        d = v - v.mean(axis=1, keepdims=True)
        square = d * d
        m2 = square.mean(axis=1)
        return (square * d if power == 3 else square * square).mean(axis=1) / m2 ** (power / 2), v.max(axis=1) == v.min(axis=1)


def rolling_skew(x: Column | str, k: int, seen: Column | str | None = None) -> Column:
    """Bias-corrected skewness (G1); 0 on a constant window. `seen` is frame(x, k), where it is a column already."""

    def skew(v):
        g, flat = _moments(v, 3)
        return np.where(flat, 0.0, np.nan_to_num(g, nan=0.0) * (math.sqrt(k * (k - 1)) / (k - 2)))

    return framed(skew, k)(frame(x, k) if seen is None else c(seen))


def rolling_kurt(x: Column | str, k: int, seen: Column | str | None = None) -> Column:
    """Bias-corrected excess kurtosis (G2); -3 on a constant window."""

    def kurt(v):
        g, flat = _moments(v, 4)
        return np.where(flat, -3.0, ((k + 1) * (g - 3) + 6) * (k - 1) / ((k - 2) * (k - 3)))

    return framed(kurt, k)(frame(x, k) if seen is None else c(seen))


def rolling_autocorr(x: Column | str, k: int, seen: Column | str | None = None) -> Column:
    """Pearson correlation of the k - 1 pairs of neighbours in the last k rows; NULL on constant windows."""

    def corr(v):
        x, y = v[:, 1:], v[:, :-1]
        dx, dy = (u - u.mean(axis=1, keepdims=True) for u in (x, y))
        flat = (x.max(axis=1) == x.min(axis=1)) | (y.max(axis=1) == y.min(axis=1))
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(flat, np.nan, (dx * dy).mean(axis=1) / np.sqrt((dx * dx).mean(axis=1) * (dy * dy).mean(axis=1)))

    return framed(corr, k)(frame(x, k) if seen is None else c(seen))


def zscore(x: Column | str, k: int) -> Column:
    w = trailing(k)
    return full(ratio(c(x) - F.avg(c(x)).over(w), F.stddev_pop(c(x)).over(w)), x, k)


def percent_rank(x: Column | str, k: int) -> Column:
    """Average-tie rank of the last value among the last k, divided by k. `x` must be a column of the frame."""

    def rank(v):
        # NaN equals NaN and is the greatest, as in Spark
        last, none = v[:, -1:], np.isnan(v)
        less, same = (v < last) | (~none & none[:, -1:]), (v == last) | (none & none[:, -1:])
        return (less.sum(axis=1) * 2 + same.sum(axis=1) + 1) / 2.0 / k

    return framed(rank, k)(frame(x, k))


#: Rows of an exponential block; smoothing above FAST uses shorter ones, lest powers overflow.
BLOCK, FAST = 3000, 0.2


def ewm(df: DataFrame, specs: Iterable[tuple[str, str, float, int]]) -> DataFrame:
    """Add exponential means y[t] = (1 - a) y[t-1] + a x[t], seeded by the first x.

    specs: (name, column, a, least number of values before the first result). Each block of
    rows is a weighted running sum, to which the end of the block before is carried over; what
    lies two blocks back weighs under 1e-13. Sums run over distances from the first value, which
    keeps their rounding errors small. All specs share one sort by block. NULLs may only lead the
    series, as in all indicators here.
    """
    specs = [s for s in specs if s[0] not in df.columns]
    if not specs:
        return df
    sizes = {name: BLOCK if a <= FAST else max(8, int(37 / -math.log(1 - a))) for name, _, a, _ in specs}
    kept = df.columns
    df = df if "rn" in kept else numbered(df)
    columns = list(dict.fromkeys(s[1] for s in specs))
    df = df.withColumns({f"_seed_{x}": F.min(F.when(F.col(x).isNotNull(), F.col("rn"))).over(running()) for x in columns} | {f"_from_{x}": F.first(x, ignorenulls=True).over(running()) for x in columns})
    local = {}
    for name, x, a, _ in specs:
        pos, log_b = F.col("rn") % sizes[name], math.log(1 - a)
        weight = F.when(F.col("rn") == F.col(f"_seed_{x}"), 1.0).otherwise(a)
        block = Window.partitionBy(*KEYS, F.floor(F.col("rn") / sizes[name])).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        local[f"_loc_{name}"] = F.sum((F.col(x) - F.col(f"_from_{x}")) * weight * F.exp(-log_b * pos)).over(block) * F.exp(log_b * pos)
    df = df.withColumns(local)
    past = series().rowsBetween(Window.unboundedPreceding, -1)
    ends = {f"_end_{n}": F.last(F.when(F.col("rn") % sizes[n] == sizes[n] - 1, F.col(f"_loc_{n}")), ignorenulls=True).over(past) for n, *_ in specs}
    df = df.withColumns(ends)
    out = {}
    for name, x, a, least in specs:
        carried = F.coalesce(F.col(f"_end_{name}"), F.lit(0.0)) * F.exp(math.log(1 - a) * (F.col("rn") % sizes[name] + 1))
        ready = F.col("rn") - F.col(f"_seed_{x}") + 1 >= max(1, least)
        out[name] = F.when(ready, F.coalesce(F.col(f"_loc_{name}"), F.lit(0.0)) + carried + F.col(f"_from_{x}"))
    return df.withColumns(out).select(*kept, *out)


def span(n: int) -> float:
    return 2.0 / (n + 1)
