"""Series cut into ranges against the same work on whole series."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from regimespark.functions import ranges
from regimespark.functions.windows import numbered
from regimespark.operators import backtest, features, signals

START = dt.datetime(2024, 1, 1)


def table(spark, sizes, seed=0, levels=(-1.0, 0.0, 1.0)):
    rng, rows = np.random.default_rng(seed), []
    for s, n in sizes.items():
        price = 100 * np.exp(np.cumsum(rng.normal(size=n + 1) * 0.01))
        x = rng.choice(levels, n).repeat(rng.integers(1, 9, n))[:n]
        rows += [(s, START + dt.timedelta(minutes=15 * i), float(price[i]), float(price[i : i + 2].max() * 1.002), float(price[i : i + 2].min() * 0.998), float(price[i + 1]), float(rng.integers(1, 50)), float(x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, signal double").repartition(5)


SIZES = {"A": 700, "B": 130, "C": 1, "D": 64}


@pytest.mark.parametrize("partitions", [1, 3, 20])
def test_numbers(spark, partitions):
    df = table(spark, SIZES)
    assert ranges.numbered_apart(df, partitions).select("symbol", "ts", "rn").exceptAll(numbered(df).select("symbol", "ts", F.col("rn").cast("long"))).count() == 0


def close(a, b, keys, tolerance=1e-12):
    a, b = (x.orderBy(*keys).toPandas() for x in (a, b))
    assert list(a.columns) == list(b.columns) and len(a) == len(b) and (a[keys] == b[keys]).all().all()
    for c in a.columns:
        if c not in keys:
            x, y = a[c].to_numpy(float), b[c].to_numpy(float)
            assert (np.isnan(x) == np.isnan(y)).all(), c
            assert np.nanmax(np.abs(x - y) / np.maximum(1, np.abs(y)), initial=0) <= tolerance, c


@pytest.mark.parametrize("bars", [2, 7, 24, 90])
@pytest.mark.parametrize("size", [5, 64, 1000])
def test_min_holding(spark, bars, size):
    df = table(spark, SIZES, bars, (-1.0, 0.0, 0.5, 1.0))
    rows = ranges.numbered_apart(df).withColumn("range", F.expr(f"rn div {size}"))
    got = signals.min_holding_in_ranges(rows, bars).select("symbol", "ts", "signal")
    close(got, signals.min_holding(df, bars).select("symbol", "ts", "signal"), ["symbol", "ts"], 0)


@pytest.mark.parametrize("seed", range(40))
def test_maps_of_ranges_compose(seed):
    """What the maps say leaves a range is what a walk over its bars leaves, for every position that may enter."""
    rng = np.random.default_rng(seed)
    bars, x = int(rng.integers(2, 9)), rng.choice([-1.0, 0.0, 1.0, 2.0], int(rng.integers(1, 30))).repeat(rng.integers(1, 4))
    table_ = [v.tolist() for v in signals._range_map(x, bars)]
    for now in (-1.0, 0.0, 1.0, 3.0):
        for free in range(bars + 1) if now else [0]:
            at, till = now, free
            for i, s in enumerate(x):
                if s != at and (at == 0 or i >= till):
                    at, till = s, i + bars
            left = 0 if at == 0 else max(0, till - len(x))
            assert signals._through(now, free, len(x), *table_) == (at, left)


@pytest.mark.parametrize("options", [{}, {"hours": [3, 4, 9], "hold": 5}, {"target": 0.5, "target_window": 20, "bars_per_year": 24960}, {"delay": 3, "hold": 1, "size": 0.5}, {"delay": 0}])
def test_pricing(spark, options):
    df = table(spark, SIZES, 3)
    close(backtest.run_in_ranges(df, 60, **options), backtest.run(df, **options), ["symbol", "ts"])


def test_features(spark):
    df = table(spark, {"A": 14_000, "B": 400}, 5).drop("signal")
    close(features.build_features_in_ranges(df, 7000), features.build_features(df), ["symbol", "ts"], 1e-8)


def test_short_ranges_are_refused(spark):
    with pytest.raises(ValueError, match="too short"):
        ranges.with_halo(spark.range(3).withColumnRenamed("id", "rn"), 5, 6)


def test_gaps_in_ranges_are_filled_from_whole_symbols(spark, monkeypatch):
    """A value carried over more bars than a halo keeps its rows, as in whole symbols."""
    monkeypatch.setattr(features, "HALO", 300)
    rng = np.random.default_rng(5)
    close = 100 * np.exp(np.cumsum(rng.normal(size=1500) * 0.001))
    close[400:1100] = close[399]  # autocorrelation is unknown for longer than a halo
    rows = [("A", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=15 * i), *[float(c)] * 4, 1.0) for i, c in enumerate(close)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    found = [features.build_features(df, ("returns", "session"), 120, range_rows=size).select("ts", "ret_autocorr_50", "ret_skew_50", "ret_3_norm").orderBy("ts").collect() for size in (None, 300)]
    assert [r.ts for r in found[0]] == [r.ts for r in found[1]] and len(found[0]) > 500
    assert np.allclose([r[1:] for r in found[0]], [r[1:] for r in found[1]], rtol=0, atol=1e-8)
