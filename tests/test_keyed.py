"""Logistic regressions of all symbols and folds at once against single ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regimespark.operators import folds, keyed, models

INPUTS = ["a", "b", "c"]


def data(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 10, 0.1] + [0, 5, 0]
    s = x[:, 0] + 0.1 * (x[:, 1] - 5) + rng.normal(size=n)
    return x, np.where(s > 0.8, 1, np.where(s < -0.5, -1, 0))


@pytest.fixture(scope="module")
def rows(spark):
    out = []
    for name, n, seed in (("A", 1500, 1), ("B", 900, 2), ("tiny", 50, 3)):
        x, y = data(n, seed)
        out += [(name, i, *map(float, r), int(c) if i < n - 20 else None) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(out, "symbol string, rn long, a double, b double, c double, label int").repartition(4).cache()


@pytest.mark.parametrize("scheme", ["expanding", "rolling"])
@pytest.mark.parametrize("n_folds,test_size,min_train", [(6, 0.12, 0.25), (1, 0.2, 0.5), (9, 0.3, 0.2)])
def test_bounds_are_those_of_the_driver(rows, scheme, n_folds, test_size, min_train):
    got = {}
    for r in keyed.fold_bounds(rows, scheme, n_folds, test_size, min_train, 48).collect():
        got.setdefault(r.symbol, []).append((r.fold, r.train_start, r.train_stop, r.test_start, r.test_end))
    for name, n in (("A", 1500), ("B", 900)):
        want = [(f.index, f.train_start, f.train_stop, f.test_start, f.test_end) for f in folds.walk_forward(n, scheme, n_folds, test_size, min_train, 48)]
        assert sorted(got[name]) == want
    assert "tiny" not in got


def test_equals_single_fits(spark, rows, monkeypatch):
    monkeypatch.setattr(keyed, "BLOCK", 128)
    bounds = keyed.fold_bounds(rows, n_folds=3, embargo=10).cache()
    packed, states = keyed.fit(rows, bounds, INPUTS, c=0.5)
    got = {(r.symbol, r.fold, r.rn): (r.p_short, r.p_flat, r.p_long) for r in keyed.predict(packed, states, 3).collect()}
    want = {}
    for b in bounds.where("symbol = 'A' OR fold = 1").collect():
        own = rows.where(F.col("symbol") == b.symbol)
        train = own.where((F.col("rn") >= b.train_start) & (F.col("rn") < b.train_stop) & F.col("label").isNotNull())
        learner = models.Learner("logistic", {"C": 0.5, "maxIter": 5000}).fit(train, INPUTS)
        test = own.where((F.col("rn") >= b.test_start) & (F.col("rn") < b.test_end))
        want |= {(b.symbol, b.fold, r.rn): (r.p_short, r.p_flat, r.p_long) for r in learner.predict_proba(test).collect()}
    assert len(want) > 500 and all(np.allclose(got[k], v, atol=1e-6) for k, v in want.items())
    assert len(got) == sum(b.test_end - b.test_start for b in bounds.collect())


def test_gradient_and_hessian_are_differences():
    rng = np.random.default_rng(4)
    z, y = np.hstack([rng.normal(size=(60, 2)), np.ones((60, 1))]), rng.integers(0, 3, 60)
    per_class, w = np.array([0.5, 1.0, 2.0]), rng.normal(size=9)
    at = lambda v: keyed.sums(z, y, v.reshape(3, 3), per_class)
    _, g, h = at(w)
    for i, e in enumerate(np.eye(9) * 1e-5):
        assert abs((at(w + e)[0] - at(w - e)[0]) / 2e-5 - g[i]) < 1e-6
        assert np.allclose((at(w + e)[1] - at(w - e)[1]) / 2e-5, h[i], atol=1e-5)


def test_a_missing_class_and_missing_values(spark):
    x, y = data(400, 5)
    rows = [("A", i, *(None if (i + j) % 37 == 0 else float(v) for j, v in enumerate(r)), 1 if c == 1 else -1) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "symbol string, rn long, a double, b double, c double, label int")
    packed, states = keyed.fit(df, keyed.fold_bounds(df, n_folds=2, embargo=0), INPUTS)
    out = keyed.predict(packed, states, 3)
    assert out.count() > 90 and out.where("p_flat <> 0 OR abs(p_short + p_long - 1) > 1e-12").count() == 0
    assert states.where("step > 1e-8").count() == 0


def test_jobs_do_not_grow_with_symbols(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which makes jobs of its own

    def jobs(symbols):
        df = spark.createDataFrame([(f"s{s}", i, *map(float, r), int(c)) for s in range(symbols) for i, (r, c) in enumerate(zip(*data(300, s), strict=True))], "symbol string, rn long, a double, b double, c double, label int")
        spark.sparkContext.setJobGroup(f"n{symbols}", "")
        keyed.fit(df, keyed.fold_bounds(df, n_folds=2, embargo=0), INPUTS, tolerance=1e9)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"n{symbols}"))

    try:
        assert jobs(2) == jobs(9)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_no_usable_folds(spark, rows):
    tiny = rows.where("symbol = 'tiny'")
    packed, states = keyed.fit(tiny, keyed.fold_bounds(tiny), INPUTS)
    assert keyed.predict(packed, states, 3).count() == 0
