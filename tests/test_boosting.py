"""Histogram boosting against a plain version that splits one leaf after another."""

import numpy as np
import pytest

from regimespark.operators import boosting
from regimespark.operators.boosting import Boosting


def rows(seed=0, n=900):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5))
    x[:, 3] = np.round(x[:, 3])
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(size=n) * 0.4 > 0.6).astype(int) + (x[:, 2] > 0.8)
    x[rng.random(n) < 0.05, 4] = np.nan
    return x, y.astype(int), rng.choice([0.5, 1.0, 3.0], n)


def table(spark, *parts):
    data = [(k, *(None if np.isnan(v) else float(v) for v in r), int(c), float(w)) for k, (x, y, ws) in parts for r, c, w in zip(x, y, ws, strict=True)]
    return spark.createDataFrame(data, "key string, a double, b double, c double, d double, e double, y int, weight double").repartition(3)


def best(g, h, bins, idx, spec):
    found = None
    total = g[idx].sum(), h[idx].sum()
    for j in range(bins.shape[1]):
        for b in range(spec.bins):
            go = idx[bins[idx, j] <= b]
            n, gl, hl = len(go), g[go].sum(), h[go].sum()
            if n < spec.least or len(idx) - n < spec.least or hl < spec.hessian or total[1] - hl < spec.hessian:
                continue
            gain = round(gl**2 / (hl + spec.l2) + (total[0] - gl) ** 2 / (total[1] - hl + spec.l2) - total[0] ** 2 / (total[1] + spec.l2), 6)
            if gain > 0 and (found is None or gain > found[0]):
                found = (gain, j, b)
    return found


def plain(x, y, w, edges, spec):
    """Probabilities after each round."""
    bins = boosting.binned(x, edges)
    scores = np.tile(np.log(np.array([w[y == k].sum() for k in range(spec.classes)]) / w.sum()), (len(y), 1))
    out = []
    for _ in range(spec.rounds):
        p = boosting.softmax(scores)
        step = np.zeros_like(scores)
        for k in range(spec.classes):
            g, h = w * (p[:, k] - (y == k)), w * p[:, k] * (1 - p[:, k])
            leaves = [(np.arange(len(y)), 0)]
            options = [best(g, h, bins, leaves[0][0], spec)]
            while len(leaves) < spec.leaves:
                able = [i for i, o in enumerate(options) if o and leaves[i][1] < spec.depth]
                if not able:
                    break
                i = max(able, key=lambda i: options[i][0])
                (idx, depth), (_, j, b) = leaves.pop(i), options.pop(i)
                for part in (idx[bins[idx, j] <= b], idx[bins[idx, j] > b]):
                    leaves.append((part, depth + 1))
                    options.append(best(g, h, bins, part, spec))
            for idx, _ in leaves:
                step[idx, k] = -spec.rate * g[idx].sum() / (h[idx].sum() + spec.l2)
        scores = scores + step
        out.append(boosting.softmax(scores))
    return out


FEATURES = ["a", "b", "c", "d", "e"]


@pytest.mark.parametrize("spec", [Boosting(rounds=4, rate=0.3, depth=3, leaves=99, bins=12, l2=1.0), Boosting(rounds=3, rate=0.3, depth=20, leaves=7, bins=16, least=10)])
def test_equals_the_plain_version(spark, spec, monkeypatch):
    monkeypatch.setattr(boosting, "STORE", 2)
    monkeypatch.setattr(boosting, "TASK_ROWS", 300)
    sets = {"one": rows(1), "two": rows(2, 500)}
    df = table(spark, *sets.items())
    model = boosting.fit(df, FEATURES, spec, weight="weight", key="key")
    for r in (1, spec.rounds):
        got = df.select("key", *FEATURES, "y", model.probability(df, "key", r).alias("p")).collect()
        for key, (x, y, w) in sets.items():
            want = plain(x, y, w, model.edges[key], spec)[r - 1]
            order = lambda v: tuple(-9.0 if u is None or np.isnan(u) else round(u, 12) for u in v)
            mine = sorted((order(g[1:6]), g.p) for g in got if g.key == key)
            theirs = sorted((order(v), list(p)) for v, p in zip(x, want, strict=True))
            assert [m[0] for m in mine] == [t[0] for t in theirs]
            assert np.allclose([m[1] for m in mine], [t[1] for t in theirs], atol=1e-9)


def test_loss_falls_each_round(spark):
    x, y, w = rows(3)
    df = table(spark, ("k", (x, y, w)))
    model = boosting.fit(df, FEATURES, Boosting(rounds=6, rate=0.2, depth=4, leaves=9, bins=32), weight="weight")
    losses = []
    for r in range(7):
        seen = df.select("y", "weight", model.probability(df, rounds=r).alias("p")).collect()
        losses.append(-sum(s.weight * np.log(s.p[s.y]) for s in seen))
    assert all(b < a for a, b in zip(losses, losses[1:], strict=False))
    assert sum(model.gains().values()) > 0 and set(model.gains()) == set(FEATURES)


def test_samples_repeat(spark):
    df = table(spark, ("k", rows(4, 400)))
    spec = Boosting(rounds=2, bins=8, row_share=0.6, column_share=0.5, depth=3)
    fits = [boosting.fit(df.coalesce(1), FEATURES, spec).rounds for _ in range(2)]
    assert [[t.feature for t in r] for r in fits[0][""]] == [[t.feature for t in r] for r in fits[1][""]]
    kept = boosting._shares(np.arange(100_000), 0.6, 7, 3)
    assert abs(kept.mean() - 0.6) < 0.01


def test_odd_tables(spark):
    x = np.array([[1.0, np.nan, 2.0, 0.0, np.nan]] * 30)
    model = boosting.fit(table(spark, ("k", (x, np.array([0, 2] * 15), np.ones(30)))), FEATURES, Boosting(rounds=2, least=1))
    p = table(spark, ("k", (x[:1], [0], [1.0]))).select(model.probability(table(spark, ("k", (x[:1], [0], [1.0])))).alias("p")).first().p
    assert np.allclose(p, [0.5, 0.0, 0.5], atol=1e-6)  # nothing to split by
    none = table(spark, ("k", (x[:0], [], [])))
    assert boosting.fit(spark.createDataFrame([], none.schema), FEATURES, Boosting(rounds=1)).rounds == {}


def test_sums_grow_with_keys_and_tasks_not_with_their_product(spark):
    sets = [(f"k{i}", rows(10 + i, 200)) for i in range(6)]
    df, spec = table(spark, *sets), Boosting(bins=8)
    _, start, edges = boosting.measured(df, FEATURES, spec, "y", "weight", "key", None)
    base = boosting.prepared(df, FEATURES, edges, start, "y", "weight", "key", 4).persist()
    growing, wanted = {k: [boosting.Tree() for _ in range(3)] for k, _ in sets}, {k: [[0], [0], [0]] for k, _ in sets}
    got = boosting.cells(base, growing, wanted, 5, 0, spec).collect()
    assert len({(r.key, r.part) for r in got}) <= 6 + 4 - 1
    counts = {k: sum(np.frombuffer(r.sums, float).reshape(3, 5, -1)[2, 0].sum() for r in got if r.key == k and r.tree == 0) for k, _ in sets}
    assert set(counts.values()) == {200.0}
    base.unpersist()


@pytest.mark.parametrize("spec", [Boosting(rounds=4, rate=0.3, depth=3, leaves=99, bins=12, l2=1.0), Boosting(rounds=3, rate=0.3, depth=20, leaves=7, bins=64, least=10), Boosting(rounds=2, leaves=1), Boosting(rounds=2, depth=0)])
def test_keys_grown_in_their_tasks_equal_the_plain_version(spark, spec, monkeypatch):
    monkeypatch.setattr(boosting, "_grow_large", None)
    sets = {"one": rows(1), "two": rows(2, 500), "o'three": rows(3, 60)}
    df = table(spark, *sets.items())
    model = boosting.fit(df, FEATURES, spec, weight="weight", key="key")
    got = df.select("key", *FEATURES, model.probability(df, "key").alias("p")).collect()
    for key, (x, y, w) in sets.items():
        order = lambda v: tuple(-9.0 if u is None or np.isnan(u) else round(u, 12) for u in v)
        mine = sorted((order(g[1:6]), g.p) for g in got if g.key == key)
        theirs = sorted((order(v), list(p)) for v, p in zip(x, plain(x, y, w, model.edges[key], spec)[-1], strict=True))
        assert [m[0] for m in mine] == [t[0] for t in theirs] and np.allclose([m[1] for m in mine], [t[1] for t in theirs], atol=1e-9)


def test_keys_grow_alike_in_a_task_and_over_tasks(spark, monkeypatch):
    """With rows and columns sampled, a class that one key lacks, and small and large keys beside each other."""
    x, y, w = rows(5, 700)
    sets = [("a", (x, y, w)), ("b", (x[:200], np.minimum(y[:200], 1), w[:200])), ("c", rows(6, 300))]
    df = table(spark, *sets).coalesce(1).cache()
    spec = Boosting(rounds=3, rate=0.2, bins=16, row_share=0.7, column_share=0.6, leaves=9)
    found = {}
    for most in (1 << 16, 250, 0):
        monkeypatch.setattr(boosting, "TASK_ROWS", max(most, 1))
        monkeypatch.setattr(boosting, "SHARE", 0)
        model = boosting.fit(df, FEATURES, spec, weight="weight", key="key")
        assert {k: len(r) for k, r in model.rounds.items()} == dict.fromkeys("abc", 3)
        found[most] = np.array([r.p for r in df.select("key", model.probability(df, "key").alias("p")).collect()])
    assert np.allclose(found[1 << 16], found[0], atol=1e-9) and np.allclose(found[250], found[0], atol=1e-9)
    df.unpersist()


def test_jobs_do_not_grow_with_the_rounds_of_small_keys(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which makes jobs of its own
    df = table(spark, *((f"k{i}", rows(i, 150)) for i in range(3)))

    def jobs(rounds):
        spark.sparkContext.setJobGroup(f"rounds{rounds}", "")
        model = boosting.fit(df, FEATURES, Boosting(rounds=rounds, bins=8), weight="weight", key="key")
        assert {len(r) for r in model.rounds.values()} == {rounds}
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds{rounds}"))

    try:
        assert jobs(2) == jobs(12)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_task_grows_no_large_part_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(boosting, "TASK_ROWS", 100)
    spread = []
    monkeypatch.setattr(boosting, "_grow_large", lambda blocks, keys, _: spread.append(({r.key for r in blocks.collect()}, keys, blocks.rdd.getNumPartitions())))
    df = table(spark, ("large", rows(1, 500)), *((f"k{i}", rows(i, 180)) for i in range(4)))
    boosting.fit(df, FEATURES, Boosting(rounds=1, bins=8), weight="weight", key="key")
    assert spread == [({"large"}, ["large"], 5)]
