"""The perceptron's gradients, weights and fits."""

import numpy as np
import pytest

from regimespark.operators import models, perceptron

SIZES = [3, 5, 4, 3]


def rows(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    return x, (x[:, 0] * x[:, 1] > 0.1).astype(int) + (x[:, 2] > 0.9), rng.choice([1.0, 2.0], n)


def table(spark, x, y, w):
    return spark.createDataFrame([(*map(float, r), int(c), float(v)) for r, c, v in zip(x, y, w, strict=True)], "a double, b double, c double, y int, weight double").repartition(3)


def test_gradient_equals_differences():
    x, y, w = rows(50)
    at = perceptron.started(SIZES, 3)
    _, g = perceptron.gradient(x, y, w, at, SIZES)
    for i in range(len(at)):
        e = np.zeros(len(at))
        e[i] = 1e-6
        assert abs((perceptron.gradient(x, y, w, at + e, SIZES)[0] - perceptron.gradient(x, y, w, at - e, SIZES)[0]) / 2e-6 - g[i]) < 1e-4


def test_sums_are_those_of_one_task(spark, monkeypatch):
    monkeypatch.setattr(perceptron, "BLOCK", 64)
    x, y, w = rows()
    at = perceptron.started(SIZES, 3)
    loss, g, n = perceptron.evaluated(perceptron.blocks(table(spark, x, y, w), ["a", "b", "c"], "y", "weight"), at, SIZES)
    want = perceptron.gradient(x, y, w, at, SIZES)
    assert abs(loss - want[0]) < 1e-9 and np.allclose(g, want[1], atol=1e-9) and n == w.sum()


def test_a_weight_of_two_is_the_row_twice(spark):
    x, y, w = rows(120)
    twice = np.repeat(np.arange(120), w.astype(int))
    fits = [perceptron.fit(df, ["a", "b", "c"], "y", "weight", [4], steps=5).w for df in (table(spark, x, y, w), table(spark, x[twice], y[twice], np.ones(len(twice))))]
    assert np.allclose(*fits, atol=1e-7)


def test_it_learns_what_a_line_cannot(spark):
    x, y, w = rows(600)
    df = table(spark, x, y, w)
    model = perceptron.fit(df, ["a", "b", "c"], "y", "weight", [16, 8], steps=120)
    got = df.select("y", model.probability(df).alias("p")).collect()
    assert np.mean([np.argmax(r.p) == r.y for r in got]) > 0.93 and all(abs(sum(r.p) - 1) < 1e-12 for r in got)


@pytest.mark.parametrize("params", [{"hidden_layer_sizes": [4], "max_iter": 3}, {}])
def test_as_a_learner(spark, params):
    x, y, _ = rows(90)
    df = table(spark, x, y, np.ones(90)).withColumnRenamed("y", "_l").selectExpr("a", "b", "c", "_l - 1 AS label")
    learner = models.build("mlp", params | {"max_iter": 3}).fit(df, ["a", "b", "c"])
    assert models.predict(learner.predict_proba(df)).where("abs(p_short + p_flat + p_long - 1) < 1e-9").count() == 90
