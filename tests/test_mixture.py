"""Mixtures of all restarts in one job a round against MLlib's own fits."""

import numpy as np
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import vector_to_array

from regimespark.operators.features import DESCRIPTORS
from regimespark.operators.regimes import MixtureRegimes


def test_equals_single_fits_in_fewer_jobs(spark, monkeypatch):
    monkeypatch.setattr("regimespark.operators.regimes.CHUNK", 64)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4)) * rng.choice([0.5, 1.0, 2.0], (600, 1)) + rng.integers(0, 3, (600, 1))
    rows = [(i, *map(float, r)) for i, r in enumerate(x)] + [(600, None, 0.0, 0.0, 0.0), (601, 0.0, float("nan"), 0.0, 0.0)]
    whole = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in DESCRIPTORS))
    df = whole.where("id < 600").repartition(2, "id").persist()
    spark.sparkContext.setJobGroup("mixture", "")
    mine = MixtureRegimes(k=3).fit(df)
    spark.sparkContext.setJobGroup("others", "")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("mixture"))
    data = mine._vectors(df).persist()
    fits = [GaussianMixture(k=3, seed=7 + i, featuresCol="_v").fit(data.select("_v").persist()) for i in range(5)]
    best = max(fits, key=lambda m: m.summary.logLikelihood)
    assert np.isclose(mine.model.likelihood, best.summary.logLikelihood, rtol=1e-9)
    assert mine.model.rounds == best.summary.numIter
    assert jobs < sum(m.summary.numIter for m in fits)
    want = {r.id: r for r in best.transform(data).select("id", "prediction", vector_to_array("probability").alias("p")).collect()}
    got = {r.id: r.posterior for r in mine.posterior(whole).collect()}
    assert set(got) == set(want)
    assert all(np.allclose(got[i], want[i].p, atol=1e-6) for i in want)
    assert {r.id: r.regime for r in mine.predict(whole).collect()} == {i: r.prediction for i, r in want.items()}
