"""Three-class learners on MLlib. Class indices 0, 1, 2 stand for labels -1, 0, 1."""

from __future__ import annotations

import importlib.util
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, perceptron


@dataclass(frozen=True)
class Spec:
    label: str
    defaults: dict
    scaled: bool = False
    requires: str | None = None
    built: bool = True


# The learners and their default settings.
SPECS = {
    "logistic": Spec("Logistic regression", {"C": 0.1}, scaled=True),
    "random_forest": Spec("Random forest", {"numTrees": 400, "maxDepth": 8, "minInstancesPerNode": 50}),
    "hist_gradient_boosting": Spec("Histogram gradient boosting", {"rounds": 400, "rate": 0.05, "depth": 6}),
    "xgboost": Spec("Boosted trees by depth, regularised", {"rounds": 500, "rate": 0.03, "depth": 5, "leaves": 32, "row_share": 0.8, "column_share": 0.8, "hessian": 20, "least": 1, "l2": 2.0}),
    "lightgbm": Spec("Boosted trees by leaf", {"rounds": 500, "rate": 0.03, "depth": 99, "leaves": 31, "least": 50, "column_share": 0.8}),
    "mlp": Spec("Multilayer perceptron", {"hidden": [64, 32], "alpha": 1e-3, "steps": 400}, scaled=True),
    "lstm": Spec("LSTM", {"lookback": 24}, scaled=True, requires="tensorflow", built=False),
    "gru": Spec("GRU", {"lookback": 24}, scaled=True, requires="tensorflow", built=False),
}
BOOSTED = ("hist_gradient_boosting", "xgboost", "lightgbm")
# Other names of the settings in configurations.
_TREES = {"max_iter": "rounds", "n_estimators": "rounds", "learning_rate": "rate", "max_depth": "depth", "num_leaves": "leaves", "max_leaf_nodes": "leaves", "min_samples_leaf": "least", "min_child_samples": "least", "min_child_weight": "hessian", "reg_lambda": "l2", "l2_regularization": "l2", "subsample": "row_share", "colsample_bytree": "column_share", "max_bins": "bins"}
NAMES = {"random_forest": {"n_estimators": "numTrees", "max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode"}, "mlp": {"hidden_layer_sizes": "hidden", "layers": "hidden", "max_iter": "steps", "maxIter": "steps"}, "logistic": {"max_iter": "maxIter"}} | dict.fromkeys(BOOSTED, _TREES)


def settings_of(name: str, params: dict | None = None) -> dict:
    """A learner's defaults with the given settings, under either name."""
    return SPECS[name].defaults | {NAMES[name].get(k, k): v for k, v in (params or {}).items()}


def is_available(name: str) -> bool:
    spec = SPECS[name]
    return spec.built and (spec.requires is None or importlib.util.find_spec(spec.requires) is not None)


def available() -> list[str]:
    return [k for k in SPECS if is_available(k)]


def catalogue(spark) -> DataFrame:
    rows = [(k, s.label, s.requires or "", is_available(k), s.built) for k, s in SPECS.items()]
    return spark.createDataFrame(rows, "model string, label string, requires string, available boolean, built boolean")


def one_hot(df: DataFrame, k: int, column: str = "regime") -> DataFrame:
    """regime_0 ... regime_{k-1}, whichever of them occur."""
    return df.withColumns({f"regime_{i}": F.when(F.col(column) == i, 1.0).otherwise(0.0) for i in range(k)})


def balanced(df: DataFrame) -> DataFrame:
    """`weight` n / (classes * class size)."""
    counts = {r.label: r["count"] for r in df.groupBy("label").count().collect()}
    n, k = sum(counts.values()), len(counts)
    weight = F.lit(1.0)
    for label, c in counts.items():
        weight = F.when(F.col("label") == label, n / (k * c)).otherwise(weight)
    return df.withColumn("weight", weight)


class Learner:
    """Median imputation, scaling where the learner needs it, and an MLlib estimator; probabilities of all three classes."""

    def __init__(self, name: str, params: dict | None = None, *, balance: bool = True, top: int | None = None, seed: int = 7):
        if name not in SPECS:
            raise ValueError(f"unknown model {name!r}; there are {sorted(SPECS)}")
        if not SPECS[name].built:
            raise RuntimeError(f"{name} is not built here, whether or not {SPECS[name].requires} is installed")
        if not is_available(name):
            raise RuntimeError(f"{name} needs {SPECS[name].requires}, which is not installed")
        self.name, self.spec, self.params, self.balance, self.top, self.seed = name, SPECS[name], settings_of(name, params), balance, top, seed

    def _estimator(self, n: int):
        p, common = dict(self.params), {"featuresCol": "_v", "labelCol": "_y"}
        name = self.name
        if name == "logistic":
            return LogisticRegression(family="multinomial", regParam=1 / (p["C"] * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=p.get("maxIter", 2000), weightCol="weight", **common)
        return RandomForestClassifier(seed=self.seed, weightCol="weight", **p, **common)

    def _filled(self, df: DataFrame) -> DataFrame:
        df = self.imputer.transform(df)
        if self.spec.scaled:
            df = df.withColumns({f"_i_{f}": (F.col(f"_i_{f}") - m) / (s or 1.0) for f, (m, s) in self.scale.items()})
        return df

    def _vectors(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=[f"_i_{f}" for f in self.features], outputCol="_v").transform(self._filled(df))

    def fit(self, df: DataFrame, features: list[str]) -> Learner:
        bad = df.where(~F.col("label").isin(-1, 0, 1)).limit(1).count()
        if bad:
            raise ValueError("labels must be -1, 0 or 1")
        df = balanced(df) if self.balance else df.withColumn("weight", F.lit(1.0))
        self.features = features
        if self.top and self.top < len(features):
            self.features = self._select(df, features)
        self.imputer = Imputer(strategy="median", inputCols=self.features, outputCols=[f"_i_{f}" for f in self.features]).fit(df)
        if self.spec.scaled:
            filled = self.imputer.transform(df)
            row = filled.agg(*(g(f"_i_{f}") for f in self.features for g in (F.avg, F.stddev_pop))).first()
            self.scale = {f: (row[2 * i], row[2 * i + 1]) for i, f in enumerate(self.features)}
        if self.name in BOOSTED:
            rows = self.imputer.transform(df).withColumn("_y", F.col("label") + 1)
            self.model = boosting.fit(rows, [f"_i_{f}" for f in self.features], boosting.Boosting(seed=self.seed, **self.params), "_y", "weight")
            return self
        if self.name == "mlp":
            rows = self._filled(df).withColumn("_y", F.col("label") + 1)
            self.model = perceptron.fit(rows, [f"_i_{f}" for f in self.features], "_y", "weight", list(self.params["hidden"]), self.params["alpha"], self.params["steps"], self.seed)
            return self
        data = self._vectors(df).select("_v", (F.col("label") + 1).cast("double").alias("_y"), "weight")
        data = data.persist()
        self.model = self._estimator(data.count()).fit(data)
        data.unpersist()
        return self

    def _select(self, df: DataFrame, features: list[str]) -> list[str]:
        """The features a small forest finds most important."""
        forest = Learner("random_forest", {"numTrees": 120}, balance=False, seed=self.seed).fit(df.drop("weight"), features)
        ranked = sorted(forest.importance().items(), key=lambda x: (-x[1], x[0]))
        return [f for f, _ in ranked[: self.top]]

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """p_short, p_flat, p_long; a class that was not trained has 0."""
        if self.name in BOOSTED:
            out = self.imputer.transform(df)
            out = out.withColumn("_p", self.model.probability(out))
        elif self.name == "mlp":
            out = self._filled(df)
            out = out.withColumn("_p", self.model.probability(out))
        else:
            out = self.model.transform(self._vectors(df)).withColumn("_p", vector_to_array("probability"))
        return out.select(*df.columns, *(F.coalesce(F.get("_p", F.lit(i)), F.lit(0.0)).alias(n) for i, n in enumerate(("p_short", "p_flat", "p_long"))))

    def importance(self) -> dict[str, float] | None:
        """Shares of the features, where the learner tells them."""
        if self.name in BOOSTED:
            used = self.model.gains()
            total = sum(used.values()) or 1
            return {f: used[f"_i_{f}"] / total for f in self.features}
        if hasattr(self.model, "featureImportances"):
            values = self.model.featureImportances.toArray()
        elif hasattr(self.model, "coefficientMatrix"):
            values = abs(self.model.coefficientMatrix.toArray()).mean(axis=0)
        else:
            return None
        total = values.sum() or 1.0
        return {f: float(v / total) for f, v in zip(self.features, values, strict=True)}


class Ensemble:
    """The mean probabilities of a learner under several seeds."""

    def __init__(self, name: str, params: dict | None = None, *, seeds: int, seed: int = 7, **options):
        self.members = [Learner(name, params, seed=seed + i, **options) for i in range(seeds)]

    def fit(self, df: DataFrame, features: list[str]) -> Ensemble:
        for m in self.members:
            m.fit(df, features)
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        names, kept, out = ("p_short", "p_flat", "p_long"), df.columns, df
        for i, m in enumerate(self.members):
            out = m.predict_proba(out).withColumnsRenamed({n: f"_{n}{i}" for n in names})
        k = len(self.members)
        return out.select(*kept, *((sum((F.col(f"_{n}{i}") for i in range(1, k)), F.col(f"_{n}0")) / k).alias(n) for n in names))

    def importance(self) -> dict[str, float] | None:
        found = [m.importance() for m in self.members]
        if None in found:
            return None
        return {f: sum(x.get(f, 0.0) for x in found) / len(found) for f in found[0]}


def build(name: str, params: dict | None = None, *, seeds: int = 1, **options):
    """A learner, or the mean of several seeds; options: balance, top (features to keep), seed."""
    return Learner(name, params, **options) if seeds <= 1 else Ensemble(name, params, seeds=seeds, **options)


def predict(df: DataFrame) -> DataFrame:
    """The most probable class; of equals the first of short, flat, long."""
    s, f, g = F.col("p_short"), F.col("p_flat"), F.col("p_long")
    return df.withColumn("prediction", F.when((s >= f) & (s >= g), -1).when(f >= g, 0).otherwise(1))
