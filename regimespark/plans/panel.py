"""One configuration on every symbol of the bars, all symbols and folds in one plan.

Features, labels, folds, fits, signals and pricing are grouped by symbol, so the number of Spark
jobs does not grow with the symbols.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored
from ..operators import backtest, boosting, features, keyed, labels, metrics, signals
from ..operators.models import BOOSTED, settings_of
from ..sources.bars import bars_per_year
from .settings import Settings
from .study import prepare, pricing


@dataclass
class Panel:
    bounds: DataFrame
    predictions: DataFrame
    equity: DataFrame
    metrics: DataFrame  # of each symbol
    fold_metrics: DataFrame  # of each symbol and fold


def fits(config: Settings) -> bool:
    """Whether a configuration's learner is one that fits all symbols at once."""
    return config["regime.method"] == "none" and config["model.name"] in ("logistic", *BOOSTED) and config["model.top_k_features"] is None and config["model.n_seeds"] == 1


def probabilities(rows: DataFrame, bounds: DataFrame, inputs: list[str], config: Settings) -> DataFrame:
    """(symbol, rn, fold, p_short, p_flat, p_long) of all test rows."""
    params = settings_of(config["model.name"], config["model.params"])
    if config["model.name"] == "logistic":
        packed, states = keyed.fit(rows, bounds, inputs, params["C"], config["model.class_balance"])
        return keyed.predict(packed, states, len(inputs))
    key = F.concat_ws("|", "fold", "symbol").alias("_key")
    train = keyed.training(rows, bounds)
    if config["model.class_balance"]:
        train = train.join(keyed.class_weights(rows, bounds).select("symbol", "fold", "label", "weight"), ["symbol", "fold", "label"])
    else:
        train = train.withColumn("weight", F.lit(1.0))
    model = boosting.fit(train.select(key, (F.col("label") + 1).alias("_y"), "weight", *inputs), inputs, boosting.Boosting(seed=config["experiment.seed"], **params), "_y", "weight", "_key")
    test = rows.join(bounds, "symbol").where((F.col("rn") >= F.col("test_start")) & (F.col("rn") < F.col("test_end"))).withColumn("_key", key)
    p = model.probability(test, "_key")
    return test.select("symbol", "rn", "fold", p.alias("_p")).select("symbol", "rn", "fold", *(F.col("_p")[i].alias(n) for i, n in enumerate(("p_short", "p_flat", "p_long"))))


def run(bars: DataFrame, config: Settings) -> Panel:
    """Walk-forward predictions, pricing and metrics of every symbol with enough bars."""
    if not fits(config):
        raise ValueError("one plan for all symbols takes logistic or boosted learners without regimes, selection and several seeds")
    year, v = bars_per_year(config["data.timeframe"]), config.section("validation")
    rows = stored(prepare(bars, config))
    inputs = [c for c in features.feature_columns(rows) if c not in {*labels.LABEL, "primary"}]
    bounds = stored(keyed.fold_bounds(rows, v["scheme"], v["n_folds"], v["test_size"], v["min_train_size"], v["embargo_bars"]))
    found = probabilities(rows, bounds, inputs, config)
    # where test windows overlap, the earlier fold holds
    found = found.groupBy("symbol", "rn").agg(F.min_by(F.struct("fold", "p_short", "p_flat", "p_long"), "fold").alias("x")).select("symbol", "rn", "x.*")
    kept = ["symbol", "ts", "rn", "open", "close", F.coalesce("label", F.lit(0)).alias("label"), *(["primary"] if "primary" in rows.columns else [])]
    out = signals.from_probabilities(rows.select(*kept).join(found, ["symbol", "rn"]), config["model.decision_threshold"])
    if "primary" in rows.columns:
        out = out.withColumn("signal", F.when(F.coalesce("primary", F.lit(0.0)) == F.col("signal"), F.col("signal")).otherwise(0.0))
    predictions = stored(out.withColumn("prediction", F.col("signal").cast("int")).drop("rn", "primary"))
    equity = stored(backtest.run(predictions, **pricing(config, year)))
    of_fold = equity.join(predictions.select("symbol", "ts", "fold"), ["symbol", "ts"]).withColumn("_k", F.concat_ws("|", "fold", "symbol"))
    by_fold = metrics.performance(of_fold, year, key="_k").select(F.regexp_replace("_k", r"^[0-9]+\|", "").alias("symbol"), F.substring_index("_k", "|", 1).cast("int").alias("fold"), *metrics.METRICS)
    return Panel(bounds, predictions, equity, metrics.performance(equity, year, backtest.trades(equity)), by_fold)
