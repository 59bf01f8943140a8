"""A study: features, labels, walk-forward regimes and learners, backtest, diagnostics, significance."""

from __future__ import annotations

import json
import threading
import time
import traceback
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored
from ..functions.windows import lead, numbered, rolling
from ..operators import backtest, classification, features, folds, labels, metrics, models, regimes, signals, significance
from ..sources.bars import bars_per_year, between, resample
from .settings import Settings


#: Bars of a range of features: ten blocks of exponential means.
RANGE = 30_000


@dataclass
class Study:
    run_id: str
    config: Settings
    predictions: DataFrame
    equity: DataFrame
    tables: dict[str, DataFrame]
    summary: dict = field(default_factory=dict)


def label_arguments(config: Settings) -> dict:
    s = config.section("labeling")
    common = {"horizon": s["horizon"], "atr_window": s["atr_window"]}
    if s["method"] == "directional":
        return common | {"deadband": s["deadband_atr"]}
    return common | {"take_profit": s["take_profit_atr"], "stop_loss": s["stop_loss_atr"]} | ({"primary": s["primary"]} if s["method"] == "meta" else {})


def pricing(config: Settings, bars_per_year: int) -> dict:
    """The arguments of backtest.run."""
    s = config.section("backtest")
    return {
        "capital": s["initial_capital"], "friction_bps": s["cost_bps"] + s["slippage_bps"], "size": s["position_size"], "delay": s["execution_lag"], "hold": s["min_holding_bars"], "bars_per_year": bars_per_year,
        "target": s["volatility_target"], "target_window": s["volatility_window"], "leverage": s["max_leverage"], "hours": s["session_hours"],
    }


def learner(config: Settings):
    s = config.section("model")
    return models.build(s["name"], s["params"], balance=s["class_balance"], top=s["top_k_features"], seeds=s["n_seeds"], seed=config["experiment.seed"])


def prepare(bars: DataFrame, config: Settings, extra=None) -> DataFrame:
    """Features of the symbols with labels beside, numbered, within the study's dates; the tail after the last label is cut. `extra` may add columns to the features."""
    s = config.section("features")
    windows = {"returns": s["return_horizons"], "volatility": s["volatility_windows"], "trend": s["trend_windows"]}
    if config["data.start"] is not None or config["data.end"] is not None:
        bars = between(bars, config["data.start"], config["data.end"])
    # swing levels may be older than a halo; all other blocks look back so far only
    size = None if "structure" in s["blocks"] else RANGE
    feats = features.build_features(bars, tuple(s["blocks"]), config["data.warmup_bars"], windows, size)
    if extra is not None:
        feats = extra(feats).dropna("any")
    # labels rest on the rows that have all features, so these are kept rather than worked out for each use
    feats = stored(feats)
    marked = labels.build_labels(feats.select(*features.OHLCV), config["labeling.method"], **label_arguments(config))
    extra = [c for c in (*labels.LABEL, "primary") if c in marked.columns]
    marked = stored(marked.select("symbol", "ts", *extra))
    rows = feats.join(marked, ["symbol", "ts"], "left")
    last = marked.groupBy("symbol").agg(F.max("ts").alias("_last"))
    return numbered(rows.join(last, "symbol").where(F.col("ts") <= F.col("_last")).drop("_last"))


def fit_fold(train: DataFrame, inputs: list[str], config: Settings) -> dict:
    """The pooled model, and one for each regime with enough rows if they are asked for."""
    fitted = {None: learner(config).fit(train, inputs)}
    if config["regime.specialised_models"]:
        n = train.count()
        least = max(500, n // (4 * config["regime.n_regimes"]))
        for r in train.groupBy("regime").agg(F.count("*").alias("n"), F.count_distinct("label").alias("k")).collect():
            if r.n >= least and r.k > 1:
                fitted[r.regime] = learner(config).fit(train.where(F.col("regime") == r.regime), inputs)
    return fitted


def score_fold(fitted: dict, test: DataFrame) -> DataFrame:
    """Probabilities from the model of each row's regime, or the pooled one."""
    own = [k for k in fitted if k is not None]
    if not own:
        return fitted[None].predict_proba(test)
    out = fitted[None].predict_proba(test.where(~F.col("regime").isin(own)))
    for k in own:
        out = out.unionByName(fitted[k].predict_proba(test.where(F.col("regime") == k)))
    return out


def run(bars: DataFrame, config: Settings | None = None, progress=None, extra=None, rows: DataFrame | None = None) -> Study:
    """A study of one symbol's bars; `extra` may add columns to its features, `rows` are prepared already."""
    cfg, began = config or Settings(), time.time()
    say = progress or (lambda share, text: None)
    year = bars_per_year(cfg["data.timeframe"])
    say(0.05, "features and labels")
    rows = stored(prepare(bars, cfg, extra)) if rows is None else rows
    n = rows.count()
    v = cfg.section("validation")
    plan = folds.walk_forward(n, v["scheme"], v["n_folds"], v["test_size"], v["min_train_size"], v["embargo_bars"])
    inputs = [c for c in features.feature_columns(rows) if c not in {*labels.LABEL, "primary"}]
    scored, importances, detector = [], [], None
    for fold in plan:
        say(0.1 + 0.6 * fold.index / len(plan), f"fold {fold.index + 1} of {len(plan)}")
        train, test = folds.split(rows, fold)
        train = train.where("label IS NOT NULL")
        detector = regimes.detector(cfg["regime.method"], cfg["regime.n_regimes"], cfg["experiment.seed"], cfg["regime.features"]).fit(train)
        train, test = detector.predict(train), detector.predict(test)
        columns = list(inputs)
        if cfg["regime.as_model_feature"] and cfg["regime.method"] != "none":
            train, test = (models.one_hot(x, cfg["regime.n_regimes"]) for x in (train, test))
            columns += [f"regime_{i}" for i in range(cfg["regime.n_regimes"])]
        fitted = fit_fold(train, columns, cfg)
        out = signals.from_probabilities(score_fold(fitted, test), cfg["model.decision_threshold"])
        if "primary" in rows.columns:
            # the learner only filters the rule's trades
            out = out.withColumn("signal", F.when(F.coalesce("primary", F.lit(0.0)) == F.col("signal"), F.col("signal")).otherwise(0.0))
        keep = out.select("symbol", "ts", F.lit(fold.index).alias("fold"), F.coalesce("label", F.lit(0)).alias("label"), F.col("signal").cast("int").alias("prediction"), "regime", "open", "close", "p_short", "p_flat", "p_long")
        scored.append(stored(keep))
        if found := fitted[None].importance():
            importances += [(fold.index, f, x) for f, x in found.items()]
    say(0.75, "backtest")
    every = scored[0]
    for more in scored[1:]:
        every = every.unionByName(more)
    # where test windows overlap, the earlier fold holds
    predictions = every.groupBy("symbol", "ts").agg(F.min_by(F.struct(*[c for c in every.columns if c not in ("symbol", "ts")]), "fold").alias("x")).select("symbol", "ts", "x.*")
    predictions = stored(predictions)
    result = stored(backtest.run(predictions.withColumn("signal", F.col("prediction").cast("double")), **pricing(cfg, year)))
    trades = backtest.trades(result)
    head = metrics.performance(result, year, trades).first().asDict()
    cls = classification.summary(predictions).first()
    cls = cls.asDict() if cls else {}
    spark = bars.sparkSession
    by_fold = metrics.performance(result.join(predictions.select("symbol", "ts", "fold"), ["symbol", "ts"]), year, key="fold")
    by_fold = stored(by_fold)
    spread = by_fold.agg(F.stddev_samp("sharpe").alias("spread")).withColumn("symbol", F.lit(head["symbol"]))
    say(0.85, "significance")
    returns = result.select("symbol", "ts", "strategy_return")
    interval = significance.bootstrap_interval(returns, cfg["evaluation.bootstrap_samples"], cfg["evaluation.confidence_level"], year, seed=cfg["experiment.seed"]).first()
    tests = significance.probabilistic_sharpe(returns, 0.0, year).join(significance.deflated_sharpe(returns, len(plan), spread, year).drop("n"), "symbol")
    tests = tests.select(F.col("psr").alias("probabilistic_sharpe"), F.col("deflated").alias("deflated_sharpe"), F.col("deflated_corrected").alias("deflated_sharpe_corrected")).first()
    stable = significance.fold_stability(by_fold).first().asDict()
    tested = (interval.asDict() if interval else {}) | tests.asDict() | {"fold_stability": stable if stable["folds"] else {}}
    say(0.95, "baselines")
    history = numbered(bars)
    where = predictions.select("symbol", "ts")
    ruled = signals.stacked(history, signals.RULES).withColumn("_s", signals.stacked_symbol("symbol"))
    ruled = ruled.join(where.withColumnRenamed("symbol", "_s"), ["_s", "ts"], "left_semi").drop("_s")
    base = metrics.performance(backtest.run(ruled, **pricing(cfg, year)), year).withColumns({"rule": signals.stacked_rule("symbol"), "symbol": signals.stacked_symbol("symbol")})
    market = predictions.select("symbol", "ts", "close", "regime")
    tables = {
        "fold_layout": folds.describe_folds(rows, plan), "fold_metrics": by_fold, "trades": trades, "confusion": classification.confusion(predictions), "per_class": classification.per_class(predictions),
        "threshold_curve": classification.threshold_sweep(predictions), "regime_table": regimes.named(regimes.profile(market, (), year), detector.names), "regime_transitions": regimes.transitions(market),
        "regime_performance": regimes.regime_performance(predictions.join(result.select("symbol", "ts", "strategy_return"), ["symbol", "ts"]), year), "baselines": base,
        "feature_importance": spark.createDataFrame(importances, "fold int, feature string, value double").groupBy("feature").agg(F.avg("value").alias("value")) if importances else None,
    }
    made = time.strftime("%Y-%m-%dT%H:%M:%S")
    summary = {"created_at": made, "seconds": time.time() - began, "bars": n, "folds": len(plan), "metrics": head, "classification": cls, "significance": tested}
    return Study(f"{time.strftime('%Y%m%d-%H%M%S')}-{uuid.uuid4().hex[:6]}", cfg, predictions, result, tables, summary)


def verdict(summary: dict) -> str:
    """One line on whether the study's edge could be chance."""
    s = summary["significance"]
    if s.get("lower") is None:
        return "too few bars to tell"
    if s["lower"] > 0:
        return "positive beyond chance"
    return "negative beyond chance" if s["upper"] < 0 else "not told from chance"


def compare(bars: DataFrame, base: Settings, model_names: list[str], regime_names: list[str]) -> list[dict]:
    """Every learner with every regime method; an arm that fails is listed with its error."""
    return sweep(bars, base, [(f"{m}/{r}", [f"model.name={m}", f"regime.method={r}"]) for m in model_names for r in regime_names])


def by_sharpe(row: dict) -> float:
    return -row["sharpe"] if row.get("sharpe") is not None else float("inf")


class _Prepared:
    """Prepared rows of the settings that they depend on, made once however many arms ask at a time."""

    SECTIONS = ("data", "features", "labeling")

    def __init__(self, bars: DataFrame, extra):
        self.bars, self.extra, self.lock, self.made = bars, extra, threading.Lock(), {}

    def of(self, config: Settings) -> DataFrame:
        key = json.dumps([config.section(s) for s in self.SECTIONS], default=str)
        with self.lock:
            one = self.made.setdefault(key, threading.Lock())
        with one if not isinstance(one, DataFrame) else nullcontext():
            if not isinstance(self.made[key], DataFrame):
                self.made[key] = stored(prepare(self.bars, config, self.extra))
            return self.made[key]


def sweep(bars: DataFrame, base: Settings, arms: list[tuple[str, list[str]]], stage: str = "search", extra=None, workers: int = 4) -> list[dict]:
    """Ledger rows of named sets of overrides, best Sharpe first.

    `workers` arms run at a time, each with a job group and a scheduler pool of its own, so that they share the cluster
    fairly where spark.scheduler.mode is FAIR. Arms of one setting of data, features and labels share their rows; bars are
    resampled for arms of a slower timeframe. An arm that fails is listed with its traceback.
    """
    sc, frames, lock = bars.sparkSession.sparkContext, {}, threading.Lock()

    def rows_of(config: Settings) -> DataFrame:
        frame = config["data.timeframe"]
        with lock:
            if frame not in frames:
                frames[frame] = _Prepared(bars if frame == base["data.timeframe"] else resample(bars, frame), extra)
        return frames[frame].of(config)

    def work(arm: tuple[str, list[str]]) -> dict:
        (name, changes), began = arm, time.time()
        row = {"stage": stage, "arm": name, "changes": "; ".join(changes)}
        sc.setJobGroup(f"{stage}/{name}", f"{stage}: {name}")
        sc.setLocalProperty("spark.scheduler.pool", f"{stage}/{name}")
        try:
            config = base.but(*changes)
            s = run(bars, config, rows=rows_of(config)).summary
            row |= {"status": "ok", "sharpe": s["metrics"]["sharpe"], "total_return": s["metrics"]["total_return"], "max_drawdown": s["metrics"]["max_drawdown"], "trades": s["metrics"]["trades"], "lower": s["significance"].get("lower"), "upper": s["significance"].get("upper")}
        except Exception as error:  # one arm must not end the search
            row |= {"status": f"failed: {error}"[:200], "error": traceback.format_exc()}
        return row | {"seconds": time.time() - began}

    with ThreadPoolExecutor(max(1, workers)) as pool:
        return sorted(pool.map(inheritable_thread_target(bars.sparkSession)(work), arms), key=by_sharpe)


def holdout(bars: DataFrame, config: Settings) -> list[dict]:
    """The chosen configuration on every symbol of the bars: in one plan where its learner fits all symbols at once, and else one study after another."""
    from . import panel

    if not panel.fits(config):
        names = [r.symbol for r in bars.select("symbol").distinct().orderBy("symbol").collect()]
        return [row | {"symbol": s} for s in names for row in sweep(bars.where(F.col("symbol") == s), config, [(s, [])], "holdout")]
    began = time.time()
    # a row for each symbol, as in the ledger that they go to
    found = {r.symbol: r for r in panel.run(bars, config).metrics.select("symbol", "sharpe", "total_return", "max_drawdown", "trades").collect()}
    out = []
    for r in bars.select("symbol").distinct().orderBy("symbol").collect():
        row = {"stage": "holdout", "arm": r.symbol, "changes": "", "symbol": r.symbol, "seconds": (time.time() - began) / max(1, len(found))}
        out.append(row | ({"status": "ok"} | found[r.symbol].asDict() if r.symbol in found else {"status": "failed: no usable folds"}))
    return out


def _swing_flags(df: DataFrame, k: int = 11) -> DataFrame:
    """Extremes marked on their own bar, against the bars before: causal, whatever its name says."""
    return df.withColumns({"swing_high_now": F.when(F.col("high") >= rolling(F.max, "high", k), 1.0).otherwise(0.0), "swing_low_now": F.when(F.col("low") <= rolling(F.min, "low", k), 1.0).otherwise(0.0)})


def _future_return(df: DataFrame, bars: int = 5) -> DataFrame:
    """The return of the coming bars as a feature: a leak on purpose."""
    return df.withColumn("future_return", lead("close", bars) / F.col("close") - 1)


LEAKS = {"honest": None, "swing": _swing_flags, "future": _future_return}


def lookahead(bars: DataFrame, config: Settings) -> list[dict]:
    """The same study without and with features that look ahead, to show what a leak does to results."""
    return [row for name, extra in LEAKS.items() for row in sweep(bars, config, [(name, [])], "lookahead", extra)]
