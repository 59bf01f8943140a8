"""One small study end to end."""

from types import SimpleNamespace

import pytest

from regimespark import queries
from regimespark.operators import models
from regimespark.plans import panel, search, study
from regimespark.plans.settings import Settings
from regimespark.sources import bars as src
from regimespark.sources import store


def test_study(spark, tmp_path):
    bars = src.from_events(spark, "/root/testdata/sf0.01", "M15", 10_000.0).where("symbol = 'click'")
    cfg = Settings().but(
        'features.blocks=["returns","session"]', "model.name=logistic", 'model.params={"maxIter":5}', "regime.method=rule", "validation.n_folds=2", "validation.test_size=0.2", "validation.embargo_bars=10",
        "labeling.horizon=8", "backtest.min_holding_bars=4", "evaluation.bootstrap_samples=20", "model.decision_threshold=0.4",
    )
    out = study.run(bars, cfg)
    n = out.predictions.count()
    assert n == sum(r.test_bars for r in out.tables["fold_layout"].collect()) and out.summary["folds"] == 2
    assert out.predictions.where("abs(p_short + p_flat + p_long - 1) > 1e-9").count() == 0
    assert out.equity.count() == n and out.tables["baselines"].count() == 5 and out.tables["confusion"].count() == 3
    assert 0 <= out.summary["significance"]["probabilistic_sharpe"] <= 1
    assert study.verdict(out.summary) in {"positive beyond chance", "negative beyond chance", "not told from chance"}
    store.save(spark, str(tmp_path), out.run_id, cfg.to_dict(), out.summary, {"predictions": out.predictions, "confusion": out.tables["confusion"]})
    assert store.load(spark, str(tmp_path), out.run_id)[1]["predictions"].count() == n


def test_sweep_lists_failed_arms(spark):
    bars = src.from_events(spark, "/root/testdata/sf0.001", "H1", 10_000.0).where("symbol = 'click'")
    rows = study.sweep(bars, Settings(), [("lstm", ["model.name=lstm"])])
    assert rows[0]["status"].startswith("failed") and rows[0]["seconds"] >= 0


def test_a_leak_is_seen_in_the_features_only(spark):
    bars = src.from_events(spark, "/root/testdata/sf0.01", "M15", 10_000.0).where("symbol = 'click'")
    cfg = Settings().but('features.blocks=["session"]', "labeling.horizon=8")
    plain, leaky = study.prepare(bars, cfg), study.prepare(bars, cfg, study.LEAKS["future"])
    assert set(leaky.columns) - set(plain.columns) == {"future_return"} and leaky.count() <= plain.count()
    assert set(study.prepare(bars, cfg, study.LEAKS["swing"]).columns) - set(plain.columns) == {"swing_high_now", "swing_low_now"}


def test_learners_that_are_not_built_raise_with_their_package_there(spark, monkeypatch):
    monkeypatch.setattr(models.importlib.util, "find_spec", lambda name: object())
    missing = {"lstm", "gru"}
    for name in missing:
        with pytest.raises(RuntimeError, match="not built"):
            models.build(name)
    assert {r.model for r in models.catalogue(spark).where("NOT built AND NOT available").collect()} == missing


PANEL = ['features.blocks=["returns","session"]', "regime.method=none", "validation.n_folds=2", "validation.test_size=0.2", "validation.embargo_bars=10", "labeling.horizon=8", "backtest.min_holding_bars=4", "evaluation.bootstrap_samples=20", "model.decision_threshold=0.4"]


def test_panel_equals_the_studies_of_its_symbols(spark):
    bars = src.from_events(spark, "/root/testdata/sf0.01", "M15", 10_000.0).where("symbol IN ('click', 'view')")
    cfg = Settings().but(*PANEL, "model.name=logistic", 'model.params={"maxIter":5000}')
    out = panel.run(bars, cfg)
    seen = {r.symbol: r for r in out.metrics.collect()}
    assert set(seen) == {"click", "view"} and out.fold_metrics.count() == 4
    one = study.run(bars.where("symbol = 'click'"), cfg)
    joined = one.predictions.alias("a").join(out.predictions.alias("b"), ["symbol", "ts"])
    assert joined.count() == one.predictions.count() and joined.where("abs(a.p_long - b.p_long) > 1e-5 OR a.label <> b.label OR a.fold <> b.fold").count() == 0
    assert abs(seen["click"].sharpe - one.summary["metrics"]["sharpe"]) < 1e-6
    held = study.holdout(bars, cfg)
    assert [r["symbol"] for r in held] == ["click", "view"] and held[0]["sharpe"] == seen["click"].sharpe


def test_panel_of_boosted_trees(spark):
    bars = src.from_events(spark, "/root/testdata/sf0.001", "M15", 10_000.0)
    cfg = Settings().but(*PANEL, "model.name=lightgbm", 'model.params={"n_estimators":2,"min_child_samples":10}', "data.warmup_bars=20", "validation.min_train_size=0.4")
    out = panel.run(bars, cfg)
    assert out.predictions.where("abs(p_short + p_flat + p_long - 1) > 1e-9").count() == 0
    assert out.predictions.select("symbol").distinct().count() == out.bounds.select("symbol").distinct().count()
    with pytest.raises(ValueError, match="one plan"):
        panel.run(bars, cfg.but("model.name=random_forest"))


def test_arms_run_at_a_time_and_share_their_rows(spark, monkeypatch):
    bars = src.from_events(spark, "/root/testdata/sf0.01", "M15", 10_000.0).where("symbol = 'click'")
    base = Settings().but(*PANEL, "model.name=logistic", 'model.params={"maxIter":5}', "data.timeframe=M15")
    made, real = [], study.prepare
    monkeypatch.setattr(study, "prepare", lambda *a: made.append(1) or real(*a))
    arms = [("a", []), ("b", ["model.decision_threshold=0.45"]), ("c", ["model.name=lstm"]), ("d", ["labeling.horizon=6"])]
    rows = study.sweep(bars, base, arms, workers=3)
    assert len(made) == 2 and {r["arm"] for r in rows} == {"a", "b", "c", "d"} and rows[-1]["arm"] == "c"
    assert rows[-1]["status"].startswith("failed") and "Traceback" in rows[-1]["error"]
    alone = study.sweep(bars, base, arms[:2], workers=1)
    assert {r["arm"]: r["sharpe"] for r in alone} == {r["arm"]: r["sharpe"] for r in rows if r["arm"] in "ab"}


def test_the_arms_are_listed_and_their_changes_are_settings():
    listed = search.arms()
    assert len(listed) == 28 and len({(s, a) for s, a, _ in listed}) == 28
    for _, _, changes in listed:
        Settings().but(*search.COMMON, *changes)
    with pytest.raises(KeyError):
        search.arms("nonsense")


def test_the_boosted_query_takes_all_rounds_of_its_learner(spark, data, monkeypatch):
    seen = []
    monkeypatch.setattr(panel, "run", lambda bars, config: seen.append(config) or SimpleNamespace(metrics=bars))
    queries.QUERIES["study_boosted"](spark, data)
    assert models.settings_of(seen[0]["model.name"], seen[0]["model.params"]) == models.SPECS["lightgbm"].defaults and models.SPECS["lightgbm"].defaults["rounds"] == 500
