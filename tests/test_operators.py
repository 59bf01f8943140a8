"""Kernels and operators on small hand-made series: semantics, traps and properties."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regimespark.functions import stats
from regimespark.functions.windows import ewm, numbered, percent_rank, rolling_kurt, rolling_skew
from regimespark.operators import backtest, classification, features, folds, labels, metrics, models, regimes, signals, significance
from regimespark.operators import indicators as ind
from regimespark.plans import settings, study
from regimespark.plans.settings import Settings
from regimespark.sources import bars as src
from regimespark.sources import csv, store

START = dt.datetime(2024, 1, 1)


def walk(n, seed=1, symbol="A"):
    rng, price, rows = random.Random(seed), 100.0, []
    for i in range(n):
        o = price
        price = max(1.0, price * (1 + rng.gauss(0, 0.01)))
        rows.append((symbol, START + dt.timedelta(minutes=15 * i), o, max(o, price) * 1.002, min(o, price) * 0.998, price, float(rng.randint(1, 50))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


@pytest.fixture(scope="module")
def series(spark):
    return frame(spark, walk(700) + walk(300, 2, "B")).cache()


def column(df, name, symbol="A"):
    return [r[name] for r in df.where(F.col("symbol") == symbol).orderBy("ts").collect()]


@pytest.mark.parametrize("a", [2 / 201, 1 / 14, 0.2, 0.5])
def test_exponential_mean_equals_pandas(series, a):
    out = column(ewm(series, [("y", "close", a, 0)]), "y")
    want = pd.Series(column(series, "close")).ewm(alpha=a, adjust=False).mean()
    assert max(abs(x - y) for x, y in zip(out, want, strict=True)) < 1e-9


def test_exponential_mean_over_several_blocks(spark):
    df = frame(spark, walk(7000))
    out, want = column(ewm(df, [("y", "close", 2 / 101, 0)]), "y"), pd.Series(column(df, "close")).ewm(alpha=2 / 101, adjust=False).mean()
    assert max(abs(x - y) for x, y in zip(out, want, strict=True)) < 1e-9


def test_rolling_moments_and_rank_equal_pandas(series):
    out = series.withColumns({"s": rolling_skew("close", 50), "k": rolling_kurt("close", 50), "p": percent_rank("close", 50)})
    close = pd.Series(column(series, "close")).rolling(50)
    for name, want in (("s", close.skew()), ("k", close.kurt()), ("p", close.rank(pct=True))):
        for x, y in zip(column(out, name), want, strict=True):
            assert (x is None and math.isnan(y)) or abs(x - y) < 1e-7


def test_constant_series(spark):
    rows = [("A", START + dt.timedelta(hours=i), 5.0, 5.0, 5.0, 5.0, 1.0) for i in range(80)]
    df = frame(spark, rows)
    assert set(column(ind.rsi(df), "rsi_14")) == {50.0} and set(column(ind.money_flow_index(df), "mfi_14")) == {50.0}
    out = features.returns_block(df)
    assert column(out, "ret_skew_50")[-1] == 0.0 and column(out, "ret_kurt_50")[-1] == -3.0 and column(out, "ret_autocorr_50")[-1] is None
    assert set(column(ind.stochastic(df), "stoch_k")) == {None}


def test_first_adx_is_at_row_26(series):
    out = column(ind.directional_index(series), "adx_14")
    assert out[25] is None and out[26] is not None


def test_channel_is_of_the_bars_before(series):
    out, high = column(ind.donchian(series, 20), "dc_20_upper"), column(series, "high")
    assert out[19] is None and out[20] == max(high[:20])


def test_features_do_not_look_ahead(spark):
    rows = walk(640)
    whole = {r.ts: r for r in features.build_features(frame(spark, rows), ("returns", "structure", "session"), 300).collect()}
    part = {r.ts: r for r in features.build_features(frame(spark, rows[:560]), ("returns", "structure", "session"), 300).collect()}
    assert part and all(whole[t] == r for t, r in part.items())
    assert min(whole) == rows[519][1]


def test_unknown_block(series):
    with pytest.raises(ValueError):
        features.build_features(series, ("returns", "astrology"))


def test_triple_barrier_against_a_loop(series):
    df = ind.atr(series.where("symbol = 'A'"))
    rows = df.orderBy("ts").collect()
    got = {r.ts: (r.label, r.barrier_hit, r.holding_bars) for r in labels.triple_barrier(series, 10).where("symbol = 'A'").collect()}
    for i, r in enumerate(rows[:-10]):
        if r.atr_14 is None:
            assert r.ts not in got
            continue
        want = (0, "time", 10.0)
        for k in range(1, 11):
            up, down = rows[i + k].high >= r.close + r.atr_14, rows[i + k].low <= r.close - r.atr_14
            if up or down:
                want = (-1, "both", float(k)) if up and down else (1, "upper", float(k)) if up else (-1, "lower", float(k))
                break
        assert got[r.ts] == want
    assert len(got) == 700 - 13 - 10


def test_meta_labels_only_where_a_trade_is_proposed(series):
    out = labels.meta(series, "rsi_mean_reversion", 10)
    assert out.where("label <> 0 AND label <> primary").count() == 0 and out.where("primary = 0").count() == 0
    assert set(out.select("barrier_hit").distinct().toPandas()["barrier_hit"]) <= {"profit", "stop", "both", "time"}


def test_minimum_holding(spark):
    wanted = [0, 1, 0, 0, -1, -1, 1, 1, 1, 0, 0]
    df = spark.createDataFrame([("A", START + dt.timedelta(hours=i), float(x)) for i, x in enumerate(wanted)], "symbol string, ts timestamp_ntz, signal double")
    assert column(signals.min_holding(df, 3), "signal") == [0, 1, 1, 1, -1, -1, -1, 1, 1, 1, 0]


def test_session_filter_freezes_the_signal(spark):
    df = spark.createDataFrame([("A", START + dt.timedelta(hours=h), float(x)) for h, x in ((7, 1), (8, -1), (9, 0), (20, 1), (32, 1))], "symbol string, ts timestamp_ntz, signal double")
    assert column(signals.session_filter(df, [8, 9]), "signal") == [0, -1, 0, 0, 1]


def test_backtest_costs_and_trades(spark):
    rows = [("A", START + dt.timedelta(hours=i), p, p, p, p, 1.0) for i, p in enumerate([100.0, 110.0, 121.0, 121.0, 100.0])]
    df = frame(spark, rows).withColumn("signal", F.when(F.hour("ts") < 2, 1.0).otherwise(0.0))
    out = backtest.run(df, friction_bps=10, hold=1)
    assert [round(x, 6) for x in column(out, "strategy_return")] == [0.0, 0.099, 0.0, -0.001, 0.0]
    t = backtest.trades(out).collect()
    assert len(t) == 1 and (t[0].entry_price, t[0].exit_price, t[0].bars, t[0].side) == (110.0, 121.0, 2, "long") and abs(t[0]["return"] - 0.099) < 1e-9


def test_trades_partition_the_invested_bars(series):
    out = backtest.run(signals.rsi_mean_reversion(series), hold=5).cache()
    trades = backtest.trades(out)
    assert trades.agg(F.sum("bars")).first()[0] == out.where("side <> 0").count()
    m = metrics.performance(out, 24_960, trades).where("symbol = 'A'").first()
    r = pd.Series(column(out, "strategy_return"))
    assert abs(m.skew - r.skew()) < 1e-9 and abs(m.kurtosis - r.kurtosis()) < 1e-8 and abs(m.var_95 - r.quantile(0.05)) < 1e-12
    assert abs(m.sharpe - r.mean() / r.std(ddof=0) * math.sqrt(24_960)) < 1e-9
    assert set(metrics.METRICS) <= set(m.asDict())


def test_folds():
    f = folds.walk_forward(14_467, n_folds=3)
    assert [(x.test_start, x.train_stop - x.train_start, x.test_end - x.test_start) for x in f] == [(3617, 3569, 1736), (7234, 7186, 1736), (10850, 10802, 1736)]
    assert [x.test_start for x in folds.walk_forward(38_141, n_folds=3)] == [9535, 19_070, 28_606]
    with pytest.raises(ValueError):
        folds.walk_forward(50)
    with pytest.raises(ValueError):
        folds.walk_forward(5000, scheme="sideways")


def test_classification_of_a_known_matrix(spark):
    cells = {(-1, -1): 1661, (-1, 0): 637, (-1, 1): 291, (0, 0): 1, (1, -1): 1540, (1, 0): 806, (1, 1): 272}
    df = spark.createDataFrame([(a, p) for (a, p), n in cells.items() for _ in range(n)], "label int, prediction int")
    m = classification.summary(df).first()
    want = {"accuracy": 0.371352, "balanced_accuracy": 0.581819, "matthews_corrcoef": 0.022087, "cohen_kappa": 0.017828, "macro_f1": 0.248716, "directional_precision": 0.513550, "sign_error_rate": 0.486450}
    for k, v in want.items():
        assert abs(m[k] - v) < 1e-6, k
    assert [tuple(r)[2:] for r in classification.confusion(df).orderBy("actual").collect()] == [(1661, 637, 291), (0, 1, 0), (1540, 806, 272)]


def test_distributions():
    assert abs(stats.student_cdf(-1.886, 2) - 0.1) < 1e-3 and abs(stats.student_cdf(0.0, 5) - 0.5) < 1e-12 and abs(stats.student_cdf(2.228, 10) - 0.975) < 1e-4
    assert abs(stats.normal_cdf(1.96) - 0.975) < 1e-4 and abs(stats.binomial_tail(5, 10) - 0.623046875) < 1e-12
    x = -1.17978 / math.sqrt(6240)
    assert abs(stats.normal_cdf(x * math.sqrt(5207) / math.sqrt(1 - 22.06 * x + 1257.5 / 4 * x * x)) - 0.181) < 2e-3


def test_distributions_as_columns(spark):
    xs = [-40.0, -8.5, -3.1, -1.0, -1e-9, 0.0, 0.3, 1.96, 5.0, 9.0, 30.0, None, float("nan")]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(stats.normal_probability(F.col("x"))).collect()]
    assert got[-2:] == [None, None] and all(abs(g - stats.normal_cdf(x)) < 1e-14 for g, x in zip(got, xs[:-2], strict=False))
    pairs = [(t, n) for t in (-3.0, -0.2, 0.0, 0.7, 2.5, 20.0) for n in (1, 2, 3, 4, 7, 10, 61)]
    got = [r[0] for r in spark.createDataFrame(pairs, "t double, n int").select(stats.student_probability(F.col("t"), F.col("n"))).collect()]
    assert all(abs(g - stats.student_cdf(t, n)) < 1e-9 for g, (t, n) in zip(got, pairs, strict=True))


def test_fold_stability(spark):
    rows = [("a", -3.2163), ("a", -3.7887), ("a", 0.1162), ("a", float("nan")), ("a", None), ("one", 2.0), ("none", float("inf"))]
    df = spark.createDataFrame(rows, "symbol string, sharpe double")
    s = significance.fold_stability(df.where("symbol = 'a'")).first()
    assert abs(s["mean"] + 2.2963) < 1e-4 and abs(s["t_statistic"] + 1.886) < 1e-3 and abs(s["p_value"] - 0.9) < 1e-3 and s["folds"] == 3
    by = {r.symbol: r for r in significance.fold_stability(df, key="symbol").collect()}
    assert by["a"].p_value == s.p_value and by["one"].t_statistic is None and by["one"]["std"] == 0 and "none" not in by
    assert significance.fold_stability(df.limit(0)).first().folds == 0


def test_bootstrap_is_repeatable_and_centred(series):
    out = backtest.run(signals.buy_and_hold(series.where("symbol = 'A'")), hold=1).select("symbol", "ts", "strategy_return").cache()
    a, b = (significance.bootstrap_interval(x, 100, mean_block=20).first() for x in (out, out.repartition(3)))
    assert all(abs(a[k] - b[k]) < 1e-9 for k in ("sharpe", "lower", "upper", "bootstrap_mean")) and a.lower < a.bootstrap_mean < a.upper and a.samples == 100


def test_regime_runs_and_transitions(spark):
    codes = [0, 0, 1, 1, 1, 0, 2]
    df = spark.createDataFrame([("A", START + dt.timedelta(hours=i), x) for i, x in enumerate(codes)], "symbol string, ts timestamp_ntz, regime int")
    assert [r.bars for r in regimes.run_lengths(df).orderBy("start").collect()] == [2, 3, 1, 1]
    t = {(r["from"], r["to"]): r.value for r in regimes.transitions(df).collect()}
    assert len(t) == 9 and t[0, 0] == pytest.approx(1 / 3) and t[1, 1] == pytest.approx(2 / 3) and t[2, 0] == 0
    assert regimes.persistence(df).first().persistence == pytest.approx(3 / 7)
    assert regimes.named(df, {0: "calm"}).where("regime = 2").first().regime_name == "Regime 2"


def test_regime_names():
    rows = [{"regime": i, "trend_strength": t, "vol_percentile": v} for i, (t, v) in enumerate([(2.0, 0.9), (-2.0, 0.1), (0.1, 0.2), (0.0, 0.1)])]
    assert regimes.regime_names(rows) == {0: "Uptrend, high-volatility", 1: "Downtrend, quiet", 2: "Range, high-volatility", 3: "Range, quiet"}


def test_learners(spark):
    rng = random.Random(1)
    rows = [(x, y, 1 if x > 0.3 else -1 if x < -0.3 else 0) for x, y in ((rng.uniform(-1, 1), rng.gauss(0, 1)) for _ in range(600))]
    df = spark.createDataFrame([(*r[:2], r[2]) for r in rows] + [(None, 0.0, 0)], "x double, y double, label int").cache()
    for m in (models.build("logistic", {"C": 100.0}), models.build("random_forest", {"n_estimators": 10, "minInstancesPerNode": 2}, top=1), models.build("random_forest", {"numTrees": 5}, seeds=2), models.build("lightgbm", {"n_estimators": 3, "min_child_samples": 2})):
        m.fit(df, ["x", "y"])
        out = models.predict(m.predict_proba(df))
        assert out.where("prediction = label").count() > 400 and abs(out.agg(F.max(F.expr("abs(p_short + p_flat + p_long - 1)"))).first()[0]) < 1e-9
        assert max(m.importance(), key=m.importance().get) == "x"
    with pytest.raises(RuntimeError):
        models.build("lstm")
    with pytest.raises(ValueError):
        models.build("oracle")


def test_settings_overrides():
    c = Settings().but("model.name=logistic", "validation.n_folds=3", "backtest.session_hours=[8,9]", 'model.params={"C": 2}')
    assert (c["model.name"], c["validation.n_folds"], c["backtest.session_hours"], c["model.params"]) == ("logistic", 3, [8, 9], {"C": 2})
    assert Settings(c.to_dict()).to_dict() == c.to_dict() and Settings()["model.name"] == "xgboost"
    for wrong in ("model.colour=red", "colour=red", "model=red", "model.name.x=1"):
        with pytest.raises((KeyError, ValueError)):
            Settings().but(wrong)
    for wrong in ("model.name=oracle", "validation.n_folds=0", "validation.test_size=1.5", "model.class_balance=1", "backtest.session_hours=[24]", "regime.method=7"):
        with pytest.raises(ValueError, match="no value"):
            Settings().but(wrong)


def test_settings_files(tmp_path):
    for section, values in Settings().to_dict().items():
        assert all(settings.TABLE[f"{section}.{k}"][1](v) for k, v in values.items())
    text = "experiment: {name: trial, seed: 3}\ndata:\n  start: 2024-01-05\n  end: null\n  timeframe: M15\nfeatures:\n  trend_windows: [10, 30]\nmodel: {name: lightgbm, params: {n_estimators: 5}}\n"
    (tmp_path / "study.yaml").write_text(text)
    s = settings.read(str(tmp_path / "study.yaml"))
    assert (s["experiment.seed"], str(s["data.start"]), s["features.trend_windows"], s["model.params"]["n_estimators"], s["regime.method"]) == (3, "2024-01-05", [10, 30], 5, "kmeans")
    (tmp_path / "study.json").write_text(s.to_json())
    assert settings.read(str(tmp_path / "study.json")).to_json() == s.to_json()
    (tmp_path / "bad.yaml").write_text("model: {colour: red}\n")
    with pytest.raises(KeyError, match="model.colour"):
        settings.read(str(tmp_path / "bad.yaml"))


def test_settings_reach_the_features(series):
    cfg = Settings().but('features.blocks=["returns","trend","volatility"]', "features.return_horizons=[1,7]", "features.trend_windows=[9,33]", "features.volatility_windows=[11,40]", "data.start=2024-01-02", "data.warmup_bars=250", "labeling.horizon=8")
    names = set(study.prepare(series, cfg).columns)
    assert {"ret_7", "ret_7_norm", "ema_9_33_spread_atr", "realised_vol_11", "atr_40_rel"} <= names and not {"ret_5", "ema_20_dist_atr", "atr_50_rel"} & names
    assert study.prepare(series, cfg).agg(F.min("ts")).first()[0] >= dt.datetime(2024, 1, 2) + dt.timedelta(minutes=15 * 250)


def test_csv_cleaning_and_catalogue(spark, tmp_path):
    folder = tmp_path / "data"
    folder.mkdir()
    (folder / "EURUSD_H1_20240101_20240102.csv").write_text(
        "Time,Open,High,Low,Close,Vol\n2024-01-01 00:00:00,1,2,0.5,1.5,10\n2024-01-01 01:00:00,1,2,0.5,1.5,10\n2024-01-01 01:00:00,1,3,0.5,2,11\n2024-01-01 02:00:00,1,0.5,2,1,1\n"
        "2024-01-01 03:00:00,0,2,0,1,1\nnot a time,1,2,0.5,1,1\n2024-01-01 04:00:00,1,2,0.5,x,1\n2024-01-01 05:00:00,1,2,0.5,1,\n2024.01.01 06:00,1,2,0.5,1,7\n"
    )
    (folder / "EURUSD_XX_20240101_20240102.csv").write_text("a\n")
    (folder / "ABC_D1_20240101_20240102.csv").write_text("stamp,o,h,l,c\n1704067200,1,2,1,2\n1704153600,2,3,2,3\n")
    table = csv.catalogue(spark, [str(folder)])
    assert csv.symbols(table) == ["ABC", "EURUSD"] and csv.timeframes(table, "eurusd") == ["H1"]
    bars = csv.load(spark, [str(folder)], "EURUSD", "H1")
    assert [(r.ts.hour, r.close, r.volume) for r in bars.orderBy("ts").collect()] == [(0, 1.5, 10.0), (1, 2.0, 11.0), (6, 1.0, 7.0)]
    assert [(r.ts, r.volume) for r in csv.load(spark, [str(folder)], "ABC", "D1").orderBy("ts").collect()] == [(dt.datetime(2024, 1, 1), 1.0), (dt.datetime(2024, 1, 2), 1.0)]
    with pytest.raises(LookupError):
        csv.find(table, "GBPUSD", "H1")
    with pytest.raises(ValueError):
        csv.load(spark, [str(folder)], "EURUSD", "H1", start="2030-01-01")
    written = csv.export(bars, str(tmp_path / "out"), "H1")
    assert written[0].endswith("EURUSD_H1_20240101_20240101.csv") and csv.read_ohlcv(spark, written[0], "EURUSD").count() == 3
    assert csv.load(spark, [str(tmp_path / "out"), str(folder)], "EURUSD", "H1", last=2).count() == 2
    (tmp_path / "plain_D1.csv").write_text(",open,high,low,price\n2024-01-01,1,2,1,2\n")
    assert csv.read_ohlcv(spark, str(tmp_path / "plain_D1.csv")).first().symbol == "PLAIN"


def test_store(spark, tmp_path):
    root = str(tmp_path)
    store.save(spark, root, "r1", {"symbol": "A", "model": "m"}, {"created_at": "2024", "metrics": {"sharpe": 1.0}}, {"trades": spark.range(3), "confusion": None})
    store.save(spark, root, "r2", {"symbol": "B", "model": "m"}, {"created_at": "2025", "metrics": {"sharpe": None}}, {})
    assert [r.run_id for r in store.runs(spark, root).collect()] == ["r2", "r1"]
    assert store.comparison(spark, root).where("symbol = 'A'").first().sharpe == 1.0
    table = store.comparison(spark, root)
    assert store.filtered(table, symbol="A").count() == table.where("symbol = 'A'").count() and store.filtered(table, symbol="none").count() == 0
    store.export_csv(table, str(tmp_path / "table"))
    assert spark.read.option("header", True).csv(str(tmp_path / "table")).count() == table.count()
    summary, tables = store.load(spark, root, "r1")
    assert summary["metrics"]["sharpe"] == 1.0 and tables["trades"].count() == 3 and list(tables) == ["trades"]
    assert store.delete(spark, root, "r1") and store.runs(spark, root).count() == 1
    with pytest.raises(LookupError):
        store.load(spark, root, "r1")
    rows = spark.createDataFrame([("ok", "search", 1.0, 0.1, 2.0), ("ok", "holdout", 1.0, 0.1, 2.0), ("failed", "search", None, None, None)], "status string, stage string, sharpe double, lower double, upper double")
    store.append_ledger(rows, f"{root}/ledger")
    store.append_ledger(rows.withColumn("more", F.lit(1)), f"{root}/ledger")
    got = store.ledger_summary(store.ledger(spark, f"{root}/ledger")).first()
    assert (got.completed, got.positive, got.survivors) == (2, 2, 2)


def test_week_and_month_bars(spark):
    rows = [("A", dt.datetime(2024, 1, d), float(d), d + 0.5, d - 0.5, d + 0.1, 1.0) for d in range(1, 16)]
    week = {r.ts.date(): r for r in src.resample(frame(spark, rows), "W1").collect()}
    assert week[dt.date(2024, 1, 7)].open == 1.0 and week[dt.date(2024, 1, 7)].close == 7.1 and week[dt.date(2024, 1, 21)].volume == 1.0
    assert src.resample(frame(spark, rows), "MN1").first().ts == dt.datetime(2024, 1, 1)


def test_streams_equal_batches(spark, tmp_path, series):
    from regimespark.streaming.bars import stream_bars, stream_min_holding

    ticks = spark.range(400).select((F.lit(1_704_067_200) + F.col("id") * 60).cast("timestamp").alias("ts"), (F.col("id") % 17 + 1.0).alias("p"), "id", F.lit("A").alias("s"))
    ticks.repartition(1).write.parquet(str(tmp_path / "ticks"))
    live = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks"))
    q = stream_bars(live, "M15", F.col("s"), F.col("p"), F.col("id")).writeStream.format("memory").queryName("bars_live").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = src.tick_bars(ticks.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "M15", F.col("s"), F.col("p"), F.col("id"))
    got = [tuple(r) for r in spark.table("bars_live").orderBy("ts").select("open", "high", "low", "close", "volume").collect()]
    assert got == [tuple(r) for r in batch.orderBy("ts").select("open", "high", "low", "close", "volume").collect()]

    sig = signals.rsi_mean_reversion(series).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "signal")
    sig.repartition(1).write.parquet(str(tmp_path / "sig"))
    live = spark.readStream.schema(sig.schema).parquet(str(tmp_path / "sig"))
    q = stream_min_holding(live, 5).writeStream.format("memory").queryName("held_live").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = signals.min_holding(signals.rsi_mean_reversion(series), 5).select("symbol", "ts", "signal").orderBy("symbol", "ts").collect()
    assert [(r.symbol, r.signal) for r in spark.table("held_live").orderBy("symbol", "ts").collect()] == [(r.symbol, r.signal) for r in want]


def test_numbered(series):
    assert numbered(series).groupBy("symbol").agg(F.max("rn")).where("symbol = 'B'").first()[1] == 299


def test_metrics_are_shown_by_kind(spark):
    row = dict.fromkeys(metrics.METRICS, 0.12345) | {"bars": 12345.0, "trades": 7.0, "sortino": float("inf"), "calmar": None, "skew": float("nan"), "sharpe": 1234.5678}
    row = {k: None if v is None else float(v) for k, v in row.items()}
    schema = "symbol string, " + ", ".join(f"{m} double" for m in metrics.METRICS)
    out = metrics.formatted(spark.createDataFrame([("A", *(row[m] for m in metrics.METRICS))], schema)).first()
    assert (out.total_return, out.bars, out.trades, out.sharpe, out.payoff_ratio) == ("12.35%", "12,345", "7", "1234.568", "0.123")
    assert (out.sortino, out.calmar, out.skew) == ("n/a", "n/a", "n/a")


def test_bootstrap_blocks_against_drawn_series(spark):
    rng = np.random.default_rng(3)
    r = rng.normal(0.001, 0.01, 400)
    rows = spark.createDataFrame([("A", i, float(x)) for i, x in enumerate(r)], "symbol string, t long, strategy_return double").selectExpr("symbol", "cast(timestamp_seconds(t) as timestamp_ntz) AS ts", "strategy_return")
    out = significance.bootstrap_sharpes(rows, 400, 10_000, mean_block=10).toPandas()["sharpe"]
    mean, spread = r.mean() / r.std() * 100, math.sqrt(10_000 / 400)
    assert len(out) == 400 and abs(out.mean() - mean) < 3 * spread / math.sqrt(100) and 0.6 * spread < out.std() < 1.6 * spread
    whole = significance.bootstrap_sharpes(rows, 5, 10_000, mean_block=1e9).toPandas()["sharpe"]
    assert np.allclose(whole, mean)  # one block that wraps round is the series itself
    assert len(significance.bootstrap_sharpes(rows, 50, 10_000, mean_block=1).toPandas()) == 50


def test_cleaned_bars_keep_the_last_of_equal_times(spark):
    from regimespark.sources.bars import cleaned

    day = START
    rows = [("A", day, 1.0, 2.0, 1.0, 2.0, 5.0, 1), ("A", day, 1.0, 3.0, 1.0, 3.0, 5.0, 2), ("A", day + dt.timedelta(1), 1.0, 0.5, 1.0, 2.0, 5.0, 3), ("A", None, 1.0, 2.0, 1.0, 2.0, 5.0, 4)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, k int")
    assert [tuple(r) for r in cleaned(df, "k").collect()] == [("A", day, 1.0, 3.0, 1.0, 3.0, 5.0)]
    assert cleaned(df.limit(0), "k").count() == 0


def test_held_positions_across_batches(spark):
    """Small Arrow batches and several symbols give what one walk over each symbol's signals gives."""
    rng = np.random.default_rng(5)
    start = START
    rows = [(s, start + dt.timedelta(minutes=i), float(x)) for s in "ABC" for i, x in enumerate(rng.integers(-1, 2, 200).repeat(rng.integers(1, 6, 200))[:300])]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, signal double")
    want, state = [], {}
    for s, t, x in rows:
        now, held = state.get(s, (0.0, 0))
        held += 1
        if (now == 0 or held > 7) and x != now:
            now, held = x, 1
        state[s] = now, held
        want.append((s, t, now))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        got = sorted(tuple(r) for r in signals.min_holding(df, 7).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted(want)
