"""Registered queries of walk-forward studies, learners and significance, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import oracles as o
from .functions.ranges import numbered_apart
from .functions.windows import lag, numbered
from .operators import backtest, boosting, keyed, labels, metrics, regimes, signals, significance
from .operators import indicators as ind
from .operators.boosting import Boosting
from .operators.features import DESCRIPTORS
from .plans import panel
from .plans.settings import Settings
from .queries import _DESC_ROWS, _PRICED, _REG, _RSI_SIG, _TB, _TRADES, M15_YEAR, ORACLE_SQL, crossover_result, cte, described, held, m15, metric_ctes, priced, register, ruled

# ---------------------------------------------------------------- series in ranges

#: Rows of a range in the queries; the shortest series has several.
RANGE = 256


@register("bt_min_hold_ranges", o.sql(o.bars(), _RSI_SIG, held(), "SELECT s.symbol, s.ts, h.now AS signal FROM s JOIN h ON s.symbol = h.symbol AND s.rn = h.rn"))
def _(spark, d):
    """The holding rule with every symbol cut into ranges that run side by side."""
    rows = numbered_apart(signals.rsi_mean_reversion(m15(spark, d)).select("symbol", "ts", "signal")).withColumn("range", F.expr(f"rn div {RANGE}"))
    return signals.min_holding_in_ranges(rows, 24).select("symbol", "ts", "signal")


@register("bt_equity_ranges", ORACLE_SQL["bt_equity"])
def _(spark, d):
    """Pricing with every symbol cut into ranges."""
    out = backtest.run_in_ranges(signals.ma_crossover(m15(spark, d)), RANGE, bars_per_year=M15_YEAR)
    return out.select("symbol", "ts", "position", *(F.round(c, 4 if c == "equity" else 8).alias(c) for c in ("cost", "strategy_return", "equity", "drawdown")))


# ---------------------------------------------------------------- folds and training statistics of all symbols


def bounds_ctes() -> list[str]:
    """CTE fb: the expanding folds of each symbol by its own number of labelled rows in lr."""
    return [
        "pa AS (SELECT symbol, count(*) AS n, greatest(1, round_even(count(*) * 0.12, 0))::BIGINT AS test, greatest(1, round_even(count(*) * 0.25, 0))::BIGINT AS train FROM lr GROUP BY 1)",
        "fa AS (SELECT *, i, round_even(train + i * ((n - train) / 6.0::DOUBLE), 0)::BIGINT AS s FROM pa, range(6) x(i) WHERE n - train >= test)",
        "fb AS MATERIALIZED (SELECT symbol, (row_number() OVER (PARTITION BY symbol ORDER BY i) - 1)::INT AS fold, 0::BIGINT AS train_start, greatest(0, s - 48) AS train_stop, s AS test_start, least(n, s + test) AS test_end"
        " FROM fa WHERE least(n, s + test) - s >= greatest(1, test // 2) AND greatest(0, s - 48) >= 100)",
    ]


# labelled bars with a few features in whole steps
_LR = [
    *_TB, *o.rsi(14, "rs", "b"),
    cte("lf0", f"close / {o.lag('close', 4)} - 1 AS change", "rs"),
    f"lr AS MATERIALIZED (SELECT tb.symbol, tb.ts, tb.label, lf0.volume, lf0.change * 1e4 AS change, floor(round(rsi_14 / 2, 6)) AS rsi, hour(tb.ts)::DOUBLE AS hour, row_number() OVER (PARTITION BY tb.symbol ORDER BY tb.ts) - 1 AS rn FROM tb JOIN lf0 ON tb.symbol = lf0.symbol AND tb.rn = lf0.rn)",
]
INPUTS = ["rsi", "hour", "volume", "change"]


def labelled(spark, d) -> DataFrame:
    b = ind.rsi(m15(spark, d), 14)
    rows = b.withColumn("change", (F.col("close") / lag("close", 4) - 1) * 1e4)
    marked = labels.triple_barrier(m15(spark, d)).select("symbol", "ts", "label")
    out = rows.join(marked, ["symbol", "ts"]).select("symbol", "ts", "label", "volume", "change", F.floor(F.round(F.col("rsi_14") / 2, 6)).cast("double").alias("rsi"), F.hour("ts").cast("double").alias("hour"))
    return numbered(out)


@register("folds_by_symbol", o.sql(o.bars(), _LR, bounds_ctes(), "SELECT * FROM fb"))
def _(spark, d):
    """Walk-forward bounds of every symbol by its own length."""
    return keyed.fold_bounds(labelled(spark, d))


@register("ml_class_weights", o.sql(
    o.bars(), _LR, bounds_ctes(), "ct AS (SELECT lr.symbol, fold, label, count(*) AS rows FROM lr JOIN fb ON lr.symbol = fb.symbol AND rn >= train_start AND rn < train_stop GROUP BY 1, 2, 3)",
    "SELECT symbol, fold, label, rows, round(sum(rows) OVER w / (count(*) OVER w * rows), 9)::DOUBLE AS weight FROM ct WINDOW w AS (PARTITION BY symbol, fold)"))
def _(spark, d):
    """Balanced class weights of every symbol and fold."""
    rows = labelled(spark, d)
    return keyed.class_weights(rows, keyed.fold_bounds(rows)).withColumn("weight", F.round("weight", 9))


@register("ml_scales", o.sql(
    o.bars(), _LR, bounds_ctes(),
    " UNION ALL ".join(f"SELECT lr.symbol, fold, '{c}' AS feature, round(coalesce(avg({c}), 0), 6) AS mean, round(coalesce(nullif(stddev_pop({c}), 0), 1), 6) AS sd FROM lr JOIN fb ON lr.symbol = fb.symbol AND rn >= train_start AND rn < train_stop GROUP BY 1, 2" for c in INPUTS)))
def _(spark, d):
    """Means and deviations of the training rows of every symbol and fold."""
    rows = labelled(spark, d)
    out = keyed.scales(rows, keyed.fold_bounds(rows), INPUTS)
    long = out.select("symbol", "fold", F.explode(F.arrays_zip(F.array(*map(F.lit, INPUTS)).alias("feature"), "mean", "sd")).alias("x"))
    return long.select("symbol", "fold", F.col("x.feature"), F.round("x.mean", 6).alias("mean"), F.round("x.sd", 6).alias("sd"))


# ---------------------------------------------------------------- learners

_CUTS = [i + 0.5 for i in range(63)]


def _split_ctes(level: int) -> list[str]:
    """CTEs k{level} and r{level + 1}: the best split of each node of r{level}, and the rows one level below."""
    r, values = f"r{level}", ", ".join(f"({i}, least({c}, 63)::INT)" for i, c in enumerate(INPUTS[:3]))
    return [
        f"c{level} AS MATERIALIZED (SELECT symbol, class, node, feature, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM (SELECT {r}.symbol, class, node, g, h, unnest([0, 1, 2]) AS feature, unnest([b0, b1, b2]) AS bin FROM {r}) GROUP BY ALL)",
        f"s{level} AS MATERIALIZED (SELECT *, sum(g) OVER u AS gl, sum(h) OVER u AS hl, sum(n) OVER u AS nl, sum(g) OVER t AS gt, sum(h) OVER t AS ht, sum(n) OVER t AS nt FROM c{level} WINDOW u AS (PARTITION BY symbol, class, node, feature ORDER BY bin ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY symbol, class, node, feature))",
        f"q{level} AS MATERIALIZED (SELECT *, CASE WHEN nl >= 20 AND nt - nl >= 20 AND hl >= 0.001 AND ht - hl >= 0.001 THEN round(gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1), 6) END AS gain FROM s{level})",
        f"k{level} AS MATERIALIZED (SELECT symbol, class, node, arg_max(feature, struct_pack(a := gain, b := -feature, c := -bin)) FILTER (WHERE gain > 0) AS feature, arg_max(bin, struct_pack(a := gain, b := -feature, c := -bin)) FILTER (WHERE gain > 0) AS bin,"
        f" max(gain) FILTER (WHERE gain > 0) AS gain, arg_min(-0.1::DOUBLE * gt / (ht + 1), struct_pack(a := feature, b := bin)) AS value FROM q{level} GROUP BY 1, 2, 3)",
        f"r{level + 1} AS MATERIALIZED (SELECT r.symbol, r.class, r.node || CASE WHEN [b0, b1, b2][k.feature + 1] <= k.bin THEN 'L' ELSE 'R' END AS node, b0, b1, b2, g, h FROM {r} r JOIN k{level} k ON r.symbol = k.symbol AND r.class = k.class AND r.node = k.node WHERE k.gain IS NOT NULL)",
    ]


@register("ml_boosted_trees", o.sql(
    o.bars(), _LR, "pc AS (SELECT symbol, class, greatest(sum((label + 1 = class)::INT) / count(*), 1e-9) AS p FROM lr, range(3) x(class) GROUP BY 1, 2)", "pn AS (SELECT symbol, class, p / sum(p) OVER (PARTITION BY symbol) AS p FROM pc)",
    "r0 AS MATERIALIZED (SELECT lr.symbol, class, '' AS node, least(rsi, 63)::INT AS b0, least(hour, 63)::INT AS b1, least(volume, 63)::INT AS b2, p - (label + 1 = class)::INT AS g, p * (1 - p) AS h FROM lr JOIN pn ON lr.symbol = pn.symbol)",
    _split_ctes(0), _split_ctes(1), _split_ctes(2),
    " UNION ALL ".join(
        f"SELECT symbol, class::INT AS class, node, {'[' + ', '.join(repr(c) for c in INPUTS[:3]) + '][feature + 1]' if level < 2 else 'NULL::VARCHAR'} AS feature, {'bin + 0.5::DOUBLE' if level < 2 else 'NULL::DOUBLE'} AS cut, {'gain' if level < 2 else 'NULL::DOUBLE'} AS gain, round(value, 9) AS value FROM k{level}" for level in range(3))))
def _(spark, d):
    """The first round of boosting for each symbol: three trees of two levels, with the gains of their splits."""
    rows = labelled(spark, d).withColumn("class", F.col("label") + 1)
    spec = Boosting(rounds=1, rate=0.1, depth=2, leaves=4, l2=1.0, bins=64)
    trees = boosting.fit(rows, INPUTS[:3], spec, "class", None, "symbol", [_CUTS] * 3).table(spark)
    return trees.select(F.col("key").alias("symbol"), "class", "node", "feature", "cut", "gain", F.round("value", 9).alias("value"))


#: A study's settings at the queries' sizes: all feature blocks but those with long windows.
STUDY = ["data.timeframe=M15", "regime.method=none", "validation.n_folds=3", "labeling.horizon=24", 'features.blocks=["returns","momentum","session"]', "features.return_horizons=[1,3,5,10]", "data.warmup_bars=120", "model.decision_threshold=0.4"]


def study_metrics(spark, d, *changes: str) -> DataFrame:
    """Walk-forward metrics of every symbol, all in one plan."""
    return panel.run(m15(spark, d), Settings().but(*STUDY, *changes)).metrics


@register("study_logistic")
def _(spark, d):
    """A logistic study of every symbol: features, labels, folds, fits, pricing, metrics."""
    return study_metrics(spark, d, "model.name=logistic")


@register("study_boosted")
def _(spark, d):
    """The same with boosted trees, all rounds of the learner's own settings."""
    return study_metrics(spark, d, "model.name=lightgbm")


# ---------------------------------------------------------------- significance

_MOMENTS = "mo AS (SELECT symbol, count(*) AS n, avg(strategy_return) / stddev_samp(strategy_return) AS s, skewness(strategy_return) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)) AS g1, kurtosis_pop(strategy_return) AS g2 FROM q GROUP BY 1)"


def _normal(z: str) -> str:
    """The normal distribution function by Simpson's rule, 2,000 steps from 0."""
    points = f"list_sum(list_transform(range(2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)::DOUBLE * exp(-power(({z}) * i / 2000.0::DOUBLE, 2) / 2)))"
    return f"0.5::DOUBLE + {points} * ({z}) / 6000.0::DOUBLE / sqrt(2 * pi())"


@register("sig_probabilistic_sharpe", o.sql(o.bars(), _PRICED, _MOMENTS, "zz AS (SELECT symbol, n, s * sqrt(n - 1) / sqrt(1 - g1 * s + g2 / 4 * s * s) AS z FROM mo)", f"SELECT symbol, n, round({_normal('z')}, 8) AS psr FROM zz"))
def _(spark, d):
    """The probability that the crossover's Sharpe ratio is positive, of each symbol."""
    return significance.probabilistic_sharpe(crossover_result(spark, d), bars_per_year=M15_YEAR).withColumn("psr", F.round("psr", 8))


TRIALS = 28


@register("sig_deflated_sharpe", o.sql(
    o.bars(), _PRICED, _MOMENTS,
    f"zz AS (SELECT symbol, n, (s - {significance.expected_maximum(TRIALS)!r}::DOUBLE / sqrt(n)) * sqrt(n - 1) / sqrt(1 - g1 * s + g2 / 4 * s * s) AS z, (s - 0.8::DOUBLE / sqrt({M15_YEAR}) * {significance.expected_maximum(TRIALS)!r}::DOUBLE) * sqrt(n - 1) / sqrt(1 - g1 * s + g2 / 4 * s * s) AS y FROM mo)",
    f"SELECT symbol, n, round({_normal('z')}, 8) AS deflated, round({_normal('y')}, 8) AS deflated_corrected FROM zz"))
def _(spark, d):
    """The same against the best of 28 chance results: with chance's spread, and with an annual one of 0.8."""
    result = crossover_result(spark, d)
    spread = result.select("symbol").distinct().withColumn("spread", F.lit(0.8))
    chance = significance.deflated_sharpe(result, TRIALS, None, M15_YEAR).select("symbol", "n", F.round("deflated", 8).alias("deflated"))
    return chance.join(significance.deflated_sharpe(result, TRIALS, spread, M15_YEAR).select("symbol", F.round("deflated_corrected", 8).alias("deflated_corrected")), "symbol")


_MONTHS = [
    "mm AS (SELECT symbol, (ts::DATE - DATE '2024-01-01') // 4 AS part, avg(strategy_return) / nullif(stddev_pop(strategy_return), 0) * sqrt(24960) AS sharpe FROM q GROUP BY 1, 2)",
    "fs AS (SELECT symbol, avg(sharpe) AS mean, coalesce(stddev_samp(sharpe), 0) AS std, min(sharpe) AS min, max(sharpe) AS max, avg((sharpe > 0)::INT) AS positive_fold_share, count(sharpe) AS folds FROM mm WHERE sharpe IS NOT NULL GROUP BY 1)",
    "ft AS (SELECT *, CASE WHEN folds > 1 AND std > 0 THEN mean / (std / sqrt(folds)) END AS t_statistic FROM fs)",
]
# Student's distribution by Simpson's rule
_STUDENT = (
    "0.5::DOUBLE - list_sum(list_transform(range(2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)::DOUBLE * power(1 + power(t_statistic * i / 2000.0::DOUBLE, 2) / (folds - 1), -folds / 2.0::DOUBLE)))"
    " * t_statistic / 6000.0::DOUBLE * exp(lgamma(folds / 2.0::DOUBLE) - lgamma((folds - 1) / 2.0::DOUBLE)) / sqrt(pi() * (folds - 1))"
)


@register("sig_fold_stability", o.sql(
    o.bars(), _PRICED, _MONTHS,
    "SELECT symbol, folds, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mean", "std", "min", "max", "positive_fold_share", "t_statistic")) + f", CASE WHEN t_statistic IS NOT NULL THEN round({_STUDENT}, 7) END AS p_value FROM ft"))
def _(spark, d):
    """How steady the crossover's Sharpe ratio is over spells of four days."""
    part = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 4)
    spells = crossover_result(spark, d).groupBy("symbol", part.alias("part")).agg((F.avg("strategy_return") / F.nullif(F.stddev_pop("strategy_return"), F.lit(0.0)) * F.sqrt(F.lit(24960.0))).alias("sharpe"))
    out = significance.fold_stability(spells, key="symbol")
    return out.select("symbol", "folds", *(F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max", "positive_fold_share", "t_statistic")), F.round("p_value", 7).alias("p_value"))


# ---------------------------------------------------------------- regimes

_K, _RESTARTS, _ROUNDS = 4, regimes.KMeansRegimes.restarts, regimes.KMeansRegimes.rounds
_Z = range(len(DESCRIPTORS))


def _hash(prefix: str) -> str:
    return f"md5({prefix} || '|' || symbol || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S'))"


_DIST = " + ".join(f"power(zr.z{i} - km.z{i}, 2)" for i in _Z)
_KMEANS = [
    *_DESC_ROWS, "sc AS (SELECT " + ", ".join(f"avg({x}) AS m{i}, stddev_pop({x}) AS s{i}" for i, x in enumerate(DESCRIPTORS)) + " FROM dn)",
    "zr AS MATERIALIZED (SELECT row_number() OVER () AS id, symbol, ts, " + ", ".join(DESCRIPTORS) + ", " + ", ".join(f"({x} - m{i}) / s{i} AS z{i}" for i, x in enumerate(DESCRIPTORS)) + " FROM dn, sc)",
    f"se AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY h) - 1 AS c, {', '.join(f'z{i}' for i in _Z)} FROM (SELECT *, {_hash(chr(39) + '7|' + chr(39) + ' || r')} AS h FROM zr, range({_RESTARTS}) x(r)))",
    f"km(it, r, c, {', '.join(f'z{i}' for i in _Z)}) AS (SELECT 0, r, c, {', '.join(f'z{i}' for i in _Z)} FROM se WHERE c < {_K} UNION ALL SELECT it + 1, r, c, {', '.join(f'avg(z{i})' for i in _Z)} FROM"
    f" (SELECT km.it, km.r, arg_min(km.c, struct_pack(d := {_DIST}, c := km.c)) AS c, {', '.join(f'any_value(zr.z{i}) AS z{i}' for i in _Z)} FROM zr, km WHERE km.it < {_ROUNDS} GROUP BY zr.id, km.it, km.r) GROUP BY it, r, c)",
    f"ke AS (SELECT zr.id, km.r, min({_DIST}) AS d, arg_min(km.c, struct_pack(d := {_DIST}, c := km.c))::INT AS regime FROM zr, km WHERE km.it = {_ROUNDS} GROUP BY 1, 2)",
    "kb AS (SELECT arg_min(r, struct_pack(d := round(d, 6), r := r)) AS r FROM (SELECT r, sum(d) AS d FROM ke GROUP BY 1))", "kr AS MATERIALIZED (SELECT zr.*, ke.regime FROM zr JOIN ke ON zr.id = ke.id JOIN kb ON ke.r = kb.r)",
    f"kc AS (SELECT regime, {', '.join(f'avg({x}) AS {x}' for x in DESCRIPTORS)} FROM kr GROUP BY 1)", "kd AS (SELECT median(abs(trend_strength)) AS t, median(vol_percentile) AS v FROM kc)",
    "kn AS (SELECT regime, CASE WHEN trend_strength > t THEN 'Uptrend' WHEN trend_strength < -t THEN 'Downtrend' ELSE 'Range' END || ', ' || CASE WHEN vol_percentile > v THEN 'high-volatility' ELSE 'quiet' END AS name FROM kc, kd)",
    "kl AS (SELECT regime, name || CASE WHEN row_number() OVER w > 1 THEN ' (' || row_number() OVER w || ')' ELSE '' END AS regime_name FROM kn WINDOW w AS (PARTITION BY name ORDER BY regime))",
]


@register("regime_kmeans", o.sql(o.bars(), _KMEANS, "SELECT symbol, ts, kr.regime, regime_name FROM kr JOIN kl ON kr.regime = kl.regime"))
def _(spark, d):
    df = described(spark, d)
    model = regimes.KMeansRegimes().fit(df)
    return regimes.named(model.predict(df), model.names).select("symbol", "ts", "regime", "regime_name")


@register("regime_display", "SELECT symbol, regime AS id, ['Range, quiet', 'Range, high-volatility', 'Trend, quiet', 'Trend, high-volatility'][regime + 1] AS \"Regime\", bars AS \"Bars\", "
    + ", ".join(f'round({c} * {by}, {digits})::DOUBLE AS "{n}"' for n, (c, by, digits) in regimes.SHOWN.items()) + " FROM (" + ORACLE_SQL["regime_profile"] + ")")
def _(spark, d):
    """The regimes' profiles as a table for reading, from figures of six digits."""
    out = regimes.profile(ruled(spark, d), bars_per_year=M15_YEAR)
    out = out.withColumns({c: F.round(c, 6) for c, _, _ in regimes.SHOWN.values()})
    return regimes.display(out, regimes.RULE_NAMES)


@register("regime_sample", o.sql(o.bars(), _REG, f"SELECT symbol, ts, round(trend_strength, 6) AS trend_strength, round(vol_percentile, 6) AS vol_percentile, regime FROM rg ORDER BY {_hash(chr(39) + '7' + chr(39))} LIMIT 2000"))
def _(spark, d):
    """A repeatable sample of the regime plane."""
    return regimes.sampled(ruled(spark, d), 2000).select("symbol", "ts", F.round("trend_strength", 6).alias("trend_strength"), F.round("vol_percentile", 6).alias("vol_percentile"), "regime")


def _stacked_sql() -> str:
    names = {"crossover": _PRICED, "hold": priced([cte("s", "1.0::DOUBLE AS signal")])}
    parts = [f"SELECT '{n}' AS name, * FROM ({o.sql(o.bars(), ctes, _TRADES, metric_ctes(), 'SELECT symbol, ' + ', '.join(f'round({m}, 6) AS {m}' for m in metrics.METRICS) + ' FROM k')})" for n, ctes in names.items()]
    return " UNION ALL ".join(parts)


@register("bt_metrics_stacked", _stacked_sql())
def _(spark, d):
    """The metrics of several strategies under each other."""
    results = {"crossover": crossover_result(spark, d), "hold": backtest.run(signals.buy_and_hold(m15(spark, d)), bars_per_year=M15_YEAR)}
    out = metrics.stacked({n: metrics.performance(r, M15_YEAR, backtest.trades(r)) for n, r in results.items()})
    return out.select("name", "symbol", *(F.round(m, 6).alias(m) for m in metrics.METRICS))
