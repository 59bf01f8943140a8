"""Whether a Sharpe ratio could be chance: bootstrap, probabilistic and deflated ratios, fold stability."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import EULER, normal_ppf, normal_probability, student_probability
from ..functions.windows import numbered


def sharpe(returns: DataFrame, bars_per_year: int = 6_240) -> DataFrame:
    return returns.groupBy("symbol").agg((F.avg("strategy_return") / F.nullif(F.stddev_pop("strategy_return"), F.lit(0.0)) * float(bars_per_year) ** 0.5).alias("sharpe"))


def moments(returns: DataFrame) -> DataFrame:
    r = "strategy_return"
    return returns.groupBy("symbol").agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.skewness(r).alias("g1"), F.kurtosis(r).alias("g2"))


def psr_z(returns: DataFrame, benchmark: float = 0.0, bars_per_year: int = 6_240) -> DataFrame:
    """(symbol, n, z): the score whose normal probability is the probabilistic Sharpe ratio."""
    s = F.col("mean") / F.nullif(F.col("sd"), F.lit(0.0))
    square = 1 - F.col("g1") * s + F.col("g2") / 4 * s * s
    z = (s - benchmark / math.sqrt(bars_per_year)) * F.sqrt(F.col("n") - 1) / F.sqrt(F.when(square > 0, square))
    return moments(returns).select("symbol", "n", F.when(F.col("n") >= 30, z).alias("z"))


def probabilistic_sharpe(returns: DataFrame, benchmark: float = 0.0, bars_per_year: int = 6_240) -> DataFrame:
    """(symbol, n, psr): the probability that the true Sharpe ratio exceeds an annualised benchmark; null under 30 bars or without spread."""
    return psr_z(returns, benchmark, bars_per_year).select("symbol", "n", normal_probability(F.col("z")).alias("psr"))


def expected_maximum(trials: int) -> float:
    """Expected greatest of `trials` standard normal draws."""
    return 0.0 if trials <= 1 else (1 - EULER) * normal_ppf(1 - 1 / trials) + EULER * normal_ppf(1 - 1 / (trials * math.e))


def deflated_sharpe(returns: DataFrame, trials: int, spread: DataFrame | None = None, bars_per_year: int = 6_240) -> DataFrame:
    """(symbol, n, deflated, deflated_corrected): PSR against the best of `trials` chance results.

    spread(symbol, spread) is how far the trials' results lie apart; it is taken as a per-bar figure, as results are compared
    with, and, corrected, as an annual one. Without it, or where it is not positive, it is that of chance, 1 / sqrt(n).
    """
    m = moments(returns)
    m = m.withColumn("spread", F.lit(None).cast("double")) if spread is None else m.join(spread.select("symbol", F.col("spread").cast("double")), "symbol", "left")
    known = (F.col("spread") > 0) & (F.col("spread") < float("inf"))
    s = F.col("mean") / F.nullif(F.col("sd"), F.lit(0.0))
    square = 1 - F.col("g1") * s + F.col("g2") / 4 * s * s

    def against(scale):
        z = (s - scale * expected_maximum(trials)) * F.sqrt(F.col("n") - 1) / F.sqrt(F.when(square > 0, square))
        return normal_probability(F.when((F.col("n") >= 30) & F.lit(trials >= 1), z))

    chance = 1 / F.sqrt("n")
    plain, annual = (F.when(known, F.col("spread") / by).otherwise(chance) for by in (1.0, math.sqrt(bars_per_year)))
    return m.select("symbol", "n", against(plain).alias("deflated"), against(annual).alias("deflated_corrected"))


def bootstrap_sharpes(returns: DataFrame, samples: int = 1000, bars_per_year: int = 6_240, mean_block: float | None = None, seed: int = 7) -> DataFrame:
    """(symbol, rep, sharpe) of stationary bootstrap replicates: blocks of geometric length, wrapping round.

    Each block is one row, whose start and length are hashes of (seed, symbol, rep, k), so a run is repeatable however it is
    split. Its sums are differences of running sums, so that no replicate is written out bar by bar. The last block that is
    drawn fills what is left of the series; that there would be more has a chance below 1e-20.
    """
    p = 1 / (mean_block or max(5.0, bars_per_year / 260 * 20))
    fade = math.log1p(-p) if p < 1 else -math.inf
    rows = numbered(returns.where("strategy_return IS NOT NULL")).select("symbol", "rn", F.col("strategy_return").alias("r"))
    sizes = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("r").alias("t1"), F.sum(F.col("r") * F.col("r")).alias("t2")).where("n >= 50")
    before = Window.partitionBy("symbol").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.select("symbol", "rn", *(F.coalesce(F.sum(x).over(before), F.lit(0.0)).alias(c) for x, c in ((F.col("r"), "s1"), (F.col("r") * F.col("r"), "s2"))))
    most = F.ceil(F.col("n") * p + F.sqrt(F.col("n") * p) * 12 + 40).cast("long")
    blocks = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("most", most).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), "most")))
    h = F.xxhash64(F.lit(seed), "symbol", "rep", "k")
    length = F.least(F.col("n"), 1 + F.floor(F.log(1 - F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))) / F.lit(fade)))
    blocks = blocks.withColumn("at", F.pmod(F.xxhash64(h), F.col("n"))).withColumn("len", F.when(F.col("k") == F.col("most"), F.col("n")).otherwise(length))
    order = Window.partitionBy("symbol", "rep").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("done", F.coalesce(F.sum("len").over(order), F.lit(0))).where("done < n")
    blocks = blocks.withColumn("end", F.col("at") + F.least("len", F.col("n") - F.col("done")))
    first = sums.select("symbol", F.col("rn").alias("at"), F.col("s1").alias("a1"), F.col("s2").alias("a2"))
    last = sums.select("symbol", F.col("rn").alias("to"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
    summed = blocks.withColumn("to", F.pmod("end", "n")).join(first, ["symbol", "at"]).join(last, ["symbol", "to"])
    total = [F.sum(F.floor(F.col("end") / F.col("n")) * F.col(f"t{x}") + F.col(f"b{x}") - F.col(f"a{x}")) for x in (1, 2)]
    found = summed.groupBy("symbol", "rep").agg((total[0] / F.first("n")).alias("mean"), (total[1] / F.first("n")).alias("square"))
    spread = F.col("square") - F.col("mean") * F.col("mean")
    # a spread of 0 but for the last bits has no ratio
    sharpe = F.when(spread > F.col("square") * 1e-13, F.col("mean") / F.sqrt(spread) * float(bars_per_year) ** 0.5)
    return found.select("symbol", "rep", sharpe.alias("sharpe"))


def bootstrap_interval(returns: DataFrame, samples: int = 1000, level: float = 0.95, bars_per_year: int = 6_240, mean_block: float | None = None, seed: int = 7) -> DataFrame:
    reps = bootstrap_sharpes(returns, samples, bars_per_year, mean_block, seed).where("sharpe IS NOT NULL")
    a = (1 - level) / 2
    found = reps.groupBy("symbol").agg(
        F.percentile("sharpe", F.lit(a)).alias("lower"), F.percentile("sharpe", F.lit(1 - a)).alias("upper"), F.avg("sharpe").alias("bootstrap_mean"), F.stddev_samp("sharpe").alias("bootstrap_std"),
        F.avg((F.col("sharpe") <= 0).cast("double")).alias("p_value_positive"), F.count("*").alias("samples"),
    )
    return sharpe(returns, bars_per_year).join(found, "symbol", "left")


def fold_stability(folds: DataFrame, metric: str = "sharpe", key: str | None = None) -> DataFrame:
    """Mean, spread, range, share of positive folds, t and one-sided p of a metric over folds, of each key; what is not finite does not count."""
    x = F.col(metric)
    rows = folds.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = rows.groupBy(*([key] if key else [])).agg(
        F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg((x > 0).cast("double")).alias("positive_fold_share"), F.count(x).alias("folds")
    )
    t = F.when((F.col("folds") > 1) & (F.col("std") > 0), F.col("mean") / (F.col("std") / F.sqrt("folds")))
    out = out.withColumn("t_statistic", t)
    return out.withColumn("p_value", 1 - student_probability(F.col("t_statistic"), F.col("folds") - 1))
