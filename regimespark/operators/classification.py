"""Metrics of three-class predictions: columns label and prediction in {-1, 0, 1}."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLASSES = {-1: "short", 0: "flat", 1: "long"}


def confusion(df: DataFrame) -> DataFrame:
    """One row for each actual class, in order, with counts of each predicted one."""
    counts = df.groupBy(F.col("label").alias("actual")).agg(*(F.count(F.when(F.col("prediction") == c, 1)).alias(n) for c, n in CLASSES.items()))
    names = df.sparkSession.createDataFrame([(k, v) for k, v in CLASSES.items()], "actual int, class string")
    return F.broadcast(names).join(counts, "actual", "left").fillna(0).select("actual", "class", *CLASSES.values())


def _cells(df: DataFrame) -> DataFrame:
    return df.agg(*(F.count(F.when((F.col("label") == a) & (F.col("prediction") == p), 1)).cast("double").alias(f"c{i}{j}") for i, a in enumerate(CLASSES) for j, p in enumerate(CLASSES)))


def _safe(a, b):
    return F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))


def _parts():
    c = [[F.col(f"c{i}{j}") for j in range(3)] for i in range(3)]
    true, pred = [sum(c[i][1:], c[i][0]) for i in range(3)], [c[0][j] + c[1][j] + c[2][j] for j in range(3)]
    precision, recall = [_safe(c[k][k], pred[k]) for k in range(3)], [_safe(c[k][k], true[k]) for k in range(3)]
    f1 = [_safe(2 * c[k][k], true[k] + pred[k]) for k in range(3)]
    return c, true, pred, precision, recall, f1


def summary(df: DataFrame) -> DataFrame:
    """One row of headline metrics; balanced accuracy over the classes that occur, macro F1 over all three."""
    c, true, pred, precision, recall, f1 = _parts()
    n, right = true[0] + true[1] + true[2], c[0][0] + c[1][1] + c[2][2]
    cross = sum((true[k] * pred[k] for k in (1, 2)), true[0] * pred[0])
    tt, pp = (n * n - sum((x[k] * x[k] for k in (1, 2)), x[0] * x[0]) for x in (true, pred))
    present = sum((F.when(true[k] > 0, 1.0).otherwise(0.0) for k in (1, 2)), F.when(true[0] > 0, 1.0).otherwise(0.0))
    taken = pred[0] + pred[2]
    cols = {
        "accuracy": right / n, "balanced_accuracy": (recall[0] + recall[1] + recall[2]) / present, "matthews_corrcoef": _safe(right * n - cross, F.sqrt(tt * pp)),
        "cohen_kappa": (right * n - cross) / F.nullif(n * n - cross, F.lit(0.0)), "macro_f1": (f1[0] + f1[1] + f1[2]) / 3,
    }
    for k, name in enumerate(CLASSES.values()):
        cols |= {f"{name}_precision": precision[k], f"{name}_recall": recall[k], f"{name}_support": true[k]}
    cols |= {"signals_taken": taken, "signal_rate": taken / n, "directional_precision": (c[0][0] + c[2][2]) / F.nullif(taken, F.lit(0.0)), "sign_error_rate": (c[0][2] + c[2][0]) / F.nullif(taken, F.lit(0.0))}
    return _cells(df).where(n > 0).select(*(v.alias(k) for k, v in cols.items()))


def per_class(df: DataFrame) -> DataFrame:
    _, true, _, precision, recall, f1 = _parts()
    rows = F.array(*(F.struct(F.lit(n).alias("class"), F.round(precision[k], 4).alias("precision"), F.round(recall[k], 4).alias("recall"), F.round(f1[k], 4).alias("f1"), true[k].cast("long").alias("support")) for k, n in enumerate(CLASSES.values())))
    return _cells(df).select(F.inline(rows))


def threshold_sweep(df: DataFrame, first: float = 0.34, step: float = 0.02, count: int = 24) -> DataFrame:
    """Coverage and precision at each of a fixed list of thresholds, from p_long, p_short and label."""
    p, q, label = (F.coalesce(F.col(c), F.lit(d)) for c, d in (("p_long", -1.0), ("p_short", -1.0), ("label", 9)))
    side = F.when(q > p, -1).otherwise(1)
    rows = df.select(F.greatest(p, q).alias("top"), (label == side).alias("hit"), ((label != 0) & (label == -side)).alias("miss"))
    levels = [first + i * step for i in range(count)]
    taken = [F.col("top") >= t for t in levels]
    # one scan: three counts for each threshold
    counts = rows.agg(F.count("*").alias("n"), F.array(*(F.struct(F.lit(round(t, 3)).alias("threshold"), F.count_if(x).alias("taken"), F.count_if(x & F.col("hit")).alias("hits"), F.count_if(x & F.col("miss")).alias("misses")) for t, x in zip(levels, taken, strict=True))).alias("at"))
    found = counts.where("n > 0").select("n", F.inline("at"))
    share = lambda c: F.col(c) / F.nullif(F.col("taken"), F.lit(0))
    return found.select("threshold", (F.col("taken") / F.col("n")).alias("signal_rate"), F.col("taken").alias("signals"), share("hits").alias("directional_precision"), share("misses").alias("sign_error_rate"))


def position_mix(rows: DataFrame, position: str = "signal") -> DataFrame:
    """Bars and share of long, short and flat for each symbol."""
    side = F.when(F.col(position) > 0, "long").when(F.col(position) < 0, "short").otherwise("flat")
    counted = rows.groupBy("symbol", side.alias("side")).agg(F.count("*").alias("bars"))
    return counted.withColumn("share", F.col("bars") / F.sum("bars").over(Window.partitionBy("symbol")))
