"""Walk-forward folds: row ranges on the driver, rows by a range join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fold:
    index: int
    train_start: int
    train_end: int
    test_start: int
    test_end: int
    embargo: int

    @property
    def train_stop(self) -> int:
        return max(self.train_start, self.train_end - self.embargo)


def walk_forward(n: int, scheme: str = "expanding", n_folds: int = 6, test_size: float = 0.12, min_train: float = 0.25, embargo: int = 48) -> list[Fold]:
    """Folds over n rows: test windows evenly spaced after the first training window; stubs and short trainings are left out."""
    if scheme not in ("expanding", "rolling"):
        raise ValueError(f"unknown scheme {scheme!r}")
    if not (0 < test_size < 1 and 0 < min_train < 1):
        raise ValueError("test_size and min_train must lie between 0 and 1")
    test, train = max(1, round(n * test_size)), max(1, round(n * min_train))
    room = n - train
    if room < test:
        raise ValueError(f"{n} rows are too few for a test window of {test} after {train} rows of training")
    out: list[Fold] = []
    for i in range(max(1, n_folds)):
        start = round(train + i * (room / n_folds if n_folds > 1 else room))
        stop = min(n, start + test)
        fold = Fold(len(out), 0 if scheme == "expanding" else max(0, start - train), start, start, stop, embargo)
        if stop - start >= max(1, test // 2) and fold.train_stop - fold.train_start >= 100:
            out.append(fold)
    if not out:
        raise ValueError("no usable folds; widen the study window")
    return out


def fold_table(spark: SparkSession, folds: list[Fold]) -> DataFrame:
    rows = [(f.index, f.train_start, f.train_stop, f.test_start, f.test_end, f.embargo) for f in folds]
    return spark.createDataFrame(rows, "fold int, train_start long, train_stop long, test_start long, test_end long, embargo int")


def describe_folds(df: DataFrame, folds: list[Fold]) -> DataFrame:
    """Layout of the folds of each symbol against the bars' times; df has rn."""
    table = F.broadcast(fold_table(df.sparkSession, folds))
    hit = (F.col("rn") >= F.col("train_start")) & (F.col("rn") < F.col("test_end"))
    rows = df.select("symbol", "ts", "rn").join(table, hit)
    train, test = F.col("rn") < F.col("train_stop"), F.col("rn") >= F.col("test_start")
    return rows.groupBy("symbol", "fold").agg(
        *(f(F.when(c, F.col("ts"))).alias(n) for c, n, f in ((train, "train_from", F.min), (train, "train_to", F.max), (test, "test_from", F.min), (test, "test_to", F.max))),
        F.count(F.when(train, 1)).alias("train_bars"), F.count(F.when(test, 1)).alias("test_bars"), F.max("embargo").alias("embargo_bars"),
    )


def split(df: DataFrame, fold: Fold) -> tuple[DataFrame, DataFrame]:
    """(train, test) rows by rn."""
    rn = F.col("rn")
    return df.where((rn >= fold.train_start) & (rn < fold.train_stop)), df.where((rn >= fold.test_start) & (rn < fold.test_end))
