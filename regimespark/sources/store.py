"""Stored runs: a folder for each run with its settings, summary and tables; and a ledger of many."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .csv import hadoop

TABLES = ["predictions", "equity", "trades", "fold_layout", "fold_metrics", "regime_table", "regime_transitions", "regime_performance", "confusion", "per_class", "threshold_curve", "feature_importance", "baselines"]


def save(spark: SparkSession, root: str, run_id: str, settings: dict, summary: dict, tables: dict[str, DataFrame]) -> str:
    """Write a run; tables that are absent are left out."""
    folder = f"{root}/{run_id}"
    line = json.dumps({"run_id": run_id, "settings": settings} | summary, default=str, allow_nan=False)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/summary")
    for name, df in tables.items():
        if df is not None:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return folder


def runs(spark: SparkSession, root: str) -> DataFrame:
    """One row for each readable run, newest first."""
    df = spark.read.option("mode", "DROPMALFORMED").json(f"{root}/*/summary")
    return df.orderBy(F.desc("created_at")) if "created_at" in df.columns else df


def comparison(spark: SparkSession, root: str) -> DataFrame:
    """Runs side by side: settings and headline metrics."""
    df = runs(spark, root)
    fields = {f.name: f.dataType for f in df.schema}

    def pick(outer: str, inner: str):
        have = outer in fields and hasattr(fields[outer], "names") and inner in fields[outer].names
        return (F.col(f"{outer}.{inner}") if have else F.lit(None).cast("string" if outer == "settings" else "double")).alias(inner)

    return df.select("run_id", *(pick("settings", c) for c in ("symbol", "timeframe", "model", "regime")), *(pick("metrics", c) for c in ("sharpe", "total_return", "max_drawdown", "trades", "profit_factor")), *(pick("classification", c) for c in ("accuracy", "directional_precision", "signal_rate", "matthews_corrcoef")))


def filtered(table: DataFrame, symbol: str | None = None, model: str | None = None, regime: str | None = None) -> DataFrame:
    """The rows of a comparison with the given symbol, model and regime; what is not given is not asked for."""
    for name, value in (("symbol", symbol), ("model", model), ("regime", regime)):
        if value is not None:
            table = table.where(F.col(name) == value)
    return table


def export_csv(table: DataFrame, path: str) -> None:
    """A comparison, which has one row for each run, as one CSV file with a header in the folder `path`."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def load(spark: SparkSession, root: str, run_id: str) -> tuple[dict, dict[str, DataFrame]]:
    """(summary, tables) of a run."""
    fs, folder = hadoop(spark, f"{root}/{run_id}")
    if not fs.exists(folder):
        raise LookupError(f"no run {run_id!r} in {root}")
    summary = json.loads(spark.read.text(f"{root}/{run_id}/summary").first().value)
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return summary, {n: spark.read.parquet(f"{root}/{run_id}/{n}") for n in names if n in TABLES}


def delete(spark: SparkSession, root: str, run_id: str) -> bool:
    fs, folder = hadoop(spark, f"{root}/{run_id}")
    return fs.delete(folder, True)


def append_ledger(rows: DataFrame, path: str) -> None:
    """Append rows; columns may differ between appends."""
    rows.write.mode("append").parquet(path)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def ledger_summary(rows: DataFrame) -> DataFrame:
    """Completed and positive arms, how many would be significant by chance, and how many are."""
    done = rows.where("status = 'ok' AND stage <> 'holdout'")
    return done.agg(F.count("*").alias("completed"), F.count(F.when(F.col("sharpe") > 0, 1)).alias("positive"), (F.count("*") * 0.05).alias("expected_by_chance"), F.count(F.when((F.col("lower") > 0) | (F.col("upper") < 0), 1)).alias("survivors"))
