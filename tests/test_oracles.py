"""Registered queries against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from regimespark import queries
from regimespark.operators import significance

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# one of each kind; the driver compares all of them
NAMES = ["bars_resample_h1", "bars_resample_w1", "dataset_describe", "ind_rsi", "ind_adx", "ind_macd", "ind_swings", "feat_session", "label_triple_barrier", "sig_donchian_breakout", "bars_clean_dedupe", "sig_position_mix", "bt_min_hold", "study_baselines", "bt_trades", "bt_metrics", "cls_summary", "folds_expanding", "sig_psr"]


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return float(f"{x:.8g}") + 0.0 if isinstance(x, float) else x


def test_every_oracle_belongs_to_a_query():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and set(NAMES) <= set(queries.ORACLE_SQL)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, data, duck, name):
    df = queries.QUERIES[name](spark, data)
    cur = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(([cell(r[n]) for n in sorted(names)] for r in df.collect()), key=str)
    want = sorted(([cell(v) for _, v in sorted(zip(names, row, strict=True))] for row in cur.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_stands_without_the_corpus_operators():
    root = Path(__file__).resolve().parents[1] / "regimespark"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path


def test_sig_bootstrap_is_the_whole_operator(spark, data):
    got = queries.QUERIES["sig_bootstrap"](spark, data).orderBy("symbol").collect()
    returns = queries.crossover_result(spark, data).select("symbol", "ts", "strategy_return")
    assert got == significance.bootstrap_interval(returns, bars_per_year=queries.M15_YEAR).orderBy("symbol").collect()
    assert {r.samples for r in got if r.samples is not None} == {1000}
