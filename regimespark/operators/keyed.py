"""Multinomial logistic regression of all symbols and folds in one plan.

Bars are packed into blocks of consecutive rows once. Each Newton step is one job, whatever the
number of symbols and folds: blocks meet their symbol's parameters in a join, tasks sum loss,
gradient and hessian of the folds that a row trains, the sums are added up by (symbol, fold) in
two stages, and each group takes its own step, back to the middle where the last one has raised its loss. Scales
and class weights are grouped sums likewise. The parameters stay a table; the driver reads how
far the largest step went.

The objective is that of the single fits: weighted negative log-likelihood plus half of |W|²/C,
intercepts free, features scaled by mean and population deviation of the training rows. A missing
feature counts as that mean. A class without training rows has probability 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import stored

#: Rows of a block, and ways into which a group's sums are dealt before they are added up.
BLOCK, WAYS = 2048, 16
CLASSES = 3


def fold_bounds(rows: DataFrame, scheme: str = "expanding", n_folds: int = 6, test_size: float = 0.12, min_train: float = 0.25, embargo: int = 48) -> DataFrame:
    """(symbol, fold, train_start, train_stop, test_start, test_end) of every symbol by its own number of rows; a symbol without a usable fold has none."""
    if scheme not in ("expanding", "rolling"):
        raise ValueError(f"unknown scheme {scheme!r}")
    whole = lambda x: F.bround(x, 0).cast("long")
    out = rows.groupBy("symbol").agg(F.count("*").alias("n"))
    out = out.withColumns({c: F.greatest(F.lit(1).cast("long"), whole(F.col("n") * share)) for c, share in (("_test", test_size), ("_train", min_train))}).where("n - _train >= _test")
    room = F.col("n") - F.col("_train")
    out = out.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(max(1, n_folds) - 1))))
    out = out.withColumn("test_start", whole(F.col("_train") + F.col("_i") * (room / F.lit(float(max(1, n_folds))))))
    out = out.withColumn("test_end", F.least("n", F.col("test_start") + F.col("_test")))
    out = out.withColumn("train_start", F.lit(0).cast("long") if scheme == "expanding" else F.greatest(F.lit(0).cast("long"), F.col("test_start") - F.col("_train")))
    out = out.withColumn("train_stop", F.greatest("train_start", F.col("test_start") - embargo))
    out = out.where((F.col("test_end") - F.col("test_start") >= F.greatest(F.lit(1), F.expr("_test div 2"))) & (F.col("train_stop") - F.col("train_start") >= 100))
    return out.select("symbol", (F.row_number().over(Window.partitionBy("symbol").orderBy("_i")) - 1).alias("fold"), "train_start", "train_stop", "test_start", "test_end")


def training(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows with a label beside each fold that they train; a symbol's folds are few."""
    inside = (F.col("rn") >= F.col("train_start")) & (F.col("rn") < F.col("train_stop"))
    return rows.where("label IS NOT NULL").join(bounds, "symbol").where(inside)


def class_weights(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """(symbol, fold, label, rows, weight): n / (classes there are * rows of the class)."""
    of = Window.partitionBy("symbol", "fold")
    counts = training(rows.select("symbol", "rn", "label"), bounds).groupBy("symbol", "fold", "label").agg(F.count("*").alias("rows"))
    return counts.withColumn("weight", F.sum("rows").over(of) / (F.count("*").over(of) * F.col("rows")))


def scales(rows: DataFrame, bounds: DataFrame, inputs: list[str]) -> DataFrame:
    """(symbol, fold, mean, sd): arrays over the inputs, of the training rows."""
    of = training(rows.select("symbol", "rn", "label", *inputs), bounds).groupBy("symbol", "fold")
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return of.agg(F.array(*(F.coalesce(F.avg(number(c)), F.lit(0.0)) for c in inputs)).alias("mean"), F.array(*(F.coalesce(F.nullif(F.stddev_pop(number(c)), F.lit(0.0)), F.lit(1.0)) for c in inputs)).alias("sd"))


_BLOCKS = "symbol string, block long, rn binary, y binary, x binary"


def blocks(rows: DataFrame, inputs: list[str]) -> DataFrame:
    """Rows (symbol, rn, label, inputs) in blocks of BLOCK rows, numbers as bytes; a missing label is -1, labels are classes 0, 1, 2."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("rn")
        column = lambda c, kind: table.column(c).combine_chunks().fill_null(-1 if c == "y" else float("nan") if c in inputs else 0).to_numpy(zero_copy_only=False).astype(kind)
        x = np.stack([column(c, float) for c in inputs], axis=1)
        values = [table.column(c)[0].as_py() for c in ("symbol", "block")] + [column("rn", np.int64).tobytes(), column("y", np.int8).tobytes(), x.tobytes()]
        return pa.table([pa.array([v], t) for v, t in zip(values, (pa.string(), pa.int64(), *[pa.binary()] * 3), strict=True)], ["symbol", "block", "rn", "y", "x"])

    some = rows.select("symbol", F.expr(f"rn div {BLOCK}").alias("block"), "rn", (F.col("label") + 1).cast("int").alias("y"), *(F.col(c).cast("double").alias(c) for c in inputs))
    return some.groupBy("symbol", "block").applyInArrow(pack, _BLOCKS)


_STATE = "symbol string, fold int, train_start long, train_stop long, test_start long, test_end long, mean array<double>, sd array<double>, per_class array<double>, w array<double>, before array<double>, loss double, step double"
_NAMES = [c.split()[0] for c in _STATE.split(", ")]
_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}[c.split()[1]]) for c in _STATE.split(", ")])


def _matrices(r: dict, width: int):
    x = np.frombuffer(r["x"], float).reshape(-1, width)
    return np.frombuffer(r["rn"], np.int64), np.frombuffer(r["y"], np.int8), x


def _scaled(x: np.ndarray, state: dict) -> np.ndarray:
    z = (x - np.array(state["mean"])) / np.array(state["sd"])
    return np.hstack([np.nan_to_num(z, nan=0.0), np.ones((len(z), 1))])


def _probability(z: np.ndarray, w: np.ndarray, there: np.ndarray) -> np.ndarray:
    s = np.where(there, z @ w.T, -np.inf)
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sums(z: np.ndarray, y: np.ndarray, w: np.ndarray, per_class: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and hessian of weighted rows, without the penalty."""
    there = per_class > 0
    p, omega = _probability(z, w, there), per_class[y]
    loss = -float(omega @ np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)))
    d = z.shape[1]
    g, h = np.zeros((CLASSES, d)), np.zeros((CLASSES, d, CLASSES, d))
    for k in np.flatnonzero(there):
        g[k] = z.T @ (omega * (p[:, k] - (y == k)))
        for m in np.flatnonzero(there)[: k + 1]:
            if m <= k:
                part = z.T @ (z * (omega * p[:, k] * ((k == m) - p[:, m]))[:, None])
                h[k, :, m], h[m, :, k] = part, part
    return loss, g.ravel(), h.reshape(CLASSES * d, CLASSES * d)


def newton(state: dict, loss: float, g: np.ndarray, h: np.ndarray, c: float) -> dict:
    """The next state of a (symbol, fold)."""
    there, w = np.array(state["per_class"]) > 0, np.array(state["w"]).reshape(CLASSES, -1)
    d = w.shape[1]
    loss += float((w[:, :-1] ** 2).sum()) / (2 * c)
    if state["loss"] is not None and loss > state["loss"] * (1 + 1e-12) + 1e-12:
        middle = (np.array(state["w"]) + np.array(state["before"])) / 2
        return state | {"w": middle.tolist(), "step": float(np.abs(middle - state["w"]).max())}
    penalty = np.tile(np.append(np.full(d - 1, 1 / c), 0.0), CLASSES)
    free = np.tile(np.append(np.zeros(d - 1), 1.0), CLASSES) * np.repeat(there, d)
    # intercepts are told apart by their sum being 0; a class that is not there stays at 0
    h = h + np.diag(penalty) + np.outer(free, free) + np.diag(np.repeat(~there, d).astype(float))
    g = g + penalty * w.ravel() + free * (free @ w.ravel())
    move = np.linalg.solve(h, g * np.repeat(there, d))
    return state | {"before": state["w"], "loss": loss, "w": (w.ravel() - move).tolist(), "step": float(np.abs(move).max())}


def _step(packed: DataFrame, states: DataFrame, width: int, c: float) -> DataFrame:
    """One Newton step of every (symbol, fold)."""
    inner = _NAMES[1:]
    # one row a symbol: its folds; blocks of a symbol are many, their parameters go with each
    of = states.groupBy("symbol").agg(F.collect_list(F.struct(*inner)).alias("folds"))
    size = CLASSES * (width + 1)

    def add(batches):
        held = {}
        for batch in batches:
            for r in batch.to_pylist():
                rn, y, x = _matrices(r, width)
                for f in r["folds"]:
                    own = (rn >= f["train_start"]) & (rn < f["train_stop"]) & (y >= 0)
                    if own.any():
                        got = sums(_scaled(x[own], f), y[own].astype(int), np.array(f["w"]).reshape(CLASSES, -1), np.array(f["per_class"]))
                        old = held.get((r["symbol"], f["fold"]))
                        held[r["symbol"], f["fold"]] = got if old is None else tuple(a + b for a, b in zip(old, got, strict=True))
        for (symbol, fold), (loss, g, h) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((symbol, fold, loss, g.tobytes(), h.tobytes()), (pa.string(), pa.int32(), pa.float64(), pa.binary(), pa.binary()), strict=True)], ["symbol", "fold", "part", "g", "h"])

    def total(table: pa.Table):
        parts = [[np.frombuffer(v, float) for v in table.column(c).to_pylist()] for c in ("g", "h")]
        return float(np.sum(table.column("part").to_numpy())), sum(parts[0]), sum(parts[1])

    def merge(table: pa.Table) -> pa.Table:
        loss, g, h = total(table)
        values = (table.column("symbol")[0].as_py(), table.column("fold")[0].as_py(), loss, g.tobytes(), h.tobytes())
        return pa.table([pa.array([v], t) for v, t in zip(values, (pa.string(), pa.int32(), pa.float64(), pa.binary(), pa.binary()), strict=True)], ["symbol", "fold", "part", "g", "h"])

    def move(state: pa.Table, table: pa.Table) -> pa.Table:
        old = state.to_pylist()[0]
        if len(table):
            loss, g, h = total(table)
            old = newton(old, loss, g, h.reshape(size, size), c)
        else:
            old["step"] = 0.0
        return pa.Table.from_pylist([old], _ARROW)

    schema = "symbol string, fold int, part double, g binary, h binary"
    parts = packed.join(of, "symbol").mapInArrow(add, schema)
    parts = parts.groupBy("symbol", "fold", (F.spark_partition_id() % WAYS).alias("_way")).applyInArrow(merge, schema)
    return states.groupBy("symbol", "fold").cogroup(parts.groupBy("symbol", "fold")).applyInArrow(move, _STATE)


def fit(rows: DataFrame, bounds: DataFrame, inputs: list[str], c: float = 0.1, balance: bool = True, tolerance: float = 1e-8, most: int = 60) -> tuple[DataFrame, DataFrame]:
    """(blocks, states) of rows(symbol, rn, label in -1, 0, 1, inputs): parameters w of every (symbol, fold), classes by scaled inputs and intercept."""
    packed = stored(blocks(rows, inputs))
    weights = class_weights(rows, bounds).groupBy("symbol", "fold").agg(F.map_from_entries(F.collect_list(F.struct("label", "weight"))).alias("_m"))
    of = F.array(*(F.coalesce(F.col("_m")[F.lit(k)] if balance else F.when(F.col("_m")[F.lit(k)].isNotNull(), 1.0), F.lit(0.0)) for k in (-1, 0, 1)))
    states = bounds.join(scales(rows, bounds, inputs), ["symbol", "fold"]).join(weights, ["symbol", "fold"]).withColumn("per_class", of)
    zero = F.array_repeat(F.lit(0.0), CLASSES * (len(inputs) + 1))
    none = F.lit(None).cast("double")
    states = stored(states.select(*_NAMES[:9], zero.alias("w"), zero.alias("before"), none.alias("loss"), none.alias("step")))
    for _ in range(most):
        states = stored(_step(packed, states, len(inputs), c))
        if (states.agg(F.max("step")).first()[0] or 0.0) <= tolerance:
            break
    return packed, states


def predict(packed: DataFrame, states: DataFrame, width: int) -> DataFrame:
    """(symbol, rn, fold, p_short, p_flat, p_long) of every fold's test rows."""
    of = states.groupBy("symbol").agg(F.collect_list(F.struct(*_NAMES[1:])).alias("folds"))
    kinds = (pa.string(), pa.int64(), pa.int32(), *[pa.float64()] * CLASSES)
    names = ["symbol", "rn", "fold", "p_short", "p_flat", "p_long"]

    def score(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rn, _, x = _matrices(r, width)
                for f in r["folds"]:
                    own = (rn >= f["test_start"]) & (rn < f["test_end"])
                    if own.any():
                        p = _probability(_scaled(x[own], f), np.array(f["w"]).reshape(CLASSES, -1), np.array(f["per_class"]) > 0)
                        columns = [[r["symbol"]] * len(p), rn[own], np.full(len(p), f["fold"], np.int32), *p.T]
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], names)

    return packed.join(of, "symbol").mapInArrow(score, "symbol string, rn long, fold int, p_short double, p_flat double, p_long double")
