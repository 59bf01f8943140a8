"""A multilayer perceptron with ReLU layers, softmax output, row weights and ridge, fitted by L-BFGS.

Rows are packed into blocks once. Each evaluation is one job: tasks run a block forward and back
with numpy and add up loss and gradient, these are added up in two stages, and one sum comes to the driver,
whose size follows from the layers and not from the rows. A row of weight 2 counts as two rows.
"""

from __future__ import annotations

import pickle
from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored

BLOCK, WAYS, MEMORY = 4096, 16, 10


def started(sizes: list[int], seed: int) -> np.ndarray:
    """Weights of all layers in one vector, uniform within the bound for layers of these sizes; biases likewise."""
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in zip(sizes, sizes[1:], strict=False):
        bound = np.sqrt(6 / (a + b))
        parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
    return np.concatenate(parts)


def layers_of(w: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:], strict=False):
        out.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def forward(x: np.ndarray, layers) -> list[np.ndarray]:
    """Values of all layers, the last being probabilities."""
    values = [x]
    for i, (m, b) in enumerate(layers):
        z = values[-1] @ m + b
        if i < len(layers) - 1:
            values.append(np.maximum(z, 0))
        else:
            e = np.exp(z - z.max(axis=1, keepdims=True))
            values.append(e / e.sum(axis=1, keepdims=True))
    return values


def gradient(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray, sizes: list[int]) -> tuple[float, np.ndarray]:
    """Summed weighted loss and its gradient, without ridge."""
    layers = layers_of(w, sizes)
    values = forward(x, layers)
    p, rows = values[-1], np.arange(len(y))
    loss = -float(weight @ np.log(np.maximum(p[rows, y], 1e-300)))
    back = p * weight[:, None]
    back[rows, y] -= weight
    parts = []
    for i in range(len(layers) - 1, -1, -1):
        parts = [(values[i].T @ back).ravel(), back.sum(axis=0), *parts]
        if i:
            back = (back @ layers[i][0].T) * (values[i] > 0)
    return loss, np.concatenate(parts)


_BLOCKS = "x binary, y binary, weight binary"


def blocks(df: DataFrame, features: list[str], label: str, weight: str) -> DataFrame:
    def pack(batches):
        for batch in batches:
            for part in (batch.slice(i, BLOCK) for i in range(0, len(batch), BLOCK)):
                x = np.stack([part.column(f).to_numpy(zero_copy_only=False) for f in features], axis=1).astype(float)
                y, w = (part.column(c).to_numpy(zero_copy_only=False).astype(t) for c, t in (("_y", np.int64), ("_w", float)))
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x, y, w)], ["x", "y", "weight"])

    return df.select(*(F.col(f).cast("double").alias(f) for f in features), F.col(label).cast("long").alias("_y"), F.col(weight).cast("double").alias("_w")).mapInArrow(pack, _BLOCKS)


def evaluated(packed: DataFrame, w: np.ndarray, sizes: list[int]) -> tuple[float, np.ndarray, float]:
    """Loss, gradient and weight of all rows."""
    shipped = packed.sparkSession.sparkContext.broadcast(w)

    def add(batches):
        total = np.zeros(len(w) + 2)
        for batch in batches:
            for x, y, weight in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "weight")), strict=True):
                weight = np.frombuffer(weight, float)
                loss, g = gradient(np.frombuffer(x, float).reshape(len(weight), -1), np.frombuffer(y, np.int64), weight, shipped.value, sizes)
                total += np.concatenate([[loss, weight.sum()], g])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def merge(table: pa.Table) -> pa.Table:
        return pa.table({"sums": pa.array([sum(np.frombuffer(s, float) for s in table.column("sums").to_pylist()).tobytes()], pa.binary())})

    parts = packed.mapInArrow(add, "sums binary").groupBy((F.spark_partition_id() % WAYS).alias("_way")).applyInArrow(merge, "sums binary")
    total = sum((np.frombuffer(r.sums, float) for r in parts.collect()), np.zeros(len(w) + 2))
    shipped.unpersist()
    return float(total[0]), total[2:], float(total[1])


def minimised(f, w: np.ndarray, steps: int, tolerance: float = 1e-6) -> np.ndarray:
    """L-BFGS with steps halved until the value falls enough; f gives value and gradient."""
    value, g = f(w)
    pairs: deque = deque(maxlen=MEMORY)
    for _ in range(steps):
        if np.abs(g).max() <= tolerance:
            break
        q, kept = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            kept.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        slope, length = -(g @ q), 1.0 if pairs else min(1.0, 1 / np.abs(g).sum())
        for _ in range(25):
            to = w - length * q
            value_to, g_to = f(to)
            if value_to <= value + 1e-4 * length * slope:
                break
            length /= 2
        else:
            break
        if (y := g_to - g) @ (s := to - w) > 1e-12:
            pairs.append((s, y))
        done = value - value_to <= 1e-10 * max(1.0, abs(value))
        w, value, g = to, value_to, g_to
        if done:
            break
    return w


@dataclass
class Perceptron:
    features: list[str]
    sizes: list[int]
    w: np.ndarray

    def probability(self, df: DataFrame):
        """A column of the classes' probabilities."""
        shipped, sizes = df.sparkSession.sparkContext.broadcast(pickle.dumps(self.w)), self.sizes

        @F.pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(forward(np.stack([np.asarray(v, float) for v in x]), layers_of(pickle.loads(shipped.value), sizes))[-1]))

        return score(F.array(*(F.col(f).cast("double") for f in self.features)))


def fit(df: DataFrame, features: list[str], label: str, weight: str, hidden: list[int], alpha: float = 1e-3, steps: int = 400, seed: int = 7, classes: int = 3) -> Perceptron:
    """The mean weighted loss plus alpha / 2 of the squared weights (biases apart) over the weights' sum, at a minimum; features are complete and scaled."""
    sizes = [len(features), *hidden, classes]
    packed = stored(blocks(df, features, label, weight))
    free = np.concatenate([np.append(np.ones(a * b), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)])

    def f(w):
        loss, g, n = evaluated(packed, w, sizes)
        n = max(n, 1e-300)
        return loss / n + alpha / (2 * n) * float((w * w) @ free), g / n + alpha / n * w * free

    return Perceptron(features, sizes, minimised(f, started(sizes, seed), steps))
