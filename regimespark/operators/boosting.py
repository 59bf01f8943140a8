"""Gradient boosting on histograms with a softmax loss.

Features are cut at quantiles into bins of a byte each. In each round one tree for each class is
grown on gradients and hessians of the loss. Trees grow by leaf, the best split first.

Many small keys (symbols, folds) are dealt to tasks, one to each: a key whose rows are worth one task, or that has no more
than a SHARE of all rows and fits a task, grows all its rounds where its rows are (`planted`), in one job for all such keys.

Larger keys grow a round at a time, all at once: tasks sum gradients and hessians over (key, tree, node) into arrays by
feature and bin, and groups of these add the arrays up and find each node's best split. To need few passes, a pass sums
for the children of every leaf that could still be split; which of them stay is settled when all
gains that the order depends on are known, so the trees are those of one split after another.
Their rows are packed once into blocks of one key and stay in their tasks: what is shuffled are sums, and as the rows of a
key lie in neighbouring tasks, there are as many as nodes, and few more. A round's scores are kept beside the blocks
while the next trees grow, so a round costs the same however many went before; they are stored every STORE rounds.

What comes to the driver is one row for each node or round, and the trees. A null or NaN feature counts as the
least value. Row and column sampling go by hashes and repeat exactly.
"""

from __future__ import annotations

import heapq
import itertools
import math
import pickle
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored

STORE = 25
#: Rows that are worth a task of their own while there are cores, and the most of one task.
TASK_ROWS, MOST_ROWS = 1 << 16, 1 << 20
#: The share of all rows up to which a key of more than TASK_ROWS is left to one task.
SHARE = 1 / 4
#: Tasks that small keys are dealt to, at most.
MOST_TASKS = 4096
#: Rows of a node that are summed at a time.
STEP = 1 << 14


@dataclass(frozen=True)
class Boosting:
    rounds: int = 400
    rate: float = 0.05
    depth: int = 6
    leaves: int = 31
    least: int = 20
    hessian: float = 1e-3
    l2: float = 0.0
    bins: int = 64
    row_share: float = 1.0
    column_share: float = 1.0
    classes: int = 3
    seed: int = 7


@dataclass
class Tree:
    """Nodes in the order in which they were made; a node without children has left = -1, one without a split a gain of NaN."""

    feature: array = field(default_factory=lambda: array("i", [0]))
    cut: array = field(default_factory=lambda: array("i", [0]))
    left: array = field(default_factory=lambda: array("i", [-1]))
    right: array = field(default_factory=lambda: array("i", [-1]))
    depth: array = field(default_factory=lambda: array("i", [0]))
    value: array = field(default_factory=lambda: array("d", [0.0]))
    gain: array = field(default_factory=lambda: array("d", [math.nan]))

    def split(self, node: int) -> tuple[int, int]:
        for _ in range(2):
            for column, x in ((self.feature, 0), (self.cut, 0), (self.left, -1), (self.right, -1), (self.depth, self.depth[node] + 1), (self.value, 0.0), (self.gain, math.nan)):
                column.append(x)
        self.left[node], self.right[node] = len(self.left) - 2, len(self.left) - 1
        return self.left[node], self.right[node]


def places(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The node that each row ends in."""
    feature, cut, left, right = (np.array(x) for x in (tree.feature, tree.cut, tree.left, tree.right))
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins) if left[0] >= 0 else 0)
    while len(rows):
        here = at[rows]
        at[rows] = down = np.where(bins[rows, feature[here]] <= cut[here], left[here], right[here])
        rows = rows[left[down] >= 0]
    return at


def added(scores: np.ndarray, bins: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    """Scores and the values of further rounds."""
    out = scores.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += np.array(tree.value)[places(tree, bins)]
    return out


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _shares(values: np.ndarray, share: float, *salt: int) -> np.ndarray:
    """Which of some whole numbers are in a share of them, by a hash."""
    if share >= 1:
        return np.ones(len(values), bool)
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(1 + sum(s * 1_000_003**i for i, s in enumerate(salt)) % (1 << 63))
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) < share * (1 << 53)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """A byte for each value: the number of edges below it; what is missing is the least."""
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(e, x[:, j], "left"))
    return out


def _named(key: str | None):
    return F.lit("") if key is None else F.col(key).cast("string")


def measured(df: DataFrame, features: list[str], spec: Boosting, label: str, weight: str | None, key: str | None, edges: list | None) -> tuple[dict, dict, dict]:
    """Of each key, the number of rows, the logarithms of the classes' weights' shares and the edges of each feature: distinct quantiles, by sketches of bounded size. One pass."""
    w, shares = F.lit(1.0) if weight is None else F.col(weight), [i / spec.bins for i in range(1, spec.bins)]
    value = lambda f: F.when(~F.isnan(F.col(f)), F.col(f)).cast("double")
    sums = [F.coalesce(F.sum(F.when(F.col(label) == k, w)), F.lit(0.0)) for k in range(spec.classes)]
    sketches = [] if edges is not None else [F.percentile_approx(value(f), shares, 10_000) for f in features]
    rows = [(r[0], r[1], np.array(r[2 : 2 + spec.classes], float), r[2 + spec.classes :]) for r in df.groupBy(_named(key)).agg(F.count("*"), *sums, *sketches).collect()]
    start = {k: np.log(np.maximum(v / max(v.sum(), 1e-300), 1e-9)) for k, _, v, _ in rows}
    found = {k: [np.array(e, float) for e in edges] if edges is not None else [np.unique(np.array(x or [], float)) for x in q] for k, _, _, q in rows}
    return {k: n for k, n, _, _ in rows}, start, found


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


#: A block: rows of one key, their numbers as bytes; bins and scores by feature and by class.
_BASE = pa.schema([("key", pa.string()), *((c, pa.binary()) for c in ("rid", "y", "w", "bins", "scores"))])
_BASE_SQL = "key string, rid binary, y binary, w binary, bins binary, scores binary"
#: Sums of a node's rows in a task: gradients, hessians and rows, by feature and bin.
_SUMS = pa.schema([("key", pa.string()), ("tree", pa.int32()), ("node", pa.int32()), ("part", pa.int32()), ("sums", pa.binary())])
_SPLITS = pa.schema([("key", pa.string()), ("tree", pa.int32()), ("node", pa.int32()), ("g", pa.float64()), ("h", pa.float64()), ("n", pa.int64()), ("feature", pa.int32()), ("bin", pa.int32()), ("gain", pa.float64())])


def _row(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


def _blocks(batches, width: int, classes: int):
    """(key, rid, y, w, bins, scores) of each block; bins are rows by features, scores rows by classes."""
    for batch in batches:
        for key, rid, y, w, bins, scores in zip(*(batch.column(c) for c in _BASE.names), strict=True):
            read = lambda v, kind: np.frombuffer(v.as_buffer(), kind)
            yield key.as_py(), read(rid, np.int64), read(y, np.int32), read(w, float), read(bins, np.uint8).reshape(width, -1).T, read(scores, float).reshape(classes, -1).T


def prepared(df: DataFrame, features: list[str], edges: dict, start: dict, label: str, weight: str | None, key: str | None, parts: int, tasks: DataFrame | None = None, spread: bool = True) -> DataFrame:
    """Rows in blocks, as the passes read them, sorted by key. Keys listed in `tasks` (key, task) are left out if rows are spread over tasks of equal size; else they alone are taken, each to its task."""
    width, shipped = len(features), df.sparkSession.sparkContext.broadcast(pickle.dumps((edges, start)))

    def pack(batches):
        edges, start = pickle.loads(shipped.value)
        for batch in batches:
            runs, at = pc.run_end_encode(batch.column("key")), 0
            for k, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                own, at = batch.slice(at, end - at), end
                bins = binned(_matrix(own.column("x"), width), edges[k])
                scores = np.repeat(np.asarray(start[k], float)[:, None], len(bins), axis=1)
                column = lambda c, kind: own.column(c).to_numpy(zero_copy_only=False).astype(kind).tobytes()  # noqa: B023, E731
                yield _row(_BASE, k, column("rid", np.int64), column("y", np.int32), column("w", float), bins.T.tobytes(), scores.tobytes())

    x = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features)).alias("x")
    rows = df.select(_named(key).alias("key"), F.monotonically_increasing_id().alias("rid"), F.col(label).cast("int").alias("y"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"), x)
    if spread:
        rest = rows if tasks is None else rows.join(F.broadcast(tasks), "key", "left_anti")
        dealt = rest.repartitionByRange(parts, "key", "rid")
    else:
        dealt = rows.join(F.broadcast(tasks), "key").repartitionById(parts, "task").drop("task")
    return dealt.sortWithinPartitions("key", "rid").mapInArrow(pack, _BASE_SQL)


def cells(base: DataFrame, growing: dict, wanted: dict, width: int, number: int, spec: Boosting) -> DataFrame:
    """(key, tree, node, part, sums): sums of gradients, hessians and rows of wanted nodes, of each task."""
    shipped = base.sparkSession.sparkContext.broadcast(pickle.dumps((growing, wanted)))

    def add(batches):
        growing, wanted = pickle.loads(shipped.value)
        part, before, sums = TaskContext.get().partitionId(), None, {}

        def done():
            for k, into in sums.items():
                for i, node in enumerate(wanted[before][k]):
                    if into[2, :, i].any():
                        yield _row(_SUMS, before, k, node, part, into[:, :, i].tobytes())

        for key, rid, y, w, bins, scores in _blocks(batches, width, spec.classes):
            if key != before:
                yield from done()
                before, sums = key, {}
            if key not in wanted:
                continue
            if spec.row_share < 1:
                seen = np.flatnonzero(_shares(rid, spec.row_share, spec.seed, number))
                y, w, bins, scores = y[seen], w[seen], np.asfortranarray(bins[seen]), scores[seen]
            p = softmax(scores)
            for k, nodes in enumerate(wanted[key]):
                features = _kept(width, number, k, spec)
                if not nodes or not len(features):
                    continue
                slot = np.full(len(growing[key][k].left), -1)
                slot[nodes] = np.arange(len(nodes))
                at = slot[places(growing[key][k], bins)]
                rows = np.flatnonzero(at >= 0)
                first, share, weight, size = at[rows] * spec.bins, p[rows, k], w[rows], len(nodes) * spec.bins
                g, h = weight * (share - (y[rows] == k)), weight * share * (1 - share)
                if k not in sums:
                    sums[k] = np.zeros((3, len(features), len(nodes), spec.bins))
                for j, f in enumerate(features):
                    cell = first + bins[rows, f]
                    for i, v in enumerate((g, h, None)):
                        sums[k][i, j] += np.bincount(cell, v, size).reshape(len(nodes), spec.bins)
        yield from done()

    return base.mapInArrow(add, "key string, tree int, node int, part int, sums binary")


def _kept(width: int, number: int, k: int, spec: Boosting) -> np.ndarray:
    """The features that a round's tree may use."""
    return np.flatnonzero(_shares(np.arange(width), spec.column_share, spec.seed, number, k))


def _best(total: np.ndarray, features: np.ndarray, spec: Boosting) -> tuple | None:
    """(feature, bin, gain) of the split with the greatest gain by sums of a node; of equal gains the first by feature and bin."""
    (gl, hl, nl), (g, h, n) = np.cumsum(total, axis=2), total[:, 0].sum(axis=1)
    gr, hr = g - gl, h - hl
    fits = (total[2] > 0) & (nl >= spec.least) & (nl <= n - spec.least) & (hl >= spec.hessian) & (hr >= spec.hessian)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl * gl / (hl + spec.l2) + gr * gr / (hr + spec.l2) - g * g / (h + spec.l2)
    gain = np.where(fits & (gain > 0), gain, 0.0).round(6)
    feature, at = divmod(int(gain.argmax()), spec.bins)
    return (int(features[feature]), at, float(gain[feature, at])) if gain[feature, at] > 0 else None


def _value(g: float, h: float, spec: Boosting) -> float:
    return -spec.rate * g / (h + spec.l2) if h + spec.l2 > 0 else 0.0


def best_splits(found: DataFrame, width: int, number: int, spec: Boosting) -> DataFrame:
    """(key, tree, node, g, h, n, feature, bin, gain): of each node, its sums and the split at `bin` (values up to it go left) with the greatest gain; equal gains by feature and bin."""

    def best(table: pa.Table) -> pa.Table:
        key, tree, node = (table.column(c)[0].as_py() for c in ("key", "tree", "node"))
        features = _kept(width, number, tree, spec)
        # added up in the order of the tasks, whichever ends first
        total = sum(np.frombuffer(v, float) for v in table.sort_by("part").column("sums").to_pylist()).reshape(3, len(features), spec.bins)
        g, h, n = total[:, 0].sum(axis=1)
        return pa.Table.from_batches([_row(_SPLITS, key, tree, node, float(g), float(h), int(n), *(_best(total, features, spec) or (None, None, None)))])

    return found.groupBy("key", "tree", "node").applyInArrow(best, "key string, tree int, node int, g double, h double, n long, feature int, bin int, gain double")


def chosen(tree: Tree, spec: Boosting) -> tuple[set[int], list[int]]:
    """The nodes that best-first growth splits, and the leaves whose children must be summed before it can go on."""
    split, heap, leaves, known = set(), [], 1, []

    def offer(node):
        if not math.isnan(tree.gain[node]) and tree.depth[node] < spec.depth:
            heapq.heappush(heap, (-tree.gain[node], node))

    offer(0)
    while heap and leaves < spec.leaves:
        node = heapq.heappop(heap)[1]
        if tree.left[node] < 0:
            known = [node, *(n for _, n in sorted(heap))]
            return split, [n for n in known if tree.left[n] < 0][: spec.leaves - leaves]
        split.add(node)
        leaves += 1
        offer(tree.left[node])
        offer(tree.right[node])
    return split, []


def pruned(tree: Tree, split: set[int]) -> Tree:
    """The tree with the given splits only."""
    out, todo = Tree(), [(0, 0)]
    while todo:
        old, new = todo.pop()
        out.value[new] = tree.value[old]
        if old in split:
            out.feature[new], out.cut[new], out.gain[new] = tree.feature[old], tree.cut[old], tree.gain[old]
            a, b = out.split(new)
            todo += [(tree.left[old], a), (tree.right[old], b)]
    return out


def grown(base: DataFrame, keys: list[str], width: int, number: int, spec: Boosting) -> dict:
    """One round: a tree for each key and class."""
    growing = {key: [Tree() for _ in range(spec.classes)] for key in keys}
    wanted = {key: [[0] for _ in range(spec.classes)] for key in keys}
    while wanted:
        for r in best_splits(cells(base, growing, wanted, width, number, spec), width, number, spec).collect():
            tree = growing[r.key][r.tree]
            tree.value[r.node] = _value(r.g, r.h, spec)
            if r.gain is not None:
                tree.feature[r.node], tree.cut[r.node], tree.gain[r.node] = r.feature, r.bin, r.gain
        wanted = {}
        for key, trees in growing.items():
            asked = [[c for n in chosen(t, spec)[1] for c in t.split(n)] for t in trees]
            if any(asked):
                wanted[key] = asked
    return {key: [pruned(t, chosen(t, spec)[0]) for t in trees] for key, trees in growing.items()}


def _paired(bins: np.ndarray, size: int) -> np.ndarray:
    """Codes of the bins of two features each, pairs by rows; an odd last feature is paired with zeros."""
    other = bins[1::2] if len(bins) % 2 == 0 else np.vstack([bins[1::2], np.zeros_like(bins[:1])])
    return bins[::2].astype(np.uint16) * np.uint16(size) + other


def _summed(bins: np.ndarray, pairs: np.ndarray, rows: np.ndarray | None, gh: np.ndarray, size: int, counts: np.ndarray | None = None) -> np.ndarray:
    """Sums of gradients (real) and hessians (imaginary) and numbers of some rows, or all, by feature and bin; bins are features by rows, `counts` numbers that are known.

    Nodes with many rows are counted by the codes of two features at a time, which are then added up by either.
    """
    width, of = len(bins), gh if rows is None else gh[rows]
    if len(of) < size * size:
        cell = ((bins if rows is None else bins[:, rows]) + np.arange(width)[:, None] * size).ravel()
        sums, numbers = np.zeros(width * size, complex), np.bincount(cell, minlength=width * size)
        np.add.at(sums, cell, np.tile(of, width))
        return np.stack([sums.real, sums.imag, numbers]).reshape(3, width, size)
    out = np.empty((3, 2 * len(pairs), size))
    for j, codes in enumerate(pairs):
        sums, numbers = np.zeros(size * size, complex), np.zeros(size * size, np.int64)
        for at in range(0, len(of), STEP):
            step = slice(at, at + STEP)
            cell = (codes[step] if rows is None else codes[rows[step]]).astype(np.intp)
            np.add.at(sums, cell, of[step])
            if counts is None:
                numbers += np.bincount(cell, minlength=size * size)
        for f, axis in ((2 * j, 1), (2 * j + 1, 0)):
            own = sums.reshape(size, size).sum(axis)
            out[0, f], out[1, f] = own.real, own.imag
            if counts is None:
                out[2, f] = numbers.reshape(size, size).sum(axis)
    if counts is not None:
        out[2, :width] = counts
    return out[:, :width]


def planted(bins: np.ndarray, gh: np.ndarray, seen: np.ndarray | None, counts: np.ndarray, features: np.ndarray, spec: Boosting) -> tuple[Tree, np.ndarray]:
    """A tree of rows that are all here, one split after another, and the value of each row.

    Bins are features by rows, gh gradients and hessians, `counts` the numbers of rows by feature and bin; rows not `seen` are left out of sums.
    Of two children only the smaller is summed; the other has what is left of its parent's sums.
    """
    tree, values, heap, totals = Tree(), np.zeros(len(gh)), [], {}
    rows = {0: np.arange(len(gh))}
    if not len(features):
        return tree, values
    kept = bins[features]
    pairs = _paired(kept, spec.bins)
    counted = lambda node: rows[node] if seen is None else rows[node][seen[rows[node]]]

    def offer(node, total):
        """A node's value, and its split among those to choose from."""
        g, h = total[:2, 0].sum(axis=1)
        tree.value[node] = _value(float(g), float(h), spec)
        if tree.depth[node] < spec.depth and (split := _best(total, features, spec)) is not None:
            totals[node] = total
            heapq.heappush(heap, (-split[2], node, split))

    offer(0, _summed(kept, pairs, None, gh, spec.bins, counts[features]) if seen is None else _summed(kept, pairs, counted(0), gh, spec.bins))
    leaves = 1
    while heap and leaves < spec.leaves:
        _, node, (tree.feature[node], tree.cut[node], tree.gain[node]) = heapq.heappop(heap)
        children, here, total = tree.split(node), rows.pop(node), totals.pop(node)
        low = bins[tree.feature[node]][here] <= tree.cut[node]
        rows[children[0]], rows[children[1]] = here[low], here[~low]
        leaves += 1
        own = {c: counted(c) for c in children}
        small, large = sorted(children, key=lambda c: len(own[c]))
        # a node of fewer rows has no split, nor have those that are never reached
        if leaves < spec.leaves and tree.depth[small] < spec.depth and len(own[large]) >= 2 * spec.least:
            part = _summed(kept, pairs, own[small], gh, spec.bins)
            for c, sums in sorted({small: part, large: total - part}.items()):
                offer(c, sums)
        else:
            for c in children:
                x = gh[own[c]].sum()
                tree.value[c] = _value(float(x.real), float(x.imag), spec)
    for leaf, own in rows.items():
        values[own] = tree.value[leaf]
    return tree, values


_ROUNDS = pa.schema([("key", pa.string()), ("number", pa.int32()), ("trees", pa.binary())])


def planted_rounds(blocks: DataFrame, width: int, spec: Boosting) -> DataFrame:
    """(key, number, trees): all rounds of keys whose blocks lie in one task each, one after another."""

    def grow(batches):
        for key, own in itertools.groupby(_blocks(batches, width, spec.classes), lambda block: block[0]):
            rid, y, w, bins, scores = (list(c) for c in list(zip(*own, strict=True))[1:])
            rid, y, w, scores = (np.concatenate(c) for c in (rid, y, w, scores))
            bins = np.concatenate([b.T for b in bins], axis=1)
            counts = np.stack([np.bincount(b, minlength=spec.bins) for b in bins])
            for number in range(spec.rounds):
                seen = _shares(rid, spec.row_share, spec.seed, number) if spec.row_share < 1 else None
                p, trees = softmax(scores), []
                for k in range(spec.classes):
                    share, gh = p[:, k], np.empty(len(y), complex)
                    gh.real, gh.imag = w * (share - (y == k)), w * share * (1 - share)
                    tree, values = planted(bins, gh, seen, counts, _kept(width, number, k, spec), spec)
                    trees.append(tree)
                    scores[:, k] += values
                yield _row(_ROUNDS, key, number, pickle.dumps(trees))

    return blocks.mapInArrow(grow, "key string, number int, trees binary")


@dataclass
class Boosted:
    features: list[str]
    edges: dict
    start: dict
    rounds: dict  # key → rounds of one tree for each class
    spec: Boosting

    def probability(self, df: DataFrame, key: str | None = None, rounds: int | None = None):
        """A column of the classes' probabilities; null for a key that was not fitted."""
        shipped = df.sparkSession.sparkContext.broadcast({k: pickle.dumps((self.edges[k], self.start[k], r[:rounds])) for k, r in self.rounds.items()})
        classes, width = self.spec.classes, len(self.features)

        @F.arrow_udf("array<double>")
        def score(x: pa.Array, keys: pa.Array) -> pa.Array:
            rows, named = _matrix(x, width), keys.dictionary_encode()
            of, out, there = named.indices.fill_null(-1).to_numpy(zero_copy_only=False), np.zeros((len(rows), classes)), np.zeros(len(rows), bool)
            for i, k in enumerate(named.dictionary.to_pylist()):
                if k in shipped.value:
                    (edges, start, trees), own = pickle.loads(shipped.value[k]), np.flatnonzero(of == i)
                    out[own] = softmax(added(np.tile(start, (len(own), 1)).reshape(-1, classes), binned(rows[own], edges), trees))
                    there[own] = True
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * classes, mask=np.append(~there, False))
            return pa.ListArray.from_arrays(ends, pa.array(out.ravel()))

        x = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in self.features))
        return score(x, _named(key))

    def table(self, spark) -> DataFrame:
        """(key, round, class, node, feature, cut, gain, value): the trees, a node named by its way from the root."""
        out = []
        for key, rounds in self.rounds.items():
            for i, trees in enumerate(rounds):
                for k, t in enumerate(trees):
                    names = [""] * len(t.left)
                    for n, left in enumerate(t.left):
                        inner = left >= 0
                        if inner:
                            names[left], names[t.right[n]] = names[n] + "L", names[n] + "R"
                        edge = self.edges[key][t.feature[n]] if inner else None
                        out.append((key, i, k, names[n], self.features[t.feature[n]] if inner else None, float(edge[t.cut[n]]) if inner else None, t.gain[n] if inner else None, t.value[n]))
        return spark.createDataFrame(out, "key string, round int, class int, node string, feature string, cut double, gain double, value double")

    def gains(self) -> dict[str, int]:
        """How often each feature splits a node, over all keys."""
        count = np.zeros(len(self.features), np.int64)
        for trees in (t for rounds in self.rounds.values() for r in rounds for t in r):
            inner = [f for f, left in zip(trees.feature, trees.left, strict=True) if left >= 0]
            count += np.bincount(inner, minlength=len(count))
        return dict(zip(self.features, count.tolist(), strict=True))


def fit(df: DataFrame, features: list[str], spec: Boosting | None = None, label: str = "y", weight: str | None = None, key: str | None = None, edges: list | None = None) -> Boosted:
    """A model for each key (one without a key) of df's rows; `label` holds classes 0, 1, ...; `edges` of the features' bins replace quantiles."""
    spec = spec or Boosting()
    if not 2 <= spec.bins <= 256:
        raise ValueError("bins must lie between 2 and 256")
    sizes, start, edges = measured(df, features, spec, label, weight, key, edges)
    model, n = Boosted(features, edges, start, {k: [] for k in edges}, spec), sum(sizes.values())
    most, arguments = max(TASK_ROWS, min(MOST_ROWS, int(n * SHARE))), (df, features, edges, start, label, weight, key)
    # the largest first, so that no long task begins at the end; a null key is none
    small = sorted((k for k, size in sizes.items() if k is not None and size <= most), key=lambda k: (-sizes[k], k))
    tasks = df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(small)], "key string, task int") if small else None
    if small:
        blocks = prepared(*arguments, min(len(small), MOST_TASKS), tasks, False)
        for r in sorted(planted_rounds(blocks, len(features), spec).collect(), key=lambda r: r.number):
            model.rounds[r.key].append(pickle.loads(r.trees))
    if large := list(edges.keys() - set(small)):
        n = sum(sizes[k] for k in large)
        parts = max(min(math.ceil(n / TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism), math.ceil(n / MOST_ROWS))
        _grow_large(prepared(*arguments, parts, tasks), large, model)
    return model


def _grow_large(blocks: DataFrame, keys: list[str], model: Boosted) -> None:
    """All rounds of keys that are spread over tasks, round by round."""
    spec, width = model.spec, len(model.features)
    base, before = stored(blocks), None
    for number in range(spec.rounds):
        trees = grown(base, keys, width, number, spec)
        if before is not None:
            before.unpersist()
        for key_, of in trees.items():
            model.rounds[key_].append(of)
        if number + 1 < spec.rounds:
            after = _scored(base, trees, width, spec.classes)
            base, before = stored(after) if (number + 1) % STORE == 0 else after.persist(), base
    base.unpersist()


def _scored(base: DataFrame, trees: dict, width: int, classes: int) -> DataFrame:
    """The base with the values of a further round in its scores."""
    shipped = base.sparkSession.sparkContext.broadcast(pickle.dumps(trees))

    def add(batches):
        trees = pickle.loads(shipped.value)
        for batch in batches:
            for i, (key, _, _, _, bins, scores) in enumerate(_blocks([batch], width, classes)):
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns[:5], pa.array([added(scores, bins, [trees[key]]).T.tobytes()], pa.binary())], schema=_BASE)

    return base.mapInArrow(add, _BASE_SQL)
