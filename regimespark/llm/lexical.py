"""Exact ranked lexical search by inner products over sparse ball trees.

A score is the inner product of an item's term weights and a document's saturated term counts,
all integers. Documents are vectors over the terms of the items asked (others add nothing to any
score); tasks build a ball tree over every TREE of their vectors, halving nodes along the line
between two far documents, and keep each node's centroid, radius and terms. No document of a node
scores more than the centroid's product plus the radius times the norm of the item's weights for
terms that the node has; bounds are rounded up beyond their floating-point error. Items visit
nodes best first, score leaves in whole numbers, and stop where the bound is below their k-th best score
so far, which a task carries from tree to tree.

Items go through in blocks of BLOCK_TERMS terms, whatever their number, so what is sent to tasks
is bounded; the distinct terms of one item have to fit in memory. Tasks give their k best of each
item; these are ranked in parts first, and then by item.

Defined results: a null or empty text has no terms and no rank; an item without terms has no
rows; rows of one item_id are one item, a null item_id too; rows of one doc_id are ranked each; equal scores
by ascending doc_id, nulls last; doc_ids are whole numbers; texts are read whole; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, measured, shuffle_partitions

#: Documents of one tree and postings at which it is closed earlier, documents of a leaf, terms of a block of items.
TREE, POSTINGS, LEAF, BLOCK_TERMS = 4096, 2_000_000, 32, 500_000
#: Relative and absolute margin of a bound over its floating-point error.
MARGIN, MORE = 1e-9, 1.0
#: Letters and digits and all beyond ASCII stay, A-Z are lowered, the rest parts terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


def _texts(column):
    return (x.as_py() or b"" for x in column.cast(pa.large_binary()))


def term_weight(docs: int, having: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * having + 1)))


def saturated(tf: np.ndarray, n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """Term counts of documents of n terms, saturated and adjusted to their length."""
    m = 50 + 50 * n * docs // words
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class BallTree:
    """Vectors in leaf order, and the nodes' centroids by term."""

    def __init__(self, ids, nulls, start, term, x, size: int, leaf: int = LEAF):
        """x: whole numbers at (row, term); start: offsets of rows; size: of the vocabulary."""
        n = len(start) - 1
        y = x.astype(float)
        lengths = np.diff(start)
        norms = np.bincount(np.repeat(np.arange(n), lengths), y * y, n)
        order = np.arange(n)
        dense = np.zeros(size)
        self.nodes, nodes_terms, nodes_means = [], [], []  # (first row, end, left child or -1, right child)
        self.radius = []
        todo = [(0, n, -1)]

        def places(rows):
            """Postings of rows, and where each row's begin."""
            many = lengths[rows]
            cut = np.cumsum(many) - many
            return np.arange(int(many.sum())) + np.repeat(start[rows] - cut, many), cut, many

        def products(at, cut, many, vector):
            if not len(at):
                return np.zeros(len(many))
            sums = np.cumsum(np.append(0.0, y[at] * vector[term[at]]))
            return sums[cut + many] - sums[cut]

        while todo:
            i, j, parent = todo.pop()
            me = len(self.nodes)
            self.nodes.append([i, j, -1, -1])
            if parent >= 0:
                self.nodes[parent][2 if self.nodes[parent][2] < 0 else 3] = me
            rows = order[i:j]
            at, cut, many = places(rows)
            mean = np.bincount(term[at], y[at], size) if len(at) else np.zeros(size)
            seen = np.unique(term[at])
            mean /= j - i
            far = np.maximum(norms[rows] - 2 * products(at, cut, many, mean) + mean @ mean, 0)
            nodes_terms.append(seen)
            nodes_means.append(mean[seen])
            # cancellation may cost as much as the rounding of the largest norm
            self.radius.append(math.sqrt(float(far.max()) + MARGIN * float(norms[rows].max() + mean @ mean)))
            if j - i > leaf:
                ends = []
                for _ in range(2):
                    row = rows[int(np.argmax(far))]
                    own = slice(start[row], start[row + 1])
                    dense[term[own]] = y[own]
                    product = products(at, cut, many, dense)
                    dense[term[own]] = 0
                    ends.append(product)
                    far = norms[rows] - 2 * product + norms[row]
                order[i:j] = rows[np.argsort(ends[0] - ends[1], kind="stable")]
                half = (i + j) // 2
                todo += [(half, j, me), (i, half, me)]
        at, _, many = places(order)
        self.ids, self.nulls, self.term, self.x = ids[order], nulls[order], term[at], x[at]
        self.start = np.append(0, np.cumsum(many))
        # centroids by term: nodes that have it, and their means
        owner = np.repeat(np.arange(len(self.nodes)), [len(t) for t in nodes_terms])
        flat, means = np.concatenate(nodes_terms), np.concatenate(nodes_means)
        by = np.argsort(flat, kind="stable")
        self.node, self.mean = owner[by], means[by]
        self.first = np.searchsorted(flat[by], np.arange(size + 1))
        self.radius = np.array(self.radius)

    def bounds(self, q: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of each node, what no document in it exceeds, for weights at terms q."""
        size = self.first[q + 1] - self.first[q]
        at = np.arange(int(size.sum())) + np.repeat(self.first[q] - (np.cumsum(size) - size), size)
        w, n = np.repeat(weight, size), len(self.radius)
        centre, norm = np.bincount(self.node[at], w * self.mean[at], n), np.bincount(self.node[at], w * w, n)
        return (centre + np.sqrt(norm) * self.radius) * (1 + MARGIN) + MORE

    def search(self, bounds: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Offer best what may be among its k; weights (by term) are whole numbers. The number of leaves scored."""
        heap, scored = [(-bounds[0], 0)], 0
        while heap and -heap[0][0] >= best.least:
            i, j, left, right = self.nodes[heapq.heappop(heap)[1]]
            if left >= 0:
                for child in (left, right):
                    heapq.heappush(heap, (-bounds[child], child))
                continue
            scored += 1
            a, b = self.start[i], self.start[j]
            if a == b:
                continue
            sums = np.cumsum(np.append(0, weights[self.term[a:b]] * self.x[a:b]))
            cut = self.start[i : j + 1] - a
            scores = sums[cut[1:]] - sums[cut[:-1]]
            good = np.flatnonzero(scores >= best.least)
            if len(good):
                best.offer(scores[good], self.ids[i:j][good], self.nulls[i:j][good])
        return scored


class Best:
    """The k best (score, id) so far; `least` is the score that still counts."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores, self.ids, self.nulls = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def offer(self, scores, ids, nulls) -> None:
        scores, ids, nulls = np.append(self.scores, scores), np.append(self.ids, ids), np.append(self.nulls, nulls)
        keep = np.lexsort((ids, nulls, -scores))[: self.k]
        self.scores, self.ids, self.nulls = scores[keep], ids[keep], nulls[keep]
        if len(keep) == self.k:
            self.least = max(1, int(self.scores[-1]))


_VECTOR = "doc_id long, n long, term array<int>, tf array<int>"


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, term, tf) of docs(doc_id, text): the number of all terms, and the counts of those in the vocabulary."""
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(vocabulary))

    def count(batches):
        get = pickle.loads(shipped.value).get
        for batch in batches:
            n, found = [], []
            for data in _texts(batch.column("text")):
                words = terms(data)
                n.append(len(words))
                some = Counter(map(get, words))
                some.pop(None, None)
                found.append(some)
            cut = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = [np.fromiter((v for f in found for v in part(f)), np.int32, cut[-1]) for part in (dict.keys, dict.values)]
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), *(pa.ListArray.from_arrays(cut, pa.array(v)) for v in lists)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "term", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, _VECTOR)


def item_blocks(items: DataFrame, limit: int):
    """Lists of (item_id, distinct terms), each of about `limit` terms, one at a time."""
    def split(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([sorted(set(terms(t))) for t in _texts(batch.column("text"))], pa.list_(pa.binary()))], ["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", "text").mapInArrow(split, f"item_id {kind}, terms array<binary>")
    rows = materialise(rows.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).where("size(terms) > 0"), "lexical-items")
    block, size = [], 0
    for r in rows.toLocalIterator():
        block.append((r.item_id, [bytes(t) for t in r.terms]))
        size += len(r.terms)
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def _found(batches, shipped, k: int, tree: int, leaf: int):
    """(item_id, doc_id, score) of a task's k best documents of each item."""
    items, weights, docs, words, kind = pickle.loads(shipped.value)
    best = [Best(k) for _ in items]
    asked = np.zeros(len(weights), np.int64)
    held, rows, postings = [], 0, 0

    def search():
        ids, nulls, start, term, x = (np.concatenate(c) for c in zip(*held, strict=True))
        grown = BallTree(ids, nulls, np.append(0, np.cumsum(start)), term, x, len(weights), leaf)
        for (_, q), b in zip(items, best, strict=True):
            asked[q] = weights[q]
            grown.search(grown.bounds(q, weights[q].astype(float)), asked, b)
            asked[q] = 0

    for batch in batches:
        for at in range(0, len(batch), tree):
            part = batch.slice(at, tree)
            ids, n, term, tf = (part.column(c) for c in ("doc_id", "n", "term", "tf"))
            size = np.diff(term.offsets.to_numpy())
            flat, count = term.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.int64)
            x = saturated(count, np.repeat(n.to_numpy(), size), docs, words)
            held.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), size, flat, x))
            rows, postings = rows + len(part), postings + len(flat)
            if rows >= tree or postings >= POSTINGS:
                search()
                held, rows, postings = [], 0, 0
    if held:
        search()
    for (item, _), b in zip(items, best, strict=True):
        if len(b.ids):
            columns = [pa.array([item] * len(b.ids), kind), pa.array(b.ids, mask=b.nulls), pa.array(b.scores)]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "score"])


def search(docs: DataFrame, items: DataFrame, k: int = 50, tree: int = TREE, leaf: int = LEAF, limit: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best of docs(doc_id, text) for each of items(item_id, text)."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark, kind = docs.sparkSession, items.schema["item_id"].dataType
    schema = f"item_id {kind.simpleString()}, doc_id long, score long"
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    for block in item_blocks(items, limit):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, ts in block for t in ts}))}
        rows = vectors(docs, vocabulary)
        rows, seen = measured(rows, "lexical-vectors", docs=F.count(F.when(F.col("n") > 0, 1)), words=F.sum("n"))
        having = np.zeros(len(vocabulary), np.int64)
        # a row for each term of the block at most
        for r in rows.select(F.explode("term").alias("term")).groupBy("term").count().collect():
            having[r[0]] = r[1]
        weights = np.array([term_weight(seen["docs"], int(c)) for c in having], np.int64)
        asked = [(item, np.array(sorted(vocabulary[t] for t in ts), np.int64)) for item, ts in block]
        shipped = spark.sparkContext.broadcast(pickle.dumps((asked, weights, seen["docs"], max(1, seen["words"]), to_arrow_type(kind))))
        some = rows.where("size(term) > 0").mapInArrow(lambda it, shipped=shipped: _found(it, shipped, k, tree, leaf), schema)
        order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        part = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, math.isqrt(shuffle_partitions(spark)))))
        some = some.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "_part").orderBy(*order))).where(F.col("rank") <= k)
        some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
        out = out.unionByName(materialise(some.select("item_id", "rank", "doc_id", "score"), "lexical-ranks"))
        shipped.unpersist()
    return out


def op11_ball_tree_search(spark, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS i, doc_id, {_TERMS} AS t FROM documents),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS words FROM d WHERE len(t) > 0),
p AS MATERIALIZED (SELECT i, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT i, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY i, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
x AS (SELECT item_id, i, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // words))))::BIGINT AS score
      FROM p JOIN w USING (term) JOIN q USING (term), s GROUP BY item_id, i, doc_id),
r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
