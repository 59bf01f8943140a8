"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are runs of a-z, 0-9 and non-ASCII bytes after A-Z are lower-cased. The automaton is
built once over the word ids of all items; document words then stream through it, and the
length of the longest match that ends at each word is tracked. Where it reaches the window,
the last `window` words are part of an item; an item of fewer words matches as a whole.
Runs of neighbouring words that no item has next to each other are skipped beforehand.

The automaton is shipped to every executor, so it is bounded: items are dealt into blocks of
about BLOCK_WORDS words (a longer item is a block of its own), of which one is held at a time.
Where there are several, each block reads the texts and writes only the ranges that it hits, by
the 128-bit hash of the text; the documents themselves are read once more in the end and are not
rewritten between.

Defined results: a null or empty text has no words and no hits; an item without words never
matches; an item with a null item_id still marks words but is not listed; repeated items
count once per item_id; an empty benchmark leaves all documents clean; repeated documents are
judged alike.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, measured, packed, relieved, sieve_join, two_hashes

BLOCK_WORDS = 500_000
_WORD = b"abcdefghijklmnopqrstuvwxyz0123456789" + bytes(range(128, 256))
_FOLD = bytes(b if b in _WORD else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over word ids, with the items of each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.ids = {w: i for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        coded = [(item, [self.ids[w] for w in ws]) for item, ws in items if ws]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        pairs = set()
        for _, ws in coded:
            last = 0
            for c in ws:
                last = self._extend(last, c)
            pairs.update(zip(ws, ws[1:], strict=False))
        size = np.int64(len(self.ids) + 1)
        self.pairs = np.array(sorted(a * int(size) + b for a, b in pairs), np.int64)
        self.least = min([window, *(len(ws) for _, ws in coded)])
        self.full: dict[int, set] = {}
        short: dict[int, set] = {}
        for item, ws in coded:
            state = 0
            for n, c in enumerate(ws, 1):
                state = self.next[state][c]
                if n >= window:
                    self.full.setdefault(self._cut(state, window), set()).add(item)
            if len(ws) < window:
                short.setdefault(self._cut(state, len(ws)), set()).add((len(ws), item))
        self.short = [()] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.short[state] = (*self.short[self.link[state]], *short.get(state, ()))

    def _new(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        cur = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _cut(self, state: int, length: int) -> int:
        """The state of the last `length` words of what leads to `state`."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def candidates(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Runs [i, j) of words each of whose neighbours are next to each other in some item."""
        known = codes >= 0
        if not len(codes) or not len(self.ids):
            return []
        joined = np.zeros(len(codes) + 1, bool)
        if len(self.pairs):
            pair = codes[:-1].astype(np.int64) * (len(self.ids) + 1) + codes[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[1:-1] = known[:-1] & known[1:] & (self.pairs[at] == pair)
        starts = np.flatnonzero(known & ~joined[:-1])
        ends = np.flatnonzero(known & ~joined[1:]) + 1
        keep = ends - starts >= self.least
        return list(zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))

    def scan(self, codes: np.ndarray) -> tuple[list[tuple[int, int]], set]:
        """Hit word ranges [i, j) and the items with occurring windows."""
        hits: list[tuple[int, int]] = []
        items: set = set()
        for i, j in self.candidates(codes):
            state = n = 0
            for at, c in enumerate(codes[i:j].tolist(), i + 1):
                while state and c not in self.next[state]:
                    state = self.link[state]
                    n = self.length[state]
                if c not in self.next[state]:
                    continue
                state = self.next[state][c]
                n += 1
                if n >= self.window:
                    hits.append((at - self.window, at))
                    items |= self.full[self._cut(state, self.window)]
                for length, item in self.short[state]:
                    if length <= n:
                        hits.append((at - length, at))
                        items.add(item)
        return hits, items


def merged(hits) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for i, j in sorted(hits):
        if out and i <= out[-1][1]:
            out[-1][1] = max(out[-1][1], j)
        else:
            out.append([i, j])
    return [(i, j) for i, j in out]


def item_blocks(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """(id, text, block) of the distinct items, and the number of blocks."""
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // (BLOCK_WORDS * 2)) or 1
    return items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))), blocks


def automaton(items: DataFrame, block: int, window: int):
    """The broadcast pickled automaton of one block."""
    rows = items.where(F.col("block") == block).collect()
    built = Automaton([(r.id, words(r.text.encode())) for r in sorted(rows, key=lambda r: (r.id or "", r.text))], window)
    return items.sparkSession.sparkContext.broadcast(cloudpickle.dumps(built))


def _scan(a: Automaton, data: bytes):
    ws = words(data)
    get = a.ids.get
    hits, got = a.scan(np.fromiter((get(w, -1) for w in ws), np.int64, len(ws)))
    return len(ws), hits, got


def _texts(column):
    return (x.as_py() or b"" for x in column.cast(pa.large_binary()))


def _block_hits(batches, shipped):
    """(k1, k2, hits, items) of the texts that a block hits."""
    a = pickle.loads(shipped.value)
    for batch in batches:
        rows = []
        for k1, k2, data in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), _texts(batch.column("text")), strict=True):
            _, hits, got = _scan(a, data)
            if hits:
                rows.append((k1, k2, [x for r in merged(hits) for x in r], sorted(x for x in got if x is not None)))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)], ["k1", "k2", "hits", "items"])


_FIELDS = {"n_words": pa.int64(), "hits": pa.list_(pa.int64()), "items": pa.list_(pa.string()), "clean": pa.string()}
_FOUND = "struct<n_words:bigint,hits:array<bigint>,items:array<string>,clean:string>"


def _judged(batches, kept, shipped=None):
    """(row, found): the hits of the only automaton, or those that came along as hits and items."""
    a = pickle.loads(shipped.value) if shipped is not None else None
    for batch in batches:
        row = batch.column("row")
        fields = {f.name: row.field(i) for i, f in enumerate(row.type)}
        along = zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True) if a is None else [(None, None)] * len(batch)
        out = []
        for data, (h, some) in zip(_texts(fields["text"]), along, strict=True):
            n, hits, got = _scan(a, data) if a is not None else (len(words(data)), list(zip(h[::2], h[1::2], strict=True)) if h else [], set(some or ()))
            flat = [x for r in merged(hits) for x in r]
            out.append((n, flat, sorted(x for x in got if x is not None), without_spans(data, flat) if flat else None))
        columns = zip(*out, strict=True) if out else [()] * 4
        struct = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, _FIELDS.values(), strict=True)], list(_FIELDS))
        yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([fields[c] for c in kept], list(kept)), struct], ["row", "found"])


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: list[str] | None = None) -> DataFrame:
    """(row, found): the `keep` columns of docs (all by default), and words, word ranges hit (flattened start, end pairs), items, and the text without the ranges where there are any."""
    kept = tuple(c for c in docs.columns if keep is None or c in keep)
    schema = f"row struct<{','.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in docs.schema if f.name in kept)}>, found {_FOUND}"
    items, blocks = item_blocks(benchmark)
    rows = docs.select(packed(docs))
    if blocks == 1:
        shipped = automaton(items, 0, window)
        return rows.mapInArrow(lambda it: relieved(_judged(it, kept, shipped)), schema)
    k1, k2 = two_hashes("text")
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), "text")
    marks = None
    for block in range(blocks):
        shipped = automaton(items, block, window)
        some = keyed.mapInArrow(lambda it, shipped=shipped: _block_hits(it, shipped), "k1 long, k2 long, hits array<long>, items array<string>")
        some = materialise(some, "decontam-block")
        shipped.unpersist()
        marks = some if marks is None else marks.unionByName(some)
    marks = marks.groupBy("k1", "k2").agg(F.flatten(F.collect_set("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.count("*").alias("c"))
    marks, seen = measured(marks, "decontam-hits", sum=F.sum("c"), top=F.max("c"))
    k1, k2 = two_hashes("row.text")
    joined = sieve_join(rows.withColumn("k1", k1).withColumn("k2", k2), marks, ["k1", "k2"], "c", seen["sum"], ["row"], seen["top"])
    return joined.select("row", "hits", "items").mapInArrow(lambda it: relieved(_judged(it, kept)), schema)


def without_spans(data: bytes, hits: list[int]) -> str:
    """The text without the words in the given ranges, and what lies between them."""
    at = [m.span() for m in re.finditer(rb"[a-z0-9\x80-\xff]+", data.translate(_FOLD))]
    out, done = [], 0
    for i, j in zip(hits[::2], hits[1::2], strict=True):
        out.append(data[done : at[i][0]])
        done = at[j - 1][1]
    out.append(data[done:])
    return b"".join(out).decode()


def n_hit():
    """Words within the (disjoint) ranges of found.hits."""
    return F.aggregate(F.transform("found.hits", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """The documents without the spans that match items, and without those of which more than `max_coverage` of the words match.

    Same columns as `docs`, whatever their names; n_chars, if there, follows the text.
    """
    found = find_hits(docs, benchmark, window).where(n_hit() <= F.col("found.n_words") * max_coverage)
    changed = {"text": F.coalesce("found.clean", "row.text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("found.clean").isNull(), F.col("row.n_chars")).otherwise(F.length("found.clean")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op4_automaton_decontam(spark, sf_dir: str) -> DataFrame:
    """Every document: words, words hit, items with occurring windows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = find_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    items = F.sha2(F.array_join(F.array_sort("found.items"), ",").cast("binary"), 256)
    return rows.select(
        "row.doc_id", "found.n_words", n_hit().alias("n_hit"), F.size("found.items").cast("long").alias("n_items"), items.alias("items_sha256"), (n_hit() > 0).alias("contaminated")
    )


OP4_SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
dw AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dg AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
m AS (SELECT dg.doc_id, dg.k, dg.i, win.item_id FROM dg JOIN win ON dg.g = win.g AND dg.k = win.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h ON dw.doc_id = h.doc_id LEFT JOIN t ON dw.doc_id = t.doc_id
"""
