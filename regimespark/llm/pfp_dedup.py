"""Removal of byte strings that occur more than once, by prefix-free parsing.

Rolling hashes of TRIGGER bytes choose the triggers: the least hash within each window of
`length` bytes (its leftmost one). Equal windows have the same trigger at the same place, and
every window has one, so the triggers cut each text into phrases: runs of window starts that
share a trigger, with the `length` bytes that follow, which is as much of the parse as a window
can reach. Only phrases that can hold a repeated window are put in order:

* a trigger that occurs once: none of its windows occurs twice, nothing more is done;
* a phrase that occurs twice with all that follows: all of its windows do;
* the distinct phrases of the other triggers form the dictionary. For each trigger, what follows
  it in the phrases is sorted (the suffix array of the parse, cut at `length` bytes, with the
  common prefixes of neighbours). From there the suffixes of the phrases are sorted by induction:
  those that start one byte further left are in order by that byte and then as before, and the
  common prefixes follow by range minima. This is the corpus order of all windows of a trigger,
  by bytes; a window is repeated if a neighbour has `length` bytes in common with it.

A trigger of more than GROUP distinct phrases is not sorted in one task: its windows are counted
by trigger, place and hash (136 bits in all), which splits by window and combines map-side.
Texts are told apart by 128 bits, phrases by the 64 bits of the trigger and 64 of their own.

Defined results: null counts as empty; texts shorter than `length` bytes keep all their
bytes; matches do not cross documents; repeated rows are repeats of each other; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import byte_column, doc_groups, hot_join, materialise, measured, semi_join, sieve_join, sieved, two_hashes

TRIGGER = 64
#: Most phrases of one trigger that a task sorts.
GROUP = 4096
_GROUP = 1 << 20


def phrases(data: np.ndarray, offsets: np.ndarray, length: int):
    """Phrases of the texts data[offsets[k]:offsets[k+1]]: (row, first start, starts, trigger's place after the first start, trigger hash, phrase hash)."""
    width = length - TRIGGER + 1
    first, last = int(offsets[0]), int(offsets[-1])
    for base in range(first, max(first + 1, last - length + 1), _GROUP):
        part = data[base : min(last, base + _GROUP + length - 1)]
        if len(part) < length:
            continue
        h = rolling.windows(part, TRIGGER)
        key = (h >> np.uint64(22) << np.uint64(22)) | np.arange(len(h), dtype=np.uint64)
        trigger = (rolling.sliding_min(key, width) & np.uint64((1 << 22) - 1)).astype(np.int64)
        n = len(part) - length + 1
        starts = np.arange(base, base + n)
        row = np.searchsorted(offsets, starts, "right") - 1
        valid = starts + length <= offsets[row + 1]
        change = np.ones(n, bool)
        change[1:] = (trigger[1:] != trigger[:-1]) | ~valid[:-1]
        lo = np.flatnonzero(valid & change)
        if not len(lo):
            continue
        ends = np.flatnonzero(valid & np.append(change[1:] | ~valid[1:], True)) + 1
        at = trigger[lo]
        whole = rolling.mix(rolling.spans(part, lo, ends + length - 1) ^ (at - lo).astype(np.uint64))
        yield row[lo], lo + base - offsets[row[lo]], ends - lo, at - lo, h[at], whole


def _parse(batches, length):
    for batch in batches:
        data, offsets = byte_column(batch.column("text"))
        tk, t2 = (batch.column(c).to_numpy() for c in ("tk", "t2"))
        for i, j in doc_groups(offsets, _GROUP):
            for row, lo, n, at, trigger, phrase in phrases(data, offsets[i : j + 1], length):
                columns = (tk[i + row], t2[i + row], lo.astype(np.int32), n.astype(np.int32), at.astype(np.int32), trigger.view(np.int64), phrase.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["tk", "t2", "lo", "n", "at", "trigger", "phrase"])


_CONTEXT = "trigger long, tk long, t2 long, lo int, n int, at int, open boolean, wide boolean, body binary"


def _contexts(batches, length):
    """The phrases to be compared, with the bytes that follow."""
    names = [x.split()[0] for x in _CONTEXT.split(", ")]
    for batch in batches:
        texts, probes = batch.column("text").cast(pa.large_binary()), batch.column("probes").to_pylist()
        for tk, t2, text, some in zip(batch.column("tk").to_pylist(), batch.column("t2").to_pylist(), texts, probes, strict=True):
            text = text.as_py()
            for i in range(0, len(some), 2000):
                rows = [(p["trigger"], tk, t2, p["lo"], p["n"], p["at"], p["open"], p["wide"] or False, text[p["lo"] : p["lo"] + p["n"] + length - 1]) for p in some[i : i + 2000]]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _neighbours(order, lcp, keep):
    """order and common prefixes of the kept elements: minima over what lies between them."""
    at = np.flatnonzero(keep)
    if not len(at):
        return order[:0], lcp[:0]
    return order[at], np.minimum.reduceat(lcp[: at[-1] + 1], np.append(0, at[:-1] + 1))


def _range_minima(lcp, lo, hi):
    """min(lcp[lo[k] : hi[k] + 1]) by doubling."""
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    out, table = np.empty(len(lo), lcp.dtype), lcp
    for k in range(int(level.max(initial=-1)) + 1):
        mine = level == k
        out[mine] = np.minimum(table[lo[mine]], table[hi[mine] - (1 << k) + 1])
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def corpus_order(triggers: np.ndarray, bodies: list[bytes], at: np.ndarray, length: int):
    """For d = 0, 1, ...: (d, order, lcp) of the windows that start d bytes before their trigger.

    bodies[k] has the trigger at at[k]. order lists the phrases with that many bytes before it by (trigger, bytes from there);
    lcp[i] is the common prefix of order[i - 1] and order[i], 0 across triggers, and no more than what is left of either body.
    """
    n = len(bodies)
    sizes = np.array([len(b) for b in bodies], np.int64)
    data = np.frombuffer(b"".join(bodies), np.uint8)
    starts = np.cumsum(sizes) - sizes
    follow = np.minimum(sizes - at, length)
    # the parse's suffixes: what follows the trigger, and its length, behind the trigger's rank
    _, group = np.unique(triggers, return_inverse=True)
    width = int(follow.max(initial=0))
    keys = np.zeros((n, 4 + width + 2), np.uint8)
    keys[:, :4] = group.astype(">u4").view(np.uint8).reshape(n, 4)
    columns = np.arange(width)
    inside = columns < follow[:, None]
    keys[:, 4:-2][inside] = data[((starts + at)[:, None] + columns)[inside]]
    keys[:, -2:] = follow.astype(">u2").view(np.uint8).reshape(n, 2)
    order = np.argsort(keys.view(f"V{keys.shape[1]}").ravel(), kind="stable")
    lcp = np.zeros(n, np.int64)
    if n > 1:
        a, b = order[:-1], order[1:]
        differ = keys[a, 4:-2] != keys[b, 4:-2]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        lcp[1:] = np.where(group[a] == group[b], np.minimum(first, np.minimum(follow[a], follow[b])), 0)
    d = 0
    while len(order):
        yield d, order, lcp
        d += 1
        order, lcp = _neighbours(order, lcp, at[order] >= d)
        byte = data[starts[order] + at[order] - d].astype(np.int64)
        key = group[order] * 256 + byte
        place = np.argsort(key, kind="stable")
        key, order = key[place], order[place]
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        new = np.zeros(len(order), np.int64)
        new[same] = 1 + _range_minima(lcp, place[same - 1] + 1, place[same])
        lcp = new


def repeated_starts(triggers: np.ndarray, bodies: list[bytes], n: np.ndarray, at: np.ndarray, length: int) -> list[np.ndarray]:
    """For each phrase, which of its n window starts have an equal window in another phrase of the trigger."""
    base = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), bool)
    for d, order, lcp in corpus_order(triggers, bodies, at, length):
        long = np.append(lcp >= length, False)
        hit = order[(long[:-1] | long[1:]) & (at[order] - d < n[order])]
        out[base[hit] + at[hit] - d] = True
    return np.split(out, base[1:])


_STARTS = "tk long, t2 long, starts array<int>"


def _ordered(batches, length):
    """Starts of the repeated windows of open phrases, from contexts sorted by trigger."""

    def judge(table):
        triggers, lo, n, at = (table.column(c).to_numpy().astype(np.int64) for c in ("trigger", "lo", "n", "at"))
        found = repeated_starts(triggers, table.column("body").to_pylist(), n, at, length)
        keep = [k for k, is_open in enumerate(table.column("open").to_pylist()) if is_open and found[k].any()]
        some = table.take(pa.array(keep, pa.int64()))
        starts = pa.array([(lo[k] + np.flatnonzero(found[k])).astype(np.int32) for k in keep], pa.list_(pa.int32()))
        for batch in some.select(["tk", "t2"]).append_column("starts", starts).combine_chunks().to_batches():
            yield batch

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        triggers = table.column("trigger").to_numpy()
        cut = int(np.searchsorted(triggers, triggers[-1])) if len(triggers) else 0
        if cut:
            yield from judge(table.slice(0, cut))
        held = table.slice(cut)
    if held is not None and len(held):
        yield from judge(held)


_WINDOW = "trigger long, place int, wh long, tk long, t2 long, s int, open boolean"


def _windows(batches, length):
    """The windows of contexts, one row each: by trigger, their place before it, and a hash."""
    for batch in batches:
        bodies = batch.column("body").to_pylist()
        for i in range(0, len(bodies), 1000):
            part = batch.slice(i, 1000)
            lo, n, at = (part.column(c).to_numpy().astype(np.int64) for c in ("lo", "n", "at"))
            sizes = np.array([len(b) for b in bodies[i : i + 1000]], np.int64)
            j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            starts = np.repeat(np.cumsum(sizes) - sizes, n) + j
            wh = rolling.spans(np.frombuffer(b"".join(bodies[i : i + 1000]), np.uint8), starts, starts + length)
            again = [part.column(c).to_numpy(zero_copy_only=False).repeat(n) for c in ("trigger", "tk", "t2", "open")]
            columns = (again[0], (np.repeat(at, n) - j).astype(np.int32), wh.view(np.int64), again[1], again[2], (np.repeat(lo, n) + j).astype(np.int32), again[3])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in _WINDOW.split(", ")])


def covered(spans: np.ndarray) -> np.ndarray:
    """Disjoint ascending [start, end) ranges that cover the same bytes."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > top[:-1])
    return np.column_stack([spans[new, 0], top[np.append(new[1:], True)]])


def _remove(batches, length, kept):
    for batch in batches:
        texts, gone, starts = batch.column("text").cast(pa.large_binary()), batch.column("gone").to_pylist(), batch.column("starts").to_pylist()
        rows = []
        for k, text in enumerate(texts):
            text = text.as_py() or b""
            spans = [(x["lo"], x["lo"] + x["n"] + length - 1) for x in gone[k] or ()] + [(s, s + length) for s in starts[k] or ()]
            spans = covered(np.array(spans, np.int64).reshape(-1, 2))
            edges = [0, *spans.ravel().tolist(), len(text)]
            left = b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
            rows.append((len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), [int(x) for x in spans.ravel()]))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_spans(docs: DataFrame, length: int = 200, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans): bytes covered by a string of `length` bytes that starts elsewhere too.

    spans holds the removed byte ranges, flattened. Triggers of more than `group` distinct phrases are counted by window.
    """
    if length <= TRIGGER:
        raise ValueError(f"length must be over {TRIGGER}")
    count = F.count(F.lit(1))
    tk, t2 = two_hashes("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tk", tk).withColumn("t2", t2)
    parsed = rows.select("tk", "t2", "text").mapInArrow(lambda it: _parse(it, length), "tk long, t2 long, lo int, n int, at int, trigger long, phrase long")
    repeated, seen = measured(parsed.groupBy("trigger").agg(count.alias("seen")).where("seen > 1"), "pfp-triggers", sum=F.sum("seen"), top=F.max("seen"))
    parse = sieved(parsed, repeated, ["trigger"]).where("_in").drop("_in")
    parse = materialise(hot_join(parse, repeated, ["trigger"], "seen", seen["sum"], ["tk", "lo"], "inner", seen["top"]).drop("seen"), "pfp-parse")
    # the dictionary: each phrase with its frequency; triggers that have phrases seen once beside others are mixed
    words, held = measured(parse.groupBy("trigger", "phrase").agg(count.alias("freq"), F.min(F.struct("tk", "t2", "lo")).alias("rep")), "pfp-words", n=count, top=F.max("freq"))
    mixed = words.groupBy("trigger").agg(F.min("freq").alias("least"), count.alias("kinds")).where("least = 1 AND kinds > 1").select("trigger", "kinds")
    mixed, most = measured(mixed, "pfp-mixed", top=F.max("kinds"))
    words = hot_join(words, mixed, ["trigger"], "kinds", held["n"], ["phrase"], "left", most["top"]).where("freq > 1 OR kinds > 1")
    words = materialise(words, "pfp-dictionary")
    marked = hot_join(parse, words, ["trigger", "phrase"], "freq", seen["sum"], ["tk", "lo"], "inner", held["top"])
    opened = F.col("freq") == 1
    probe = opened | (F.col("kinds").isNotNull() & (F.struct("tk", "t2", "lo") == F.col("rep")))
    asked = F.struct("trigger", "lo", "n", "at", opened.alias("open"), (F.col("kinds") > group).alias("wide"))
    texts = marked.groupBy("tk", "t2").agg(
        F.collect_set(F.when(F.col("freq") > 1, F.struct("lo", "n"))).alias("gone"), F.collect_set(F.when(probe, asked)).alias("probes"), count.alias("marks"), F.count_distinct("lo").alias("kinds")
    )
    texts, copies = measured(texts.withColumn("copies", F.ceil(F.col("marks") / F.col("kinds"))).drop("marks", "kinds"), "pfp-texts", n=count, asked=F.sum((F.size("probes") > 0).cast("long")), top=F.max("copies"))
    # one copy of each text that is asked for
    probed = texts.where(F.size("probes") > 0).select("tk", "t2", "probes")
    once = semi_join(rows.drop("doc_id"), probed.select("tk", "t2"), ["tk", "t2"], copies["asked"]).groupBy("tk", "t2").agg(F.first("text").alias("text"))
    contexts = once.join(probed.hint("shuffle_hash"), ["tk", "t2"]).mapInArrow(lambda it: _contexts(it, length), _CONTEXT)
    contexts = materialise(contexts, "pfp-contexts")
    starts = contexts.where("NOT wide").repartition("trigger").sortWithinPartitions("trigger").mapInArrow(lambda it: _ordered(it, length), _STARTS)
    if most["top"] > group:
        windows = contexts.where("wide").mapInArrow(lambda it: _windows(it, length), _WINDOW)
        equal = windows.groupBy("trigger", "place", "wh").agg(count.alias("c"), F.max("open").alias("open")).where("c > 1 AND open").drop("open")
        equal, met = measured(equal, "pfp-equal", sum=F.sum("c"), top=F.max("c"))
        met = hot_join(windows.where("open").drop("open"), equal, ["trigger", "place", "wh"], "c", met["sum"], ["tk", "s"], "inner", met["top"])
        starts = starts.unionByName(met.groupBy("tk", "t2").agg(F.collect_list("s").alias("starts")))
    starts = starts.groupBy("tk", "t2").agg(F.sort_array(F.flatten(F.collect_list("starts"))).alias("starts"))
    found = texts.select("tk", "t2", "gone", "copies").join(starts, ["tk", "t2"], "left").where(F.size("gone") + F.coalesce(F.size("starts"), F.lit(0)) > 0)
    found, total = measured(found, "pfp-found", sum=F.sum("copies"), top=F.max("copies"))
    out = sieve_join(rows, found, ["tk", "t2"], "copies", total["sum"], ["doc_id"], total["top"])
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"
    return out.select("doc_id", "text", "gone", "starts").mapInArrow(lambda it: _remove(it, length, ["doc_id"]), schema)


def op5_pfp_substrings(spark, sf_dir: str) -> DataFrame:
    """Every document: bytes, bytes removed, runs removed, and a digest of the rest."""
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
