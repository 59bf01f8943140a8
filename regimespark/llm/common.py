"""Shared helpers: cutting lineage in the shared folder, joins that survive hot keys,
and Arrow string columns seen as one byte buffer."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A key holding at least 1/HOT_PARTS of the rows is hot; there are at most HOT_PARTS such keys.
HOT_PARTS = 1000
#: Bytes up to which a checked side may be broadcast.
BROADCAST_BYTES = 8 << 20
#: Bytes that one key of a few longs takes in a broadcast hash table.
KEY_BYTES = 96
#: Bits of a sieve: 8 MB, whatever the number of keys.
SIEVE_BITS = 26


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where it is unset and all run in this process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(df: DataFrame, *dropped: str):
    """All columns of df but the dropped ones in one struct `row`, out of reach of other names."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in dropped)).alias("row")


def measured(df: DataFrame, name: str, **measures) -> tuple[DataFrame, dict]:
    """materialise, and the given aggregates (0 for none) over all rows, taken while they are written."""
    seen = Observation(name)
    out = materialise(df.observe(seen, *(m.alias(k) for k, m in measures.items())), name)
    got = seen.get
    return out, {k: got.get(k) or 0 for k in measures}


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, spread: list[str], how: str = "left", top: int | None = None) -> DataFrame:
    """Equi-join in which no task gets all rows of a hot key.

    `right` has one row per key and, in `weight`, how many rows of `left` have it. A key
    with at least total/HOT_PARTS rows is cut into parts of about that many rows by a hash
    of the `spread` columns, and its row of `right` is repeated for each part. The list of
    hot keys that is broadcast holds HOT_PARTS rows at most, whatever the input; where the
    largest weight, `top`, is known to be below the limit, there is none.
    """
    least = -(-max(total, HOT_PARTS * 100) // HOT_PARTS)
    if top is not None and top < least:
        # `right` grows with the data, so it is shuffled at every size and not left to a broadcast while it happens to be small
        return left.join(right.hint("shuffle_hash"), keys, how)
    parts = F.ceil(F.col(weight) * F.lit(HOT_PARTS) / F.lit(max(total, 1))).cast("int")
    right = right.withColumn("_parts", F.when(F.col(weight) >= least, parts).otherwise(F.lit(1)))
    listed = F.broadcast(right.where("_parts > 1").select(*keys, F.col("_parts").alias("_cut")))
    left = left.join(listed, keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_cut")).cast("int"), F.lit(0))).drop("_cut")
    right = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts").hint("shuffle_hash")
    return left.join(right, [*keys, "_part"], how).drop("_part")


def sieved(left: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """left with `_in`: true where the hash of `on` is that of some key, so of all rows that have a partner and of few others while keys are fewer than the bits.

    What is broadcast is a bitmap of 2**SIEVE_BITS bits in blocks, whatever the number of keys.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(1 << SIEVE_BITS)) + 1
    bits = keys.select(place.alias("x")).groupBy(F.expr("bitmap_bucket_number(x)").alias("_block")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(x))").alias("_bits"))
    asked = left.withColumn("_x", place).withColumn("_block", F.expr("bitmap_bucket_number(_x)")).join(F.broadcast(bits), "_block", "left")
    byte = F.expr("cast(conv(hex(substring(_bits, cast(bitmap_bit_position(_x) div 8 + 1 as int), 1)), 16, 10) as int)")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(_x) % 8 as int))")) != 0
    return asked.withColumn("_in", F.coalesce(hit, F.lit(False))).drop("_x", "_block", "_bits")


def semi_join(left: DataFrame, keys: DataFrame, on: list[str], n: int, once: bool = False) -> DataFrame:
    """left_semi; keys (n of them) are broadcast when they fit BROADCAST_BYTES, and else shuffled, to where only what passes their sieve follows.

    With `once`, equal rows of left may be reduced to one before they are shuffled.
    """
    if n * KEY_BYTES <= BROADCAST_BYTES:
        return left.join(F.broadcast(keys), on, "left_semi")
    passed = sieved(left, keys, on).where("_in").drop("_in")
    return (passed.distinct() if once else passed).join(keys, on, "left_semi")


def anti_join(left: DataFrame, keys: DataFrame, on: list[str], n: int) -> DataFrame:
    """left_anti on hash columns that are never null, likewise; rows that the sieve clears stay where they are."""
    if n * KEY_BYTES <= BROADCAST_BYTES:
        return left.join(F.broadcast(keys), on, "left_anti")
    marked = sieved(left, keys, on)
    return marked.where("NOT _in").drop("_in").unionByName(marked.where("_in").drop("_in").join(keys, on, "left_anti"))


def sieve_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, spread: list[str], top: int | None = None) -> DataFrame:
    """hot_join from the left in which rows that the sieve clears of a partner stay where they are and only the others are shuffled."""
    marked = sieved(left, right, keys)
    met = hot_join(marked.where("_in").drop("_in"), right, keys, weight, total, spread, "left", top)
    return met.unionByName(marked.where("NOT _in").drop("_in"), allowMissingColumns=True)


def two_hashes(column):
    """128 bits that stand for a value, as two columns' expressions."""
    return F.xxhash64(column), F.xxhash64(F.lit(7), column)


def row_key(tk):
    """Two hashes that tell rows apart: of doc_id, null or not, and of the text."""
    return F.xxhash64("doc_id", F.col("doc_id").isNull()).alias("_i"), (F.col(tk) if isinstance(tk, str) else tk).alias("_t")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) long pairs: (node, label), the label being the smallest node reachable.

    Each round takes the least label among neighbours (map-side combined) and then follows
    labels of labels, so that a path of length d needs about log d rounds. Both joins follow
    shuffles of written tables, so that a hub's rows are split at run time.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, "edges")
    total = F.sum(F.col("l").cast("decimal(38,0)"))
    labels, before = measured(both.groupBy("a").agg(F.least("a", F.min("b")).alias("l")), "labels", s=total)
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        step = labels.join(near, "a").select("a", F.least("l", "m").alias("l"))
        jump = labels.select(F.col("a").alias("l"), F.col("l").alias("ll"))
        labels, now = measured(step.join(jump, "l", "left").select("a", F.least("l", "ll").alias("l")), "labels", s=total)
        if now == before:
            return labels.select(F.col("a").alias("node"), F.col("l").alias("label"))
        before = now


def kept(owner: str) -> dict:
    """What this Python worker keeps from task to task for an operator; what it has kept for others goes."""
    held = sys.modules.setdefault("_corpus_kept", types.ModuleType("_corpus_kept")).__dict__.setdefault("by_owner", {})
    for other in [o for o in held if o != owner]:
        del held[other]
    return held.setdefault(owner, {})


def relieved(batches, owner: str = ""):
    """The same batches. Python workers live on from stage to stage: what they keep for other operators goes first, and at the end of the task memory that is free goes back to the system."""
    kept(owner)
    yield from batches
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (all bytes, offsets); null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def doc_groups(offsets: np.ndarray, limit: int):
    """Runs (i, j) of consecutive rows of about `limit` bytes; a longer row is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j
