"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Rows whose texts are equal form a group that no shard boundary cuts. A group larger than an
even share of what is left takes a shard alone. All others are differenced: the two partial
partitions of largest spread are joined in opposite order, again and again. Groups are dealt to
tasks by hash, each of which differences PART groups or so down to one partial partition (a sum
for each shard); FAN of these are then differenced like items of many sums, level by level, until
one is left. No task sees more than that, however large the corpus is.

Defined results: a null text has no bytes, crc 0, and all null texts form one group; an
empty text likewise forms a group of its own; repeated rows each get a slot; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, materialise, measured

#: Groups that a task differences, and partial partitions that one of the next level does.
PART, FAN = 50_000, 4096
OVERHEAD = 16


def join_partials(partials: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One partial partition of the given ones (rows of sums, descending): its sums, and for each row the places that its own take in it."""
    n, k = partials.shape
    heap = [(-int(row[0] - row[-1]), j, row) for j, row in enumerate(partials)]
    heapq.heapify(heap)
    tree: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        sums = x + y[::-1]
        place = np.argsort(-sums, kind="stable")
        sums = sums[place]
        tree.append((a, b, place))
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), n + len(tree) - 1, sums))
    where = {heap[0][1]: np.arange(k, dtype=np.int32)}
    for node in range(n + len(tree) - 1, n - 1, -1):
        a, b, place = tree[node - n]
        places = np.empty(k, np.int32)
        places[place] = where.pop(node)
        where[a], where[b] = places, places[::-1]
    return heap[0][2], np.array([where[j] for j in range(n)])


def join_items(sizes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """join_partials of single groups: the sums, and the place of each group."""
    partials = np.zeros((len(sizes), shards), np.int64)
    partials[:, 0] = sizes
    sums, places = join_partials(partials)
    return sums, places[:, 0]


def giants(largest: list[int], total: int, shards: int) -> int:
    """How many of the sizes, in descending order, take a shard alone, as each is an even share of what is left or more."""
    taken = 0
    while taken < min(len(largest), shards - 1) and largest[taken] * (shards - taken) >= total:
        total -= largest[taken]
        taken += 1
    return taken


def difference(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item, in one task."""
    out = np.zeros(len(sizes), np.int32)
    order = np.argsort(-sizes, kind="stable")
    alone = giants(sizes[order[:shards]].tolist(), int(sizes.sum()), shards)
    out[order[:alone]] = np.arange(alone)
    rest = order[alone:]
    if len(rest):
        out[rest] = alone + join_items(sizes[rest], shards - alone)[1]
    return out


def place_groups(groups: DataFrame, n: int, total: int, shards: int, part: int = PART, fan: int = FAN) -> DataFrame:
    """groups(group, bytes) with their shard."""
    spark = groups.sparkSession
    top = [(r["group"], r["bytes"]) for r in groups.select("group", "bytes").orderBy(F.desc("bytes"), "group").limit(shards).collect()]
    alone = giants([b for _, b in top], total, shards)
    k, parts = shards - alone, max(1, -(-n // part))
    fixed = spark.createDataFrame([(g, i) for i, (g, _) in enumerate(top[:alone])], "group long, shard int")
    rest = groups.join(F.broadcast(fixed.select("group")), "group", "left_anti").withColumn("p", F.pmod(F.xxhash64(F.lit(3), "group"), F.lit(parts)))

    def first(key, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["bytes", "group"], ascending=[False, True], kind="stable")
        sums, place = join_items(table["bytes"].to_numpy(np.int64), k)
        return pd.DataFrame({"p": key[0], "group": table["group"], "place": place, "sums": [None] * (len(table) - 1) + [sums.tolist()]})

    def later(key, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("p", kind="stable")
        sums, places = join_partials(np.array(table["sums"].tolist(), np.int64))
        return pd.DataFrame({"p": table["p"], "up": key[0], "places": places.tolist(), "sums": [None] * (len(table) - 1) + [sums.tolist()]})

    placed = materialise(rest.select("p", "group", "bytes").groupBy("p").applyInPandas(first, "p long, group long, place int, sums array<long>"), "shard-places")
    partial, levels = placed.where("sums IS NOT NULL").select("p", "sums"), []
    while parts > 1:
        parts = -(-parts // fan)
        up = partial.withColumn("up", F.pmod("p", F.lit(parts))).groupBy("up").applyInPandas(later, "p long, up long, places array<int>, sums array<long>")
        levels.append(materialise(up, "shard-partials"))
        partial = levels[-1].where("sums IS NOT NULL").select(F.col("up").alias("p"), "sums")
    # from the last level down: where the places of each partial partition end up
    goal = None
    for level in levels[::-1]:
        own = level.select("p", "up", "places")
        if goal is not None:
            own = own.join(goal.select(F.col("p").alias("up"), F.col("places").alias("upper")).hint("shuffle_hash"), "up").withColumn("places", F.transform("places", lambda x: F.get("upper", x)))
        goal = materialise(own.select("p", "places"), "shard-goals")
    if goal is not None:
        placed = placed.join(goal.hint("shuffle_hash"), "p").withColumn("place", F.get("places", F.col("place")))
    return placed.select("group", (F.col("place") + alone).cast("int").alias("shard")).unionByName(fixed)


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = OVERHEAD, part: int = PART, fan: int = FAN) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): equal texts together, bytes near equal, slots gapless from 0."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + overhead).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.coalesce(F.xxhash64("text"), F.lit(1)), F.col("text").isNull(), F.octet_length("text")).alias("group"),
    )
    rows, seen = measured(rows, "shard-rows", bytes=F.sum("size"), n=F.count(F.lit(1)))
    groups, held = measured(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups", n=F.count(F.lit(1)), top=F.max("n"))
    placed = place_groups(groups, held["n"], seen["bytes"], shards, part, fan)
    groups = materialise(groups.select("group", "n").join(placed.hint("shuffle_hash"), "group"), "shard-of-groups")
    rows = hot_join(rows, groups, ["group"], "n", seen["n"], ["doc_id", "size"], "left", held["top"])
    # slots: numbered within small cuts of each shard, then offset by the cuts before
    cuts = max(16, seen["n"] // (shards * 20_000))
    rows = rows.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id"), F.lit(cuts)).alias("cut"))
    rows = materialise(rows, "shard-placed")
    before = Window.partitionBy("shard").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "cut").agg(F.count("*").alias("c")).select("shard", "cut", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "cut").orderBy("doc_id", "size", "text_crc32"))
    rows = rows.withColumn("r", within).join(starts, ["shard", "cut"])
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("r") - 1).alias("slot"))


def op1_kk_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39, by the `bytes` law."""
    placed = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select(
        "doc_id", F.col("size").cast("long"), "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard")
    )
