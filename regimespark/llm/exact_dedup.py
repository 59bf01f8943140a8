"""Exact deduplication by a Golomb-coded fingerprint exchange.

Blocks of rows send owners of fingerprint ranges their sorted, delta- and Rice-coded
fingerprints; an owner answers each message with a bitmap of the fingerprints that occur
in another message too; only rows so suspected have their bytes compared. Fingerprints are
log2(rows) + SPARE bits long: short ones only raise suspicions that the bytes then refute.

Defined results: null counts as empty; of rows with equal text and doc_id, one stays; null
doc_ids sort lowest; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialise, measured, semi_join, shuffle_partitions

SPARE = 12
#: Rows whose fingerprints one owner is meant to hold, fingerprints that a message should have, and the fewest and most rows of a block.
OWNED, MESSAGE = 1_000_000, 16
SMALL_BLOCK, LARGE_BLOCK = 1 << 16, 1 << 21


def golomb_encode(values: np.ndarray, low: int, span: int) -> bytes:
    """Sorted distinct values in [low, low + span): count and Rice parameter, remainders of fixed width, quotients in unary."""
    n = len(values)
    k = max(0, int(math.log2(max(1, span // max(1, n)))))
    gaps = np.diff(values, prepend=np.int64(low)).astype(np.uint64)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + n, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    remainders = (gaps[:, None] >> np.arange(k - 1, -1, -1, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
    return np.array([n, k], np.uint32).tobytes() + np.packbits(remainders).tobytes() + np.packbits(unary).tobytes()


def golomb_decode(payload: bytes, low: int) -> np.ndarray:
    n, k = (int(x) for x in np.frombuffer(payload[:8], np.uint32))
    width = (n * k + 7) // 8
    bits = np.unpackbits(np.frombuffer(payload, np.uint8, width, 8))[: n * k].reshape(n, k).astype(np.int64)
    remainders = bits @ (np.int64(1) << np.arange(k - 1, -1, -1, dtype=np.int64)) if k else np.zeros(n, np.int64)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(payload, np.uint8, offset=8 + width)))[:n]
    quotients = np.diff(ones, prepend=-1) - 1
    return low + np.cumsum((quotients << k) + remainders)


def block_of(rid, rows: int, parts: int, owners: int):
    """Block of a row id: blocks grow with the owners, so that messages do not get ever shorter, and take several partitions where these are small."""
    size = min(LARGE_BLOCK, max(SMALL_BLOCK, MESSAGE * owners))
    together = max(1, size * parts // max(1, rows))
    part, place = F.shiftright(rid, 33), rid.bitwiseAND(F.lit((1 << 33) - 1))
    return F.floor(part / F.lit(together)) * F.lit(1 << 20) + F.floor(place / F.lit(size))


def suspects(digest: DataFrame, rows: int, parts: int) -> DataFrame:
    """Rows of the digest (rid, doc_id, sha, fp) whose fingerprint another row may share."""
    spark = digest.sparkSession
    bits = min(62, max(20, math.ceil(math.log2(rows + 2)) + SPARE))
    owners = max(shuffle_partitions(spark), math.ceil(rows / OWNED))
    span = -(-(1 << bits) // owners)
    rows_of = digest.withColumn("fp", F.shiftrightunsigned("fp", 64 - bits)).withColumn("block", block_of(F.col("rid"), rows, parts, owners))

    def send(key, table: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(table["fp"].to_numpy(np.int64))
        to = fps // span
        at, out = np.flatnonzero(np.diff(to, prepend=-1)), []
        for i, j in zip(at, [*at[1:], len(fps)], strict=True):
            out.append((int(to[i]), key[0], golomb_encode(fps[i:j], int(to[i]) * span, span)))
        return pd.DataFrame(out, columns=["owner", "block", "payload"])

    def own(key, table: pd.DataFrame) -> pd.DataFrame:
        parts = [golomb_decode(x, key[0] * span) for x in table["payload"]]
        _, back, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        cut = np.cumsum([len(x) for x in parts])[:-1]
        return pd.DataFrame({"owner": key[0], "block": table["block"], "bitmap": [np.packbits(x).tobytes() for x in np.split(count[back] > 1, cut)]})

    def suspect(table: pa.Table, replies: pa.Table) -> pa.Table:
        fps, back, count = np.unique(table["fp"].to_numpy(), return_inverse=True, return_counts=True)
        sent = np.bincount((fps // span).astype(np.int64), minlength=owners)
        bitmaps = sorted(zip(replies["owner"].to_pylist(), replies["bitmap"].to_pylist(), strict=True))
        dup = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[: sent[o]] for o, b in bitmaps])
        return table.filter(pa.array(((dup > 0) | (count > 1))[back])).select(["rid", "doc_id", "sha"])

    sent = rows_of.select("block", "fp").groupBy("block").applyInPandas(send, "owner long, block long, payload binary")
    replies = sent.groupBy("owner").applyInPandas(own, "owner long, block long, bitmap binary")
    schema = f"rid long, doc_id {digest.schema['doc_id'].dataType.simpleString()}, sha binary"
    return rows_of.select("block", "fp", "rid", "doc_id", "sha").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(suspect, schema)


def dedupe(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): the row of largest doc_id of each group of equal texts stays."""
    text = F.coalesce("text", F.lit("")).alias("text")
    sha = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha")
    digest = docs.select("doc_id", text).select("doc_id", sha, F.xxhash64("text").alias("fp"), F.monotonically_increasing_id().alias("rid"))
    digest, seen = measured(digest, "exact-digest", n=F.count(F.lit(1)), parts=F.max(F.shiftright("rid", 33)) + 1)
    rows = seen["n"]
    found = materialise(suspects(digest, rows, seen["parts"]), "exact-suspects")
    groups = found.groupBy("sha").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("n")).where("n > 1")
    groups, held = measured(groups, "exact-claims", groups=F.count(F.lit(1)))
    # bytes of the suspects: equal texts combine before the shuffle, in whose tables keys compare byte by byte
    texts = semi_join(docs.select(text).select("text", sha), groups.select("sha"), ["sha"], held["groups"])
    seen = texts.groupBy("sha", "text").agg(F.count("*").alias("c")).groupBy("sha").agg(F.sum("c").alias("c"), F.count("*").alias("texts"))
    proven = groups.join(seen, "sha").where((F.col("texts") == 1) & (F.col("c") == F.col("n"))).select("sha", "keep", "n")
    proven, held = measured(proven, "exact-groups", top=F.max("n"))
    out = hot_join(digest.drop("fp"), proven, ["sha"], "n", rows, ["rid"], "left", held["top"])
    alone = F.col("n").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("keep.rid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document, with the row of its equal texts that stays."""
    return dedupe(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
