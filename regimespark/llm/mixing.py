"""Mixing sources to target weights by Poisson replication.

A source of `bytes` bytes with target weight w gets the repetition rate
w * budget / bytes. Each document draws a uniform number from a hash of its id, its text and
the seed; the inverse of the Poisson distribution with that rate turns it into a count, so any
run gives the same copies. Documents are exploded by their counts and put into a global random
order by a hash of id, copy number and seed.

Defined results: a null source is a source of its own; null and empty texts have OVERHEAD
bytes, as all texts have besides their own; a source without a weight in a given mapping gets
none; without a mapping weights are the sizes to the power `temper`; repeated rows draw alike;
an empty table gives no rows. Extra columns are kept; only `mix` replaces those named copies,
copy, rate or mix_key. Rows that tie in mix_key are ordered by doc_id and copy.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, KEY_BYTES, hot_join, materialise, measured, packed

OVERHEAD = 16
SEED = 17


def _mass():
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD


def poisson_steps(rate: float) -> tuple[int, np.ndarray]:
    """(k, P(count <= k), P(count <= k + 1), ...), over all counts that a double can tell from 0 and 1.

    The steps are built by ratios from the mode outward and scaled to a sum of 1, so that they hold at any rate; they are about 24 square roots of it.
    """
    reach = 12 * math.sqrt(rate) + 40
    low, high = max(0, int(rate - reach)), int(rate + reach)
    counts = np.arange(low, high + 1, dtype=np.float64)
    mode = int(rate) - low
    up = np.cumprod(rate / counts[mode + 1 :]) if rate else np.zeros(len(counts) - mode - 1)
    down = np.cumprod(counts[1 : mode + 1][::-1] / rate)[::-1] if mode else np.zeros(0)
    mass = np.concatenate([down, [1.0], up])
    return low, np.minimum(np.cumsum(mass / mass.sum()), 1.0)


def poisson_count(rate, low, first, number):
    """The count at which the distribution reaches a number in [0, 1), from P(count = low) = first upward, as poisson_steps has them."""
    start = F.struct(F.lit(0.0).alias("below"), first.alias("p"), low.alias("n"))

    def step(a, k):
        total = a["below"] + a["p"]
        return F.struct(total.alias("below"), (a["p"] * rate / (k + 1)).alias("p"), (a["n"] + F.when(total <= number, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.sequence(low, (rate + F.sqrt(rate) * 12 + 40).cast("long")), start, step, lambda a: a["n"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(src, rows, bytes, rate, low, first): repetition rate of each source, and where its distribution starts."""
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("rows"), F.sum(_mass()).alias("bytes"))
    sizes = materialise(sizes, "mix-sizes")
    if weights is None:
        weighed = sizes.withColumn("w", F.pow("bytes", F.lit(temper)))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "source string, w double")
        weighed = sizes.join(given, sizes["source"].eqNullSafe(given["source"]), "left").select(sizes["*"], F.coalesce("w", F.lit(0.0)).alias("w"))
    total = weighed.agg(F.sum("bytes").alias("b"), F.sum("w").alias("w")).first()
    budget, mass = (total.b or 0) * epochs, total.w or 1.0
    start = F.pandas_udf(lambda r: pd.DataFrame([(low, steps[0]) for low, steps in map(poisson_steps, r)], columns=["low", "first"]), "low long, first double")
    rated = weighed.withColumn("rate", F.col("w") / F.lit(mass) * F.lit(budget) / F.col("bytes"))
    return rated.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("src"), "rows", "bytes", "rate", start("rate").alias("start")).select("src", "rows", "bytes", "rate", "start.*")


def uniform(seed: int, *columns):
    """A number in [0, 1) of 52 bits from md5, the same in any engine."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *columns).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def draw(seed: int):
    """Each document's number, from its id, its text and the seed."""
    return uniform(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def _key(seed: int):
    return F.xxhash64(F.lit(seed), "_d", "_u", "copy")


def copies(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = 0.5, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """(row, copies, copy, rate, mix_key, _d): the copies of the documents, packed in row, numbered from 0."""
    rated, seen = measured(rates(docs, weights, temper, epochs), "mix-rates", rows=F.sum("rows"), sources=F.count(F.lit(1)), top=F.max("rows"), width=F.max(F.length("src")))
    src = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    keyed = docs.select(packed(docs), src.alias("src"), F.col("doc_id").alias("_d"), draw(seed).alias("_u"))
    table = rated.select("src", "rows", "rate", "low", "first")
    if seen["sources"] * (KEY_BYTES + 4 * seen["width"]) <= BROADCAST_BYTES:
        joined = keyed.join(F.broadcast(table), "src")
    else:
        joined = hot_join(keyed, table, ["src"], "rows", seen["rows"], ["_d"], "inner", seen["top"])
    counted = joined.withColumn("copies", poisson_count(F.col("rate"), F.col("low"), F.col("first"), F.col("_u")))
    return counted.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).select("row", "copies", "copy", "rate", _key(seed).alias("mix_key"), "_d")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = 0.5, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """The copies of the documents with copies, copy (from 0), rate and mix_key, by which to sort for the global random order."""
    own = ("copies", "copy", "rate", "mix_key")
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in own]
    return copies(docs, weights, temper, epochs, seed).select(*kept, *own)


def mixture(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = 0.5, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """The copies in the global random order, with the columns of docs, whatever their names."""
    return copies(docs, weights, temper, epochs, seed).orderBy("mix_key", "_d", "copy").select("row.*")


def with_mix_key(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs, of which the copies are equal rows, with the mix_key that mix gave them; rows equal in id and text are numbered as its copies are."""
    rows = docs.select(packed(docs, "mix_key"), F.col("doc_id").alias("_d"), draw(seed).alias("_u"))
    numbered = rows.withColumn("copy", (F.row_number().over(Window.partitionBy("_d", "_u").orderBy("_d")) - 1).cast("long"))
    return numbered.select("row.*", _key(seed).alias("mix_key"))


def op9_poisson_mix(spark, sf_dir: str) -> DataFrame:
    """Every copy of every document, weights by the square root of the sources' sizes, in mixed order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    mixed = mix(docs).select("doc_id", "source", "copies", "copy", "mix_key")
    return mixed.orderBy("mix_key", "doc_id", "copy").select("doc_id", "source", F.col("copies").cast("long"), F.col("copy").cast("long"))


OP9_SQL = """
WITH RECURSIVE s AS (SELECT coalesce('=' || source, '') AS src, sum(strlen(coalesce(text, '')) + 16)::DOUBLE AS b FROM documents GROUP BY 1),
t AS (SELECT sum(b) AS b, sum(sqrt(b)) AS w FROM s),
r AS (SELECT src, sqrt(s.b) / t.w * t.b / s.b AS rate FROM s, t),
c(src, rate, k, p, f) AS (SELECT src, rate, 0, exp(-rate), exp(-rate) FROM r UNION ALL
  SELECT src, rate, k + 1, p * rate / (k + 1), f + p * rate / (k + 1) FROM c WHERE k < rate + 12 * sqrt(rate) + 40),
u AS (SELECT doc_id, source, coalesce('=' || source, '') AS src,
  ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT doc_id, source, (SELECT count(*) FROM c WHERE c.src = u.src AND c.f <= u.u) AS copies FROM u)
SELECT doc_id, source, copies, unnest(range(copies)) AS copy FROM n
"""
