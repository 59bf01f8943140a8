"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are added as log-probabilities: the likelihood of the text (byte
trigrams, naive Bayes, tempered so that long texts do not drown the rest), of the declared
markup language, of the address suffix, and a prior of the host that is smoothed towards its
parent domain and that towards the corpus. The tables for the last three are counts of what
the text alone says with certainty, by grouped aggregation over all rows; a row's own count is
taken out of its host's. One more hypothesis, `und`, stands for text in no known language.

The trigram model is fitted on at most about `fit_rows` labelled rows, chosen by hash, for the
`languages` most frequent values of the label (ties by name), both of them parameters of fit(); there
are fewer written languages than the default allows, times their scripts, so it only keeps a label column
that is none from growing the model. Everything else covers all rows.

Defined results: a null or empty text, or one without letters, has no text evidence and is
judged by the rest, with `und` as likely as any language; null or unknown declarations,
suffixes and hosts are values of their own; repeated rows are judged alike; an empty table
gives no rows; without labelled rows everything is `und`. Of equally likely languages the first
by name is taken. Other columns may have any names and are ignored, and kept by keep_identified.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import anti_join, byte_column, doc_groups, hot_join, materialise, measured, packed, relieved, row_key

BUCKET_BITS = 14
FIT_ROWS = 50_000
#: Languages of a model at most, each of which takes 64 KB, and a term of the expressions.
LANGUAGES = 512
#: Trigrams that a text counts for at most, and the log-probability of a trigram under `und`.
EFFECTIVE, UNKNOWN = 100.0, -BUCKET_BITS * math.log(2)
SMOOTH_HOST, SMOOTH_VALUE = 20.0, 20.0
CERTAIN = 0.95
_GROUP = 1 << 20
_FOLD = np.array([b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def trigrams(data: np.ndarray, offsets: np.ndarray):
    """(row, bucket) of the byte trigrams of each text that hold a letter; runs of other bytes count as one space."""
    folded = _FOLD[data[offsets[0] : offsets[-1]]]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32) | (row[1:] != row[:-1])
    folded, row = folded[keep].astype(np.uint32), row[keep]
    if len(folded) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = folded[:-2] << np.uint32(16) | folded[1:-1] << np.uint32(8) | folded[2:]
    valid = (row[:-2] == row[2:]) & (code != 0x202020)
    bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    return row[:-2][valid], bucket[valid].astype(np.int64)


class Model:
    def __init__(self, languages: list[str], logs: np.ndarray):
        self.languages, self.logs = languages, logs


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, languages: int = LANGUAGES) -> Model:
    """Trigram model from (text, lang): counts over at most about fit_rows rows of the `languages` most frequent labels, smoothed."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang"))
    common, seen = measured(rows.groupBy("lang").agg(F.count("*").alias("c")), "lang-labels", rows=F.sum("c"))
    # so many rows at most
    chosen = sorted(r.lang for r in common.orderBy(F.desc("c"), "lang").limit(languages).collect())
    part = -(-seen["rows"] // fit_rows) or 1
    sample = rows.where((F.pmod(F.xxhash64("text"), F.lit(part)) == 0) & F.col("lang").isin(chosen))

    def count(batches):
        for batch in batches:
            data, offsets = byte_column(batch.column("text"))
            names, code = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
            for i, j in doc_groups(offsets, _GROUP):
                row, bucket = trigrams(data, offsets[i : j + 1])
                key, c = np.unique(code[i:j][row] << BUCKET_BITS | bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names[key >> BUCKET_BITS], pa.string()), pa.array((key & ((1 << BUCKET_BITS) - 1)).astype(np.int32)), pa.array(c.astype(np.int64))], ["lang", "bucket", "c"])

    counts = sample.mapInArrow(count, "lang string, bucket int, c long").groupBy("lang", "bucket").agg(F.sum("c").alias("c")).toPandas()
    names = sorted(counts["lang"].unique())
    table = np.full((len(names), 1 << BUCKET_BITS), 0.05)
    table[np.searchsorted(np.array(names, object), counts["lang"].to_numpy(object)), counts["bucket"].to_numpy()] += counts["c"].to_numpy()
    return Model(names, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def text_evidence(rows: DataFrame, model: Model) -> DataFrame:
    """rows(id..., text) with `ll`, tempered log-likelihoods of the languages and of `und`, in place of text."""
    shared = rows.sparkSession.sparkContext.broadcast(model.logs)
    kept = [f.name for f in rows.schema if f.name != "text"]
    k = len(model.languages)

    def score(batches):
        logs = shared.value
        for batch in batches:
            data, offsets = byte_column(batch.column("text"))
            out = np.zeros((len(batch), k + 1))
            for i, j in doc_groups(offsets, _GROUP):
                row, bucket = trigrams(data, offsets[i : j + 1])
                n = np.bincount(row, minlength=j - i)
                temper = EFFECTIVE / (EFFECTIVE + n)
                for x in range(k):
                    out[i:j, x] = np.bincount(row, weights=logs[x][bucket], minlength=j - i) * temper
                out[i:j, k] = n * UNKNOWN * temper
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(list(out), pa.list_(pa.float64()))], [*kept, "ll"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(lambda it: relieved(score(it)), f"{fields}, ll array<double>")


def _softmax(logs):
    top = F.array_max(logs)
    shifted = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def fuse(rows: DataFrame, model: Model) -> DataFrame:
    """rows(id..., text, host, parent, declared, suffix) → id..., text_language, language, confidence.

    The columns host, parent, declared and suffix may be null; the ids may have any names but the three of the result.
    """
    names = [*model.languages, "und"]
    evidence = ("host", "parent", "declared", "suffix")
    ids = F.struct(*(F.col(f"`{c}`") for c in rows.columns if c not in ("text", *evidence))).alias("row")
    flat = rows.select(ids, "text", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(f"_{c}") for c in evidence))
    scored = text_evidence(flat, model).withColumn("_alone", _softmax(F.col("ll")))
    best = F.array_max("_alone")
    scored = scored.withColumn("_pick", F.when(best >= CERTAIN, F.array_position("_alone", best).cast("int") - 1).otherwise(-1))
    counts = F.array(*(F.count(F.when(F.col("_pick") == i, 1)) for i in range(len(names))))
    scored = scored.withColumn("_best", (F.array_position("_alone", best) - 1).cast("int")).drop("_alone")
    scored, seen = measured(scored, "lang-text", n=F.count(F.lit(1)), c=counts)
    total, overall = seen["n"], list(seen["c"] or [0] * len(names))
    world = [(x + 1) / (sum(overall) + len(names)) for x in overall]
    joined = scored
    for c in (f"_{e}" for e in evidence):
        table, held = measured(scored.groupBy(c).agg(F.count("*").alias("_n"), counts.alias(f"{c}_c")), f"lang{c}", top=F.max("_n"))
        joined = hot_join(joined, table, [c], "_n", total, ["row"], "left", held["top"]).drop("_n")
    base = F.array(*map(F.lit, world))
    own = F.transform(F.array(*map(F.lit, range(len(names)))), lambda i: (i == F.col("_pick")).cast("long"))

    def smoothed(column: str, prior, weight: float):
        mine = F.zip_with(F.col(column), own, lambda a, b: a - b)
        seen = F.aggregate(mine, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.zip_with(mine, prior, lambda a, p: (a + weight * p) / (seen + weight))

    joined = joined.withColumn("_parent_p", smoothed("_parent_c", base, SMOOTH_HOST)).withColumn("_prior", smoothed("_host_c", F.col("_parent_p"), SMOOTH_HOST))
    totals = F.array(*(F.lit(float(x)) for x in overall))

    def likelihood(column: str):
        mine = F.zip_with(F.col(column), own, lambda a, b: a - b)
        seen = F.aggregate(mine, F.lit(0).cast("long"), lambda a, x: a + x)
        share = (seen + 1) / F.lit(float(sum(overall) + 1))
        return F.zip_with(mine, totals, lambda a, t: F.log((a + SMOOTH_VALUE * share) / (t + SMOOTH_VALUE)))

    logs = F.transform("_prior", lambda p: F.log(p))
    for more in (F.col("ll"), likelihood("_declared_c"), likelihood("_suffix_c")):
        logs = F.zip_with(logs, more, lambda a, b: a + b)
    out = joined.withColumn("_post", _softmax(logs)).withColumn("_top", F.array_max("_post"))
    named = F.array(*map(F.lit, names))
    return out.select(
        "row.*", F.element_at(named, F.col("_best") + 1).alias("text_language"), F.element_at(named, F.array_position("_post", F.col("_top")).cast("int")).alias("language"), F.col("_top").alias("confidence")
    )


def identify_documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, tk, text_language, language, confidence) of documents: lang is the declaration, source the host."""
    model = model or fit(docs)
    rows = docs.select("doc_id", F.xxhash64("text").alias("tk"), "text", F.col("source").alias("host"), F.lit(None).alias("parent"), F.col("lang").alias("declared"), F.lit(None).alias("suffix"))
    return fuse(rows, model)


def keep_identified(docs: DataFrame, languages: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """The documents identified with at least `least` confidence as one of `languages` (all that were fitted, by default)."""
    model = fit(docs)
    wanted = F.col("language").isin(languages or model.languages) & (F.col("confidence") >= least)
    gone = identify_documents(docs, model).where(~wanted).select(*row_key("tk")).distinct()
    gone, seen = measured(gone, "lang-gone", n=F.count(F.lit(1)))
    return anti_join(docs.select(packed(docs), *row_key(F.xxhash64("text"))), gone, ["_i", "_t"], seen["n"]).select("row.*")


def page_rows(pages: DataFrame) -> DataFrame:
    """(page_id, text, host, parent, declared, suffix) of raw pages."""
    html = F.coalesce("html", F.lit(""))
    body = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    text = F.regexp_replace(body, r"&#?\w+;", " ")
    rest = F.regexp_extract("url", r"^[^/?#]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(rest, r"^.*@|:\d*$", ""))
    labels = F.split(host, r"\.")
    parent = F.when(F.size(labels) > 2, F.array_join(F.slice(labels, 2, F.size(labels) - 1), ".")).otherwise(host)
    section = F.regexp_extract("url", r"^[^/?#]*://[^/?#]*/([A-Za-z]{2})(?:[-_/?#]|$)", 1)
    suffix = F.concat_ws("/", F.element_at(labels, -1), F.lower(section))
    declared = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))
    return pages.select("page_id", text.alias("text"), *(F.when(x != "", x).alias(n) for x, n in ((host, "host"), (parent, "parent"), (declared, "declared"), (suffix, "suffix"))))


def op6_bayes_langid(spark, sf_dir: str) -> DataFrame:
    """Every page's language; the text model is fitted on the documents' lang."""
    model = fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = fuse(page_rows(spark.read.parquet(f"{sf_dir}/pages.parquet")), model)
    return found.select("page_id", "text_language", "language", F.round("confidence", 6).alias("confidence"))
