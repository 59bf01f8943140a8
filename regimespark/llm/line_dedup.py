"""Cross-site line deduplication by distinct-site spread.

A HyperLogLog sketch of the sites of each line hash is merged by map-side combined
aggregation. Lines whose estimate is clearly below the threshold stay, clearly above it
are boilerplate, and those in between get an exact distinct count. Boilerplate lines are
removed everywhere.

Defined results: lines end at \\n; lines shorter than `min_chars` characters are never
removed; a null text has no lines and stays null; an empty text is one empty line; a null
site counts as one site of its own; repeated rows are treated alike; work grows with a text's lines,
however many there are; an empty table gives no rows. Extra columns are kept, but for those named n_lines or n_removed, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, measured, packed, semi_join, sieve_join, two_hashes

LG_CONFIG = 11
#: Relative error of a sketch that is trusted without an exact count: over six times its standard error.
MARGIN = 0.15


def line_keys(docs: DataFrame, site: str) -> DataFrame:
    """One row for each line of each text that is not null: 128 bits each of text and line, position, site, characters."""
    (tk, t2), (lh, l2) = two_hashes("text"), two_hashes("line")
    rows = docs.where("text IS NOT NULL").select(
        tk.alias("tk"), t2.alias("t2"), F.coalesce(F.concat(F.lit("="), F.col(site).cast("string")), F.lit("")).alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"),
    )
    return rows.select("tk", "t2", "site", "pos", lh.alias("lh"), l2.alias("l2"), F.length("line").alias("chars"))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(lh, l2, n): hashes of lines on at least `min_sites` sites, with their occurrences."""
    line = ["lh", "l2"]
    sketched = lines.groupBy(*line).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_CONFIG))).alias("sites"), F.count("*").alias("n"))
    unclear = F.col("sites") <= min_sites * (1 + MARGIN)
    sketched, seen = measured(sketched.where(F.col("sites") >= min_sites * (1 - MARGIN)), "line-sketches", near=F.sum(unclear.cast("long")))
    near = sketched.where(unclear)
    # a line has one row for each of its sites left when it is counted
    spread = semi_join(lines.select(*line, "site"), near.select(*line), line, seen["near"], once=True).groupBy(*line).agg(F.count_distinct("site").alias("exact"))
    exact = near.join(spread.where(F.col("exact") >= min_sites), line, "left_semi")
    return sketched.where(~unclear).unionByName(exact).select(*line, "n")


def removal_mask(column: str):
    """A byte for each line up to the last of the sorted positions, 1 at these, so that a text's lines are looked up in the time that reading them takes."""
    before = lambda k: F.coalesce(F.get(F.col(column), k - 1), F.lit(-1))
    return F.array_join(F.transform(column, lambda p, k: F.concat(F.repeat(F.lit("0"), p - before(k) - 1), F.lit("1"))), "").cast("binary")


def remove_lines(docs: DataFrame, site: str = "source", min_sites: int = 10, min_chars: int = 1) -> DataFrame:
    """The documents with boilerplate lines removed from text, and n_lines, n_removed beside."""
    lines, seen = measured(line_keys(docs, site).where(F.col("chars") >= min_chars).drop("chars"), "lines", n=F.count(F.lit(1)))
    found, held = measured(boilerplate(lines, min_sites), "boilerplate", top=F.max("n"))
    hits = hot_join(lines.drop("site"), found, ["lh", "l2"], "n", seen["n"], ["tk", "pos"], "inner", held["top"])
    per_text = hits.groupBy("tk", "t2").agg(F.sort_array(F.collect_set("pos")).alias("_gone"), F.count("*").alias("rows"))
    per_text = per_text.select("tk", "t2", F.size("_gone").cast("long").alias("_n"), removal_mask("_gone").alias("_mask"), (F.col("rows") / F.size("_gone")).cast("long").alias("copies"))
    per_text, total = measured(per_text, "line-removals", copies=F.sum("copies"), top=F.max("copies"))
    own = ("n_lines", "n_removed")
    tk, t2 = two_hashes("text")
    rows = docs.select(packed(docs, *own), F.col("doc_id").alias("_d"), tk.alias("tk"), t2.alias("t2"))
    joined = sieve_join(rows, per_text, ["tk", "t2"], "copies", total["copies"], ["_d"], total["top"])
    parts = F.split("row.text", "\n", -1)
    left = F.filter(parts, lambda _, i: F.substr(F.col("_mask"), i + 1, F.lit(1)) != F.lit(b"1"))
    text = F.when(F.col("_mask").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(parts)).cast("long")
    kept = [text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in own]
    return joined.select(*kept, n_lines.alias("n_lines"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_removed"))


def op3_line_spread(spark, sf_dir: str) -> DataFrame:
    """Every document: lines, boilerplate lines removed, and a digest of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = remove_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = """
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
           FROM documents WHERE text IS NOT NULL),
b AS (SELECT line FROM l WHERE length(line) >= 1 GROUP BY line HAVING count(DISTINCT coalesce('=' || source, '')) >= 10),
m AS (SELECT l.doc_id, l.pos, l.line, b.line IS NOT NULL AS gone FROM l LEFT JOIN b ON l.line = b.line),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
