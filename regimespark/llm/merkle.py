"""Merkle manifest of a dataset, built by slot pivots.

Leaves are digests of rows. In each group (a language, say) they ascend by given columns, and
every `fanout` consecutive nodes become their parent: conditional aggregates spread a parent's
children into one column a slot, the columns concatenated are hashed to the parent, and the
columns but the own slot's are a node's siblings. The tops of the groups, in bytewise order of
the group with null first, likewise give the root.

Levels are taken CHUNK at a time: rows are dealt by (group, bucket of fanout**levels consecutive
nodes), so all levels of a bucket are pivoted without another shuffle and no task gets more than
a bucket of a group together. Only one row of each bucket goes on to the next levels; on the way
back a bucket's path meets its rows where they already are. Places of rows come from one sort by
range and counts by (group, sorted partition), not from a window over a group.

Only DataFrame functions are used.

Defined results: null and empty values have different leaves; rows of equal order columns are
ordered by their leaves, so equal rows have equal leaves and each a place of its own; null order
columns and a null group come first; the only row of a table is its own root and has no siblings;
an empty table gives no rows; texts of any length are hashed whole; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, KEY_BYTES, hot_join, measured, shuffle_partitions

#: Nodes of a bucket, at most (or one parent's children, where these are more).
BUCKET = 32
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts) -> Column:
    """Lowercase hex sha256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*columns) -> Column:
    """Digest of a row's values: `-` for null, else UTF-8 byte count, `:`, value."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def placed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows(g, h, ...) with their place `pos` in the order of (order, h) in g and the number `n` of g's rows, and the largest n."""
    keys = [F.col(c).asc_nulls_first() for c in ("g", *order, "h")]
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    dealt, _ = measured(dealt.withColumn("_at", F.monotonically_increasing_id()), "merkle-rows", n=F.count(F.lit(1)))
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    # a row for each group and sorted partition that has it
    of = Window.partitionBy("g")
    starts = dealt.groupBy("g", "_part").agg(F.count("*").alias("c"), F.min("_at").alias("_low"))
    before = F.sum("c").over(of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select("g", "_part", (F.coalesce(before, F.lit(0)) - F.col("_low")).alias("_add"), F.sum("c").over(of).alias("n"))
    starts, seen = measured(starts, "merkle-starts", rows=F.count(F.lit(1)), most=F.max("n"))
    starts = F.broadcast(starts) if seen["rows"] * KEY_BYTES <= BROADCAST_BYTES else starts.hint("shuffle_hash")
    return dealt.join(starts, ["g", "_part"]).withColumn("pos", F.col("_at") + F.col("_add")).drop("_at", "_part", "_add"), seen["most"]


def pivoted(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """nodes(g, pos, n, h, ...) with `bucket`, the place of the ancestor `levels` up; h becomes that ancestor, and `path` the siblings on the way, left and right of the own slot."""
    out = nodes.withColumn("bucket", F.expr(f"pos div {fanout**levels}")).repartition("g", "bucket").withColumn("path", F.array().cast(_PATH))
    slots = [f"_c{j}" for j in range(fanout)]
    for k in range(levels):
        slot, parent = F.expr(f"pos div {fanout**k} % {fanout}"), Window.partitionBy("g", "bucket", F.expr(f"pos div {fanout ** (k + 1)}"))
        out = out.withColumns({c: F.coalesce(F.max(F.when(slot == j, F.col("h"))).over(parent), F.lit("")) for j, c in enumerate(slots)})
        left, right = (F.concat(*(F.when(F.lit(j) < slot if own == "left" else F.lit(j) > slot, F.col(c)).otherwise("") for j, c in enumerate(slots))) for own in ("left", "right"))
        many = F.col("n") > fanout**k  # else h is the top already
        path = F.when(many, F.concat("path", F.array(F.struct(left.alias("left"), right.alias("right"))))).otherwise(F.col("path"))
        out = out.withColumns({"path": path, "h": F.when(many, digest(*slots)).otherwise(F.col("h"))}).drop(*slots)
    return out


def climb(nodes: DataFrame, most: int, fanout: int) -> list[DataFrame]:
    """The levels of nodes(g, pos, n, h, ...), of which no group has over `most`, in chunks from the leaves to the tops."""
    todo, step = 0, 1
    while fanout**todo < most:
        todo += 1
    while fanout ** (step + 1) <= BUCKET:
        step += 1
    chunks = []
    while True:
        now = min(step, todo)
        chunks.append(pivoted(nodes, fanout, now))
        todo -= now
        if not todo:
            return chunks
        tops = chunks[-1].where(F.expr(f"pos % {fanout**now} = 0"))
        nodes, _ = measured(tops.select("g", F.col("bucket").alias("pos"), F.expr(f"(n + {fanout**now - 1}) div {fanout**now}").alias("n"), "h"), "merkle-tops", n=F.count(F.lit(1)))


def descend(chunks: list[DataFrame]) -> DataFrame:
    """The leaves with their group's top in h and the whole path in path."""
    known = chunks[-1]
    for rows in reversed(chunks[:-1]):
        above = known.select("g", F.col("pos").alias("bucket"), F.col("path").alias("_up"), F.col("h").alias("_top"))
        met = rows.join(above.hint("shuffle_hash"), ["g", "bucket"])
        known = met.withColumns({"path": F.concat("path", "_up"), "h": F.col("_top")}).drop("_up", "_top")
    return known


def manifest(rows: DataFrame, group: str, order: list[str], leaf: str = "leaf", fanout: int = 2) -> DataFrame:
    """All columns of rows in one struct `row`, and subroot, root and path: the siblings (left, right of the own slot) level by level from the leaf to the root."""
    if fanout < 2:
        raise ValueError("a parent needs two slots at least")
    # null is the least group, and never equal to another
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    nodes = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), named.alias("g"), F.col(leaf).alias("h"))
    nodes, most = placed(nodes.withColumns({f"_o{i}": F.col("row").getField(c) for i, c in enumerate(order)}), [f"_o{i}" for i in range(len(order))])
    chunks = climb(nodes.select("row", "g", "pos", "n", "h"), most, fanout)
    sizes = nodes.where("pos = 0").select("g", F.col("n").alias("rows"))
    tops, seen = measured(chunks[-1].where("pos = 0").select("g", "h").join(sizes, "g"), "merkle-groups", groups=F.count(F.lit(1)), all=F.sum("rows"))
    above = tops.select(F.lit("").alias("g"), F.col("g").alias("_o0"), "h", "rows")
    above, _ = placed(above, ["_o0"])
    above = descend(climb(above, seen["groups"], fanout)).select(F.col("_o0").alias("g"), F.col("h").alias("root"), F.col("path").alias("_up"), "rows")
    leaves = descend(chunks).select("row", "g", F.col("h").alias("subroot"), "path")
    if seen["groups"] * (KEY_BYTES + 128 * fanout * (seen["groups"].bit_length() + 1)) <= BROADCAST_BYTES:
        met = leaves.join(F.broadcast(above.drop("rows")), "g")
    else:
        met = hot_join(leaves, above, ["g"], "rows", seen["all"], ["row"], "inner")
    return met.select("row", "subroot", "root", F.concat("path", "_up").alias("path"))


def folded(start, path) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda h, s: digest(s["left"], h, s["right"]))


def proof(path) -> Column:
    """Digest of the siblings from the leaf to the root, left to right in each level."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots, digest of its proof, and whether a leaf that may have been tampered with leads to the root."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    other = leaf(*(F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in FIELDS))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, other)
    rows = docs.select("doc_id", "lang", leaf(*FIELDS).alias("leaf"), tampered.alias("tampered"))
    out = manifest(rows, "lang", ["doc_id"]).withColumn("_found", folded(F.coalesce("row.tampered", "row.leaf"), F.col("path")))
    return out.select("row.doc_id", "row.leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), F.col("_found").alias("folded_root"), (F.col("_found") == F.col("root")).alias("verified"))


def _fields(n_chars: str) -> str:
    return " || ".join(f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')" for v in (n_chars if c == "n_chars" else c for c in FIELDS))


# nodes of all levels by recursion, level 0 being the leaves; group 0 of `up` holds the subroots
OP12_SQL = f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, lang, sha256({_fields('n_chars')}) AS leaf, sha256({_fields('(n_chars + 1)')}) AS other,
      xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS sum FROM documents, crc),
l AS MATERIALIZED (SELECT doc_id, leaf, CASE WHEN sum % 7 = 0 THEN other ELSE leaf END AS start, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS g,
      row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
t(g, lvl, pos, n, h) AS (SELECT g, 0, pos, n, leaf FROM l
  UNION ALL SELECT g, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY g, lvl, pos // 2, n),
s AS MATERIALIZED (SELECT g, lvl AS top, h AS subroot FROM t WHERE n = 1),
up(lvl, pos, n, h) AS (SELECT 0, g - 1, count(*) OVER (), subroot FROM s
  UNION ALL SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY lvl, pos // 2, n),
r AS MATERIALIZED (SELECT lvl AS last, h AS root FROM up WHERE n = 1),
k AS MATERIALIZED (SELECT row_number() OVER () AS i, l.doc_id, l.leaf, l.start, l.g, l.pos, s.top, s.subroot, r.last, r.root FROM l JOIN s ON l.g = s.g, r),
steps AS (SELECT k.i, x.lvl, (k.pos >> x.lvl) & 1 AS slot, t.h FROM k, LATERAL (SELECT unnest(range(k.top)) AS lvl) x LEFT JOIN t ON t.g = k.g AND t.lvl = x.lvl AND t.pos = xor(k.pos >> x.lvl, 1)
  UNION ALL SELECT k.i, k.top + x.lvl, ((k.g - 1) >> x.lvl) & 1, up.h FROM k, LATERAL (SELECT unnest(range(k.last)) AS lvl) x LEFT JOIN up ON up.lvl = x.lvl AND up.pos = xor((k.g - 1) >> x.lvl, 1)),
p AS MATERIALIZED (SELECT i, list({{'slot': slot, 'h': coalesce(h, '')}} ORDER BY lvl) AS path FROM steps GROUP BY i),
f(i, lvl, h) AS (SELECT i, 0, start FROM k
  UNION ALL SELECT f.i, f.lvl + 1, sha256(CASE WHEN p.path[f.lvl + 1].slot = 1 THEN p.path[f.lvl + 1].h || f.h ELSE f.h || p.path[f.lvl + 1].h END) FROM f JOIN p ON p.i = f.i WHERE f.lvl < len(p.path))
SELECT k.doc_id, k.leaf, k.subroot, k.root, sha256(coalesce(array_to_string(list_transform(p.path, lambda x: x.h), ''), '')) AS proof_sha256, f.h AS folded_root, f.h = k.root AS verified
FROM k LEFT JOIN p ON p.i = k.i JOIN f ON f.i = k.i AND f.lvl = k.top + k.last
"""
