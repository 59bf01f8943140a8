"""Near-duplicate detection by min-max hashing.

Each multiplicative permutation of the shingle hashes is evaluated once and both its least
and its greatest value enter the signature, so that BANDS bands of four values need only two
permutations each. A band of four agrees for two sets of similarity s with a chance of about
s**4; of 30 bands none agrees at s = 0.8 with a chance of 1e-7.

Documents of equal shingle sets form one class, and only classes are compared. A class is
compared with the most central members (by the sizes of the buckets they lie in) of its
buckets, PIVOTS of them at most; similarity is confirmed on the full sets, and components form.
Classes that then still share a bucket without being in one component are compared in full, so
that no link between components is lost, while the pairs inside a component are never made. Of
these, two sets can only be linked when the rarest shingles of both (those that occur outside
their component, as many as a link may miss) have one in common, so that pairs are made by these
shingles and never by a whole bucket. Two bits of each signature value tell pairs of lower
similarity apart beforehand, at a chance of about 1e-8 to lose one.

Sets are of 64-bit shingle hashes: a false match of two of them moves an intersection by one,
at a chance of 1e-12 in a million compared pairs of a thousand shingles.

Defined results: a null text, or one without words, has no shingles and is linked with
nothing; one of fewer words than a shingle is a single shingle; repeated rows are equal sets;
a null doc_id never becomes a component_id unless the component has no other; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rolling
from .common import anti_join, components, hot_join, materialise, measured, packed, relieved, row_key, semi_join

#: The chance that a pair at the threshold shares no band, and the standard deviations by which its sketches may fall short.
MISS, SPREAD = 1.5e-7, 5.6
PIVOTS = 3
_GROUP = 1 << 18
_WORD_HOLE = np.uint8(32)


def shingle_sets(texts: list[bytes], width: int):
    """(number of the text, its distinct shingle hashes, sorted) for texts that have words."""
    parts, owner, size = [], [], 0
    for k, text in enumerate(texts):
        norm = b" ".join(text.lower().split())
        if norm:
            parts.append(norm)
            owner.append(k)
            size += len(norm)
        if parts and (size > _GROUP or k == len(texts) - 1):
            yield from _sets_of(parts, owner, width)
            parts, owner, size = [], [], 0
    if parts:
        yield from _sets_of(parts, owner, width)


def _sets_of(parts, owner, width):
    data = np.frombuffer(b" ".join(parts), np.uint8)
    ends = np.append(np.flatnonzero(data == _WORD_HOLE), len(data))
    starts = np.append(0, ends[:-1] + 1)
    close = np.cumsum([len(p) + 1 for p in parts]) - 1
    to = np.searchsorted(ends, close) + 1  # words of the texts so far
    frm = np.append(0, to[:-1])
    last = np.minimum(np.arange(len(starts)) + width, np.repeat(to, to - frm)) - 1
    hashes = rolling.spans(data, starts, ends[last])
    for k, i, j in zip(owner, frm.tolist(), to.tolist(), strict=True):
        yield k, np.unique(hashes[i : max(i + 1, j - width + 1)])


def _permutations(bands: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20_240_607)).integers(1, 1 << 63, size=(2 * bands, 2), dtype=np.uint64) | np.uint64(1)


def band_keys(sets: list[np.ndarray], bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes and the sketch of two bits a value (30 values a word), one row for each set."""
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    at = np.append(0, np.cumsum(sizes)[:-1])
    out = np.zeros((len(sets), bands), np.uint64)
    bits = np.zeros((len(sets), -(-4 * bands // 30)), np.uint64)
    for p, (a, b) in enumerate(_permutations(bands)):
        x = (values ^ b) * a
        x ^= x >> np.uint64(31)
        x *= a
        for k, v in enumerate((np.minimum.reduceat(x, at), np.maximum.reduceat(x, at)), 2 * p):
            out[:, p // 2] = rolling.mix(out[:, p // 2] * np.uint64(31) + v)
            bits[:, k // 30] |= (rolling.mix(v) >> np.uint64(62)) << np.uint64(2 * (k % 30))
    return out + np.arange(bands, dtype=np.uint64), bits


def _sign(batches, width, bands):
    for batch in batches:
        texts = [x.as_py() or b"" for x in batch.column("text").cast(pa.large_binary())]
        n = np.zeros(len(texts), np.int64)
        node = np.zeros(len(texts), np.int64)
        keys: list = [None] * len(texts)
        sketch: list = [None] * len(texts)
        held: list = []

        def flush(held=held, keys=keys, sketch=sketch, n=n, node=node):
            for (k, s), row, bits in zip(held, *band_keys([s for _, s in held], bands), strict=True):
                n[k] = len(s)
                node[k] = (rolling.mix(np.bitwise_xor.reduce(s, keepdims=True) ^ np.uint64(len(s))) + np.add.reduce(rolling.mix(s), keepdims=True))[0].view(np.int64)
                keys[k], sketch[k] = row.view(np.int64), bits.view(np.int64)
            held.clear()

        size = 0
        for k, s in shingle_sets(texts, width):
            held.append((k, s))
            size += len(s)
            if size > _GROUP:
                flush()
                size = 0
        if held:
            flush()
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (keys, sketch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tk"), pa.array(n), pa.array(node, mask=n == 0), *lists], ["doc_id", "tk", "n", "node", "keys", "sketch"])


def _full_sets(batches, width):
    for batch in batches:
        texts = [x.as_py() or b"" for x in batch.column("text").cast(pa.large_binary())]
        for k, s in shingle_sets(texts, width):
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(k, 1), pa.array([s.view(np.int64)], pa.list_(pa.int64()))], ["node", "shingles"])


def bands_for(percent: int) -> int:
    """Bands of four values, of which none agrees at the threshold with a chance of MISS."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be over 0 and at most 100")
    same = (percent / 100) ** 4
    return 1 if same == 1 else math.ceil(math.log(MISS) / math.log1p(-same))


def least_agreeing(percent: int, bands: int) -> int:
    """Signature values of 4 * bands that agree in two bits at the threshold, but for SPREAD standard deviations."""
    values, chance = 4 * bands, percent / 100 + (1 - percent / 100) / 4
    return math.floor(values * chance - SPREAD * math.sqrt(values * chance * (1 - chance)))


def _agreeing(x, y):
    """Signature values that agree in two sketches."""
    odd = 0x5555555555555555
    differ = F.zip_with(x, y, lambda a, b: a.bitwiseXOR(b))
    counts = F.transform(differ, lambda d: F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(odd))))
    return F.size(x) * 30 - F.aggregate(counts, F.lit(0), lambda a, c: a + c)


def _plausible(n, m, x, y, percent: int, bands: int):
    """Sizes and sketches allow the similarity."""
    unused = 30 * -(-4 * bands // 30) - 4 * bands
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (_agreeing(x, y) >= least_agreeing(percent, bands) + unused)


def _sets(asked: DataFrame, n: int, docs: DataFrame, width: int) -> DataFrame:
    """(node, shingles): the full sets of the n classes asked for by the document (tk, r) that stands for each."""
    rows = semi_join(docs.select("doc_id", "text", F.xxhash64("text").alias("tk")), asked.select("tk"), ["tk"], n)
    asked = asked.select("node", F.col("tk").alias("_t"), "r").hint("shuffle_hash")
    found = rows.join(asked, (F.col("tk") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("r")))
    sets = found.select("node", "text").mapInArrow(lambda it: relieved(_full_sets(it, width)), "node long, shingles array<long>")
    return materialise(sets.dropDuplicates(["node"]), "near-sets")


def _confirm(pairs: DataFrame, n: int, sets: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """The pairs (node, p) whose full sets reach the similarity, as (a, b), and their number; a p of many pairs is cut into parts."""
    asked, most = measured(pairs.groupBy("p").agg(F.count("*").alias("c")), "near-asked", c=F.max("c"))
    pivots = materialise(asked.join(sets.select(F.col("node").alias("p"), F.col("shingles").alias("y")).hint("shuffle_hash"), "p"), "near-asked-sets")
    left = pairs.join(sets.select("node", F.col("shingles").alias("x")).hint("shuffle_hash"), "node")
    both = hot_join(left, pivots, ["p"], "c", n, ["node"], "inner", most["c"])
    common = F.size(F.array_intersect("x", "y"))
    links = both.where(common * 100 >= percent * (F.size("x") + F.size("y") - common)).select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b"))
    links, got = measured(links, "near-links", n=F.count(F.lit(1)))
    return links, got["n"]


def _stars(member: DataFrame, pivots: DataFrame, crowd: int, most: int, percent: int, bands: int) -> DataFrame:
    """Pairs (node, p) of each class with the central members of its buckets, PIVOTS for each class."""
    met = hot_join(member, pivots, ["bucket"], "members", crowd, ["node"], "inner", most).where(F.col("node") != F.col("top.node"))
    met = met.where(_plausible(F.col("n"), F.col("top.n"), F.col("sketch"), F.col("top.sketch"), percent, bands)).select("node", F.col("top.weight").alias("w"), F.col("top.node").alias("p")).distinct()
    best = met.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("w"), "p"))).where(F.col("k") <= PIVOTS)
    # of a pair that was made both ways, one
    return best.groupBy(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).agg(F.max(F.struct("w", "p")).alias("top")).select(F.when(F.col("top.p") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("node"), "top.p")


def rarest_shared(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, label, n, sketch, h, more): for members of rest(node, label, n, sketch) that may be linked with another component, the rarest of their shingles that occur in others.

    A link needs percent of the shingles of either set in the other, all of which occur in two components. Of m such shingles
    and k needed, the rarest of those in common is among the first m - k + 1, for both sets alike. From there on, two sets can
    have no more in common than `more`, the shingles that are left in either.
    """
    shingles, all_of = measured(rest.select("node", "label").join(sets.hint("shuffle_hash"), "node").select("node", "label", F.explode("shingles").alias("h")), "near-shingles", n=F.count(F.lit(1)))
    shared = shingles.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("h", "c")
    shared, most = measured(shared, "near-shared", c=F.max("c"))
    met = hot_join(shingles.select("node", "h"), shared, ["h"], "c", all_of["n"], ["node"], "inner", most["c"])
    own = met.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("own")).join(rest, "node")
    spare = F.size("own") - F.ceil(F.col("n") * F.lit(percent) / F.lit(100)).cast("int")
    return own.where(spare >= 0).select("node", "label", "n", "sketch", F.size("own").alias("m"), F.posexplode(F.slice("own", F.lit(1), spare + 1)).alias("at", "s")).select("node", "label", "n", "sketch", "s.h", (F.col("m") - F.col("at")).alias("more"))


def _crossings(rest: DataFrame, sets: DataFrame, percent: int, bands: int) -> tuple[DataFrame, int]:
    """Pairs (node, p) of classes of different components that may be linked, and their number."""
    rare = materialise(rarest_shared(rest, sets, percent), "near-rare")
    one, two = (rare.select("h", *(F.col(x).alias(x + s) for x in ("node", "label", "n", "sketch", "more"))) for s in "12")
    enough = F.least("more1", "more2") * (100 + percent) >= (F.col("n1") + F.col("n2")) * percent
    apart = (F.col("node1") < F.col("node2")) & (F.col("label1") != F.col("label2")) & enough
    cross = one.join(two, "h").where(apart & _plausible(F.col("n1"), F.col("n2"), F.col("sketch1"), F.col("sketch2"), percent, bands))
    cross, got = measured(cross.select(F.col("node1").alias("node"), F.col("node2").alias("p")).distinct(), "near-cross", n=F.count(F.lit(1)))
    return cross, got["n"]


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, tk): components of documents of similarity percent/100 or more.

    tk is the hash of the text; with doc_id it tells rows apart. The number of bands follows from percent.
    """
    bands = bands or bands_for(percent)
    key = docs.schema["doc_id"].dataType.simpleString()
    count = F.count(F.lit(1))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tk"))
    signed, seen = measured(rows.mapInArrow(lambda it: relieved(_sign(it, width, bands)), f"doc_id {key}, tk long, n long, node long, keys array<long>, sketch array<long>"), "near-signed", n=count)
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "tk")).alias("rep")
    classes = signed.where("n > 0").groupBy("node").agg(rep, F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.count("*").alias("copies"))
    classes, held = measured(classes, "near-classes", copies=F.max("copies"))
    banded = classes.select("node", F.posexplode("keys").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "node")
    buckets, crowd = measured(banded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "near-buckets", sum=F.sum("members"), top=F.max("members"))
    groups = classes.select("node", "copies", F.col("rep.doc_id").alias("first"), F.col("node").alias("label"))
    if crowd["sum"]:
        member = materialise(hot_join(banded, buckets, ["bucket"], "members", crowd["sum"], ["node"], "inner", crowd["top"]), "near-members")
        weights = member.groupBy("node").agg(F.sum("members").alias("weight"))
        nodes, asked = measured(classes.join(weights.hint("shuffle_hash"), "node").select("node", "n", "sketch", "weight", F.col("rep.tk").alias("tk"), F.col("rep.doc_id").alias("r")), "near-nodes", n=count)
        sets = _sets(nodes, asked["n"], docs, width)
        member = materialise(member.drop("members").join(nodes.drop("tk", "r").hint("shuffle_hash"), "node"), "near-weighed")
        pivots = materialise(member.groupBy("bucket").agg(F.max(F.struct("weight", "node", "n", "sketch")).alias("top"), F.count("*").alias("members")), "near-pivots")
        pairs, made = measured(_stars(member, pivots, crowd["sum"], crowd["top"], percent, bands), "near-star", n=count)
        links, linked = _confirm(pairs, made["n"], sets, percent)
        labels = components(links)
        # what still lies in different components of one bucket is compared by its rarest shingles
        placed = materialise(member.select("bucket", "node").join(labels.hint("shuffle_hash"), "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label")), "near-placed")
        split = placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("bucket", "c")
        split, left = measured(split, "near-split", sum=F.sum("c"), top=F.max("c"))
        if left["sum"]:
            rest = hot_join(placed, split, ["bucket"], "c", left["sum"], ["node"], "inner", left["top"]).select("node", "label").distinct()
            rest = materialise(rest.join(nodes.select("node", "n", "sketch").hint("shuffle_hash"), "node"), "near-rest")
            cross, made = _crossings(rest, sets, percent, bands)
            if made:
                found, more = _confirm(cross, made, sets, percent)
                labels = components(links.unionByName(found)) if more else labels
        groups = groups.drop("label").join(labels.hint("shuffle_hash"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least, most = measured(groups.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("c")), "near-least", c=F.max("c"))
    groups = materialise(hot_join(groups, least, ["label"], "c", seen["n"], ["node"], "inner", most["c"]).select("node", "copies", "component_id"), "near-groups")
    plain = signed.drop("keys", "sketch").withColumn("node", F.coalesce("node", F.lit(0)))
    out = hot_join(plain, groups, ["node"], "copies", seen["n"], ["doc_id", "tk"], "left", held["copies"])
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "tk")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component: the one of smallest doc_id. Repeated rows of it are reduced to one; same columns."""
    count = F.count(F.lit(1))
    found = materialise(near_duplicates(docs, width, percent).select(*row_key("tk"), "kept"), "near-kept")
    gone, seen = measured(found.where("NOT kept").select("_i", "_t").distinct(), "near-gone", n=count)
    again = found.where("kept").groupBy("_i", "_t").agg(count.alias("c")).where("c > 1")
    out = anti_join(docs.select(packed(docs), *row_key(F.xxhash64("text"))), gone, ["_i", "_t"], seen["n"])
    if not again.isEmpty():
        out = out.dropDuplicates(["_i", "_t"])
    return out.select("row.*")


def op7_minmax_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document: its shingles and component, four words a shingle."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, width=4).drop("tk")


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(a, b) AS (SELECT a, b FROM d UNION SELECT r.a, d.b FROM r JOIN d ON r.b = d.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id,
       w.doc_id <= coalesce(m.b, w.doc_id) AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN m ON w.doc_id = m.a
"""
