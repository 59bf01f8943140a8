"""The Merkle manifest against a tree built row by row."""

import hashlib
import zlib

import pytest

from regimespark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, g string, h string, path string, n long, leaf string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes, fanout):
    """All levels from the leaves to the top."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(tree, place, fanout):
    out = []
    for level in tree[:-1]:
        first = place - place % fanout
        run = level[first : first + fanout]
        out.append(("".join(run[: place - first]), "".join(run[place - first + 1 :])))
        place //= fanout
    return out


def brute(rows, fanout):
    """(doc_id, leaf, subroot, root, path) of rows (doc_id, lang, leaf)."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, r[2])):
        groups.setdefault(r[1], []).append(r)
    trees = [levels([r[2] for r in g], fanout) for g in groups.values()]
    top = levels([t[-1][0] for t in trees], fanout)
    return sorted(repr((r[0], r[2], t[-1][0], top[-1][0], siblings(t, k, fanout) + siblings(top, i, fanout))) for i, (g, t) in enumerate(zip(groups.values(), trees, strict=True)) for k, r in enumerate(g))


def odd_rows():
    langs = ["en", None, "", "é", "ｚ", "a", "EN"]
    rows = [(i * 7 % 211 - 20, f"text {i}", langs[0] if i % 3 else langs[i % 7], "s", i) for i in range(211)]
    rows += [rows[3], rows[3], (None, "x", "en", None, 1), (None, None, None, None, None), (5, "é" * 5000, "lonely", "s", 3), (5, "", "en", "", 0), (5, None, "en", None, 0)]
    return [(*r, *["clash"] * 4, 9, "clash") for r in rows]


@pytest.mark.parametrize("fanout", [2, 3, 40])
def test_manifest(spark, fanout):
    docs = spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)
    rows = docs.select("doc_id", "lang", "g", "n", "path", merkle.leaf(*merkle.FIELDS).alias("leaf"))
    got = merkle.manifest(rows, "lang", ["doc_id"], fanout=fanout).collect()
    want = brute([(r[0], r[2], leaf(r[0], r[3], r[2], r[4], r[1])) for r in odd_rows()], fanout)
    assert sorted(repr((r.row.doc_id, r.row.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.path])) for r in got) == want
    assert all(r.row.path == "clash" for r in got)


@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 1025])
def test_sizes_around_buckets(spark, n):
    rows = spark.range(n).select("id", merkle.leaf("id").alias("leaf"), (merkle.F.col("id") % 1).cast("string").alias("lang"))
    got = merkle.manifest(rows, "lang", ["id"]).select("row.id", "subroot", "root", merkle.folded(merkle.F.col("row.leaf"), merkle.F.col("path")).alias("back"), "path").collect()
    tree = levels([leaf(i) for i in range(n)], 2)
    assert {(r.subroot, r.root, r.back) for r in got} == {(tree[-1][0],) * 3}
    assert all([(s.left, s.right) for s in r.path] == siblings(tree, r.id, 2) for r in got)


def test_many_groups(spark, monkeypatch):
    rows = spark.range(300).select("id", merkle.F.concat(merkle.F.lit("k"), merkle.F.col("id") % 97).alias("lang"), merkle.leaf("id").alias("leaf"))
    want = brute([(i, f"k{i % 97}", leaf(i)) for i in range(300)], 2)
    for limit in (merkle.BROADCAST_BYTES, 0):  # joins by broadcast, and by shuffles
        monkeypatch.setattr(merkle, "BROADCAST_BYTES", limit)
        got = merkle.manifest(rows, "lang", ["id"]).collect()
        assert sorted(repr((r.row.id, r.row.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.path])) for r in got) == want


def test_query(spark, tmp_path):
    rows = odd_rows()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()
    want = brute([(r[0], r[2], leaf(r[0], r[3], r[2], r[4], r[1])) for r in rows], 2)
    paths = {}
    for text in want:
        doc, own, _, root, path = eval(text)
        paths.setdefault(own, []).append((root, h(*(x for s in path for x in s)), path))
    changed = {leaf(r[0], r[3], r[2], r[4], r[1]): leaf(r[0], r[3], r[2], None if r[4] is None else r[4] + 1, r[1]) for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0}
    assert len(got) == len(rows) and any(not r.verified for r in got)
    for r in got:
        found = set()  # equal neighbours have the same siblings
        for root, proof, path in paths[r.leaf]:
            back = changed.get(r.leaf, r.leaf)
            for left, right in path:
                back = h(left, back, right)
            found.add((root, proof, back, back == root))
        assert (r.root, r.proof_sha256, r.folded_root, r.verified) in found


def test_empty_table(spark):
    rows = spark.createDataFrame([], "doc_id long, lang string, leaf string")
    assert merkle.manifest(rows, "lang", ["doc_id"]).count() == 0
