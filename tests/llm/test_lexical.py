"""Ranked search against scoring every document, and the tree's bounds against every score."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from regimespark.llm import lexical

DOCS = "doc_id long, text string, term string, tf string, n string, score string, item_id string, rank string"
ITEMS = "item_id long, text string, doc_id string, terms string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, words = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    having = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in asked.items():
        scores = []
        for i, c in counts:
            n = sum(c.values())
            m = 50 + 50 * n * n_docs // words if words else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * having[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(repr, out))


def collected(df):
    return sorted(repr((r.item_id, r["rank"], r.doc_id, r.score)) for r in df.collect())


def tables(spark, docs, items):
    return (spark.createDataFrame([(*r, *["clash"] * 6) for r in docs], DOCS).repartition(3), spark.createDataFrame([(*r, *["clash"] * 2) for r in items], ITEMS))


def random_case(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)]
    prose = lambda size: " ".join(rng.choice(vocabulary) for _ in range(size))
    docs = [(i, prose(rng.choice([1, 5, 40, 40, 200]))) for i in range(n)]
    docs += [(n + i, docs[i % 7][1]) for i in range(n // 4)]  # copies
    return docs, [(i, prose(rng.choice([1, 8, 30]))) for i in range(12)]


@pytest.mark.parametrize("tree,leaf,limit", [(4096, 32, 10**6), (50, 4, 10**6), (7, 1, 20)])
def test_search(spark, tree, leaf, limit):
    docs, items = random_case(1, 400)
    got = lexical.search(*tables(spark, docs, items), k=9, tree=tree, leaf=leaf, limit=limit)
    assert collected(got) == brute(docs, items, 9)


def test_odd_rows(spark):
    docs = [(3, None), (4, ""), (5, " .,! \n"), (6, "One one ONE"), (7, "é É naïve"), (None, "one two"), (None, "one two"), (8, "one two"), (2, "one two"), (2, "one two three"), (9, "x" * 100_000 + " one"), (10, "one " * 50_000), (-5, "two\x00one{two}"), (11, "١٢ one2")]
    items = [(1, "ONE two"), (1, "three"), (None, "é"), (2, None), (3, ""), (4, "absent"), (5, "one " * 1000), (6, "X" * 100_000)]
    for k in (1, 3, 50):
        assert collected(lexical.search(*tables(spark, docs, items), k=k)) == brute(docs, items, k)


def test_empty_tables(spark):
    docs, items = random_case(2, 20)
    assert lexical.search(*tables(spark, docs, [])).count() == 0
    assert lexical.search(*tables(spark, [], items)).count() == 0
    assert lexical.search(*tables(spark, [(1, None)], items)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_bounds_hold_and_prune(seed):
    rng = np.random.default_rng(seed)
    size = 40
    centres = rng.integers(0, 10**6, (8, size)) * (rng.random((8, size)) < 0.3)
    rows = [np.maximum(0, centres[i % 8] + rng.integers(-2000, 2000, size) * (centres[i % 8] > 0)) for i in range(600)]
    rows[5] = rows[6] = np.zeros(size, np.int64)
    term = [np.flatnonzero(r) for r in rows]
    start = np.append(0, np.cumsum([len(t) for t in term]))
    weights = rng.integers(0, 7000, size)
    ids = rng.permutation(600).astype(np.int64)
    tree = lexical.BallTree(ids, np.zeros(600, bool), start, np.concatenate(term), np.concatenate([r[t] for r, t in zip(rows, term, strict=True)]), size, leaf=8)
    by_id = dict(zip(ids.tolist(), rows, strict=True))
    leaves = 0
    for _ in range(20):
        q = np.sort(rng.choice(size, 6, replace=False))
        bounds = tree.bounds(q, weights[q].astype(float))
        exact = np.array([(weights[q] * by_id[i][q]).sum() for i in tree.ids.tolist()])
        for (i, j, _, _), bound in zip(tree.nodes, bounds, strict=True):
            assert exact[i:j].max() <= bound
        best, asked = lexical.Best(5), np.zeros(size, np.int64)
        asked[q] = weights[q]
        leaves += tree.search(bounds, asked, best)
        want = sorted(((-s, i) for s, i in zip(exact.tolist(), tree.ids.tolist(), strict=True) if s > 0))[:5]
        assert list(zip((-best.scores).tolist(), best.ids.tolist(), strict=True)) == want
    assert leaves < 20 * 64 * 0.6  # subtrees are left out
