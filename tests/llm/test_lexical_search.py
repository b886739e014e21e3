"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from haulage.llm import lexical_search as ls

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, best=10):
    split = [(key, Counter(terms(text))) for key, text in docs]
    split = [(key, c) for key, c in split if c]
    count, total = len(split), sum(sum(c.values()) for _, c in split)
    asked = defaultdict(set)
    for item, text in items:
        asked[item].update(terms(text))
    out = set()
    for item, wanted in asked.items():
        scored = []
        for key, c in split:
            m = 10 + (90 * sum(c.values()) * count) // total
            score = 0
            for t in wanted & set(c):
                df = sum(t in other for _, other in split)
                w = math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1)))
                score += w * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out.update((item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scored)[:best], 1))
    return out


def drawn(seed, rows):
    rng = random.Random(seed)
    pool = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    return [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([1, 5, 40, 120])))) for i in range(rows)]


def test_edges(spark):
    docs = [
        (1, "Alpha beta, gamma-delta"), (1, "Alpha beta, gamma-delta"), (2, None), (3, ""), (4, " ?! "),
        (None, "alpha"), (None, None), (5, "ÄLPHA älpha alpha_beta É"), (6, "beta " * 100_000), (7, "x�y 日本 beta"),
        (8, "unrelated"), (9, "alpha"), (10, "alpha"),
    ]
    items = [(1, "ALPHA beta"), (1, "ALPHA beta"), (2, None), (3, "?"), (None, "日本"), (4, "nowhere"), (5, "gamma delta älpha é É")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr(
        "*", "1 AS rank", "2 AS SCORE", "'q' AS TEXT", "3 AS n", "4 AS terms", "5 AS item", "6 AS c1", "7 AS item_id"
    )
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS term", "'q' AS Text", "2 AS doc_id")
    got = [tuple(r) for r in ls.search(d, q).collect()]
    assert set(got) == brute(docs, items) and len(got) == len(set(got))
    assert ls.search(d.limit(0), q).count() == 0
    assert ls.search(d, q.limit(0)).count() == 0


@pytest.mark.parametrize("leaf, rows", [(64, 4096), (4, 4096), (2, 50)])
def test_trees_of_any_size_agree(spark, monkeypatch, leaf, rows):
    monkeypatch.setattr(ls, "LEAF_ROWS", leaf)
    monkeypatch.setattr(ls, "TREE_ROWS", rows)
    docs = drawn(1, 500) + [(900 + i, "w1 w2 w3 w40 w50") for i in range(100)]
    items = [(i, text) for i, (_, text) in enumerate(drawn(2, 20))] + [(99, "w50 w40")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in ls.search(d, q).collect()} == brute(docs, items)
    assert {tuple(r) for r in ls.search(d.repartition(5), q, best=3).collect()} == brute(docs, items, 3)


def test_blocks_of_items_agree(spark):
    docs, items = drawn(3, 200), drawn(4, 30)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in ls.search(d, q, block_terms=200).collect()} == brute(docs, items)


def tree_of(vectors, factors):
    flat = np.array([t for v in vectors for t in sorted(v)], np.int64)
    times = np.array([v[t] for v in vectors for t in sorted(v)], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(v) for v in vectors])])
    return ls.Tree(np.array(factors, np.int64), starts, flat, times)


def test_bounds_hold_and_spare_work(monkeypatch):
    monkeypatch.setattr(ls, "LEAF_ROWS", 4)
    rng = random.Random(5)
    vectors = [{t: rng.randint(1, 4) for t in range(40) if rng.random() < 0.9 / (1 + t / 4)} or {0: 1} for _ in range(600)]
    vectors += [{**v, 50 + i % 3: 2} for i, v in enumerate(vectors[:9])]
    factors = [rng.randint(10, 60) for _ in vectors]
    tree = tree_of(vectors, factors)
    assert sorted(tree.docs) == list(range(len(vectors)))
    asked, weights = np.array([1, 5, 50, 52]), np.array([10, 40, 900, 900])

    def score(d):
        return sum(int(w) * int(ls.parts(np.int64(vectors[d].get(int(t), 0)), np.int64(factors[d]))) for t, w in zip(asked, weights))

    def below(node):
        if node in tree.leaves:
            return set(tree.docs[np.unique(tree.leaves[node][2])])
        return set().union(*(below(c) for c in tree.children[node]))

    for node in range(len(tree.children)):
        assert all(score(d) <= tree.bound(node, asked, weights) for d in below(node))
    best = ls.Best(3)
    scored = tree.search(asked, weights, best, list(range(len(vectors))))
    wanted = sorted((-score(d), d) for d in range(len(vectors)))[:3]
    assert [(-s, k) for s, k in best.rows] == wanted
    assert scored < len(vectors) / 2
