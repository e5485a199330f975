import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillgraph.llm import best_position as bp

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def said(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, k=10):
    docs = [(d, Counter(said(t)), len(said(t))) for d, t in rows if said(t)]
    n, words = len(docs), sum(size for *_, size in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(said(text))
    out = []
    for item, query in asked.items():
        scored = []
        for doc_id, c, size in docs:
            m = 100 - 75 + 75 * size * n // words
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in query.items() if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(docs, items, **more):
    return sorted((tuple(r) for r in bp.search(docs, items, **more).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def texts(seed, n, words):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    return [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(words)], k=rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("block, slice_terms", [(1_000_000, 200_000), (150, 25)])
def test_against_brute_force(spark, make_docs, block, slice_terms):
    rows = [*enumerate(texts(1, 250, 80)), (900, None), (901, ""), (902, "?!"), (903, "W0 w0\tW1-w2"), (903, "W0 w0\tW1-w2"), (None, "w3 w3 w4"), (904, "é日本 É w5" * 3_000)]
    asked = [*enumerate(texts(2, 12, 90)), (50, None), (51, ""), (52, "nowhere"), (53, "W0 é日本"), (53, "w1"), (None, "w7 w7")]
    items = spark.createDataFrame(asked, "item_id long, text string").selectExpr("*", "item_id AS query", "text AS term", "1 AS score")
    assert got(make_docs(rows), items, block=block, slice_terms=slice_terms) == brute(rows, asked)


def test_ties_hot_terms_and_nothing(spark, make_docs):
    rows = [(i, "the same text") for i in range(400)] + [(i, "the " * (i % 7)) for i in range(400, 600)]
    items = spark.createDataFrame([(1, "the same"), (2, "the"), (3, "text text")], "item_id int, text string")
    assert got(make_docs(rows), items, block=300) == brute(rows, [(1, "the same"), (2, "the"), (3, "text text")])
    assert bp.search(make_docs([]), items).count() == 0
    assert bp.search(make_docs(rows[:5]), items.limit(0)).count() == 0
    assert bp.search(make_docs([(1, None), (2, "--")]), items).count() == 0


def _block(seed, docs=3_000, lists=8):
    rng = np.random.default_rng(seed)
    per = [np.sort(rng.choice(lists, rng.integers(1, lists + 1), replace=False)) for _ in range(docs)]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in per])])
    numbers = np.concatenate(per)
    return bp.Block(np.arange(docs), starts, numbers, (1 + rng.pareto(1.0, len(numbers)) * 1_000).astype(np.int64), lists), starts, numbers


@pytest.mark.parametrize("seed", range(5))
def test_lists_are_left_early_and_whole_results_come(seed):
    block, starts, numbers = _block(seed)
    query, weights = np.arange(8), np.arange(1, 9)
    found = block.search(query, weights, bp.NOTHING, 10)
    scores = np.add.reduceat(weights[numbers] * block.impacts, starts[:-1])
    order = np.lexsort((np.arange(len(scores)), -scores))[:10]
    assert found.ids.tolist() == order.tolist() and found.scores.tolist() == scores[order].tolist()
    assert found.direct < len(scores) / 2
    # A full heap from an earlier block ends the search sooner.
    again = block.search(query, weights, bp.Found(found.scores + 10**9, found.ids + 10**6), 10)
    assert again.direct <= found.direct


def test_equal_to_the_kth_is_not_a_reason_to_stop():
    """A document as good as the k-th but of smaller id stands deep in the only list."""
    n = 500
    block = bp.Block(np.arange(n)[::-1].copy(), np.arange(n + 1), np.zeros(n, np.int64), np.full(n, 7), 1)
    assert block.search(np.array([0]), np.array([3]), bp.NOTHING, 4).ids.tolist() == [0, 1, 2, 3]
