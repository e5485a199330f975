import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import similar


def _near_copies(n_bases, copies, seed=5):
    """Texts of 30 to 120 words, each with copies that have one to three words changed."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n_bases):
        base = [f"w{rng.randrange(4_000)}" for _ in range(rng.randrange(30, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(copies + 1)):
            other = list(base)
            for _ in range(rng.randrange(1, 4)):
                other[rng.randrange(len(other))] = f"x{rng.randrange(4_000)}"
            texts.append(" ".join(other))
    rng.shuffle(texts)
    return texts


def _holds(rows, kept_ids):
    """No two kept texts are similar, every other one is similar to a kept one; kept ids are unique."""
    sets = {d: similar.shingles(t) for d, t in rows}
    kept = sorted(kept_ids)
    assert len(kept) == len(set(kept))
    for a in kept:
        assert not any(a < b and similar.similarity(sets[a], sets[b]) >= 0.8 for b in kept), a
    for d in set(sets) - set(kept):
        assert any(similar.similarity(sets[d], sets[k]) >= 0.8 for k in kept), d


def test_against_brute_force(spark, make_docs):
    rows = list(enumerate(_near_copies(40, 6)))
    docs = make_docs(rows)
    got = similar.keep_dissimilar(docs)
    assert got.columns == docs.columns
    kept = [r.doc_id for r in got.collect()]
    _holds(rows, kept)
    again = similar.keep_dissimilar(docs.repartition(5)).select("doc_id").collect()
    assert sorted(kept) == sorted(r.doc_id for r in again)


@pytest.mark.parametrize("block", [16, 32_768])
def test_one_group_of_near_copies(spark, make_docs, block, monkeypatch):
    """Half of all rows are near copies of one text; blocks are split and the group goes but for one."""
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(1)
    base = [f"w{rng.randrange(900)}" for _ in range(80)]
    rows = [(i, " ".join([*base[:40], f"v{i}", *base[41:]])) for i in range(60)]
    rows += [(100 + i, " ".join(f"u{rng.randrange(9_000)}" for _ in range(80))) for i in range(60)]
    kept = [r.doc_id for r in similar.keep_dissimilar(make_docs(rows, clash=False)).collect()]
    assert len([d for d in kept if d < 100]) == 1 and len([d for d in kept if d >= 100]) == 60


def test_candidates_of_a_group_are_not_all_pairs(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(900)}" for _ in range(300)]
    texts = [" ".join([*base[:150], f"v{i}", *base[151:]]) for i in range(80)]
    found = [similar.signature(t) for t in texts]
    rows = [(i, n, *(int(x) for x in lanes.view(np.int64))) for i, (n, lanes) in enumerate(found)]
    nodes = spark.createDataFrame(rows, "node bigint, size bigint, fp0 bigint, fp1 bigint")
    first = similar.candidates(nodes, nodes, 0.8, first_only=True).collect()
    assert sorted((r.v, r.u) for r in first if r.v is not None) == [(i, 0) for i in range(1, 80)]
    assert sorted(r.u for r in first if r.v is None) == list(range(79))


def test_edge_cases(spark, make_docs):
    assert similar.keep_dissimilar(make_docs([])).count() == 0
    long = " ".join(f"word{i}" for i in range(60_000)) + " "
    rows = [
        (1, None), (2, ""), (3, " \t "), (4, "one"), (5, "ONE"), (6, "one two"), (7, long), (8, long + "end"), (9, "tie"), (9, "tie"),
        (None, "nobody knows"), (None, "nobody else here"), (10, "same id a b c d"), (10, "another text of the id 10"),
    ]
    got = similar.keep_dissimilar(make_docs(rows)).collect()
    ids = [r.doc_id for r in got]
    assert len([d for d in ids if d in (1, 2, 3)]) == 1
    assert len([d for d in ids if d in (4, 5)]) == 1 and 6 in ids
    assert len([d for d in ids if d in (7, 8)]) == 1
    assert ids.count(9) == 1 and ids.count(None) == 2 and ids.count(10) == 2


def test_sizes_and_similarity():
    assert similar.shingles(None) == set() and similar.shingles("A b") == {b"a b"}
    assert similar.similarity(set(), set()) == 1.0 and similar.similarity({b"a"}, set()) == 0.0
    size, lanes = similar.signature("a b c d e a b c d e a b c d e")
    assert size == len(similar.shingles("a b c d e a b c d e a b c d e")) and len(lanes) == similar.LANES


def test_recall_by_band():
    """Sets of random shingles at a similarity of 0.8 and more are within the radius in 9 of 10 cases and more."""
    rng = random.Random(3)
    for target in (0.8, 0.85, 0.9, 0.95):
        hits = 0
        for _ in range(100):
            words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
            other = list(words)
            at = 0
            while similar.similarity(similar.shingles(" ".join(words)), similar.shingles(" ".join([*other[:at], "x", *other[at + 1 :]]))) >= target:
                other[at] = f"y{at}"
                at += 1
            (_, a), (_, b) = similar.signature(" ".join(words)), similar.signature(" ".join(other))
            bits = np.bitwise_count(a ^ b)
            hits += bits[0] <= similar.FIRST_RADIUS and bits.sum() <= similar.RADIUS
        assert hits >= 90, (target, hits)


def test_null_ids_and_repeats(spark, make_docs):
    docs = make_docs([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f")])
    assert similar.keep_dissimilar(docs.withColumn("more", F.lit(1))).count() == 1


def test_candidates_store_and_broadcast_no_part_counts(spark, monkeypatch):
    """Every round asks twice for candidates: the counts of blocks are some dozens of numbers and need no job of their own kind."""
    rows = [(i, 10 + i % 3, i, i) for i in range(20)]
    nodes = spark.createDataFrame(rows, "node long, size long, fp0 long, fp1 long")
    monkeypatch.setattr(similar.scale, "cut", lambda df: pytest.fail("stored"))
    found = similar.candidates(nodes, nodes, 0.8, first_only=False)
    assert "Broadcast" not in found._jdf.queryExecution().simpleString()
    assert (1, 0) in {(r.v, r.u) for r in found.collect()}


def test_a_chain_needs_no_round_for_each_of_its_links(spark, make_docs, monkeypatch):
    """Texts that are each similar to the next one only: as their pairs are no more than the documents, blocks are compared twice."""
    words = [f"w{i}" for i in range(1_000)]
    rows = [(i, " ".join(words[7 * i : 7 * i + 120])) for i in range(40)]
    rows += [(100 + i, f"u{i}") for i in range(400)]
    compared, candidates = [], similar.candidates
    monkeypatch.setattr(similar, "candidates", lambda *a, **k: compared.append(1) or candidates(*a, **k))
    kept = [r.doc_id for r in similar.keep_dissimilar(make_docs(rows, clash=False)).collect()]
    _holds(rows, kept)
    assert len([d for d in kept if d < 100]) < 40 and len(compared) == 2


@pytest.mark.parametrize("pairs", [[], [(1, 0)], [(1, 0), (2, 1), (3, 2), (4, 3)], [(2, 0), (2, 1), (3, 2), (4, 2), (4, 3), (5, 4), (9, 5)]])
def test_later_of_similar_is_greedy(spark, pairs):
    gone = set()
    for v in sorted({v for v, _ in pairs}):
        if any(u not in gone for w, u in pairs if w == v):
            gone.add(v)
    told = similar.later_of_similar(spark.createDataFrame(pairs, "v long, u long")).collect()
    assert sorted(r.node for r in told) == sorted(gone)


@pytest.mark.parametrize("pivots", [8, 1024])
def test_a_group_that_is_only_alike_needs_few_rounds(spark, make_docs, pivots, monkeypatch):
    """Near copies of one text that are candidates of each other but mostly not similar: rounds do not grow with the texts that stay."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(900)}" for _ in range(100)]
    texts = []
    for i in range(90):
        other = list(base)
        for at in rng.sample(range(100), rng.randrange(1, 6)):
            other[at] = f"v{i}"
        texts.append(" ".join(other))
    rows = list(enumerate(texts))
    found, sets = [similar.signature(t) for t in texts], [similar.shingles(t) for t in texts]
    bits = [[int(np.bitwise_count(a ^ b).sum()) for _, b in found] for _, a in found]
    alike = sum(bits[i][j] <= similar.RADIUS for i in range(90) for j in range(i))
    close = sum(similar.similarity(sets[i], sets[j]) >= 0.8 for i in range(90) for j in range(i))
    assert alike > 20 * 90 and 90 < close < alike / 2
    monkeypatch.setattr(similar, "PIVOTS", pivots)
    monkeypatch.setattr(similar, "MEETING", 16)
    rounds, candidates = [], similar.candidates
    monkeypatch.setattr(similar, "candidates", lambda *a, **k: rounds.append(k["first_only"]) or candidates(*a, **k))
    kept = [r.doc_id for r in similar.keep_dissimilar(make_docs(rows, clash=False)).collect()]
    assert len(kept) > 20 and sum(rounds) <= (1 if pivots > 90 else 14)
    left = set(kept)
    for d in range(90):
        near = [k for k in kept if k != d and similar.similarity(sets[d], sets[k]) >= 0.8 and bits[d][k] <= similar.RADIUS]
        assert not [k for k in near if np.bitwise_count(found[d][1][0] ^ found[k][1][0]) <= similar.FIRST_RADIUS] if d in left else near, d
