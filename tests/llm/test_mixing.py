import math
import random
import re

import pytest

from quillgraph.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def _targets(sizes):
    """Share by weight, stop at three times the size, share the rest again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        rest, all_weights = total - sum(stopped.values()), sum(weight[s] for s in free)
        over = {s: 3 * sizes[s] for s in free if rest * weight[s] / all_weights > 3 * sizes[s]}
        if not over:
            return stopped | {s: rest * weight[s] / all_weights for s in free}
        stopped |= over


def _rows():
    rng = random.Random(2)
    rows = []
    for source, n, long in [("b", 60, 40), ("a", 40, 30), (None, 30, 200), ("é", 50, 10), ("", 8, 5), ("Z", 5, 3), ("zero", 3, 0), ("hot", 400, 60)]:
        rows += [(len(rows) + i, "w " * rng.randrange(0, long + 1), source) for i in range(n)]
    return rows + [(9_000, None, "b"), (9_001, "x" * 100_000, "a"), (None, "a b c", "b"), (9_002, "no\x85break here", "a")]


def test_targets_and_words_taken(make_docs):
    rows = _rows()
    size = {d: len(WORD.findall(t or "")) for d, t, _ in rows}
    source_of = {d: s for d, _, s in rows}
    sizes = {}
    for d, s in source_of.items():
        sizes[s] = sizes.get(s, 0) + size[d]
    target = _targets(sizes)
    assert any(t == 3 * sizes[s] > 0 for s, t in target.items())
    got = mixing.mix(make_docs(rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((d is None, d or 0) for d in size)
    taken = {}
    for r in got:
        s = source_of[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[s])
        assert r.target == pytest.approx(target[s])
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], 2), s
    again = mixing.mix(make_docs(rows).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_rates_solve_the_dual(make_docs):
    rows = [(i, "w " * (i % 30 + 1), "abc"[i % 3]) for i in range(600)]
    got = mixing.mix(make_docs(rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.target, []).append(r)
    for target, held in by.items():
        assert sum(r.rate * r.size for r in held) == pytest.approx(target, rel=1e-5)
        tilts = {round(math.log(r.rate) / r.size, 6) for r in held if r.rate < 3}
        assert len(tilts) == 1  # rates are one exponential in size


def test_whole_documents(make_docs):
    rows = [*_rows()[:150], (5, "again and again", "b"), (5, "again and again", "b")]
    docs = make_docs(rows)
    copies = {}
    for r in mixing.mix(docs).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    back = mixing.mix(docs, whole=True)
    assert back.columns == docs.columns
    found = {}
    for r in back.collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == {d: n for d, n in copies.items() if n}


def test_no_rows_and_no_words(make_docs):
    assert mixing.mix(make_docs([])).count() == 0
    assert mixing.mix(make_docs([]), whole=True).count() == 0
    got = mixing.mix(make_docs([(1, None, "a"), (2, " ", None)])).collect()
    assert {(r.size, r.target, r.taken) for r in got} == {(0, 0.0, 0)}


def test_main_path_has_no_python(make_docs):
    plan = mixing.mix(make_docs([(1, "a b", "s"), (2, "c", "t")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
