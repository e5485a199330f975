import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, rank int, score double, v int, dim int, block int"


def _df(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0.0, 0, 0, 0) for i, v in rows], SCHEMA).repartition(3)


def _brute(rows, query, k):
    found = []
    own = dict(rows)[query]
    for i, v in rows:
        if i != query and len(v) == len(own):
            found.append((float(np.sqrt(((np.float64(np.float32(v)) - np.float64(np.float32(own))) ** 2).sum())), i))
    return sorted(found)[:k]


def _vectors(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return [(i, (centres[i % 12] + 0.4 * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("block", [8_192, 200])
def test_recall(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    rows = _vectors(1_500)
    got = {}
    for r in ann.nearest(_df(spark, rows), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert len(got) == 15
    hits = 0
    for query, found in got.items():
        want = _brute(rows, query, 10)
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        exact = {i: d for d, i in _brute(rows, query, len(rows))}
        assert all(s == pytest.approx(exact[i], rel=1e-12) for _, i, s in found)
        assert found == sorted(found, key=lambda x: (x[2], x[1]))
        hits += len({i for _, i, _ in found} & {i for _, i in want})
    assert hits >= 0.97 * 150


def test_ties_copies_and_vectors_that_take_no_part(spark):
    one = [1.0, 2.0]
    rows = [(i, one) for i in range(0, 40)] + [(100, [1.0, 2.5]), (101, None), (102, [0.0, 0.0]), (103, [float("nan"), 1.0]), (104, [float("inf"), 1.0]), (105, [None, 1.0]), (200, [0.0, 0.0]), (None, one), (300, [1.0]), (301, [2.0]), (7, one)]
    got = {}
    for r in ann.nearest(_df(spark, rows), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 100, 300}
    assert sorted(got[0]) == [(r, r, 0.0) for r in range(1, 11)]
    assert sorted(got[100]) == [(r, r - 1, 0.5) for r in range(1, 11)]
    assert got[300] == [(1, 301, 1.0)]


def test_few_and_no_rows(spark):
    assert ann.nearest(_df(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.nearest(_df(spark, [(100, [1.0, 1.0])]), F.col("vec_id") % 100 == 0).count() == 0
