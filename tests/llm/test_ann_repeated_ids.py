import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import ann


@pytest.mark.parametrize("block", [8_192, 150])
def test_every_vector_of_an_id_counts(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = [(i % 300, rng.normal(size=6).astype(np.float32).tolist()) for i in range(900)]
    rows += [(7, rng.normal(size=6).astype(np.float32).tolist()) for _ in range(60)]
    is_query = F.col("vec_id") % 100 == 0
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3), is_query).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 100, 200}
    hits = 0
    for query, found in got.items():
        own = [np.float64(np.float32(v)) for i, v in rows if i == query]
        nearest = {}
        for i, v in rows:
            if i != query:
                d = min(float(np.sqrt(((np.float64(np.float32(v)) - o) ** 2).sum())) for o in own)
                nearest[i] = min(d, nearest.get(i, d))
        want = sorted(nearest, key=lambda i: (nearest[i], i))[:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and len({i for _, i, _ in found}) == 10
        hits += sum(i in want and s == pytest.approx(nearest[i], rel=1e-9) for _, i, s in found)
    assert hits >= 0.9 * 30
