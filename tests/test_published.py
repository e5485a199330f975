import os

import pytest

from checks import q_sources

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_published_documents_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(q_sources, "BLOCK", 20)
    monkeypatch.setattr(q_sources.v, "scratch", lambda spark: str(tmp_path))
    customers = {r.c_custkey: r for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    nodes = q_sources.read_graph_json(spark, SF).collect()
    files = list((tmp_path / "published").glob("part-*"))
    assert len(files) == len({k // 20 for k in customers}) > 1
    assert all(f.read_text().count('"page_title"') <= 20 for f in files)
    assert {r.node_id: (r.page_title, r.label) for r in nodes} == {k: (r.c_name, r.c_mktsegment) for k, r in customers.items()}
    assert len(nodes) == len(customers)
