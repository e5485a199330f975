from collections import Counter

from quillgraph.llm import sharding


def _check(rows, limit):
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r)
    for name, held in shards.items():
        assert all(len(name) == r.depth and r.shard_docs == len(held) and r.shard_bytes == sum(x.bytes for x in held) for r in held)
        assert held[0].shard_bytes <= limit or len(held) == 1
        assert not any(other != name and other.startswith(name) for other in shards)
    return shards


def test_every_shard_fits(make_docs):
    rows = [(i, "x" * (i % 40)) for i in range(300)] + [(1000, "y" * 5_000), (1001, None), (None, "z"), (1002, "é")]
    got = sharding.shard(make_docs(rows), 200).collect()
    assert len(got) == len(rows)
    shards = _check(got, 200)
    assert any(r.bytes == 5_000 and r.shard_docs == 1 for r in got)
    assert {r.doc_id: r.bytes for r in got}[1002] == 2
    # Only what was too large has been split: each shard's parent held more than the limit.
    for name in shards:
        if name:
            assert sum(r.bytes for r in got if r.shard.startswith(name[:-1])) > 200


def test_one_id_on_many_rows_is_split(make_docs):
    got = sharding.shard(make_docs([(7, "x" * 10)] * 64 + [(8, "q")]), 100).collect()
    _check(got, 100)
    assert len(got) == 65 and max(Counter(r.shard for r in got).values()) <= 10


def test_no_rows_and_one_shard(make_docs):
    assert sharding.shard(make_docs([])).count() == 0
    assert {(r.shard, r.depth) for r in sharding.shard(make_docs([(1, "a"), (2, "b")]), 100).collect()} == {("", 0)}


def test_written_shards(spark, make_docs, tmp_path):
    docs = make_docs([(i, "x" * 30) for i in range(40)], clash=False)
    sharding.write_shards(docs, str(tmp_path / "out"), 200)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.doc_id for r in back.collect()) == list(range(40))
    assert max(r["count"] for r in back.groupBy("shard").count().collect()) <= 6


def test_every_row_is_written_once(spark, make_docs, tmp_path):
    rows = [(1, "x" * 40)] * 6 + [(2, "y"), (None, "z"), (None, None), (3, "")]
    docs = make_docs(rows)  # has a column ``shard`` of its own
    sharding.write_shards(docs, str(tmp_path / "out"), 100)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert "shard_1" in back.columns and set(docs.columns) < set(back.columns)
    kept = sorted(((r.doc_id, r.text, r.shard) for r in back.collect()), key=str)
    assert kept == sorted(((r.doc_id, r.text, r.shard) for r in docs.collect()), key=str)
    sizes = {}
    for r in back.collect():
        sizes.setdefault(r.shard_1, []).append(len(r.text or ""))
    assert len(sizes) > 2 and all(sum(s) <= 100 or len(s) == 1 for s in sizes.values())
