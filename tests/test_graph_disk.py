"""What the path search keeps on disk: no shuffle files of stored tables, lists of steps, few steps for components."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillgraph import scale
from quillgraph.operators import graph


def _shuffled(spark) -> set[str]:
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def test_cut_leaves_no_shuffle_files(spark):
    rows = spark.range(1000).groupBy((F.col("id") % 70).alias("k")).count()
    before = _shuffled(spark)
    stored, n = scale.cut_counted(rows)
    until = time.time() + 10
    while (left := _shuffled(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert n == 70 and stored.count() == 70 and rows.count() == 70
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def _graph():
    rng = random.Random(5)
    rows = {(rng.randrange(60), rng.randrange(60)) for _ in range(90)} | {(100 + i, 101 + i) for i in range(12)}
    rows |= {(200, 200 + i) for i in range(1, 15)} | {(215 + i, 215) for i in range(1, 9)}
    return sorted((a, b, 0) for a, b in rows if a != b)


@pytest.mark.parametrize("split", [False, True])
def test_parts_are_components(spark, split):
    if split:
        spark.conf.set("quillgraph.heavyShare", "0")
    try:
        edges = spark.createDataFrame(_graph(), "src long, dst long, ty tinyint")
        ways = graph._ways_of(edges, None)
        assert ways.size == len(_graph())
        for (lists, _), near, far in ((ways.outward, "src", "dst"), (ways.inward, "dst", "src")):
            assert lists.count() < ways.size
            told = {(r[near], x) for r in lists.collect() for x in r[far]}
            assert told == {((a, b) if near == "src" else (b, a)) for a, b, _ in _graph()}
        nodes = spark.createDataFrame([(i,) for i in range(240)], "node_id long")
        parts = {r.node_id: r.component for r in graph._parts(ways, nodes).collect()}
        whole = {r.node_id: r.component for r in graph.connected_components(edges, nodes).collect()}
        assert parts == whole
    finally:
        spark.conf.unset("quillgraph.heavyShare")


def test_estimates_stay_small_over_rounds(spark):
    rows = spark.range(50).select(F.col("id").alias("a"), (F.col("id") * 7 % 50).alias("b"))
    near = scale.cut(rows)
    for _ in range(8):
        there = near.select(F.col("a").alias("b"), F.col("b").alias("c"))
        near = scale.cut(near.join(there, "b").join(there.withColumnRenamed("c", "d"), "b").select("a", F.col("c").alias("b")))
    assert near._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= 64
    want = {(i, i * 7 ** (2 ** 8) % 50) for i in range(50)}
    assert {(r.a, r.b) for r in near.collect()} == want
