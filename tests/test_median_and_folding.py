import random
import statistics
import sys

import pytest

from quillgraph.functions import names
from quillgraph.operators import layout


@pytest.mark.parametrize("values", [
    [], [None], [3.5], [2.0, 1.0], [-1.0, -2.0, -3.0, 0.0, -0.0, 5.0], [7.0] * 9 + [1e-300, -1e300],
    [float("inf"), 1.0, float("-inf")], [None, 4.0, None, 6.0],
])
def test_median(spark, values):
    _same_median(spark, values)


def test_median_of_many(spark):
    draw = random.Random(3)
    _same_median(spark, [draw.choice((-1, 1)) * draw.random() * 10 ** draw.randint(-9, 9) for _ in range(4_000)])


def _same_median(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    got = layout.exact_median(rows, "v").collect()
    some = [v for v in values if v is not None]
    assert [r.median for r in got] == [statistics.median(some) if some else None]


def test_folding_of_every_code_point(spark):
    """Each code point alone and between others, against the Unicode database of Python."""
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    blocks = ["a" + "É".join(chars[i : i + 500]) for i in range(0, len(chars), 500)] + [None, "", "ABC", "한글 ΣΑΣ É 각"]
    rows = spark.createDataFrame(list(enumerate(blocks)), "id int, t string").repartition(4)
    got = {r.id: r.norm for r in rows.select("id", names.normalize_text("t").alias("norm")).collect()}
    for i, text in enumerate(blocks):
        assert got[i] == (None if text is None else names._fold(text)), i


def test_folding_needs_no_python(spark):
    plan = spark.range(1).selectExpr("string(id) AS t").select(names.normalize_text("t"))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
