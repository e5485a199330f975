"""Very long and broken markup: nothing may take a stack level or a rescan per character."""

import time

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text, wikitext
from quillgraph.operators import extract
from quillgraph.plans.dump_to_graph import DumpTables, build_graph
from quillgraph import scale
from quillgraph.sources import sqldump

LONG = 200_000


def test_long_labels_captions_and_templates(spark):
    x = "x" * LONG
    rows = [
        (f"[[Target|{x}]] [[b]]", ["Target", "b"]),
        (f"[[File:a.jpg|{x} [[inner]] [u]]] [[b]]", ["b"]),
        (f"[[a|b{x}", []),
        (f"{{{{name|{x}}}}} [[b|]]", ["b"]),
    ]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    got = df.select("t", text.extract_links("t").alias("links"), text.plain_text("t").alias("plain")).collect()
    found = {r.t: r for r in got}
    assert [found[t].links for t, _ in rows] == [want for _, want in rows]
    assert found[rows[0][0]].plain == f"{x} b" and found[rows[1][0]].plain == "b"


def test_long_sql_title(spark):
    line = "INSERT INTO `linktarget` VALUES (1,0,'" + "a\\'" * LONG + "'),(2,0,'b');"
    got = sqldump.parse_linktargets(spark.createDataFrame([(line,)], "value string")).collect()
    assert [(r.lt_id, len(r.title)) for r in got] == [(1, 2 * LONG), (2, 1)]


@pytest.mark.parametrize("part", ["{{ab", "[[ab", "* {{a\n", "{|", "{{a|[["])
def test_unclosed_brackets_take_one_pass(part):
    begin = time.process_time()
    page = part * 20_000 + "\n"
    boxes = wikitext.page_boxes("{{infobox x|name=n}}\n" + page, "infobox x")
    assert [b["params"]["name"] for b in boxes] == ["n"]
    assert time.process_time() - begin < 10


def test_many_equally_hot_keys_are_all_split(spark):
    rows = spark.range(100_000).select((F.col("id") % 20).alias("key"), "id")
    heavy = scale.heavy_keys(rows, "key").collect()
    assert len(heavy) == 0 or len(heavy) == 20
    spark.conf.set("quillgraph.heavyShare", "0.01")
    heavy = scale.cut(scale.heavy_keys(rows, "key"))
    split = scale.split_rows(rows, "key", heavy, ["id"])
    most = split.groupBy("key", "_slot").count().agg(F.max("count")).first()[0]
    spark.conf.unset("quillgraph.heavyShare")
    assert heavy.count() == 20 and most < 2 * 100_000 * 0.01 / 4


def test_a_page_produced_twice_ends_the_run(spark, tmp_path):
    page = ("Jazz", "{{Infobox music genre|name=Jazz}}")
    pages = spark.createDataFrame([(1, *page), (2, *page)], "page_id long, title string, text string").withColumn("ts", F.current_timestamp())
    nothing = spark.createDataFrame([], "a int")
    with pytest.raises(ValueError, match="more than once: Jazz"):
        build_graph(spark, DumpTables(pages, nothing, nothing, nothing, nothing, "en.wikipedia.org"), str(tmp_path))
    assert extract.classify_pages(pages).count() == 2
