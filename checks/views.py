"""The driver tables in the roles the operators expect, for Spark and for SQL.

Each ``*_SQL`` string is the DuckDB form (one or more CTEs) of the function of
the same name.  All views cover their whole tables.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph import scale


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt to all tasks by ``key``: a small file is read by one task, whatever its rows cost after that."""
    return rows.repartition(scale._tasks(rows.sparkSession), key)


def write_file_per_row(rows: DataFrame, folder: str, key: str, ending: str) -> None:
    """Write ``value`` of each row, and a line end, as a file of its own, every task into a folder of its own.

    Spark's writer would create them one by one in the task that reads the
    table and rename each of them on the driver.
    """

    def write(batches):
        from pyarrow.fs import FileSystem

        part = TaskContext.get().partitionId()
        files, where = FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", f"{folder}/folder={part}"))
        files.create_dir(where)
        values = (value for batch in batches for value in batch.column(0).to_pylist())
        n = 0
        for n, value in enumerate(values, 1):
            with files.open_output_stream(f"{where}/part-{part:05d}-{n:06d}{ending}", compression=None) as out:
                out.write(((value or "") + "\n").encode("utf-8"))
        yield pa.RecordBatch.from_pydict({"n": [n]})

    spread(rows.select(key, "value"), key).select("value").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def scratch(spark: SparkSession) -> str:
    """A new folder for one run inside the folder all executors share."""
    if spark.sparkContext.getCheckpointDir() is None:
        scale.cut(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/check-{uuid.uuid4().hex}"


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def nodes(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("node_id"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("label")
    )


NODES_SQL = "nodes AS (SELECT p_partkey AS node_id, p_name || ' ' || p_partkey AS label FROM part)"


def edges(spark, sf):
    """Parts that follow each other in an order."""
    after = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    rows = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("src"),
        F.lead("l_partkey").over(after).alias("dst"),
        (F.col("l_linenumber") % 3).cast("tinyint").alias("ty"),
    )
    return rows.filter("dst is not null and src <> dst").distinct()


EDGES_SQL = """edges AS (SELECT DISTINCT src, dst, ty FROM (
  SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS dst, l_linenumber % 3 AS ty
  FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)"""

BOTH_SQL = """both_ways AS (SELECT DISTINCT node_id, neighbour FROM (
  SELECT src AS node_id, dst AS neighbour FROM edges UNION ALL SELECT dst, src FROM edges))"""

DEGREE_SQL = """degrees AS (SELECT n.node_id, n.label, coalesce(d.degree, 0) AS degree FROM nodes n LEFT JOIN (
  SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges)
  GROUP BY 1) d USING (node_id))"""


def order_nodes(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("node_id"))


def order_edges(spark, sf):
    """Each customer's orders as a chain in time; the type is the order status."""
    after = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    ty = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    return (
        table(spark, sf, "orders")
        .select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(after).alias("dst"), ty.cast("tinyint").alias("ty"))
        .filter("dst is not null")
    )


COMPONENT_SQL = """comp AS (SELECT o_orderkey AS node_id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component,
  count(*) OVER (PARTITION BY o_custkey) AS size FROM orders)"""


def order_points(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("node_id"),
        (F.col("o_totalprice") / 100).alias("x"),
        (F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date")) * 1.0).alias("y"),
    )


ORDER_POINTS_SQL = """points AS (SELECT o_orderkey AS node_id, o_totalprice / 100 AS x,
  date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::DOUBLE AS y FROM orders)"""


def genre_pages(spark, sf):
    """Parts as genre pages, some of them under a heading of a shared page."""
    part = table(spark, sf, "part")
    key = F.col("p_partkey")
    group = F.floor(key / 4).cast("string")
    own = F.concat(F.lit("#"), "p_name", F.lit(" "), key.cast("string"))
    rooted = (key % 4 == 0) & (F.col("p_size") > 10)
    page = F.concat(F.lit("Page "), group, F.when(rooted, F.lit("")).otherwise(own))

    def link(number):
        return F.concat(F.lit("PART "), F.floor(number).cast("string"))

    return part.select(
        page.alias("page"),
        F.concat_ws(" ", "p_name", key.cast("string")).alias("label"),
        key.alias("part"),
        F.array(link(key / 2), link(key / 3)).alias("stylistic_origins"),
        F.array(link(key + F.col("p_size"))).alias("derivatives"),
        F.array(link(key * 2), link(key * 2 + 1)).alias("subgenres"),
        F.array(link(key + F.col("p_size") * 7), link(key)).alias("fusion_genres"),
    )


GENRE_PAGES_SQL = """genre_pages AS (SELECT p_partkey AS part, p_name || ' ' || p_partkey AS label,
  'Page ' || (p_partkey // 4) AS root, CASE WHEN p_partkey % 4 = 0 AND p_size > 10 THEN NULL ELSE p_name || ' ' || p_partkey END AS heading,
  p_size FROM part),
named AS (SELECT *, root || coalesce('#' || heading, '') AS page FROM genre_pages),
ids AS (SELECT *, row_number() OVER (ORDER BY root, heading NULLS FIRST) - 1 AS node_id FROM named)"""

RELATIONS_SQL = """refs AS (
  SELECT part AS here, unnest([part // 2, part // 3]) AS there, 0 AS ty, true AS inward FROM ids
  UNION ALL SELECT part, part + p_size, 0, false FROM ids
  UNION ALL SELECT part, unnest([part * 2, part * 2 + 1]), 1, false FROM ids
  UNION ALL SELECT part, unnest([part + p_size * 7, part]), 2, false FROM ids),
found AS (SELECT CASE WHEN inward THEN b.node_id ELSE a.node_id END AS src, CASE WHEN inward THEN a.node_id ELSE b.node_id END AS dst, ty,
  CASE WHEN inward THEN b.label ELSE a.label END AS src_label, CASE WHEN inward THEN a.label ELSE b.label END AS dst_label
  FROM refs JOIN ids a ON refs.here = a.part JOIN ids b ON refs.there = b.part WHERE refs.here <> refs.there)"""


def genre_links(spark, sf):
    """Lower-case link to page for every genre page."""
    pages = genre_pages(spark, sf)
    return pages.select(F.concat(F.lit("part "), F.col("part").cast("string")).alias("link"), "page")


def customer_brands(spark, sf):
    """Customers as artists: the brands they bought, in order of first purchase.

    A customer has at most as many entries as there are brands.
    """
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", *[c for c in LINE_ORDER if c != "l_shipdate"])
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    brands = table(spark, sf, "part").select("p_partkey", "p_brand")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(
        brands, lines["l_partkey"] == brands["p_partkey"]
    )
    seen = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    first = joined.groupBy("o_custkey", "p_brand").agg(F.min(seen).alias("seen"))
    lists = first.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("seen", "p_brand"))).alias("l"))
    names = table(spark, sf, "customer").select("c_custkey", "c_name")
    return lists.join(names, lists["o_custkey"] == names["c_custkey"]).select(
        F.col("c_name").alias("page"), F.col("l.p_brand").alias("genres")
    )


CUSTOMER_BRANDS_SQL = """firsts AS (SELECT o_custkey, p_brand, min(row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS seen
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
brands AS (SELECT c_name AS artist, p_brand AS brand, row_number() OVER (PARTITION BY o_custkey ORDER BY seen) - 1 AS position,
  count(*) OVER (PARTITION BY o_custkey) AS total FROM firsts JOIN customer ON o_custkey = c_custkey)"""


def customer_links(spark, sf):
    """Number of orders per customer."""
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("links"))
    names = table(spark, sf, "customer")
    return names.join(orders, names["c_custkey"] == orders["o_custkey"], "left").select(
        F.col("c_name").alias("page"), F.coalesce("links", F.lit(0)).alias("links")
    )


CUSTOMER_LINKS_SQL = """cust AS (SELECT c_name AS artist, coalesce(n, 0) AS links FROM customer
  LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""


def brand_links(spark, sf):
    """Lower-case brand to brand page; brands of the second maker are unknown."""
    brand = table(spark, sf, "part").select("p_brand").distinct()
    return brand.filter(~F.col("p_brand").startswith("Brand#2")).select(F.lower("p_brand").alias("link"), F.col("p_brand").alias("page"))


def brand_redirects(spark, sf):
    """Part redirects: a part that is no multiple of three leads to a third of it."""
    key = F.col("p_partkey")
    return table(spark, sf, "part").filter(key % 3 != 0).select(
        F.concat(F.lit("Part "), key.cast("string")).alias("title"),
        F.concat(F.lit("PART "), F.floor(key / 3).cast("string")).alias("target"),
    )


def real_parts(spark, sf):
    key = F.col("p_partkey")
    return table(spark, sf, "part").filter(key % 3 == 0).select(F.concat(F.lit("Part "), key.cast("string")).alias("page"))


REDIRECTS_SQL = """chain AS (SELECT p_partkey AS part, p_partkey AS stop FROM part
  UNION ALL SELECT part, stop // 3 FROM chain WHERE stop % 3 <> 0),
resolved AS (SELECT part, stop FROM chain WHERE stop % 3 = 0)"""


def mixes(spark, sf):
    """Distinct part and supplier pairs of low supplier numbers as page and mix."""
    pairs = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    kind = F.when(F.col("l_suppkey") % 2 == 0, "playlist").otherwise("video")
    return pairs.select(
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("page"), kind.alias("kind"),
        F.concat(F.lit("mix"), F.col("l_suppkey").cast("string")).alias("id"),
    )


MIXES_SQL = """mixes AS (SELECT DISTINCT 'Part ' || l_partkey AS page, CASE WHEN l_suppkey % 2 = 0 THEN 'playlist' ELSE 'video' END AS kind,
  'mix' || l_suppkey AS id FROM lineitem)"""


def supplier_points(spark, sf):
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("node_id"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") * 7 % 1000 * 1.0).alias("y")
    )


SUPPLIER_POINTS_SQL = "points AS (SELECT s_suppkey AS node_id, s_acctbal AS x, (s_suppkey * 7 % 1000)::DOUBLE AS y FROM supplier)"


def part_points(spark, sf):
    """Parts as placed, linked nodes."""
    from quillgraph.operators import graph

    degrees = graph.degree(edges(spark, sf), nodes(spark, sf))
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("node_id"), (F.col("p_retailprice") * 1.0).alias("x"), (F.col("p_size") * 20.0).alias("y")
    )
    return part.join(degrees, "node_id")


PART_POINTS_SQL = """placed AS (SELECT p_partkey AS node_id, p_retailprice AS x, p_size * 20.0::DOUBLE AS y, degree
  FROM part JOIN degrees ON p_partkey = node_id)"""


def wiki_pages(spark, sf):
    """Raw web pages with their links written as wiki links."""
    linked = F.regexp_replace("html", r'<a href="([^"]*)"[^>]*>([^<]*)</a>', r"[[$1|$2]]")
    return table(spark, sf, "pages").select(F.col("url").alias("page"), F.col("page_id"), linked.alias("text"), "html")
