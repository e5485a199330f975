"""Mix files, the published graph and the per-entity documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import names
from quillgraph.functions.text import parse_mixes

NODE = (
    "struct<page_title:string,label:string,aliases:array<string>,links:bigint,x:double,y:double,hue:double>"
)
GRAPH = (
    "wikipedia_domain string, wikipedia_db_name string, dump_date string, "
    f"nodes array<{NODE}>, edges array<array<bigint>>, max_degree bigint"
)
GENRE_DOC = "description string, last_revision_date timestamp, mixes string, top_artists array<string>"
ARTIST_DOC = "name string, description string, last_revision_date timestamp, genres array<bigint>"


def _file_stem(suffix: str = "") -> Column:
    """Name of the file a row came from; Spark reports it percent-encoded."""
    encoded = F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))
    return F.regexp_replace(F.url_decode(encoded), suffix + "$", "")


def read_mix_files(spark: SparkSession, path: str) -> DataFrame:
    """``(page, raw)`` per file; the file name is the sanitised page name."""
    files = spark.read.text(path, wholetext=True)
    return files.select(names.unsanitize(_file_stem()).alias("page"), F.col("value").alias("raw"))


def parse_mix_files(files: DataFrame) -> DataFrame:
    return files.select("page", parse_mixes("raw").alias("mixes"))


def graph_tables(document: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """``nodes`` and ``edges`` of graph documents; a node's id is its position in its document.

    Of several documents, ``keys`` are the columns that tell them apart; both tables keep them.
    """
    nodes = document.select(*keys, F.posexplode("nodes").alias("node_id", "n")).select(
        *keys, F.col("node_id").cast("long").alias("node_id"), "n.*"
    )
    nodes = nodes.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    nodes = nodes.withColumn("links", F.coalesce("links", F.lit(0).cast("long")))
    edges = document.select(*keys, F.explode("edges").alias("e")).select(
        *keys, F.col("e")[0].alias("src"), F.col("e")[1].alias("dst"), F.col("e")[2].cast("tinyint").alias("ty")
    )
    return nodes, edges


def read_graph_json(spark: SparkSession, path: str, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Tables of published graphs, each held in one JSON document; a task reads whole documents."""
    return graph_tables(spark.read.schema(GRAPH).json(path, multiLine=True), *keys)


def read_graph_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Tables of a graph written by ``write_graph``: one node or edge per line."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"^,", "").alias("line"))
    nodes = lines.filter(F.col("line").startswith('{"node_id"')).select(
        F.from_json("line", f"struct<node_id:bigint,{NODE[7:]}").alias("n")
    )
    edges = lines.filter(F.col("line").rlike(r"^\[\d+,")).select(F.from_json("line", "array<bigint>").alias("e"))
    return (
        nodes.select("n.*"),
        edges.select(F.col("e")[0].alias("src"), F.col("e")[1].alias("dst"), F.col("e")[2].cast("tinyint").alias("ty")),
    )


def read_entity_docs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON document in a folder; ``page`` comes from the file name."""
    docs = spark.read.schema(schema).json(path, multiLine=True)
    return docs.select(names.unsanitize(_file_stem(r"\.json")).alias("page"), "*")
