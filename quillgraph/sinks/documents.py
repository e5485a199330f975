"""Sinks.

Every sink writes as many files as Spark has tasks; nothing is brought together
in one row, one task or the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph import scale

_JSON = {"ignoreNullFields": "true"}


def write_stage(df: DataFrame, path: str, *by: str) -> DataFrame:
    """Write one stage as parquet, in folders ``by`` columns, and read it back, which also ends its lineage."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return df.sparkSession.read.parquet(path)


def _null_if_empty(column: str):
    return F.when(F.size(column) > 0, F.col(column))


def graph_lines(nodes: DataFrame, edges: DataFrame, meta: DataFrame) -> DataFrame:
    """The graph document as ordered text lines ``(section, a, b, c, line)``.

    One head line, a line per node in id order, a line per edge in
    (src, dst, ty) order and one tail line.  All but the first element of a
    list begin with the comma, so the lines put together in order are one JSON
    document.  ``meta(domain, db_name, dump_date, max_degree)`` is one row.
    """
    node = F.to_json(
        F.struct(
            "node_id",
            "page_title",
            "label",
            _null_if_empty("aliases").alias("aliases"),
            F.nullif("links", F.lit(0)).alias("links"),
            "x",
            "y",
            "hue",
        ),
        _JSON,
    )
    first_node = nodes.agg(F.min("node_id").alias("m")).scalar()
    first_edge = edges.agg(F.min(F.struct("src", "dst", "ty")).alias("m")).scalar()
    zero = F.lit(0).cast("long")

    def comma(is_first):
        return F.when(is_first, F.lit("")).otherwise(F.lit(","))

    head = meta.select(
        F.lit(0).alias("section"), zero.alias("a"), zero.alias("b"), zero.alias("c"),
        F.concat(
            F.regexp_replace(
                F.to_json(
                    F.struct(
                        F.col("domain").alias("wikipedia_domain"),
                        F.col("db_name").alias("wikipedia_db_name"),
                        F.col("dump_date").cast("string").alias("dump_date"),
                        "max_degree",
                    )
                ),
                r"\}$",
                "",
            ),
            F.lit(',"nodes":['),
        ).alias("line"),
    )
    node_lines = nodes.select(
        F.lit(1).alias("section"), F.col("node_id").alias("a"), zero.alias("b"), zero.alias("c"),
        F.concat(comma(F.col("node_id") == first_node), node).alias("line"),
    )
    middle = meta.select(
        F.lit(2).alias("section"), zero.alias("a"), zero.alias("b"), zero.alias("c"), F.lit('],"edges":[').alias("line")
    )
    edge = F.concat(F.lit("["), F.concat_ws(",", *[F.col(c).cast("string") for c in ("src", "dst", "ty")]), F.lit("]"))
    edge_lines = edges.select(
        F.lit(3).alias("section"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("ty").cast("long").alias("c"),
        F.concat(comma(F.struct("src", "dst", "ty") == first_edge), edge).alias("line"),
    )
    tail = meta.select(
        F.lit(4).alias("section"), zero.alias("a"), zero.alias("b"), zero.alias("c"), F.lit("]}").alias("line")
    )
    return head.union(node_lines).union(middle).union(edge_lines).union(tail)


def write_graph(nodes: DataFrame, edges: DataFrame, meta: DataFrame, path: str) -> None:
    """The graph document, sharded by lines; the files in name order are one JSON."""
    ordered = graph_lines(nodes, edges, meta).orderBy("section", "a", "b", "c")
    ordered.select("line").write.mode("overwrite").text(path)


def write_graph_tables(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The same graph as two parquet tables, the form to query at scale."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def mixes_json(mixes: str = "mixes"):
    """JSON of the mixes: an object for help, else a list of playlists and videos."""
    reason = F.concat(
        F.lit('{"help_reason":'), F.coalesce(F.to_json(F.array(F.col(f"{mixes}.help_reason"))), F.lit("[null]")), F.lit("}")
    )
    reason = F.regexp_replace(F.regexp_replace(reason, r":\[", ":"), r"\]\}$", "}")
    items = F.transform(
        f"{mixes}.items",
        lambda i: F.struct(
            F.when(i["kind"] == "playlist", i["id"]).alias("playlist"),
            F.when(i["kind"] == "video", i["id"]).alias("video"),
            i["note"].alias("note"),
        ),
    )
    return F.when(F.col(f"{mixes}.kind") == "help", reason).otherwise(F.to_json(items, _JSON))


def genre_docs(genres: DataFrame, mixes: DataFrame, ranked: DataFrame) -> DataFrame:
    """``(page, description, last_revision_date, mixes, top_artists)`` per genre.

    ``ranked`` holds at most ten artists per genre, so the list stays short.
    """
    top = ranked.groupBy(F.col("genre").alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "artist"))).alias("t")
    )
    return (
        genres.select("page", "description", F.col("revision").alias("last_revision_date"))
        .join(mixes.select("page", "mixes"), "page", "left")
        .join(top.select("page", F.col("t.artist").alias("top_artists")), "page", "left")
        .select(
            "page", "description", "last_revision_date", "mixes",
            F.coalesce("top_artists", F.array().cast("array<string>")).alias("top_artists"),
        )
    )


def write_genre_docs(docs: DataFrame, path: str) -> None:
    """JSON lines; ``mixes`` is left out where there are none."""
    when = F.date_format("last_revision_date", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = F.to_json(F.struct("page", "description", when.alias("last_revision_date"), "top_artists"), {"ignoreNullFields": "false"})
    mixes = F.when(F.col("mixes").isNotNull(), F.concat(F.lit(',"mixes":'), mixes_json(), F.lit("}"))).otherwise(F.lit("}"))
    docs.select(F.concat(F.regexp_replace(fields, r"\}$", ""), mixes).alias("value")).write.mode("overwrite").text(path)


def artist_docs(artists: DataFrame, ranked: DataFrame, genre_ids: DataFrame) -> DataFrame:
    """Documents of the artists that are in some genre's top ten."""
    shown = artists.join(ranked.select(F.col("artist").alias("page")), "page", "left_semi")
    ids = genre_ids.select(F.col("artist").alias("page"), "genres")
    return shown.select(
        "page", F.col("label").alias("name"), "description", F.col("revision").alias("last_revision_date")
    ).join(ids, "page", "left").withColumn("genres", F.coalesce("genres", F.array().cast("array<bigint>")))


def write_artist_docs(docs: DataFrame, path: str) -> None:
    when = F.date_format("last_revision_date", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    docs.withColumn("last_revision_date", when).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def link_ids(links: DataFrame, page_ids: DataFrame) -> DataFrame:
    """``(link, node_id)`` for every link whose page is a node."""
    return scale.lookup_join(links, page_ids, "page").select("link", "node_id")


def write_link_ids(ids: DataFrame, path: str) -> None:
    ids.write.mode("overwrite").json(path)
