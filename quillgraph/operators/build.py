"""Nodes and typed edges of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph import scale
from quillgraph.functions import names
from quillgraph.functions.names import EDGE_TYPES

# At most this many aliases per node, none longer than this.
MAX_ALIASES = 32
MAX_ALIAS_LENGTH = 60


def assign_node_ids(genres: DataFrame) -> DataFrame:
    """Dense 0-based ``node_id`` in page order."""
    return scale.with_dense_index(genres, names.page_order("page"), "node_id")


def root_fallback(nodes: DataFrame) -> DataFrame:
    """``(page, node_id)`` of every page name: its own node, else its first heading's.

    Ids follow page order and a page without heading sorts first, so the
    smallest id of a name is the one wanted.
    """
    return nodes.groupBy(names.root_page("page").alias("page")).agg(F.min("node_id").alias("node_id"))


def page_ids(nodes: DataFrame) -> DataFrame:
    """Ids of all node pages and of root pages known only by their headings."""
    headed = nodes.filter(names.page_heading("page").isNotNull()).select("page", "node_id")
    return headed.unionByName(root_fallback(nodes))


def relation_edges(genres: DataFrame, links: DataFrame) -> DataFrame:
    """Edges named by the four relation arrays, with the labels at both ends.

    ``genres`` carry ``node_id`` and ``label``.  Origins point into the page;
    derivatives, subgenres and fusions point out of it.  Links that lead to no
    genre or back to the page itself are dropped.
    """

    def arm(column: str, kind: str, inward: bool):
        return F.transform(
            column,
            lambda link: F.struct(
                F.lit(EDGE_TYPES[kind]).cast("tinyint").alias("ty"),
                F.lit(inward).alias("inward"),
                link.alias("raw_link"),
            ),
        )

    arms = F.concat(
        arm("stylistic_origins", "Derivative", True),
        arm("derivatives", "Derivative", False),
        arm("subgenres", "Subgenre", False),
        arm("fusion_genres", "FusionGenre", False),
    )
    refs = (
        genres.select(F.col("node_id").alias("here"), F.col("label").alias("here_label"), F.explode(arms).alias("r"))
        .select("here", "here_label", "r.*")
        .withColumn("link", F.lower("raw_link"))
    )
    targets = scale.lookup_join(links, genres.select("page", "node_id", "label"), "page").select(
        "link", F.col("node_id").alias("there"), F.col("label").alias("there_label")
    )
    found = scale.lookup_join(refs, targets, "link", spread=["here", "ty", "inward"]).filter("here <> there")

    def end(inward_column: str, outward_column: str):
        return F.when(F.col("inward"), F.col(inward_column)).otherwise(F.col(outward_column))

    return found.select(
        end("there", "here").alias("src"),
        end("here", "there").alias("dst"),
        "ty",
        end("there_label", "here_label").alias("src_label"),
        end("here_label", "there_label").alias("dst_label"),
    )


def reject_edges(edges: DataFrame, rejects: DataFrame) -> DataFrame:
    """Drop labelled edges a curator found wrong."""
    return edges.join(rejects.select("src_label", "dst_label", "ty"), ["src_label", "dst_label", "ty"], "left_anti")


def heading_parent_edges(nodes: DataFrame) -> DataFrame:
    """Subgenre edge from a page to each node under one of its headings."""
    headed = nodes.filter(names.page_heading("page").isNotNull()).select(
        names.root_page("page").alias("root"), F.col("node_id").alias("dst")
    )
    parents = root_fallback(nodes).select(F.col("page").alias("root"), F.col("node_id").alias("src"))
    subgenre = F.lit(EDGE_TYPES["Subgenre"]).cast("tinyint")
    return scale.lookup_join(headed, parents, "root").filter("src <> dst").select("src", "dst", subgenre.alias("ty"))


def edge_union(*parts: DataFrame) -> DataFrame:
    """Set of typed edges from all sources."""
    return scale.union_all([p.select("src", "dst", "ty") for p in parts]).distinct()


def first_alias(aliases: DataFrame) -> DataFrame:
    """Per page and normal form, the alias whose raw title sorts first.

    ``aliases(page, alias, shown, norm)``; pages with very many redirects are
    spread by normal form, and rows of one page and form, which differ in case,
    marks or qualifier only, stream past a plain minimum.
    """
    first = F.min(F.struct("alias", "shown"))
    return scale.finer(aliases, "page", "norm").groupBy("page", "norm").agg(first.alias("m")).select("page", "norm", F.col("m.shown").alias("shown"))


def clean_aliases(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(page, aliases)``: display-worthy aliases, shortest first, at most 32.

    The cap is part of the feature.  Spark keeps 32 rows per page in each map
    task, so the collected list never grows with the number of redirects.
    """
    shown = F.trim(names.strip_qualifier("alias"))
    usable = (
        aliases.select("page", "alias", shown.alias("shown"))
        .filter((F.col("shown") != "") & (F.char_length("shown") <= MAX_ALIAS_LENGTH))
        .withColumn("norm", names.normalize_text("shown"))
        .filter(F.col("norm") != "")
    )
    own = nodes.select("page", F.explode(F.array("label", "page")).alias("own")).select(
        "page", names.normalize_text("own").alias("norm")
    )
    kept = first_alias(usable).join(own, ["page", "norm"], "left_anti")
    shortest = Window.partitionBy("page").orderBy(F.octet_length("shown"), "shown")
    best = kept.withColumn("n", F.row_number().over(shortest)).filter(F.col("n") <= MAX_ALIASES)
    lists = best.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("n", "shown"))).alias("l"))
    lists = lists.select("page", F.col("l.shown").alias("aliases"))
    empty = F.array().cast("array<string>")
    return nodes.select("page").join(lists, "page", "left").select("page", F.coalesce("aliases", empty).alias("aliases"))


def attach_mixes(genres: DataFrame, mixes: DataFrame) -> DataFrame:
    """Add the mixes of each genre, null where there are none."""
    return genres.join(mixes.select("page", "mixes"), "page", "left")


def artist_genre_ids(artist_genres: DataFrame, ids: DataFrame) -> DataFrame:
    """``(artist, genres)``: sorted node ids; genres that are no node drop out.

    The list of one artist is bounded by the links in that artist's own box.
    """
    known = ids.select(F.col("page").alias("genre"), "node_id")
    mapped = scale.lookup_join(artist_genres, known, "genre")
    return mapped.groupBy("artist").agg(F.sort_array(F.collect_set("node_id")).alias("genres"))
