"""From a dump to the published graph.

Stages that several later steps read are written once as parquet: processed
entities, links and aliases, link counts, scores.  Everything in between stays
lazy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import scale
from quillgraph.functions import names
from quillgraph.operators import build, extract, graph, hues, layout, links, rank, search
from quillgraph.sinks import documents as sink
from quillgraph.sinks import page_files
from quillgraph.sources import curation


# So many names of duplicate pages are told.
DUPLICATES_SHOWN = 20


@dataclass(frozen=True)
class DumpTables:
    """Inputs: ``pages(page_id, title, ts, text)``, link tables, mixes and meta."""

    pages: DataFrame
    linktargets: DataFrame
    pagelinks: DataFrame
    mixes: DataFrame
    meta: DataFrame
    domain: str


def build_graph(spark: SparkSession, dump: DumpTables, work: str, positions: DataFrame | None = None) -> dict[str, DataFrame]:
    """All published tables.  ``positions(page, x, y)`` are node places, if known.

    Small components then go to a ring around the rest, and all is scaled to
    the usual size; a node without a position starts at the origin.
    """
    curated = curation.curation_tables(spark)
    # The dump is read once: its classified pages are a small share of it.
    classified = extract.drop_namespaced(extract.classify_pages(dump.pages))
    ours = sink.write_stage(classified, f"{work}/classified", "kind")
    redirects = sink.write_stage(extract.read_redirects(ours, dump.domain), f"{work}/redirects")

    def entities(kind: str, process, renames: str) -> DataFrame:
        rows = process(ours.filter(F.col("kind") == kind))
        rows = extract.apply_renames(rows, curated[renames])
        found = sink.write_stage(extract.drop_ignored(rows, curated["ignored_pages"]), f"{work}/{kind}s")
        twice = extract.duplicate_pages(found).orderBy("page").limit(DUPLICATES_SHOWN).collect()
        if twice:
            raise ValueError(f"{kind} pages produced more than once: {', '.join(r['page'] for r in twice)}")
        return found

    genres = entities("genre", extract.process_genres, "genre_renames")
    artists = entities("artist", extract.process_artists, "artist_renames")
    artist_pages = ours.filter(F.col("kind") == "artist").select(F.col("title").alias("page"))

    pages = genres.select("page", F.lit(0).alias("rank")).unionByName(artists.select("page", F.lit(1).alias("rank")))
    resolved, aliases = links.resolve_redirects(pages, extract.resolved_only(redirects))
    resolved = sink.write_stage(resolved, f"{work}/links")
    aliases = sink.write_stage(aliases, f"{work}/aliases")

    tracked = links.tracked_pages(artist_pages, genres, aliases)
    targets = links.tracked_linktargets(dump.linktargets, tracked)
    counts = sink.write_stage(links.inbound_counts(dump.pagelinks, targets, tracked), f"{work}/link_counts")

    artist_links = links.aggregated_link_count(artists, aliases, counts)
    scores = sink.write_stage(rank.artist_scores(artists, artist_links, resolved), f"{work}/artist_scores")
    ranked = sink.write_stage(rank.top_artists(scores), f"{work}/top_artists")
    by_artist = rank.artist_genres(artists, resolved)

    nodes = sink.write_stage(build.assign_node_ids(genres), f"{work}/nodes")
    relations = build.reject_edges(build.relation_edges(nodes, resolved), curated["rejected_edges"])
    edges = sink.write_stage(build.edge_union(relations, build.heading_parent_edges(nodes)), f"{work}/edges")
    ids = build.page_ids(nodes)

    hue = hues.propagate_hues(nodes, edges)
    genre_links = links.aggregated_link_count(nodes, aliases, counts)
    node_rows = (
        nodes.select("node_id", "page", "label")
        .join(build.clean_aliases(nodes, aliases), "page", "left")
        .join(genre_links, "page", "left")
        .join(hue, "node_id", "left")
    )
    if positions is not None:
        node_rows = node_rows.join(sink.write_stage(_layout(nodes, edges, positions), f"{work}/layout"), "node_id", "left")
    else:
        node_rows = node_rows.withColumn("x", F.lit(0.0)).withColumn("y", F.lit(0.0))
    published = node_rows.select(
        "node_id", names.display_title("page", "label").alias("page_title"), "label", "aliases", "links", "x", "y", "hue"
    )
    return {
        "nodes": sink.write_stage(published, f"{work}/published_nodes"),
        "edges": edges,
        "meta": dump.meta.withColumn("max_degree", graph.max_degree(edges).scalar()),
        "genre_docs": sink.genre_docs(genres, dump.mixes, ranked),
        "artist_docs": sink.artist_docs(artists, ranked, build.artist_genre_ids(by_artist, ids)),
        "link_ids": sink.link_ids(resolved, ids),
    }


def _layout(nodes: DataFrame, edges: DataFrame, positions: DataFrame) -> DataFrame:
    """``(node_id, x, y)``: positions with the ring and the scale of the published graph."""
    placed = nodes.select("node_id", "page").join(positions.select("page", "x", "y"), "page", "left")
    points = placed.select("node_id", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    components = scale.cut(graph.component_sizes(graph.connected_components(edges, nodes)))
    return layout.normalize_layout(scale.cut(layout.isolated_ring(points, components)), components)


def write_all(tables: dict[str, DataFrame], out: str) -> None:
    sink.write_graph(tables["nodes"], tables["edges"], tables["meta"], f"{out}/graph")
    sink.write_graph_tables(tables["nodes"], tables["edges"], f"{out}/tables")
    sink.write_genre_docs(tables["genre_docs"], f"{out}/genres")
    sink.write_artist_docs(tables["artist_docs"], f"{out}/artists")
    page_files.write_genre_pages(tables["genre_docs"], f"{out}/pages/genres")
    page_files.write_artist_pages(tables["artist_docs"], f"{out}/pages/artists")
    sink.write_link_ids(tables["link_ids"], f"{out}/link_ids")
    index = search.build_search_index(tables["nodes"])
    index.write.mode("overwrite").parquet(f"{out}/search_index")
