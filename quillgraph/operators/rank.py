"""Ranking of artists per genre."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import names
from quillgraph.operators.links import lookup_links


def position_weight(position: Column, total: Column, dtype: str = "float") -> Column:
    """1 for a single entry, else ``0.1 + 0.9 * 0.5 ** (position / (total - 1))``."""
    step = position.cast(dtype) / F.nullif(total - 1, F.lit(0)).cast(dtype)
    decay = F.pow(F.lit(0.5), step.cast("double")).cast(dtype)
    weight = F.lit(0.1).cast(dtype) + F.lit(0.9).cast(dtype) * decay
    return F.coalesce(weight, F.lit(1.0).cast(dtype)).cast(dtype)


def weighted_links(artists: DataFrame, dtype: str = "float") -> DataFrame:
    """One row per link of an artist: ``(page, position, raw_link, weight)``.

    Position and total count unresolved links as well.
    """
    kept = [c for c in artists.columns if c != "genres"]
    return (
        artists.select(*kept, F.size("genres").alias("_total"), F.posexplode("genres").alias("position", "raw_link"))
        .withColumn("weight", position_weight(F.col("position"), F.col("_total"), dtype))
        .drop("_total")
    )


def artist_scores(
    artists: DataFrame, link_counts: DataFrame, links: DataFrame, dtype: str = "float"
) -> DataFrame:
    """``(genre, artist, score)``; two links to one genre add up.

    The link count joins before the explode, so the wide side of the big join
    carries two short columns and the sum is combined on the map side.
    """
    counted = artists.select("page", "genres").join(link_counts, "page", "left")
    weighted = weighted_links(counted, dtype).select(
        F.col("page").alias("artist"),
        "position",
        "raw_link",
        (F.coalesce("links", F.lit(0)).cast(dtype) * F.col("weight")).cast(dtype).alias("part"),
    )
    scored = lookup_links(weighted, "raw_link", links, spread=["artist", "position"])
    return (
        scored.groupBy(F.col("page").alias("genre"), "artist").agg(F.sum("part").cast(dtype).alias("score"))
    )


def artist_genres(artists: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct resolved genres per artist, one row each."""
    refs = artists.select(F.col("page").alias("artist"), F.posexplode("genres").alias("position", "raw_link"))
    found = lookup_links(refs, "raw_link", links, spread=["artist", "position"])
    return found.select("artist", F.col("page").alias("genre")).distinct()


def top_artists(scores: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best artists of each genre, with ``rank`` from 1.

    Spark limits each map task to ``k`` rows per genre before the shuffle, so a
    genre with a third of all artists costs no more than any other.
    """
    order = [F.desc("score"), *names.page_order("artist")]
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("genre").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)
