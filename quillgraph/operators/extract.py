"""From raw dump pages to redirects and processed entities."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import names, text
from quillgraph.functions.wikitext import page_boxes

# Box template per kind, the substrings that select a page, and
# the parameters holding links.
BOX_TEMPLATE = {"genre": "infobox music genre", "artist": "infobox musical artist"}
PAGE_MARK = {"genre": "nfobox music genre", "artist": "nfobox musical artist"}
GENRE_LINKS = {
    "stylistic_origins": "stylistic_origins",
    "derivatives": "derivatives",
    "subgenres": "subgenres",
    "fusion_genres": "fusiongenres",
}
ARTIST_LINKS = {"genres": "genre"}


def classify_pages(pages: DataFrame, any_case_redirect: bool = False) -> DataFrame:
    """Keep redirects, genre and artist pages; ``kind`` says which."""
    head = F.upper(F.substring("text", 1, 9)) if any_case_redirect else F.col("text")
    kind = (
        F.when(head.startswith("#REDIRECT"), F.lit("redirect"))
        .when(F.col("text").contains(PAGE_MARK["genre"]), F.lit("genre"))
        .when(F.col("text").contains(PAGE_MARK["artist"]), F.lit("artist"))
    )
    return pages.withColumn("kind", kind).filter(F.col("kind").isNotNull())


def drop_namespaced(pages: DataFrame) -> DataFrame:
    """Drop entity pages outside the main namespace; redirects all stay."""
    return pages.filter((F.col("kind") == "redirect") | ~F.col("title").contains(":"))


def read_redirects(classified: DataFrame, domain: str) -> DataFrame:
    """``(title, target, error)`` of the redirect pages; see ``resolved_only``."""
    parsed = classified.filter(F.col("kind") == "redirect").select(
        "title", text.parse_redirect("text", F.lit(domain)).alias("r")
    )
    target = F.when(F.col("r.name").isNotNull(), names.page_format(F.col("r.name"), F.col("r.heading")))
    return parsed.select("title", target.alias("target"), F.col("r.error").alias("error"))


def resolved_only(redirects: DataFrame) -> DataFrame:
    return redirects.filter(F.col("error").isNull()).select("title", "target")


def extract_infobox(pages: DataFrame, kind: str) -> DataFrame:
    """One row per box: ``(title, ts, heading, ord, params, description)``.

    The scan is row-local: no shuffle, and only pages that passed the
    substring filter reach Python.
    """
    wanted = BOX_TEMPLATE[kind]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (title, ts, box["heading"], at, box["params"], box["description"])
                for title, ts, body in zip(batch["title"], batch["ts"], batch["text"])
                for at, box in enumerate(page_boxes(body, wanted))
            ]
            yield pd.DataFrame(rows, columns=["title", "ts", "heading", "ord", "params", "description"])

    ready = pages.filter(F.col("text").contains(PAGE_MARK[kind])).select(
        "title", "ts", text.clean_wikitext("text").alias("text")
    )
    return ready.mapInPandas(
        scan,
        "title string, ts timestamp, heading string, ord int, params map<string,string>, description string",
    )


def extract_lead(pages: DataFrame, kind: str) -> DataFrame:
    """Lead text of every entity on the pages."""
    boxes = extract_infobox(pages, kind)
    return boxes.select(names.page_format("title", "heading").alias("page"), "description")


def process_entities(boxes: DataFrame, links: dict[str, str]) -> DataFrame:
    """Name and unresolved link arrays of every box."""
    param = F.col("params")
    arrays = [
        F.coalesce(text.extract_links(F.try_element_at(param, F.lit(source))), F.array().cast("array<string>")).alias(
            target
        )
        for target, source in links.items()
    ]
    return boxes.select(
        names.page_format("title", "heading").alias("page"),
        "title",
        text.entity_name(F.try_element_at(param, F.lit("name")), "title").alias("label"),
        "description",
        F.col("ts").alias("revision"),
        *arrays,
    )


def process_genres(pages: DataFrame) -> DataFrame:
    return process_entities(extract_infobox(pages, "genre"), GENRE_LINKS)


def process_artists(pages: DataFrame) -> DataFrame:
    return process_entities(extract_infobox(pages, "artist"), ARTIST_LINKS)


def apply_renames(entities: DataFrame, renames: DataFrame) -> DataFrame:
    """Use the curated label unless the page was edited after the correction.

    ``renames(page, new_label, fixed_at)``: a rename without ``fixed_at`` always
    holds; one minute of leeway otherwise.  Matched on the page title, as the
    headings of a page share its rename.
    """
    patch = renames.select(F.col("page").alias("_page"), "new_label", "fixed_at")
    applies = F.col("_page").isNotNull() & (
        F.col("fixed_at").isNull() | (F.col("revision") + F.expr("interval 1 minute") < F.col("fixed_at"))
    )
    return (
        entities.join(patch, F.col("title") == F.col("_page"), "left")
        .withColumn("label", F.when(applies, F.col("new_label")).otherwise(F.col("label")))
        .drop("_page", "new_label", "fixed_at")
    )


def drop_ignored(entities: DataFrame, ignored: DataFrame) -> DataFrame:
    """Remove curated pages ``ignored(name, heading)``; headings may be null."""
    name, heading = names.page_name(entities["page"]), names.page_heading(entities["page"])
    same = (name == ignored["name"]) & heading.eqNullSafe(ignored["heading"])
    return entities.join(ignored, same, "left_anti")


def duplicate_pages(entities: DataFrame) -> DataFrame:
    """Pages produced more than once."""
    return entities.groupBy("page").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def relation_count(genres: DataFrame) -> DataFrame:
    """Number of links in the four relation arrays of each genre."""
    total = sum((F.size(c) for c in GENRE_LINKS), F.lit(0))
    return genres.withColumn("relations", total)
