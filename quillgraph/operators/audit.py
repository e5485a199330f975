"""Checks on the published data; each returns the rows a person should look at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph import scale
from quillgraph.functions import names, text
from quillgraph.operators.extract import relation_count

# Fixed value: the one video that may be shared and is never checked.
EXEMPT_VIDEO = "dQw4w9WgXcQ"


def mix_items(mixes: DataFrame) -> DataFrame:
    """``(page, kind, id, note)``: the playlists and videos, without help rows."""
    return mixes.select("page", F.explode("mixes.items").alias("i")).select("page", "i.kind", "i.id", "i.note")


def _checked(items: DataFrame, exempt: str) -> DataFrame:
    return items.filter((F.col("kind") != "video") | (F.col("id") != exempt))


def page_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pages of ``a`` that are not in ``b``."""
    return a.select("page").distinct().join(b.select("page"), "page", "left_anti")


def missing_mixes(genres: DataFrame, mixes: DataFrame) -> DataFrame:
    """Genres without a mix file, in page order."""
    return page_difference(genres, mixes).orderBy(*names.page_order("page"))


def curation_worklist(genres: DataFrame, mixes: DataFrame) -> DataFrame:
    """Genres without a mix, those with most relations first."""
    open_ = relation_count(genres).join(mixes.select("page"), "page", "left_anti").select("page", "relations")
    return open_.orderBy(
        F.desc("relations"), names.page_name("page").desc(), names.page_heading("page").desc_nulls_last()
    )


def duplicate_mixes(items: DataFrame, exempt: str = EXEMPT_VIDEO) -> DataFrame:
    """Uses of a playlist or video that occurs more than once, one row each use."""
    uses = _checked(items, exempt).groupBy("kind", "id", "page").agg(F.count(F.lit(1)).alias("uses"))
    shared = uses.groupBy("kind", "id").agg(F.sum("uses").alias("total")).filter("total > 1")
    keyed = uses.select(F.struct("kind", "id").alias("mix"), "page", "uses")
    shared = shared.select(F.struct("kind", "id").alias("mix"), "total")
    found = scale.lookup_join(keyed, shared, "mix", spread=["page"])
    return found.select("mix.kind", "mix.id", "page", "uses", "total")


def audit_mix_status(items: DataFrame, status: DataFrame, exempt: str = EXEMPT_VIDEO) -> DataFrame:
    """``(page, kind, id, problem)`` for ids not found, not embeddable or not public.

    ``status(kind, id, embeddable, public)`` is the answer of the video service.
    """
    keyed = _checked(items, exempt).select(F.struct("kind", "id").alias("mix"), "page")
    answers = status.select(F.struct("kind", "id").alias("mix"), "embeddable", "public", F.lit(True).alias("found"))
    joined = scale.lookup_join(keyed, answers, "mix", "left", spread=["page"])
    problems = F.array_compact(
        F.array(
            F.when(F.col("found").isNull(), "missing"),
            F.when((F.col("mix.kind") == "video") & ~F.col("embeddable"), "not embeddable"),
            F.when(~F.col("public"), "not public"),
        )
    )
    return joined.select("page", "mix.kind", "mix.id", F.explode(problems).alias("problem"))


def used_templates(docs: DataFrame) -> DataFrame:
    """``(template, page)``: templates named in ``docs(page, text)``."""
    found = F.regexp_extract_all("text", F.lit(r"\{\{([^{}|]+)"), 1)
    named = F.filter(F.transform(found, text.template_name), lambda name: name != "")
    return docs.select("page", F.explode(F.array_distinct(named)).alias("template"))


def audit_templates(docs: DataFrame, template_dim: DataFrame) -> DataFrame:
    """``(template, page)`` for templates nobody has described yet, one row each."""
    uses = used_templates(docs).filter(
        ~F.col("template").startswith("defaultsort") & ~F.col("template").startswith("#expr:")
    )
    return scale.lookup_join(uses, template_dim.select(F.col("name").alias("template")), "template", "left_anti").distinct()


def link_targets_of(docs: DataFrame, link_ids: DataFrame) -> DataFrame:
    """``(page, position, link, node_id)``: links of a text that lead to a node."""
    refs = docs.select("page", F.posexplode(text.extract_links("text")).alias("position", "raw_link"))
    keyed = refs.withColumn("link", F.lower("raw_link"))
    return scale.lookup_join(keyed, link_ids, "link", spread=["page", "position"]).select(
        "page", "position", F.col("raw_link").alias("link"), "node_id"
    )


def attach_revision_docs(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Description and revision date of each node, by its display title."""
    title = F.coalesce("page_title", "label")
    return nodes.withColumn("_title", title).join(
        docs.withColumnRenamed("page", "_title"), "_title", "left"
    ).drop("_title")
