"""Redirect closure, link lookup and inbound link counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph import scale
from quillgraph.functions import names


def resolve_redirects(pages: DataFrame, redirects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Follow redirects to a fixed point.

    ``pages(page[, rank])`` are the real entities, ``redirects(title, target)``
    the redirect pages.  Returns ``links(link, page)`` with lower-case links and
    ``aliases(page, alias)`` with the redirect titles in their own case.

    A link resolves in the round that is its number of steps from a page; per
    link the smallest title of its first round wins.  Real pages keep their own
    link.  Two pages that differ only in case: the higher ``rank``, then the
    later page.

    A link with one target is a pointer.  Pointers are doubled, so a chain of n
    redirects needs log n joins and a ring is known by the steps it has made.
    A link with several targets (titles that differ only in case) is a fork: no
    pointer goes past it, and the few forks are settled among themselves.
    """
    rank = F.col("rank") if "rank" in pages.columns else F.lit(0)
    heading = names.page_heading("page")
    latest = F.struct(rank, names.page_name("page"), heading.isNotNull(), F.coalesce(heading, F.lit("")), F.col("page"))
    found = scale.cut(pages.groupBy(F.lower("page").alias("link")).agg(F.max(latest).alias("m")).select("link", F.col("m.page").alias("page")))

    ways = redirects.groupBy(F.lower("title").alias("link"), F.lower("target").alias("to")).agg(F.min("title").alias("title"))
    ways = ways.filter(F.col("link").isNotNull() & F.col("to").isNotNull()).join(found, "link", "left_anti")
    ways = scale.cut(ways.withColumn("ways", F.count(F.lit(1)).over(Window.partitionBy("link"))))
    ends = _chase(ways.filter("ways = 1").select("link", "to"))
    settled = found.select(F.col("link").alias("end"), "page", F.lit(0).cast("long").alias("steps"))
    forks = _settle_forks(ways.filter("ways > 1"), ends, settled)

    reached = scale.lookup_join(ends, settled.unionByName(forks.select(F.col("link").alias("end"), "page", "steps")).select("end", "page"), "end", spread=["link"])
    titled = reached.select("link", "page").join(ways.filter("ways = 1").select("link", "title"), "link")
    aliased = scale.cut(titled.select("link", "page", "title").unionByName(forks.select("link", "page", "title")))
    return found.unionByName(aliased.select("link", "page")), aliased.select("page", F.col("title").alias("alias"))


def _chase(pointers: DataFrame) -> DataFrame:
    """``(link, end, steps)``: where each pointer ``link -> to`` leads in the end; links that run into a ring go.

    In round r every open pointer spans 2^r steps.  One that is still open when
    it has made more steps than there are pointers runs in a ring.
    """
    pointers, total = scale.cut_counted(pointers)
    known = pointers.select(F.col("link").alias("to"), F.lit(True).alias("more"))
    first = scale.lookup_join(pointers, known, "to", "left", spread=["link"], stored=True)
    jumps, _ = scale.cut_counted(first.select("link", "to", F.lit(1).cast("long").alias("steps"), F.col("more").isNull().alias("done")))
    finished, span = [jumps.filter("done")], 1
    active, n = jumps.filter("not done"), total
    while n and span <= total:
        table = scale.union_all([*finished, active])
        onward = table.select(F.col("link").alias("to"), F.col("to").alias("end"), F.col("steps").alias("further"), F.col("done").alias("ended"))
        joined = scale.lookup_join(active, onward, "to", spread=["link"], stored=True)
        moved = scale.cut(joined.select("link", F.col("end").alias("to"), (F.col("steps") + F.col("further")).alias("steps"), F.col("ended").alias("done")))
        finished = scale.merge_levels([*finished, moved.filter("done")])
        active, n = scale.cut_counted(moved.filter("not done"))
        span *= 2
    return scale.cut(scale.union_all(finished).select("link", F.col("to").alias("end"), "steps"))


def _settle_forks(ways: DataFrame, ends: DataFrame, settled: DataFrame) -> DataFrame:
    """``(link, page, title, steps)`` of the links with several targets: the fewest steps, then the smallest title."""
    ways, n = scale.cut_counted(ways.select("link", "to", "title"))
    none = settled.select(F.col("end").alias("link"), "page", F.lit("").alias("title"), "steps").limit(0)
    if n == 0:
        return none
    through = ends.select(F.col("link").alias("to"), "end", "steps")
    led = scale.lookup_join(ways, through, "to", "left", spread=["link", "title"], stored=True)
    led = scale.cut(led.select("link", "title", F.coalesce("end", "to").alias("end"), (F.coalesce("steps", F.lit(0)) + 1).alias("cost")))
    forks, before = none, None
    while True:
        known = settled.unionByName(forks.select(F.col("link").alias("end"), "page", "steps"))
        found = scale.lookup_join(led, known, "end", spread=["link", "title"], stored=True)
        best = F.min(F.struct((F.col("steps") + F.col("cost")).alias("steps"), "title", "page")).alias("m")
        forks = scale.cut(found.groupBy("link").agg(best).select("link", "m.page", "m.title", "m.steps"))
        mark = forks.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*forks.columns)).alias("x")).first()
        if mark == before:
            return forks
        before = mark


def lookup_links(rows: DataFrame, column: str, links: DataFrame, spread: list[str] | None = None) -> DataFrame:
    """Replace raw link text by the page it leads to; unresolved rows go."""
    keyed = rows.withColumn("link", F.lower(column))
    return scale.lookup_join(keyed, links, "link", spread=spread).drop("link")


def tracked_pages(artists: DataFrame, genres: DataFrame, aliases: DataFrame) -> DataFrame:
    """Titles whose inbound links are counted."""
    return (
        artists.select(F.col("page").alias("title"))
        .unionByName(genres.select(names.root_page("page").alias("title")))
        .unionByName(aliases.select(F.col("alias").alias("title")))
        .distinct()
    )


def tracked_linktargets(targets: DataFrame, tracked: DataFrame) -> DataFrame:
    """Link targets in the main namespace whose title is tracked."""
    return targets.filter(F.col("ns") == 0).join(tracked, "title", "left_semi").select("lt_id", "title")


def links_to_tracked(pagelinks: DataFrame, targets: DataFrame) -> DataFrame:
    """Single page links that lead to a tracked target.

    Other links go first, so only the few that stay are stored and counted for heavy keys.
    """
    named = targets.select(F.col("lt_id").alias("target_id"), "title")
    wanted = pagelinks.join(named.select("target_id"), "target_id", "left_semi")
    return scale.lookup_join(wanted, named, "target_id")


def inbound_counts(pagelinks: DataFrame, targets: DataFrame, tracked: DataFrame) -> DataFrame:
    """``(title, n)`` for every tracked title, 0 when nothing links to it.

    Links to other targets, nearly all of them, go before the count: the
    tracked ids are few.  Then links are counted per target id, so a target that
    a third of all links lead to crosses the network as one row per map task.
    """
    wanted = targets.select(F.col("lt_id").alias("target_id"))
    per_target = pagelinks.join(wanted, "target_id", "left_semi").groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))
    counted = (
        per_target.join(targets, per_target["target_id"] == targets["lt_id"])
        .groupBy("title")
        .agg(F.sum("n").alias("n"))
    )
    return tracked.join(counted, "title", "left").select("title", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def aggregated_link_count(pages: DataFrame, aliases: DataFrame, counts: DataFrame) -> DataFrame:
    """``(page, links)``: own count, if it is a root page, plus its aliases'."""
    own = pages.select("page").filter(names.page_heading("page").isNull()).withColumn("title", F.col("page"))
    via = scale.lookup_join(aliases, pages.select("page"), "page", "left_semi")
    via = via.select("page", F.col("alias").alias("title"))
    counted = own.unionByName(via).join(counts, "title").select("page", "n")
    # Every page is there once with nothing, so none is lost; no null title enters the join.
    none = pages.select("page", F.lit(0).cast("long").alias("n"))
    return counted.unionByName(none).groupBy("page").agg(F.sum("n").alias("links"))
