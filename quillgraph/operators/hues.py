"""Hues that follow the lineage of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph import scale
from quillgraph.operators.graph import degree

# Golden angle in degrees and the default settings.
GOLDEN_ANGLE = 137.507764
SEEDS, MAX_PASSES, TOLERANCE = 20, 50, 0.5


def weighted_circular_mean(hue: Column, weight: Column) -> Column:
    """Aggregate: direction of the weighted sum of unit vectors, in [0, 360)."""
    angle = F.radians(hue)
    mean = F.degrees(F.atan2(F.sum(weight * F.sin(angle)), F.sum(weight * F.cos(angle))))
    return F.pmod(mean, F.lit(360.0))


def spread_hue(rank: Column) -> Column:
    return F.pmod(rank * F.lit(GOLDEN_ANGLE), F.lit(360.0))


def hue_seeds(degrees: DataFrame, k: int = SEEDS) -> DataFrame:
    """The ``k`` nodes of highest degree with evenly spread hues; ties by node id."""
    top = degrees.orderBy(F.desc("degree"), "node_id").limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("degree"), "node_id")) - 1
    return top.withColumn("rank", rank).select("node_id", "rank", spread_hue(F.col("rank")).alias("hue"))


def propagate_hues(
    nodes: DataFrame, edges: DataFrame, seeds: int = SEEDS, max_passes: int = MAX_PASSES, tolerance: float = TOLERANCE
) -> DataFrame:
    """``(node_id, hue)``: every other node takes the mean of its parents.

    A pass updates all nodes at once.  Edges are joined to the degrees of their
    sources and split at hubs once; a pass moves one short row per edge and
    adds them up on the map side.
    """
    degrees = scale.cut(degree(edges, nodes))
    seeded = scale.cut(hue_seeds(degrees, seeds).select("node_id", "hue"))
    weight = degrees.select(F.col("node_id").alias("src"), F.col("degree").alias("weight"))
    pull = edges.join(seeded.select(F.col("node_id").alias("dst")), "dst", "left_anti")
    pull = scale.lookup_join(pull.select("src", "dst", "ty"), weight, "src", spread=["dst", "ty"])
    pull, heavy = scale.for_lookups(pull, "src", ["dst", "ty"])

    hues = seeded
    for _ in range(max_passes):
        parents = scale.copy_to_slots(hues.select(F.col("node_id").alias("src"), "hue"), "src", heavy)
        means = (
            pull.join(parents, ["src", "_slot"])
            .groupBy(F.col("dst").alias("node_id"))
            .agg(weighted_circular_mean(F.col("hue"), F.col("weight")).alias("new"))
        )
        turn = F.pmod(F.col("new") - F.col("hue"), F.lit(360.0))
        change = F.when(F.col("new").isNull(), 0.0).when(F.col("hue").isNull(), 360.0).otherwise(
            F.least(turn, 360.0 - turn)
        )
        moved = scale.cut(
            hues.join(means, "node_id", "full").select(
                "node_id", F.coalesce("new", "hue").alias("hue"), change.alias("change")
            )
        )
        hues = moved.select("node_id", "hue")
        if (moved.agg(F.max("change").alias("c")).first()["c"] or 0.0) < tolerance:
            break
    full = nodes.select("node_id").join(hues, "node_id", "left")
    return full.select("node_id", F.coalesce("hue", spread_hue(F.col("node_id"))).alias("hue"))
