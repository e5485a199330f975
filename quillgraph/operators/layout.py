"""Table-shaped parts of the layout: near pairs, rings, scaling, statistics."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph import scale

# Fixed values of the layout.
TARGET_RMS = 850.0
RING_FACTOR, EMPTY_RING, WOBBLE, CLUSTER = 1.12, 100.0, 0.06, 0.03
GOLDEN = math.pi * (3.0 - math.sqrt(5.0))
COINCIDENT = 1e-9


def close_pairs(points: DataFrame, d: float) -> DataFrame:
    """``(i, j, dist)``: all pairs closer than ``d`` that do not coincide.

    ``points(node_id, x, y)``.  Equal positions are folded first, so copies of
    one point are never compared.  Positions meet in grid cells of side ``d``;
    half of the eight cells around suffices, as a pair needs to meet once.  A
    quarter cell is smaller than ``d`` across, so a crowded cell yields a fixed
    share of real pairs; crowded cells are split over tasks.
    """
    cell = F.struct(F.floor(F.col("x") / d).alias("cx"), F.floor(F.col("y") / d).alias("cy"))
    places = points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).select("x", "y", cell.alias("cell"))
    places = scale.cut(places)
    heavy = scale.cut(scale.heavy_keys(places, "cell"))
    right = scale.split_rows(places, "cell", heavy).select("cell", "_slot", F.col("x").alias("x2"), F.col("y").alias("y2"))
    around = F.array(
        *[
            F.struct((F.col("cell.cx") + dx).alias("cx"), (F.col("cell.cy") + dy).alias("cy"))
            for dx, dy in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))
        ]
    )
    spread = places.select("x", "y", F.col("cell").alias("home"), F.explode(around).alias("cell"))
    left = scale.copy_to_slots(spread, "cell", heavy)
    gap = (F.col("x2") - F.col("x")) * (F.col("x2") - F.col("x")) + (F.col("y2") - F.col("y")) * (
        F.col("y2") - F.col("y")
    )
    once = (F.col("home") != F.col("cell")) | (F.struct("x", "y") < F.struct("x2", "y2"))
    near = (
        left.join(right, ["cell", "_slot"])
        .withColumn("gap", gap)
        .filter(once & (F.col("gap") < d * d) & (F.col("gap") >= COINCIDENT))
        .select("x", "y", "x2", "y2", F.sqrt("gap").alias("dist"))
    )
    # Many nodes may stand on one place: its rows are split, and the pairs of places repeated for each part.
    at = scale.cut(points.select(F.struct("x", "y").alias("place"), "node_id"))
    crowd = scale.cut(scale.heavy_keys(at, "place"))

    def nodes_at(pairs: DataFrame, x: str, y: str, name: str) -> DataFrame:
        left = scale.copy_to_slots(pairs.withColumn("place", F.struct(F.col(x).alias("x"), F.col(y).alias("y"))), "place", crowd)
        right = scale.split_rows(at, "place", crowd, ["node_id"]).withColumnRenamed("node_id", name)
        return left.join(right, ["place", "_slot"]).drop("place", "_slot")

    named = nodes_at(nodes_at(near, "x", "y", "a"), "x2", "y2", "b")
    return named.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "dist")


# Bits of a value that one counting round settles.
DIGIT = 16
SIGN_SHIFT, MAGNITUDE = 63, (1 << 63) - 1


def _ordered_bits(value: Column) -> Column:
    """A long that orders as the double does: both zeros alike, NaN last."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    return bits.bitwiseXOR(F.shiftright(bits, SIGN_SHIFT).bitwiseAND(F.lit(MAGNITUDE)))


def _value_of(key: int) -> float:
    bits = key ^ (MAGNITUDE if key < 0 else 0)
    return struct.unpack("<d", struct.pack("<q", bits))[0]


def exact_median(df: DataFrame, value: str) -> DataFrame:
    """One row with the exact median of the doubles of a column; nulls do not count, no value gives null.

    The values are never sorted.  A round counts the next ``DIGIT`` bits of the
    values that share the bits found so far with a middle one, so a task sends
    at most 2 x 65,536 counts, and the driver sees the two rows that hold the
    middle ranks.
    """
    doubles = df.select(F.col(value).cast("double").alias("value")).filter("value IS NOT NULL")
    keys, n = scale.cut_counted(doubles.select(_ordered_bits(F.col("value")).alias("key")))
    if n == 0:
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("median"))
    # Per middle rank: the leading bits found and the rank among the values that begin with them.
    sought = {rank: (None, rank) for rank in ((n - 1) // 2, n // 2)}
    for shift in range(64 - DIGIT, -1, -DIGIT):
        head = F.shiftright("key", shift)
        prefix = F.shiftright("key", shift + DIGIT) if shift + DIGIT < 64 else F.lit(0).cast("long")
        wanted = {found or 0 for found, _ in sought.values()}
        counts = keys.filter(prefix.isin(*wanted)).groupBy(prefix.alias("prefix"), head.alias("head")).agg(F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("prefix").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
        running = counts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
        holds = [
            (F.col("prefix") == (found or 0)) & (F.col("before") <= left) & (left < F.col("before") + F.col("n"))
            for found, left in sought.values()
        ]
        rows = running.filter(holds[0] | holds[-1]).collect()
        sought = {
            rank: next((r["head"], left - r["before"]) for r in rows if r["prefix"] == (found or 0) and 0 <= left - r["before"] < r["n"])
            for rank, (found, left) in sought.items()
        }
    middle = [_value_of(key) for key, _ in sought.values()]
    return df.sparkSession.range(1).select(F.lit((middle[0] + middle[-1]) / 2).alias("median"))


def core_window(points: DataFrame, sigma: float = 2.0) -> DataFrame:
    """One row: centroid of the linked nodes and ``sigma`` spreads around it."""
    return points.filter("degree > 0").agg(
        F.avg("x").alias("cx"),
        F.avg("y").alias("cy"),
        (sigma * F.greatest(F.stddev_pop("x"), F.stddev_pop("y"))).alias("radius"),
    )


def layout_stats(points: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of figures on ``points(node_id, x, y, degree)`` and its edges."""
    points = scale.cut(points.select("node_id", "x", "y", "degree"))
    bad = F.isnan("x") | F.isnan("y")
    endless = (F.abs("x") == float("inf")) | (F.abs("y") == float("inf"))
    base = points.agg(
        F.count(F.lit(1)).alias("nodes"),
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.stddev_pop("x").alias("x_std"),
        F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.stddev_pop("y").alias("y_std"),
        F.coalesce(F.bool_or(bad), F.lit(False)).alias("any_nan"),
        F.coalesce(F.bool_or(endless), F.lit(False)).alias("any_inf"),
        F.max("degree").alias("max_degree"),
        F.count_if(F.col("degree") == 0).alias("degree_0"),
        F.count_if(F.col("degree") == 1).alias("degree_1"),
    )
    tenths = [F.floor(F.col(c) * 10 + 0.5).alias(c) for c in ("x", "y")]
    shared = points.groupBy(*tenths).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("n"))

    lengths = scale.cut(edge_lengths(points, edges))
    span = lengths.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.min("length").alias("lo"), F.avg("length").alias("mid"), F.max("length").alias("hi"))
    ).scalar()
    core = core_window(points).select(F.struct("*")).scalar()
    median = exact_median(lengths, "length").scalar()
    return base.select(
        "*",
        shared.scalar().alias("shared_positions"),
        span.alias("s"), median.alias("edge_median"), core.alias("c"),
    ).select(
        *base.columns, "shared_positions",
        F.col("s.n").alias("edges"), F.col("s.lo").alias("edge_min"), "edge_median",
        F.col("s.mid").alias("edge_mean"), F.col("s.hi").alias("edge_max"),
        F.col("c.cx").alias("core_x"), F.col("c.cy").alias("core_y"), F.col("c.radius").alias("core_radius"),
    )


def edge_lengths(points: DataFrame, edges: DataFrame) -> DataFrame:
    """``(src, dst, ty, length)`` from the positions of both ends."""
    at = points.select("node_id", "x", "y")
    source = at.select(F.col("node_id").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    target = at.select(F.col("node_id").alias("dst"), F.col("x").alias("tx"), F.col("y").alias("ty_"))
    edges = scale.cut(edges.select("src", "dst", "ty"))
    hot = scale.cut(scale.heavy_keys(edges, "dst"))
    both = scale.lookup_join(scale.lookup_join(edges, source, "src", stored=True), target, "dst", heavy=hot)
    dx, dy = F.col("sx") - F.col("tx"), F.col("sy") - F.col("ty_")
    return both.select("src", "dst", "ty", F.sqrt(dx * dx + dy * dy).alias("length"))


def isolated_ring(points: DataFrame, components: DataFrame) -> DataFrame:
    """Put small components on a ring just outside the linked core.

    ``components(node_id, component, isolated)``; linked nodes stay put.  Slots
    are numbered by a range sort over the small components, and a member's
    place is counted within its own component of five nodes or fewer.
    """
    joined = points.select("node_id", "x", "y").join(
        components.select("node_id", "component", "isolated"), "node_id"
    )
    linked = joined.filter(~F.col("isolated"))
    core = linked.agg(F.coalesce(F.max(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))), F.lit(0.0)).alias("r"))
    radius = F.when(core.scalar() > 0, core.scalar() * RING_FACTOR).otherwise(F.lit(EMPTY_RING))

    small = joined.filter("isolated").select("node_id", "component")
    slots = scale.cut(
        scale.with_dense_index(small.select("component").distinct(), [F.col("component")], "slot")
    )
    n_slots = slots.agg(F.count(F.lit(1)).alias("n")).scalar()
    within = Window.partitionBy("component")
    members = small.select(
        "node_id", "component",
        (F.row_number().over(within.orderBy("node_id")) - 1).alias("k"),
        F.count(F.lit(1)).over(within).alias("size"),
    )
    angle = F.col("slot") * F.lit(2.0 * math.pi) / F.col("n_slots")
    anchor = F.col("radius") * (1.0 + WOBBLE * F.sin(F.lit(GOLDEN) * F.col("slot")))
    turn = F.col("k") * F.lit(2.0 * math.pi) / F.col("size")
    offset = F.when(F.col("size") > 1, F.col("radius") * CLUSTER).otherwise(0.0)
    placed = members.join(slots, "component").withColumn("radius", radius).withColumn("n_slots", n_slots)
    ring = placed.select(
        "node_id",
        (anchor * F.cos(angle) + offset * F.cos(turn)).alias("x"),
        (anchor * F.sin(angle) + offset * F.sin(turn)).alias("y"),
    )
    return linked.select("node_id", "x", "y").unionByName(ring)


def normalize_layout(points: DataFrame, components: DataFrame, target: float = TARGET_RMS) -> DataFrame:
    """Scale all points so the linked ones have the wanted RMS radius."""
    linked = points.join(components.filter(~F.col("isolated")).select("node_id"), "node_id", "left_semi")
    rms = linked.agg(F.sqrt(F.avg(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).alias("rms")).scalar()
    factor = F.when(rms > 1e-6, F.lit(target) / rms).otherwise(1.0)
    return points.withColumn("_f", factor).select(
        "node_id", (F.col("x") * F.col("_f")).alias("x"), (F.col("y") * F.col("_f")).alias("y")
    )


def top_degree_labels(points: DataFrame, n: int = 30, sigma: float = 2.0, limit_first: bool = False) -> DataFrame:
    """The ``n`` best linked nodes inside the core window.

    With ``limit_first`` the window is applied to the overall top ``n``.
    """
    core = core_window(points, sigma).select(F.struct("*")).scalar()
    inside = (F.abs(F.col("x") - F.col("_c.cx")) < F.col("_c.radius")) & (
        F.abs(F.col("y") - F.col("_c.cy")) < F.col("_c.radius")
    )
    best = [F.desc("degree"), F.col("node_id")]
    framed = points.withColumn("_c", core)
    if limit_first:
        return framed.orderBy(*best).limit(n).filter(inside).drop("_c")
    return framed.filter(inside).orderBy(*best).limit(n).drop("_c")
