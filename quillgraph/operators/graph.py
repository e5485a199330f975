"""Graph queries on ``edges(src, dst, ty)``.

Hubs are the norm here, so no operator gathers a node's neighbours in one row,
but for lists that the square root of the links bounds, and every join on a node id splits the ids that hold very many edges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph import scale

# Fixed values of the review rule for derivative edges.
SUSPICIOUS_MIN_DEGREE = 15
SUSPICIOUS_RATIO = 5.0

# Steps of a found path put together in one job.
WALK_STEPS = 5

# A search looks for pairs without any path before both sides hold more open
# nodes than this, and than this share of the steps.
LARGE_LEVEL = 100_000
LEVEL_SHARE = 32

# Steps of each list that join nodes to parts before all steps are asked.
FEW = 2


def visible_edges(edges: DataFrame, types: list[int] | None = None) -> DataFrame:
    """Edges of the enabled types; all of them by default."""
    return edges if types is None else edges.filter(F.col("ty").isin(types))


def degree(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(node_id, degree)``: in plus out, parallel edges of other types count."""
    counted = (
        edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
        .groupBy("node_id")
        .agg(F.count(F.lit(1)).alias("degree"))
    )
    if nodes is None:
        return counted
    full = nodes.select("node_id").join(counted, "node_id", "left")
    return full.select("node_id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def max_degree(edges: DataFrame) -> DataFrame:
    """One row; 0 for a graph without edges."""
    return degree(edges).agg(F.coalesce(F.max("degree"), F.lit(0).cast("long")).alias("max_degree"))


def degree_scale(nodes: DataFrame) -> DataFrame:
    """Drawing size and saturation from ``degree``."""
    top = nodes.agg(F.max("degree").alias("m")).scalar()
    share = F.coalesce(F.try_divide(F.col("degree"), top), F.lit(0.0))
    return nodes.withColumn("size", 84.0 * (0.2 + share * 0.8)).withColumn("saturation", (share * 0.8 + 0.2) * 100.0)


def neighbour_sets(edges: DataFrame) -> DataFrame:
    """Undirected neighbours as distinct rows ``(node_id, neighbour)``; a pair is made distinct once and turned after that."""
    first = F.col("src").isNull() | (F.col("src") <= F.col("dst"))
    pairs = edges.select(
        F.when(first, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("b")
    ).distinct()
    both = F.array(
        F.struct(F.col("a").alias("node_id"), F.col("b").alias("neighbour")), F.struct(F.col("b").alias("node_id"), F.col("a").alias("neighbour"))
    )
    return pairs.select(F.explode(F.array_distinct(both)).alias("p")).select("p.*")


def neighbour_overlap(left: str, right: str) -> list:
    """Sizes of intersection and union of two small neighbour arrays."""
    return [
        F.size(F.array_intersect(left, right)).alias("common"),
        F.size(F.array_union(left, right)).alias("combined"),
    ]


def connections(edges: DataFrame, types: list[int] | None = None) -> DataFrame:
    """Neighbours of every node by type and direction, one row each.

    ``category`` is the display order: each type inbound, then outbound.
    """
    both = F.explode(
        F.array(
            F.struct(F.col("dst").alias("node_id"), (F.col("ty") * 2).cast("int").alias("category"),
                     F.lit("inbound").alias("direction"), F.col("src").alias("neighbour")),
            F.struct(F.col("src").alias("node_id"), (F.col("ty") * 2 + 1).cast("int").alias("category"),
                     F.lit("outbound").alias("direction"), F.col("dst").alias("neighbour")),
        )
    )
    return visible_edges(edges, types).select("ty", both.alias("c")).select("c.node_id", "c.category", "ty", "c.direction", "c.neighbour")


def immediate_neighbours(edges: DataFrame, nodes: DataFrame, types: list[int] | None = None) -> DataFrame:
    """For each node asked for: itself and both ends of its visible edges."""
    pairs = neighbour_sets(visible_edges(edges, types))
    wanted = nodes.select("node_id").distinct()
    near = scale.lookup_join(pairs, wanted, "node_id", "left_semi")
    return near.unionByName(wanted.select("node_id", F.col("node_id").alias("neighbour"))).distinct()


def edge_jaccard(edges: DataFrame) -> DataFrame:
    """Share of common neighbours of the two ends of each edge.

    Every linked pair points from its end of lower degree to the other one, so a
    node points to at most the square root of twice the pairs, and these lists
    alone travel: a common neighbour of two linked nodes closes a triangle, which
    is found once, from its lowest corner, and counts for its three sides.
    """
    edges = scale.cut(edges)
    first = F.col("src").isNull() | (F.col("src") <= F.col("dst"))
    linked = edges.select(
        F.when(first, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("b")
    )
    linked = scale.cut(linked.distinct())
    ways = F.array_distinct(F.array(F.struct(F.col("a").alias("node_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("node_id"), F.col("a").alias("other"))))
    # How many neighbours a node has, null included and not, and whether it is its own.
    degrees = linked.select(F.explode(ways).alias("w")).select("w.*").groupBy("node_id").agg(
        F.count(F.lit(1)).alias("d"), F.count("other").alias("known"), F.coalesce(F.max(F.expr("cast(node_id = other AS int)")), F.lit(0)).alias("loop")
    )
    degrees = scale.cut(degrees)
    hot = scale.cut(scale.heavy_of(degrees, "node_id", "d"))

    def told(end: str) -> DataFrame:
        return degrees.select(F.col("node_id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("d", "known", "loop")))

    near = scale.lookup_join(linked, told("a"), "a", heavy=hot.withColumnRenamed("node_id", "a"))
    near = scale.lookup_join(near, told("b"), "b", spread=["a"], heavy=hot.withColumnRenamed("node_id", "b"))
    up = F.col("d_a") <= F.col("d_b")
    own = F.when(F.col("a") == F.col("b"), F.col("known_a")).otherwise(F.col("loop_a") + F.col("loop_b"))
    near = scale.cut(near.select(
        F.when(up, F.col("a")).otherwise(F.col("b")).alias("low"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("high"),
        F.greatest("d_a", "d_b").alias("high_d"), (F.col("d_a") + F.col("d_b")).alias("both"), own.cast("long").alias("own"),
    ))
    lists = near.filter("low <> high").groupBy("low").agg(F.sort_array(F.collect_list(F.struct("high_d", "high"))).alias("l"))
    lists = scale.cut(lists.select("low", F.col("l.high").alias("later")))
    # Each node sends every node it points to those that come after.
    sent = lists.select("low", F.posexplode("later").alias("at", "high"), "later").filter(F.col("at") < F.size("later") - 1)
    sent = sent.select("low", "high", F.slice("later", F.col("at") + 2, F.size("later")).alias("rest"))
    there = lists.select(F.col("low").alias("high"), "later")
    met = scale.lookup_join(sent, there, "high", spread=["low"], heavy=hot.withColumnRenamed("node_id", "high"))
    met = met.select("low", "high", F.explode(F.array_intersect("rest", "later")).alias("top"))
    sides = F.array(*(F.struct(F.col(x).alias("low"), F.col(y).alias("high")) for x, y in (("low", "high"), ("low", "top"), ("high", "top"))))
    closed = met.select(F.explode(sides).alias("side")).groupBy("side.low", "side.high").agg(F.count(F.lit(1)).alias("closed"))
    common = F.coalesce("closed", F.lit(0)) + F.col("own")
    scored = near.join(closed, ["low", "high"], "left").select(
        F.least("low", "high").alias("a"),
        F.greatest("low", "high").alias("b"),
        F.coalesce(F.try_divide(common, F.col("both") - common), F.lit(0.0)).alias("jaccard"),
    )
    ends = edges.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    return ends.join(scored, ["a", "b"]).select("src", "dst", "ty", "jaccard")


def _shuffled(key: str):
    """Another order of 64-bit ids: xor and shift steps, each of them reversible."""
    key = F.col(key)
    for _ in range(2):
        key = key.bitwiseXOR(F.shiftleft(key, 13))
        key = key.bitwiseXOR(F.shiftrightunsigned(key, 7))
        key = key.bitwiseXOR(F.shiftleft(key, 17))
    return key


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node_id, component)``; a component is named by its smallest member.

    Each round every node points to its smallest neighbour, pointers are
    followed once more, and the graph is contracted to the nodes pointed to.
    Ids are shuffled anew for each round, so a chain of ascending ids shrinks
    as fast as any other graph.  The pointers of all rounds are put together
    from the last, smallest one back to the first.
    """
    links = edges.filter("src <> dst").select(_shuffled("src").alias("a"), _shuffled("dst").alias("b"))
    smaller = [F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")]
    pairs, n = scale.cut_counted(links.select(*smaller).distinct())
    steps: list[tuple[DataFrame, int]] = []
    while n > 0:
        both = pairs.select("u", "v").union(pairs.select("v", "u"))
        up = scale.cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        over = up.select(F.col("u").alias("m"), F.col("m").alias("mm"))
        found = scale.lookup_join(up, over, "m", stored=True)
        step, size = scale.cut_counted(found.select("u", _shuffled("mm").alias("root")))
        steps.append((step, size))
        hot = scale.cut(scale.heavy_keys(pairs, "v"))
        left = scale.lookup_join(pairs, step, "u", stored=True).select("v", F.col("root").alias("a"))
        there = step.select(F.col("u").alias("v"), F.col("root").alias("b"))
        right = scale.lookup_join(left, there, "v", heavy=hot)
        pairs, n = scale.cut_counted(right.filter("a <> b").select(*smaller).distinct())
    if not steps:
        return nodes.select("node_id", F.col("node_id").alias("component"))
    # A root is named by its key and the round that ended its component.
    whole = steps[-1][0].select("u", F.struct(F.lit(len(steps)).alias("round"), "root").alias("group"))
    for round_, (step, size) in reversed(list(enumerate(steps[:-1], 1))):
        later = whole.select(F.col("u").alias("root"), "group")
        joined = scale.lookup_join(step, later, "root", "left", stored=True)
        ended = F.struct(F.lit(round_).alias("round"), "root")
        whole = joined.select("u", F.coalesce("group", ended).alias("group"))
        whole = scale.cut(whole)
    keyed = nodes.select("node_id", _shuffled("node_id").alias("u")).join(whole, "u", "left")
    keyed, n = scale.cut_counted(keyed.select("node_id", "group"))
    names = keyed.filter("group is not null").groupBy("group").agg(F.min("node_id").alias("component"))
    named = scale.lookup_join(keyed, names, "group", "left", spread=["node_id"], stored=True)
    return named.select("node_id", F.coalesce("component", "node_id").alias("component"))


def component_sizes(components: DataFrame, isolated_up_to: int = 5) -> DataFrame:
    """Size of each node's component; small components count as isolated."""
    components, n = scale.cut_counted(components)
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    sized = scale.lookup_join(components, sizes, "component", stored=True)
    return sized.select("node_id", "component", "size", (F.col("size") <= isolated_up_to).alias("isolated"))


def reach_within(edges: DataFrame, starts: DataFrame, k: int = 2, types: list[int] | None = None) -> DataFrame:
    """Nodes within ``k`` steps of each start along outgoing visible edges.

    ``(start, node_id, distance, via_src, via_ty)``: the last two name the edge
    that reached the node first when every node visits its targets in id
    order, that is the edge at the end of the smallest shortest id sequence.
    """
    steps = visible_edges(edges, types).groupBy("src", "dst").agg(F.min("ty").alias("ty"))
    steps, heavy = scale.for_lookups(steps, "src", ["dst"])
    first = starts.select(
        F.col("start"),
        F.col("start").alias("node_id"),
        F.lit(0).alias("distance"),
        F.lit(None).cast("long").alias("via_src"),
        F.lit(None).cast("tinyint").alias("via_ty"),
        F.array(F.col("start")).alias("trail"),
    ).distinct()
    levels, frontier = [first], first
    for distance in range(1, k + 1):
        seen = scale.union_all(levels).select("start", "node_id")
        here = scale.copy_to_slots(frontier.select("start", F.col("node_id").alias("src"), "trail"), "src", heavy)
        reached = (
            here.join(steps, ["src", "_slot"])
            .groupBy("start", F.col("dst").alias("node_id"))
            .agg(F.min(F.struct("trail", "src", "ty")).alias("m"))
            .join(seen, ["start", "node_id"], "left_anti")
        )
        frontier, n = scale.cut_counted(
            reached.select(
                "start",
                "node_id",
                F.lit(distance).alias("distance"),
                F.col("m.src").alias("via_src"),
                F.col("m.ty").alias("via_ty"),
                F.concat("m.trail", F.array("node_id")).alias("trail"),
            )
        )
        levels.append(frontier)
        if n == 0:
            break
    return scale.union_all(levels).drop("trail")


def shortest_path(edges: DataFrame, pairs: DataFrame, types: list[int] | None = None) -> DataFrame:
    """``(source, target, hops, path)`` per distinct pair; nulls when unreachable.

    Among the shortest paths the smallest id sequence, which is also the one a
    queue-based search over id-ordered edges finds.

    Searches from both ends, always growing the side with fewer open nodes, so
    a pair at distance d costs two searches of about half that depth.  A pair
    is done when the two sides first share a node, or when one side runs dry.
    Before the sides grow large, pairs that no undirected path joins go.
    """
    return _shortest(_ways_of(edges, types), pairs)


@dataclass(frozen=True)
class _Ways:
    """The distinct steps of a graph, as lists placed for lookups from both ends, and their number."""

    size: int
    outward: tuple[DataFrame, DataFrame]
    inward: tuple[DataFrame, DataFrame]


def _ways_of(edges: DataFrame, types: list[int] | None) -> _Ways:
    steps, size = scale.cut_counted(visible_edges(edges, types).filter("src <> dst").select("src", "dst").distinct())
    return _Ways(size, scale.lists_for_lookups(steps, "src", "dst"), scale.lists_for_lookups(steps, "dst", "src"))


def _shortest(graph: _Ways, pairs: DataFrame) -> DataFrame:
    asked = scale.cut(pairs.select("source", "target").distinct())
    open_pairs = asked.filter("source <> target")

    none = F.lit(None).cast("long")
    forth = [scale.cut_counted(open_pairs.select(F.col("source").alias("end"), F.col("source").alias("node_id"), none.alias("next")).distinct())]
    back = [scale.cut_counted(open_pairs.select(F.col("target").alias("end"), F.col("target").alias("node_id"), none.alias("next")).distinct())]
    met: list[tuple[int, int, DataFrame]] = []
    # The pairs that are still searched: stored anew each round, so a pair costs as many rows as it has hops.
    waiting, n_waiting, sifted = open_pairs, forth[-1][1], False
    while n_waiting > 0 and forth[-1][1] > 0 and back[-1][1] > 0:
        if not sifted and min(forth[-1][1], back[-1][1]) > max(LARGE_LEVEL, graph.size // LEVEL_SHARE):
            waiting, n_waiting = scale.cut_counted(_joined_pairs(waiting, graph))
            sifted = True
            if n_waiting == 0:
                break
        if forth[-1][1] <= back[-1][1]:
            forth.append(_grow(forth, waiting.select(F.col("source").alias("end")).distinct(), graph.outward, "src", "dst"))
            alive, end = forth[-1][0], "source"
        else:
            back.append(_grow(back, waiting.select(F.col("target").alias("end")).distinct(), graph.inward, "dst", "src"))
            alive, end = back[-1][0], "target"
        here = forth[-1][0].select(F.col("end").alias("source"), "node_id")
        there = back[-1][0].select(F.col("end").alias("target"), "node_id")
        reach = here.join(waiting, "source")
        common, n = scale.cut_counted(reach.join(there, ["target", "node_id"]).select("source", "target", "node_id"))
        waiting = waiting.join(alive.select(F.col("end").alias(end)).distinct(), end, "left_semi")
        if n > 0:
            # Open pairs are at least this far apart: no earlier round joined them.
            apart = len(forth) + len(back) - 2
            met.append((len(forth) - 1, apart, common))
            waiting = waiting.join(common.select("source", "target").distinct(), ["source", "target"], "left_anti")
        waiting, n_waiting = scale.cut_counted(waiting.select("source", "target"))

    hops = [asked.filter("source = target").select("source", "target", F.lit(0).alias("hops"), F.lit(0).alias("onward"))]
    hops += [m.select("source", "target", F.lit(apart).alias("hops"), F.lit(level).alias("onward")).distinct() for level, apart, m in met]
    found = scale.cut(asked.join(scale.union_all(hops), ["source", "target"], "left"))
    onward = _mark_ways([level for level, _ in forth], met, graph.inward)
    return _walk(found, onward, [level for level, _ in back], max((apart - level for level, apart, _ in met), default=0))


def _parts(graph: _Ways, nodes: DataFrame) -> DataFrame:
    """``(node_id, component)`` of ``nodes``: ``connected_components`` that lets few steps travel.

    The first ``FEW`` steps of each list join most of a component.  All steps
    are asked once which parts they join, and these parts are joined in turn.
    """
    (rows, heavy), (inward, hot) = graph.outward, graph.inward
    few = rows.select("src", F.explode(F.slice("dst", 1, FEW)).alias("dst"))
    few = scale.cut(few.unionByName(inward.select(F.explode(F.slice("src", 1, FEW)).alias("src"), "dst")).distinct())
    every = few.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    first = scale.cut(connected_components(few, every))
    here = scale.copy_to_slots(first.select(F.col("node_id").alias("src"), F.col("component").alias("a")), "src", heavy)
    asked = here.join(rows, ["src", "_slot"]).select("src", "a", F.explode("dst").alias("dst"))
    there = first.select(F.col("node_id").alias("dst"), F.col("component").alias("b"))
    between = scale.lookup_join(asked, there, "dst", spread=["src"], heavy=hot).filter("a <> b")
    between = scale.cut(between.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    whole = connected_components(between, first.select(F.col("component").alias("node_id")).distinct())
    named = scale.cut(nodes.select("node_id").join(first.withColumnRenamed("component", "_part"), "node_id", "left"))
    last = whole.select(F.col("node_id").alias("_part"), "component")
    named = scale.lookup_join(named, last, "_part", "left", spread=["node_id"], stored=True)
    return named.select("node_id", F.coalesce("component", "node_id").alias("component"))


def _joined_pairs(pairs: DataFrame, graph: _Ways) -> DataFrame:
    """The pairs whose ends lie in one component: no other pair has a path, in either direction."""
    pairs = scale.cut(pairs)
    ends = pairs.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    parts = scale.cut(_parts(graph, ends))
    first = parts.select(F.col("node_id").alias("source"), F.col("component").alias("_first"))
    last = parts.select(F.col("node_id").alias("target"), F.col("component").alias("_last"))
    named = scale.lookup_join(scale.lookup_join(pairs, first, "source", stored=True), last, "target")
    return named.filter("_first = _last").select("source", "target")


def _grow(levels: list, active: DataFrame, steps: tuple, near: str, far: str) -> tuple[DataFrame, int]:
    """Next level of a search: new nodes per end and the smallest node they lead to."""
    rows, heavy = steps
    frontier, n = levels[-1]
    frontier = frontier.join(active, "end", "left_semi")
    here = scale.copy_to_slots(frontier.select("end", F.col("node_id").alias(near)), near, heavy)
    seen = scale.union_all([level for level, _ in levels]).select("end", "node_id")
    reached = (
        here.join(rows, [near, "_slot"])
        .select("end", near, F.explode(far).alias("node_id"))
        .groupBy("end", "node_id")
        .agg(F.min(near).alias("next"))
        .join(seen, ["end", "node_id"], "left_anti")
    )
    return scale.cut_counted(reached)


def _mark_ways(forth: list[DataFrame], met: list[tuple[int, int, DataFrame]], inward: tuple) -> list[DataFrame]:
    """``(source, target, node_id, next)`` on the way from a source to a meeting node, one table per step.

    Goes back from the meeting nodes over the levels the source has reached and
    keeps only nodes on a shortest path, each with its smallest next node.
    """
    rows, heavy = inward
    ways: list[DataFrame] = []
    for level in range(max((f for f, _, _ in met), default=0), 0, -1):
        fresh = [m.select("source", "target", "node_id") for f, _, m in met if f == level]
        if ways:
            fresh.append(ways[-1].select("source", "target", "node_id"))
        here = scale.copy_to_slots(scale.union_all(fresh).withColumnRenamed("node_id", "dst"), "dst", heavy)
        before = forth[level - 1].select(F.col("end").alias("source"), F.col("node_id").alias("src"))
        marked = scale.cut(
            here.join(rows, ["dst", "_slot"])
            .select("source", "target", "dst", F.explode("src").alias("src"))
            .groupBy("source", "target", "src")
            .agg(F.min("dst").alias("next"))
            .join(before, ["source", "src"], "left_semi")
            .select("source", "target", F.col("src").alias("node_id"), "next")
        )
        ways.append(marked)
    return ways[::-1]


def _walk(found: DataFrame, onward: list[DataFrame], back: list[DataFrame], longest: int) -> DataFrame:
    """Put the paths together: ``onward`` to the meeting node, then home over the levels of ``back``.

    A step reads only the rows of its own level and the paths that take it, so
    the whole walk reads as many rows as the paths have nodes.  Paths that meet
    at a node are joined to its one row; Spark splits such a node's paths.
    """
    path = F.when(F.col("hops").isNotNull(), F.array("source"))
    walk = found.withColumn("path", path).withColumn("at", F.col("source"))
    done = [walk.filter("hops is null or hops = 0")]
    walk, turned = walk.filter("hops > 0"), []
    to = F.col("next")
    longer = F.when(to.isNull(), F.col("path")).otherwise(F.concat("path", F.array("next")))
    columns = ["source", "target", "hops", "onward", longer.alias("path"), F.coalesce(to, "at").alias("at")]
    turned.append(walk.filter("onward = 0"))
    walk = walk.filter("onward > 0")
    for step, ways in enumerate(onward, 1):
        # A path that has arrived finds no next node and stays as it is.
        walk = walk.join(ways.withColumnRenamed("node_id", "at"), ["source", "target", "at"], "left").select(*columns)
        if step % WALK_STEPS == 0 or step == len(onward):
            walk = scale.cut(walk)
            turned.append(walk.filter(F.col("onward") <= step))
            walk = walk.filter(F.col("onward") > step)
    arrived = scale.union_all(turned)
    done.append(arrived.filter("hops = onward"))
    home = None
    for left in range(longest, 0, -1):
        start = arrived.filter(F.col("hops") - F.col("onward") == left)
        home = start if home is None else home.unionByName(start)
        level = back[left].select(F.struct(F.col("end").alias("target"), F.col("node_id").alias("at")).alias("here"), "next")
        home = home.withColumn("here", F.struct("target", "at")).join(level, "here").select(*columns)
        if left % WALK_STEPS == 0:
            home = scale.cut(home)
    if home is not None:
        done.append(home)
    return scale.union_all([d.select("source", "target", "hops", "path") for d in done])


def route_report(edges: DataFrame, pairs: DataFrame, types: list[int] | None = None) -> DataFrame:
    """Path per pair and, where there is none, the path the other way round.

    Both are null when source and target are the same.
    """
    asked = pairs.select("source", "target").distinct()
    ways = _ways_of(edges, types)
    there = scale.cut(_shortest(ways, asked.filter("source <> target")))
    missed = there.filter(F.col("path").isNull()).select(F.col("target").alias("source"), F.col("source").alias("target"))
    back = _shortest(ways, missed).select(
        F.col("target").alias("source"), F.col("source").alias("target"), F.col("path").alias("reverse_path")
    )
    found = there.select("source", "target", "path").join(back, ["source", "target"], "left")
    same = asked.filter("source = target").select(
        "source", "target", F.lit(None).cast("array<bigint>").alias("path"),
        F.lit(None).cast("array<bigint>").alias("reverse_path"),
    )
    return found.unionByName(same)


def path_edge_types(paths: DataFrame, edges: DataFrame, types: list[int] | None = None) -> DataFrame:
    """``(source, target, hop, src, dst, ty)``: smallest visible type of each hop."""
    hops = (
        paths.filter(F.size("path") > 1)
        .select("source", "target", "path", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("hop"))
        .select("source", "target", "hop", F.struct(
            F.element_at("path", F.col("hop")).alias("src"), F.element_at("path", F.col("hop") + 1).alias("dst")
        ).alias("ends"))
    )
    first = visible_edges(edges, types).groupBy(F.struct("src", "dst").alias("ends")).agg(F.min("ty").alias("ty"))
    typed = scale.lookup_join(hops, first, "ends", "left", spread=["source", "target", "hop"])
    return typed.select("source", "target", "hop", "ends.src", "ends.dst", "ty")


def suspicious_edges(
    edges: DataFrame, nodes: DataFrame, accepted: DataFrame | None = None, rejected: DataFrame | None = None
) -> DataFrame:
    """Derivative edges from a minor to a much better linked node, unreviewed.

    Only the targets at or above the degree floor join the edges, and the
    sources join what is left after that.
    """
    degrees = degree(edges)
    target = degrees.filter(F.col("degree") >= SUSPICIOUS_MIN_DEGREE).select(
        F.col("node_id").alias("dst"), F.col("degree").alias("dst_degree")
    )
    source = degrees.select(F.col("node_id").alias("src"), F.col("degree").alias("src_degree"))
    label = nodes.select("node_id", "label")
    derived = scale.cut(edges.filter("ty = 0"))
    hot = scale.cut(scale.heavy_keys(derived, "src"))
    hot_target = scale.cut(scale.heavy_keys(derived, "dst"))
    flagged = scale.lookup_join(scale.lookup_join(derived, target, "dst", heavy=hot_target), source, "src", heavy=hot).filter(
        (F.col("src_degree") < F.col("dst_degree"))
        & (F.col("dst_degree") / F.greatest("src_degree", F.lit(1)) >= SUSPICIOUS_RATIO)
    )
    named = scale.lookup_join(
        flagged, label.select(F.col("node_id").alias("dst"), F.col("label").alias("dst_label")), "dst",
        heavy=hot_target,
    )
    named = scale.lookup_join(named, label.select(F.col("node_id").alias("src"), F.col("label").alias("src_label")), "src", heavy=hot)
    for reviewed in (accepted, rejected):
        if reviewed is not None:
            named = named.join(reviewed, ["src_label", "dst_label", "ty"], "left_anti")
    ratio = F.col("dst_degree") / F.greatest("src_degree", F.lit(1))
    return named.select("src", "dst", "src_label", "src_degree", "dst_label", "dst_degree", ratio.alias("ratio"))
