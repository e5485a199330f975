"""Graph queries, hues and layout tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check
from quillgraph.operators import graph, hues, layout

GRAPH_SQL = f"WITH {v.NODES_SQL}, {v.EDGES_SQL}, {v.DEGREE_SQL}"


def _ty(df):
    return df.withColumn("ty", F.col("ty").cast("int"))


@check("visible_edges", f"WITH {v.EDGES_SQL} SELECT src, dst, ty FROM edges WHERE ty IN (0, 2)")
def visible_edges(spark, sf):
    return _ty(graph.visible_edges(v.edges(spark, sf), [0, 2]))


@check("degree", f"{GRAPH_SQL} SELECT node_id, degree FROM degrees")
def degree(spark, sf):
    return graph.degree(v.edges(spark, sf), v.nodes(spark, sf))


@check("max_degree", f"{GRAPH_SQL} SELECT max(degree) AS max_degree FROM degrees")
def max_degree(spark, sf):
    return graph.max_degree(v.edges(spark, sf))


@check("degree_scale", f"""{GRAPH_SQL}, top AS (SELECT max(degree) AS m FROM degrees) SELECT node_id,
  round(84 * (0.2 + 0.8 * degree / m::DOUBLE), 6)::DOUBLE AS size, round((0.8 * degree / m::DOUBLE + 0.2) * 100, 6)::DOUBLE AS saturation FROM degrees, top""")
def degree_scale(spark, sf):
    sized = graph.degree_scale(graph.degree(v.edges(spark, sf), v.nodes(spark, sf)))
    return sized.select("node_id", F.round("size", 6).alias("size"), F.round("saturation", 6).alias("saturation"))


@check("neighbour_sets", f"WITH {v.EDGES_SQL}, {v.BOTH_SQL} SELECT node_id, neighbour FROM both_ways")
def neighbour_sets(spark, sf):
    return graph.neighbour_sets(v.edges(spark, sf))


@check("neighbour_overlap", """SELECT l_orderkey AS a, l_linenumber::BIGINT AS b, l_partkey AS c, l_suppkey AS d,
  len(list_intersect(list_distinct([l_partkey, l_suppkey, l_linenumber]), list_distinct([l_suppkey, l_quantity::BIGINT, l_orderkey % 100])))::BIGINT AS common,
  len(list_distinct([l_partkey, l_suppkey, l_linenumber, l_quantity::BIGINT, l_orderkey % 100]))::BIGINT AS combined FROM lineitem""")
def neighbour_overlap(spark, sf):
    lines = v.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("a"), F.col("l_linenumber").cast("long").alias("b"), F.col("l_partkey").alias("c"), F.col("l_suppkey").alias("d"),
        F.array("l_partkey", "l_suppkey", F.col("l_linenumber").cast("long")).alias("u"),
        F.array("l_suppkey", F.col("l_quantity").cast("long"), F.col("l_orderkey") % 100).alias("w"),
    )
    both = lines.select("a", "b", "c", "d", *graph.neighbour_overlap("u", "w"))
    return both.withColumn("common", F.col("common").cast("long")).withColumn("combined", F.col("combined").cast("long"))


@check("connections", f"""WITH {v.EDGES_SQL} SELECT dst AS node_id, ty * 2 AS category, ty, 'inbound' AS direction, src AS neighbour FROM edges
  UNION ALL SELECT src, ty * 2 + 1, ty, 'outbound', dst FROM edges""")
def connections(spark, sf):
    return _ty(graph.connections(v.edges(spark, sf)))


@check("immediate_neighbours", f"""WITH {v.EDGES_SQL}, {v.BOTH_SQL} SELECT node_id, neighbour FROM both_ways JOIN supplier ON node_id = s_suppkey
  UNION SELECT s_suppkey, s_suppkey FROM supplier""")
def immediate_neighbours(spark, sf):
    wanted = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node_id"))
    return graph.immediate_neighbours(v.edges(spark, sf), wanted)


@check("edge_jaccard", f"""WITH {v.EDGES_SQL}, {v.BOTH_SQL}, d AS (SELECT node_id, count(*) AS d FROM both_ways GROUP BY 1),
  c AS (SELECT src, dst, ty, count(b.node_id) AS common FROM edges JOIN both_ways a ON a.node_id = src LEFT JOIN both_ways b
    ON b.node_id = dst AND b.neighbour = a.neighbour GROUP BY 1, 2, 3)
  SELECT src, dst, ty, round(common / (s.d + t.d - common)::DOUBLE, 6)::DOUBLE AS jaccard FROM c JOIN d s ON s.node_id = src JOIN d t ON t.node_id = dst""")
def edge_jaccard(spark, sf):
    return _ty(graph.edge_jaccard(v.edges(spark, sf))).withColumn("jaccard", F.round("jaccard", 6))


@check("connected_components", f"WITH {v.COMPONENT_SQL} SELECT node_id, component FROM comp")
def connected_components(spark, sf):
    return graph.connected_components(v.order_edges(spark, sf), v.order_nodes(spark, sf))


def _components(spark, sf):
    return graph.component_sizes(connected_components(spark, sf))


@check("component_sizes", f"WITH {v.COMPONENT_SQL} SELECT node_id, component, size, size <= 5 AS isolated FROM comp")
def component_sizes(spark, sf):
    return _components(spark, sf)


def _levels(start: str, edges: str, depth: int) -> str:
    """CTEs of a plain level by level search that keeps the smallest id path."""
    out = [f"l0 AS ({start})"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT source, node FROM l{i}" for i in range(k))
        out.append(
            f"l{k} AS (SELECT n.* FROM (SELECT source, dst AS node, min(list_append(path, dst)) AS path FROM l{k - 1} JOIN {edges} "
            f"ON node = src GROUP BY 1, 2) n ANTI JOIN ({seen}) s ON s.source = n.source AND s.node = n.node)"
        )
    every = " UNION ALL ".join(f"SELECT source, node, path FROM l{i}" for i in range(depth + 1))
    return ", ".join(out) + f", ways AS ({every})"


STARTS_SQL = "SELECT DISTINCT s_suppkey AS source, s_suppkey AS node, [s_suppkey] AS path FROM supplier"


@check("reach_within", f"""WITH {v.EDGES_SQL}, {_levels(STARTS_SQL, 'edges', 2)}, first AS (SELECT src, dst, min(ty) AS ty FROM edges GROUP BY 1, 2)
  SELECT source AS start, node AS node_id, len(path) - 1 AS distance, path[-2] AS via_src, ty AS via_ty FROM ways
  LEFT JOIN first ON len(path) > 1 AND src = path[-2] AND dst = node""")
def reach_within(spark, sf):
    starts = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("start"))
    found = graph.reach_within(v.edges(spark, sf), starts, 2)
    return found.withColumn("via_ty", F.col("via_ty").cast("int")).withColumn("distance", F.col("distance").cast("long"))


PAIRS_SQL = "pairs AS (SELECT DISTINCT s_suppkey AS source, s_suppkey * 17 + s_nationkey AS target FROM supplier)"
PATH_SQL = f"""WITH {v.EDGES_SQL}, {PAIRS_SQL}, {_levels('SELECT DISTINCT source, source AS node, [source] AS path FROM pairs', 'edges', 7)},
  paths AS (SELECT p.source, p.target, path FROM pairs p LEFT JOIN ways w ON w.source = p.source AND w.node = p.target)"""


def _pairs(spark, sf):
    key = F.col("s_suppkey")
    return v.table(spark, sf, "supplier").select(key.alias("source"), (key * 17 + F.col("s_nationkey")).alias("target"))


def _joined(path):
    return F.array_join(F.transform(path, lambda n: n.cast("string")), ">")


@check("shortest_path", f"{PATH_SQL} SELECT source, target, len(path) - 1 AS hops, array_to_string(path, '>') AS path FROM paths")
def shortest_path(spark, sf):
    found = graph.shortest_path(v.edges(spark, sf), _pairs(spark, sf))
    return found.select("source", "target", F.col("hops").cast("long").alias("hops"), _joined("path").alias("path"))


@check("path_edge_types", f"""{PATH_SQL}, hops AS (SELECT source, target, unnest(generate_series(1, len(path) - 1)) AS hop, path FROM paths WHERE len(path) > 1)
  SELECT source, target, hop, path[hop] AS src, path[hop + 1] AS dst, min(ty) AS ty FROM hops JOIN edges ON src = path[hop] AND dst = path[hop + 1] GROUP BY ALL""")
def path_edge_types(spark, sf):
    edges = v.edges(spark, sf)
    typed = _ty(graph.path_edge_types(graph.shortest_path(edges, _pairs(spark, sf)), edges))
    return typed.withColumn("hop", F.col("hop").cast("long"))


@check("route_report", """WITH first AS (SELECT o_custkey, arg_min(o_orderkey, row(o_orderdate, o_orderkey)) AS k FROM orders GROUP BY 1),
  so_far AS (SELECT o_custkey, o_orderkey, list(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS way FROM orders)
  SELECT o_orderkey AS source, k AS target, NULL::VARCHAR AS path, CASE WHEN o_orderkey <> k THEN array_to_string(way, '>') END AS reverse_path
  FROM so_far JOIN first USING (o_custkey)""")
def route_report(spark, sf):
    """From every order to its customer's first: only the way back exists."""
    orders = v.table(spark, sf, "orders")
    first = orders.groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    pairs = orders.join(first, "o_custkey").select(F.col("o_orderkey").alias("source"), F.col("m.o_orderkey").alias("target"))
    found = graph.route_report(v.order_edges(spark, sf), pairs)
    return found.select("source", "target", _joined("path").alias("path"), _joined("reverse_path").alias("reverse_path"))


@check("weighted_circular_mean", """SELECT l_partkey AS node_id, round((degrees(atan2(sum(l_quantity * sin(radians(l_suppkey * 3.7::DOUBLE))),
  sum(l_quantity * cos(radians(l_suppkey * 3.7::DOUBLE))))) + 360) % 360, 4)::DOUBLE AS hue FROM lineitem GROUP BY 1""")
def weighted_circular_mean(spark, sf):
    mean = hues.weighted_circular_mean(F.col("l_suppkey") * 3.7, F.col("l_quantity"))
    return v.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("node_id")).agg(F.round(mean, 4).alias("hue"))


SEEDS_SQL = """seeds AS (SELECT node_id, rank, (rank * 137.507764::DOUBLE) % 360 AS hue FROM (
  SELECT node_id, row_number() OVER (ORDER BY degree DESC, node_id) - 1 AS rank FROM degrees) WHERE rank < 20)"""


@check("hue_seeds", f"{GRAPH_SQL}, {SEEDS_SQL} SELECT node_id, rank, round(hue, 6)::DOUBLE AS hue FROM seeds")
def hue_seeds(spark, sf):
    seeds = hues.hue_seeds(graph.degree(v.edges(spark, sf), v.nodes(spark, sf)))
    return seeds.select("node_id", F.col("rank").cast("long").alias("rank"), F.round("hue", 6).alias("hue"))


def _passes(n: int) -> str:
    """All passes one after the other; each stays as it was once a pass has changed nothing by half a degree."""
    out = ["h0 AS MATERIALIZED (SELECT node_id, hue, false AS still FROM seeds)"]
    for k in range(1, n + 1):
        out.append(
            f"m{k} AS MATERIALIZED (SELECT dst AS node_id, ((degrees(atan2(sum(degree * sin(radians(hue))), sum(degree * cos(radians(hue)))))) + 360) % 360 AS hue "
            f"FROM edges JOIN h{k - 1} h ON h.node_id = src JOIN degrees d ON d.node_id = src WHERE dst NOT IN (SELECT node_id FROM seeds) GROUP BY 1), "
            f"n{k} AS MATERIALIZED (SELECT node_id, CASE WHEN h.still THEN h.hue ELSE coalesce(m{k}.hue, h.hue) END AS hue, coalesce(h.still, false) AS still, "
            f"CASE WHEN m{k}.hue IS NULL THEN 0 WHEN h.hue IS NULL THEN 360 ELSE least((m{k}.hue - h.hue + 360) % 360, 360 - (m{k}.hue - h.hue + 360) % 360) END AS change "
            f"FROM h{k - 1} h FULL JOIN m{k} USING (node_id) WHERE m{k}.hue IS NULL OR h.node_id IS NOT NULL OR NOT (SELECT bool_or(still) FROM h{k - 1})), "
            f"h{k} AS MATERIALIZED (SELECT node_id, hue, (SELECT bool_or(still) OR max(change) < 0.5 FROM n{k}) AS still FROM n{k})"
        )
    return ", ".join(out)


@check("propagate_hues", f"""{GRAPH_SQL}, {SEEDS_SQL}, {_passes(hues.MAX_PASSES)} SELECT n.node_id, round(coalesce(hue, (n.node_id * 137.507764::DOUBLE) % 360), 4)::DOUBLE AS hue
  FROM nodes n LEFT JOIN h{hues.MAX_PASSES} USING (node_id)""")
def propagate_hues(spark, sf):
    found = hues.propagate_hues(v.nodes(spark, sf), v.edges(spark, sf))
    return found.withColumn("hue", F.round("hue", 4))


@check("close_pairs", f"""WITH {v.SUPPLIER_POINTS_SQL} SELECT a.node_id AS i, b.node_id AS j, round(sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)), 6)::DOUBLE AS dist
  FROM points a JOIN points b ON a.node_id < b.node_id AND pow(b.x - a.x, 2) + pow(b.y - a.y, 2) < 250 * 250 AND pow(b.x - a.x, 2) + pow(b.y - a.y, 2) >= 1e-9""")
def close_pairs(spark, sf):
    return layout.close_pairs(v.supplier_points(spark, sf), 250.0).withColumn("dist", F.round("dist", 6))


PLACED_SQL = f"{GRAPH_SQL}, {v.PART_POINTS_SQL}"


@check("layout_stats", f"""{PLACED_SQL}, lens AS (SELECT sqrt(pow(s.x - t.x, 2) + pow(s.y - t.y, 2)) AS len FROM edges JOIN placed s ON s.node_id = src JOIN placed t ON t.node_id = dst),
  base AS (SELECT count(*) AS nodes, min(x) AS x_min, max(x) AS x_max, stddev_pop(x) AS x_std, min(y) AS y_min, max(y) AS y_max, stddev_pop(y) AS y_std,
    false AS any_nan, false AS any_inf, max(degree) AS max_degree, count(*) FILTER (degree = 0) AS degree_0, count(*) FILTER (degree = 1) AS degree_1 FROM placed),
  shared AS (SELECT count(*) FILTER (n > 1) AS shared_positions FROM (SELECT count(*) AS n FROM placed GROUP BY floor(x * 10 + 0.5), floor(y * 10 + 0.5))),
  e AS (SELECT count(*) AS edges, min(len) AS edge_min, median(len) AS edge_median, avg(len) AS edge_mean, max(len) AS edge_max FROM lens),
  c AS (SELECT avg(x) AS core_x, avg(y) AS core_y, 2 * greatest(stddev_pop(x), stddev_pop(y)) AS core_radius FROM placed WHERE degree > 0)
  SELECT * FROM base, shared, e, c""")
def layout_stats(spark, sf):
    return layout.layout_stats(v.part_points(spark, sf), v.edges(spark, sf))


RING_SQL = f"""WITH {v.ORDER_POINTS_SQL}, {v.COMPONENT_SQL}, p AS (SELECT node_id, x, y, component, size, size <= 5 AS isolated FROM points JOIN comp USING (node_id)),
  core AS (SELECT coalesce(max(sqrt(x * x + y * y)), 0) AS r FROM p WHERE NOT isolated),
  ring AS (SELECT CASE WHEN r > 0 THEN r * 1.12 ELSE 100 END AS radius FROM core),
  slots AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS slot, count(*) OVER () AS n FROM (SELECT DISTINCT component FROM p WHERE isolated)),
  m AS (SELECT node_id, component, size, row_number() OVER (PARTITION BY component ORDER BY node_id) - 1 AS k FROM p WHERE isolated),
  a AS (SELECT node_id, radius * (1 + 0.06 * sin(pi() * (3 - sqrt(5)) * slot)) AS r, 2 * pi() * slot / n AS ang, 2 * pi() * k / size AS turn,
    CASE WHEN size > 1 THEN radius * 0.03 ELSE 0 END AS off FROM m JOIN slots USING (component), ring)"""


@check("isolated_ring", f"""{RING_SQL} SELECT node_id, round(r * cos(ang) + off * cos(turn), 4)::DOUBLE AS x, round(r * sin(ang) + off * sin(turn), 4)::DOUBLE AS y FROM a
  UNION ALL SELECT node_id, round(x, 4)::DOUBLE, round(y, 4)::DOUBLE FROM p WHERE NOT isolated""")
def isolated_ring(spark, sf):
    ring = layout.isolated_ring(v.order_points(spark, sf), _components(spark, sf))
    return ring.select("node_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@check("normalize_layout", f"""{RING_SQL}, rms AS (SELECT sqrt(avg(x * x + y * y)) AS rms FROM p WHERE NOT isolated)
  SELECT node_id, round(x * 850 / rms, 4)::DOUBLE AS x, round(y * 850 / rms, 4)::DOUBLE AS y FROM p, rms""")
def normalize_layout(spark, sf):
    scaled = layout.normalize_layout(v.order_points(spark, sf), _components(spark, sf))
    return scaled.select("node_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@check("top_degree_labels", f"""{PLACED_SQL}, c AS (SELECT avg(x) AS cx, avg(y) AS cy, greatest(stddev_pop(x), stddev_pop(y)) AS r FROM placed WHERE degree > 0)
  SELECT node_id, degree FROM placed, c WHERE abs(x - cx) < r AND abs(y - cy) < r ORDER BY degree DESC, node_id LIMIT 30""")
def top_degree_labels(spark, sf):
    return layout.top_degree_labels(v.part_points(spark, sf), 30, 1.0).select("node_id", "degree")
