import itertools
import math
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import build, graph, hues, layout
from quillgraph.sources import curation


def _edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, ty byte")


def _nodes(spark, n):
    return spark.range(n).withColumnRenamed("id", "node_id")


def _random_edges(seed, n, m, hub=True):
    rng = random.Random(seed)
    rows = {(rng.randrange(n), rng.randrange(n), rng.randrange(3)) for _ in range(m)}
    if hub:
        rows |= {(0, i, 0) for i in range(1, n // 2)} | {(i, 1, 1) for i in range(2, n // 3)}
    return sorted(r for r in rows if r[0] != r[1])


def _paths(rows, source, types=(0, 1, 2)):
    out = defaultdict(list)
    for s, d, t in rows:
        if t in types:
            out[s].append(d)
    best, queue = {source: [source]}, deque([source])
    while queue:
        at = queue.popleft()
        for d in sorted(set(out[at])):
            if d not in best:
                best[d] = best[at] + [d]
                queue.append(d)
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_and_reach_match_a_queue_search(spark, tiny_heavy, seed):
    rows = _random_edges(seed, 40, 45)
    edges = _edges(spark, rows)
    pairs = [(s, t) for s in (0, 3, 7, 11) for t in range(0, 40, 3)]
    asked = spark.createDataFrame(pairs + pairs[:3], "source long, target long")
    got = {(r.source, r.target): r.path for r in graph.shortest_path(edges, asked).collect()}
    want = {(s, t): _paths(rows, s).get(t) for s, t in pairs}
    assert got == want

    starts = spark.createDataFrame([(0,), (3,), (7,)], "start long")
    reach = {(r.start, r.node_id): (r.distance, r.via_src) for r in graph.reach_within(edges, starts, 2).collect()}
    want = {
        (s, n): (len(p) - 1, p[-2] if len(p) > 1 else None) for s in (0, 3, 7) for n, p in _paths(rows, s).items() if len(p) <= 3
    }
    assert reach == want


def test_path_examples(spark):
    edges = _edges(spark, [(0, 1, 0), (1, 2, 0), (2, 3, 0), (0, 2, 0), (5, 6, 1), (6, 7, 0)])
    asked = spark.createDataFrame([(0, 3), (3, 0), (0, 9), (4, 4), (5, 7)], "source long, target long")
    got = {(r.source, r.target): (r.hops, r.path) for r in graph.shortest_path(edges, asked).collect()}
    assert got == {(0, 3): (2, [0, 2, 3]), (3, 0): (None, None), (0, 9): (None, None), (4, 4): (0, [4]), (5, 7): (2, [5, 6, 7])}
    hidden = {(r.source, r.target): r.path for r in graph.shortest_path(edges, asked, [0, 2]).collect()}
    assert hidden[(5, 7)] is None
    report = {(r.source, r.target): (r.path, r.reverse_path) for r in graph.route_report(edges, asked).collect()}
    assert report[(3, 0)] == (None, [0, 2, 3]) and report[(0, 3)] == ([0, 2, 3], None)
    assert report[(4, 4)] == (None, None) and report[(0, 9)] == (None, None)
    parallel = edges.union(_edges(spark, [(0, 2, 2), (2, 3, 1)]))
    hops = graph.path_edge_types(graph.shortest_path(parallel, asked), parallel, [1, 2, 0]).orderBy("source", "hop").collect()
    assert [(r.src, r.dst, r.ty) for r in hops] == [(0, 2, 0), (2, 3, 0), (5, 6, 1), (6, 7, 0)]


def test_empty_path_request(spark):
    asked = spark.createDataFrame([], "source long, target long")
    assert graph.shortest_path(_edges(spark, [(0, 1, 0)]), asked).count() == 0


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_components(spark, tiny_heavy, seed):
    rows = _random_edges(seed, 60, 25, hub=seed == 5) + [(i, i + 1, 0) for i in range(60, 75)]
    n = 80
    name = list(range(n))

    def find(a):
        while name[a] != a:
            a = name[a]
        return a

    for s, d, _ in rows:
        a, b = sorted((find(s), find(d)))
        name[b] = a
    got = {r.node_id: r.component for r in graph.connected_components(_edges(spark, rows), _nodes(spark, n)).collect()}
    assert got == {i: find(i) for i in range(n)}
    sizes = {r.node_id: (r.size, r.isolated) for r in graph.component_sizes(graph.connected_components(_edges(spark, rows), _nodes(spark, n))).collect()}
    counts = defaultdict(int)
    for i in range(n):
        counts[find(i)] += 1
    assert sizes == {i: (counts[find(i)], counts[find(i)] <= 5) for i in range(n)}


def test_components_without_edges(spark):
    got = graph.connected_components(_edges(spark, [(1, 1, 0)]), _nodes(spark, 3)).collect()
    assert sorted(tuple(r) for r in got) == [(0, 0), (1, 1), (2, 2)]


@pytest.mark.parametrize("seed", [6, 7])
def test_jaccard(spark, tiny_heavy, seed):
    rows = _random_edges(seed, 30, 80)
    near = defaultdict(set)
    for s, d, _ in rows:
        near[s].add(d)
        near[d].add(s)
    want = {(s, d, t): len(near[s] & near[d]) / len(near[s] | near[d]) for s, d, t in rows}
    got = {(r.src, r.dst, r.ty): r.jaccard for r in graph.edge_jaccard(_edges(spark, rows)).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_jaccard_of_loops_and_nulls(spark, tiny_heavy):
    rows = [(1, 1, 0), (1, 2, 0), (2, 3, 0), (3, 1, 1), (2, 2, 0), (4, 4, 0), (4, None, 0), (None, 3, 0)]
    got = {(r.src, r.dst, r.ty): r.jaccard for r in graph.edge_jaccard(_edges(spark, rows)).collect()}
    # Neighbours: 1 {1,2,3}, 2 {1,2,3}, 3 {1,2,null}, 4 {4,null}; the edges with a null end meet the loop of the other one.
    assert got == {(1, 1, 0): 1.0, (1, 2, 0): 1.0, (2, 3, 0): pytest.approx(2 / 4), (3, 1, 1): pytest.approx(2 / 4), (2, 2, 0): 1.0, (4, 4, 0): pytest.approx(1 / 3), (4, None, 0): pytest.approx(1 / 3)}


def test_jaccard_sends_no_neighbours_of_leaves(spark):
    """Two linked hubs with shared leaves: a leaf sends one neighbour, a hub none (the hubs' lists crossed whole before)."""
    rows = [(0, 1, 0)] + [(h, leaf, 0) for h in (0, 1) for leaf in range(2, 40)]
    scored = graph.edge_jaccard(_edges(spark, rows))
    got = {(r.src, r.dst): r.jaccard for r in scored.collect()}
    assert got[(0, 1)] == pytest.approx(38 / 40) and got[(0, 2)] == pytest.approx(1 / 40)
    assert "slice(later" in scored._jdf.queryExecution().simpleString()


def test_paths_drop_pairs_of_other_components(spark, monkeypatch):
    """Two separate grids: a pair across them is dropped by its component, the others keep their paths."""
    monkeypatch.setattr(graph, "LARGE_LEVEL", 0)
    monkeypatch.setattr(graph, "LEVEL_SHARE", 1_000)
    rows = [(i, i + 1, 0) for i in range(4)] + [(i, i + 1, 0) for i in range(10, 14)]
    dropped, whole = [], graph._joined_pairs
    monkeypatch.setattr(graph, "_joined_pairs", lambda pairs, steps: dropped.append(pairs.count() - (kept := whole(pairs, steps)).count()) or kept)
    asked = spark.createDataFrame([(0, 4), (0, 14), (10, 13), (13, 10), (2, 2)], "source long, target long")
    got = {(r.source, r.target): r.path for r in graph.shortest_path(_edges(spark, rows), asked).collect()}
    assert got == {(0, 4): [0, 1, 2, 3, 4], (0, 14): None, (10, 13): [10, 11, 12, 13], (13, 10): None, (2, 2): [2]}
    assert dropped == [1]


def test_degree_and_neighbours(spark, tiny_heavy):
    edges = _edges(spark, [(0, 1, 0), (0, 1, 2), (2, 0, 1), (3, 0, 1), (4, 0, 0)])
    got = {r.node_id: r.degree for r in graph.degree(edges, _nodes(spark, 6)).collect()}
    assert got == {0: 5, 1: 2, 2: 1, 3: 1, 4: 1, 5: 0}
    assert graph.max_degree(edges).first()[0] == 5 and graph.max_degree(_edges(spark, [])).first()[0] == 0
    sized = {r.node_id: (r.size, r.saturation) for r in graph.degree_scale(graph.degree(edges, _nodes(spark, 6))).collect()}
    assert sized[0] == (pytest.approx(84.0), pytest.approx(100.0)) and sized[5] == (pytest.approx(16.8), pytest.approx(20.0))
    assert graph.neighbour_sets(edges).count() == 8
    rows = [tuple(r) for r in graph.connections(edges).filter("node_id = 0").orderBy("category", "neighbour").collect()]
    assert rows == [
        (0, 0, 0, "inbound", 4), (0, 1, 0, "outbound", 1), (0, 2, 1, "inbound", 2), (0, 2, 1, "inbound", 3), (0, 5, 2, "outbound", 1),
    ]
    near = graph.immediate_neighbours(edges, _nodes(spark, 6).filter("node_id in (0, 5)"), [0]).collect()
    assert sorted(tuple(r) for r in near) == [(0, 0), (0, 1), (0, 4), (5, 5)]
    both = spark.createDataFrame([([1, 2, 3], [2, 3, 4, 5])], "a array<int>, b array<int>")
    assert tuple(both.select(*graph.neighbour_overlap("a", "b")).first()) == (2, 5)


def test_suspicious(spark, tiny_heavy):
    rows = [(i, 0, 0) for i in range(1, 16)] + [(20, 1, 0), (1, 21, 1), (22, 1, 2)]
    nodes = _nodes(spark, 30).withColumn("label", F.concat(F.lit("n"), "node_id"))
    flagged = graph.suspicious_edges(_edges(spark, rows), nodes)
    assert sorted(r.src for r in flagged.collect()) == list(range(2, 16))
    reviewed = spark.createDataFrame([("n2", "n0", 0)], "src_label string, dst_label string, ty byte")
    assert graph.suspicious_edges(_edges(spark, rows), nodes, reviewed, curation.curation_tables(spark)["rejected_edges"]).count() == 13


def _mean(pairs):
    s = sum(w * math.sin(math.radians(h)) for h, w in pairs)
    c = sum(w * math.cos(math.radians(h)) for h, w in pairs)
    return math.degrees(math.atan2(s, c)) % 360


def test_hues(spark, tiny_heavy):
    hue = spark.createDataFrame([(350.0, 1.0), (10.0, 1.0)], "h double, w double")
    mean = hue.agg(hues.weighted_circular_mean(F.col("h"), F.col("w")).alias("m")).first()["m"]
    assert mean < 1e-6 or mean > 360 - 1e-6
    lone = {r.node_id: r.hue for r in hues.propagate_hues(_nodes(spark, 5), _edges(spark, [])).collect()}
    assert len({round(h, 2) for h in lone.values()}) == 5
    chain = _edges(spark, [(0, 1, 0), (1, 2, 0), (2, 3, 0)])
    # degrees 1, 2, 2, 1: node 1 is the only seed, node 0 has no parent
    got = {r.node_id: r.hue for r in hues.propagate_hues(_nodes(spark, 4), chain, seeds=1).collect()}
    assert got[1] == got[2] == got[3] == 0.0 and got[0] == 0.0
    blend = _edges(spark, [(0, 2, 0), (0, 3, 0), (0, 4, 0), (0, 5, 0), (1, 5, 0), (1, 6, 0)])
    got = {r.node_id: r.hue for r in hues.propagate_hues(_nodes(spark, 7), blend, seeds=2).collect()}
    assert got[5] == pytest.approx(_mean([(0.0, 4.0), (137.507764, 2.0)])) and got[6] == pytest.approx(137.507764)


def test_close_pairs_match_brute_force(spark, tiny_heavy):
    rng = random.Random(8)
    rows = [(i, rng.choice([rng.uniform(-9, 9), 0.25]), rng.choice([rng.uniform(-9, 9), 0.5])) for i in range(120)]
    rows += [(200 + i, 1.0, 1.0) for i in range(10)]
    points = spark.createDataFrame(rows, "node_id long, x double, y double")
    got = {(r.i, r.j): r.dist for r in layout.close_pairs(points, 1.3).collect()}
    want = {}
    for (a, ax, ay), (b, bx, by) in itertools.combinations(rows, 2):
        gap = (bx - ax) ** 2 + (by - ay) ** 2
        if 1e-9 <= gap < 1.3 * 1.3:
            want[(a, b)] = math.sqrt(gap)
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_layout_figures(spark):
    points = spark.createDataFrame(
        [(0, 0.0, 0.0, 2), (1, 3.0, 4.0, 1), (2, -3.0, 0.0, 1), (3, 0.01, 0.02, 0)], "node_id long, x double, y double, degree long"
    )
    edges = _edges(spark, [(0, 1, 0), (2, 0, 1)])
    row = layout.layout_stats(points, edges).first()
    assert (row.nodes, row.edges, row.max_degree, row.degree_0, row.degree_1, row.shared_positions) == (4, 2, 2, 1, 2, 1)
    assert (row.edge_min, row.edge_median, row.edge_mean, row.edge_max) == (3.0, 4.0, 4.0, 5.0)
    assert not row.any_nan and not row.any_inf and row.core_x == 0.0
    labels = layout.top_degree_labels(points, 2, 1.0).collect()
    assert [r.node_id for r in labels] == [0, 3]
    assert [r.node_id for r in layout.top_degree_labels(points, 3, 2.0, limit_first=True).collect()] == [0, 1, 2]


def test_ring_and_scale(spark):
    points = spark.createDataFrame([(i, float(i), 0.0) for i in range(10)], "node_id long, x double, y double")
    comps = spark.createDataFrame(
        [(i, 0, False) for i in range(6)] + [(6, 6, True), (7, 7, True), (8, 7, True), (9, 9, True)],
        "node_id long, component long, isolated boolean",
    )
    got = {r.node_id: (r.x, r.y) for r in layout.isolated_ring(points, comps).collect()}
    ring, golden = 5 * 1.12, math.pi * (3 - math.sqrt(5))
    for node, slot, k, size in ((6, 0, 0, 1), (7, 1, 0, 2), (8, 1, 1, 2), (9, 2, 0, 1)):
        r = ring * (1 + 0.06 * math.sin(golden * slot))
        a, b = 2 * math.pi * slot / 3, 2 * math.pi * k / size
        off = ring * 0.03 if size > 1 else 0
        assert got[node] == (pytest.approx(r * math.cos(a) + off * math.cos(b)), pytest.approx(r * math.sin(a) + off * math.sin(b)))
    assert got[5] == (5.0, 0.0)
    scaled = {r.node_id: r.x for r in layout.normalize_layout(points, comps).collect()}
    assert scaled[9] == pytest.approx(9 * 850 / math.sqrt(sum(i * i for i in range(6)) / 6))
    all_iso = comps.withColumn("isolated", F.lit(True))
    assert layout.isolated_ring(points, all_iso).agg(F.max(F.abs("x"))).first()[0] <= 106
    assert layout.normalize_layout(points, all_iso).agg(F.max("x")).first()[0] == 9.0


def _genres(spark):
    return spark.createDataFrame(
        [
            ("B", "Bee", ["A"], ["b", "D#h"], [], ["nowhere"]), ("A", "Aye", [], ["B"], ["D#h"], []),
            ("D#h", "Dee", [], [], [], ["a"]), ("D#k", "Kay", [], [], [], []), ("E", "Eee", [], [], [], []), ("E#x", "Ex", [], [], [], []),
        ],
        "page string, label string, stylistic_origins array<string>, derivatives array<string>, subgenres array<string>, fusion_genres array<string>",
    )


def test_graph_build(spark, tiny_heavy):
    nodes = build.assign_node_ids(_genres(spark)).cache()
    ids = {r.page: r.node_id for r in nodes.collect()}
    assert ids == {"A": 0, "B": 1, "D#h": 2, "D#k": 3, "E": 4, "E#x": 5}
    assert {r.page: r.node_id for r in build.page_ids(nodes).collect()} == {**ids, "D": 2}
    links = spark.createDataFrame([("a", "A"), ("b", "B"), ("d#h", "D#h"), ("nowhere", "Artist")], "link string, page string")
    found = build.relation_edges(nodes, links)
    assert sorted((r.src, r.dst, r.ty, r.src_label) for r in found.collect()) == [
        (0, 1, 0, "Aye"), (0, 1, 0, "Aye"), (0, 2, 1, "Aye"), (1, 2, 0, "Bee"), (2, 0, 2, "Dee"),
    ]
    rejects = spark.createDataFrame([("Bee", "Dee", 0)], "src_label string, dst_label string, ty byte")
    edges = build.edge_union(build.reject_edges(found, rejects), build.heading_parent_edges(nodes))
    assert sorted(tuple(r) for r in edges.collect()) == [(0, 1, 0), (0, 2, 1), (2, 0, 2), (2, 3, 1), (4, 5, 1)]
    pairs = spark.createDataFrame([("X", "B"), ("X", "A"), ("X", "Q"), ("Y", "D")], "artist string, genre string")
    assert {r.artist: r.genres for r in build.artist_genre_ids(pairs, build.page_ids(nodes)).collect()} == {"X": [0, 1], "Y": [2]}


def test_dense_ids_are_dense(spark):
    n = 5000
    df = spark.range(n).select(F.concat(F.lit("p"), F.format_string("%06d", (F.col("id") * 7919) % n)).alias("page"))
    rows = build.assign_node_ids(df).collect()
    assert sorted(r.node_id for r in rows) == list(range(n)) and all(int(r.page[1:]) == r.node_id for r in rows)


@pytest.mark.parametrize(
    "label, page, raw, kept",
    [
        ("Bebop", "Bebop", ["Bebop (music)", "Bop (jazz)"], ["Bop"]),
        ("Hip-hop", "Hip-hop music", ["Hip hop", "HIP-HOP", "Hip-hop Music", "Rap music"], ["Hip hop", "Rap music"]),
        ("Hip-hop", "Hip-hop", ["List of every single genre that was ever considered hip hop by anyone", "Rap"], ["Rap"]),
        ("Drum and bass", "Drum and bass", ["Jungle music", "DnB", "D&B"], ["D&B", "DnB", "Jungle music"]),
        ("X", "X", [f"alias {i:03}" for i in range(40)], [f"alias {i:03}" for i in range(32)]),
        ("X", "X", ["Fé (b)", "Fé (a)", "FE"], ["FE"]),
        ("X", "X", [], []),
    ],
)
def test_clean_aliases(spark, label, page, raw, kept):
    nodes = spark.createDataFrame([(page, label)], "page string, label string")
    aliases = spark.createDataFrame([(page, a) for a in raw], "page string, alias string")
    assert build.clean_aliases(nodes, aliases).first()["aliases"] == kept


def test_neighbour_pairs_are_made_distinct_once_and_turned_after(spark):
    rows = [(1, 2, 0), (2, 1, 1), (1, 2, 2), (3, 3, 0), (3, 3, 1), (None, 4, 0), (4, None, 1), (None, None, 0), (9, 1, 0)]
    got = graph.neighbour_sets(spark.createDataFrame(rows, "src long, dst long, ty int"))
    both = {(s, d) for s, d, _ in rows} | {(d, s) for s, d, _ in rows}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(both, key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")


def test_aliases_are_dealt_to_more_tasks_than_a_shuffle_has(spark):
    rows = [(f"p{i % 50}", f"alias {i}", f"alias {i}", f"alias {i % 400}") for i in range(800)]
    first = build.first_alias(spark.createDataFrame(rows, "page string, alias string, shown string, norm string"))
    tasks = first.select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = {}
    for page, alias, shown, norm in rows:
        least[page, norm] = min(least.get((page, norm), (alias, shown)), (alias, shown))
    assert sorted(map(tuple, first.collect())) == sorted((p, n, s) for (p, n), (_, s) in least.items())
