import pytest
from pyspark.sql import functions as F

from quillgraph.operators import links, rank


def _run(spark, pages, redirects):
    p = spark.createDataFrame([(x, i) for i, x in enumerate(pages)], "page string, rank int").drop("rank")
    r = spark.createDataFrame(redirects, "title string, target string")
    resolved, aliases = links.resolve_redirects(p, r)
    return {x.link: x.page for x in resolved.collect()}, sorted((x.page, x.alias) for x in aliases.collect())


def test_redirect_closure(spark):
    resolved, aliases = _run(
        spark,
        ["Hip-hop", "House", "House#Deep"],
        [
            ("Rap", "Hip-hop"), ("Rap music", "rap"), ("MCing", "Rap music"), ("Deep house", "House#Deep"),
            ("Deep", "House#Missing"), ("HIP-HOP", "House"), ("x", "y"), ("y", "x"), ("RAP", "House"),
        ],
    )
    assert resolved == {
        "hip-hop": "Hip-hop", "house": "House", "house#deep": "House#Deep", "rap": "House",
        "rap music": "House", "mcing": "House", "deep house": "House#Deep",
    }
    # "RAP" sorts before "Rap"; both appear in round one, so it takes the key.
    assert aliases == [("House", "MCing"), ("House", "RAP"), ("House", "Rap music"), ("House#Deep", "Deep house")]


def test_closure_with_split_hot_target(spark, tiny_heavy):
    many = [(f"r{i:02}", "Hot") for i in range(40)] + [("s", "r07"), ("t", "S")]
    resolved, aliases = _run(spark, ["Hot"], many)
    assert len(resolved) == 43 and set(resolved.values()) == {"Hot"} and len(aliases) == 42


def test_later_kind_wins_case_collision(spark):
    p = spark.createDataFrame([("ABBA", 1), ("abba", 0)], "page string, rank int")
    r = spark.createDataFrame([], "title string, target string")
    assert [x.page for x in links.resolve_redirects(p, r)[0].collect()] == ["ABBA"]


@pytest.fixture
def tables(spark):
    targets = spark.createDataFrame(
        [(1, 0, "Jazz"), (2, 0, "Rap"), (3, 1, "Jazz"), (4, 0, "Other"), (5, 0, "Never")], "lt_id long, ns int, title string"
    )
    pagelinks = spark.createDataFrame(
        [(i, 0, 1) for i in range(7)] + [(9, 14, 2), (9, 0, 3), (9, 0, 4), (9, 0, 99)], "from_id long, from_ns int, target_id long"
    )
    tracked = spark.createDataFrame([("Jazz",), ("Rap",), ("Never",), ("NoTarget",)], "title string")
    return targets, pagelinks, tracked


def test_counts(spark, tables, tiny_heavy):
    targets, pagelinks, tracked = tables
    kept = links.tracked_linktargets(targets, tracked)
    assert sorted(r.lt_id for r in kept.collect()) == [1, 2, 5]
    assert links.links_to_tracked(pagelinks, kept).groupBy("title").count().count() == 2
    assert links.links_to_tracked(pagelinks, kept).count() == 8
    counts = {r.title: r.n for r in links.inbound_counts(pagelinks, kept, tracked).collect()}
    assert counts == {"Jazz": 7, "Rap": 1, "Never": 0, "NoTarget": 0}


def test_aggregated_counts(spark):
    pages = spark.createDataFrame([("A",), ("A#h",), ("B",)], "page string")
    aliases = spark.createDataFrame([("A", "a1"), ("A#h", "h1"), ("A#h", "h2"), ("Z", "a1")], "page string, alias string")
    counts = spark.createDataFrame([("A", 5), ("A#h", 100), ("a1", 2), ("h1", 3)], "title string, n long")
    got = {r.page: r.links for r in links.aggregated_link_count(pages, aliases, counts).collect()}
    assert got == {"A": 7, "A#h": 3, "B": 0}


def test_tracked_pages(spark):
    a = spark.createDataFrame([("X",)], "page string")
    g = spark.createDataFrame([("G",), ("G#h",)], "page string")
    al = spark.createDataFrame([("G", "g2"), ("G", "X")], "page string, alias string")
    assert sorted(r.title for r in links.tracked_pages(a, g, al).collect()) == ["G", "X", "g2"]


def test_weights(spark):
    df = spark.range(1).select(
        rank.position_weight(F.lit(0), F.lit(1)).alias("one"),
        rank.position_weight(F.lit(0), F.lit(3)).alias("first"),
        rank.position_weight(F.lit(1), F.lit(3)).alias("mid"),
        rank.position_weight(F.lit(2), F.lit(3)).alias("last"),
    )
    assert dict(df.dtypes)["mid"] == "float"
    row = df.first()
    assert row.one == 1.0 and row.first == pytest.approx(1.0) and row.last == pytest.approx(0.55)
    assert row.mid == pytest.approx(0.1 + 0.9 * 0.5**0.5, rel=1e-6)


def test_ranking(spark, tiny_heavy):
    artists = spark.createDataFrame(
        [("A", ["Rock", "nowhere", "rap music"]), ("B", ["ROCK"]), ("C", ["rock", "Rock music"]), ("D", [])],
        "page string, genres array<string>",
    )
    found = spark.createDataFrame([("rock", "Rock"), ("rock music", "Rock"), ("rap music", "Hip-hop")], "link string, page string")
    counts = spark.createDataFrame([("A", 10), ("B", 20), ("C", 100)], "page string, links long")
    scores = {(r.genre, r.artist): r.score for r in rank.artist_scores(artists, counts, found).collect()}
    assert scores == {
        ("Rock", "A"): pytest.approx(10.0), ("Hip-hop", "A"): pytest.approx(5.5), ("Rock", "B"): pytest.approx(20.0),
        ("Rock", "C"): pytest.approx(155.0),
    }
    best = rank.top_artists(rank.artist_scores(artists, counts, found), 2)
    assert sorted((r.genre, r["rank"], r.artist) for r in best.collect()) == [("Hip-hop", 1, "A"), ("Rock", 1, "C"), ("Rock", 2, "B")]
    pairs = sorted((r.artist, r.genre) for r in rank.artist_genres(artists, found).collect())
    assert pairs == [("A", "Hip-hop"), ("A", "Rock"), ("B", "Rock"), ("C", "Rock")]


def test_tied_scores_follow_page_order(spark):
    scores = spark.createDataFrame([("g", "A#x", 1.0), ("g", "A", 1.0), ("g", "A b", 1.0)], "genre string, artist string, score float")
    got = [r.artist for r in rank.top_artists(scores).orderBy("rank").collect()]
    assert got == ["A", "A#x", "A b"]


def test_long_chains_need_few_rounds(spark, monkeypatch):
    """A chain of 1,000 redirects, rings, and titles that differ only in case."""
    from quillgraph import scale
    from quillgraph.operators import links

    rounds, plain = [], scale.lookup_join
    monkeypatch.setattr(scale, "lookup_join", lambda *a, **k: rounds.append(1) or plain(*a, **k))
    chain = [(f"R{i:04}", f"r{i - 1:04}" if i else "Page") for i in range(1_000)]
    rings = [("Ring1", "Ring2"), ("Ring2", "Ring1"), ("Into", "ring1"), ("Dead", "Nowhere"), ("Self", "self")]
    redirects = spark.createDataFrame(chain + rings, "title string, target string")
    found, aliases = links.resolve_redirects(spark.createDataFrame([("Page",)], "page string"), redirects)
    assert sorted(tuple(r) for r in found.collect()) == sorted([("page", "Page")] + [(t.lower(), "Page") for t, _ in chain])
    assert sorted(r.alias for r in aliases.collect()) == sorted(t for t, _ in chain)
    assert len(rounds) <= 12 + 1  # and one to name the pages


def _rounds(pages, redirects):
    """Brute force: round by round, the smallest title of a link's first round."""
    level = {p.lower(): (p, None) for p in pages}
    while True:
        new = {}
        for title, target in redirects:
            if title.lower() not in level and target.lower() in level:
                new[title.lower()] = min(new.get(title.lower(), ("\U0010ffff", "")), (title, level[target.lower()][0]))
        if not new:
            return {(link, page) for link, (page, _) in level.items()}, sorted((page, title) for page, title in level.values() if title)
        level |= {link: (page, title) for link, (title, page) in new.items()}


def test_forks_against_rounds(spark, tiny_heavy):
    import random

    from quillgraph.operators import links

    for seed in range(3):
        rng = random.Random(seed)
        words = [f"{c}{d}" for c in "abcdefgh" for d in "xyz"]
        case = lambda w: rng.choice([w, w.upper(), w.capitalize()])
        pages = sorted({w.capitalize() for w in rng.sample(words, 3)})
        redirects = [(case(rng.choice(words)), case(rng.choice(words))) for _ in range(40)]
        found, aliases = links.resolve_redirects(
            spark.createDataFrame([(p,) for p in pages], "page string"), spark.createDataFrame(redirects, "title string, target string")
        )
        want, titles = _rounds(pages, redirects)
        assert {tuple(r) for r in found.collect()} == want
        assert sorted(tuple(r) for r in aliases.collect()) == titles


def test_stored_side_of_lookups_stays_placed(spark):
    from pyspark.sql import functions as F

    from quillgraph import scale

    facts = spark.range(2_000).select((F.col("id") % 37).alias("src"), F.col("id").alias("dst"))
    placed, heavy = scale.for_lookups(facts, "src", ["dst"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frontier = scale.cut(spark.range(20).select(F.col("id").alias("src")))
        joined = scale.copy_to_slots(frontier, "src", heavy).join(placed, ["src", "_slot"])
        plan = joined._jdf.queryExecution().sparkPlan().toString(), joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == sum(1 for i in range(2_000) if i % 37 < 20)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan[1].count("Exchange hashpartitioning(src") == 1
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
