import json
from datetime import datetime

from pyspark.sql import functions as F

from quillgraph.plans.dump_to_graph import DumpTables, build_graph, write_all
from quillgraph.sources import documents

GENRES = {
    "House music": "{{Infobox music genre|name=House|stylistic_origins=[[Disco]]|subgenres=* [[Acid house]]\n* [[House music#Deep house|Deep]]}}\n'''House''' is dance music.\n== Deep house ==\n{{Infobox music genre|name=Deep house|stylistic_origins=[[jazz music]]}}\nDeep lead.\n",
    "Acid house": "{{Infobox music genre|derivatives=[[Nowhere]], [[Acid house]]}}\nAcid.",
    "Disco": "{{Infobox music genre|name=Disco|fusiongenres=[[House (genre)|x]]}}\nDisco lead",
    "Jazz": "{{Infobox music genre|name=Jazz}}",
    "LGBTQ music": "{{Infobox music genre|name=LGBTQ music|derivatives=[[Disco]]}}",
}
ARTISTS = {
    "Fingers": "{{Infobox musical artist|name=Mr. Fingers|genre=[[Deep house]], [[House (genre)]], [[unknown]]}}\nDJ.",
    "Sun Ra": "{{Infobox musical artist|genre=[[Jazz]]}}\nPianist.",
}
REDIRECTS = {"House (genre)": "House music", "Deep house": "House music#Deep house", "Jazz Music": "Jazz", "Larry Heard": "Fingers", "Larry": "Larry Heard"}


def test_dump_to_published_files(spark, tmp_path):
    stamp = datetime(2025, 3, 1, 12)
    rows = [(t, b) for t, b in {**GENRES, **ARTISTS}.items()] + [(t, f"#REDIRECT [[{x}]]") for t, x in REDIRECTS.items()] + [("Other", "text")]
    pages = spark.createDataFrame([(i, t, stamp, b) for i, (t, b) in enumerate(rows)], "page_id long, title string, ts timestamp, text string")
    targets = ["House music", "Deep house", "Fingers", "Larry", "Sun Ra", "Disco", "Other"]
    linktargets = spark.createDataFrame([(i, 0, t) for i, t in enumerate(targets)], "lt_id long, ns int, title string")
    pagelinks = spark.createDataFrame([(n, 0, i) for i in range(len(targets)) for n in range(i + 1)], "from_id long, from_ns int, target_id long")
    mixes = documents.parse_mix_files(spark.createDataFrame([("Disco", "https://youtu.be/x"), ("Jazz", "help: none")], "page string, raw string"))
    meta = spark.createDataFrame([("en.wikipedia.org", "enwiki", "2025-03-01")], "domain string, db_name string, dump_date string")
    work, out = str(tmp_path / "work"), str(tmp_path / "out")
    positions = spark.createDataFrame([("Jazz", 3.0, 4.0), ("Disco", -1.0, 2.0), ("No node", 0.0, 0.0)], "page string, x double, y double")
    tables = build_graph(spark, DumpTables(pages, linktargets, pagelinks, mixes, meta, "en.wikipedia.org"), work, positions)

    nodes = {r.node_id: r for r in tables["nodes"].collect()}
    assert [(i, nodes[i].page_title, nodes[i].label) for i in range(6)] == [
        (0, None, "Acid house"), (1, None, "Disco"), (2, "House music", "House"), (3, "House music#Deep house", "Deep house"),
        (4, None, "Jazz"), (5, None, "LGBTQ music"),
    ]
    assert nodes[2].aliases == [] and nodes[4].aliases == ["Jazz Music"] and nodes[3].aliases == []
    # five nodes and one: both components are small, so all go to the ring, which has radius 100 without a core
    assert {90 <= (r.x**2 + r.y**2) ** 0.5 <= 110 for r in nodes.values()} == {True}
    assert nodes[2].links == 1 and nodes[3].links == 2 and nodes[1].links == 6 and nodes[0].links == 0
    # origins in, derivatives and subgenres out, fusions through a redirect, heading parent, rejected LGBTQ -> Disco
    assert sorted(tuple(r) for r in tables["edges"].collect()) == [(1, 2, 0), (1, 2, 2), (2, 0, 1), (2, 3, 1), (4, 3, 0)]

    write_all(tables, out)
    whole = "".join(p.read_text() for p in sorted((tmp_path / "out" / "graph").glob("part-*")))
    document = json.loads(whole)
    assert document["max_degree"] == 4 and len(document["nodes"]) == 6 and document["edges"][0] == [1, 2, 0]
    genres = {r.page: json.loads(r.value) for r in spark.read.text(f"{out}/genres").select(F.get_json_object("value", "$.page").alias("page"), "value").collect()}
    assert genres["House music"]["top_artists"] == ["Fingers"] and genres["Jazz"]["top_artists"] == ["Sun Ra"]
    assert genres["Disco"]["mixes"] == [{"video": "x"}] and genres["Jazz"]["mixes"] == {"help_reason": "none"}
    assert "mixes" not in genres["House music"] and genres["House music#Deep house"]["description"] == "Deep lead."
    pages = {r.page: r for r in documents.read_entity_docs(spark, f"{out}/pages/genres", documents.GENRE_DOC).collect()}
    assert set(pages) == set(genres) and pages["Jazz"].top_artists == ["Sun Ra"]
    artists = {r.page: r for r in spark.read.json(f"{out}/artists").collect()}
    assert artists["Fingers"].name == "Mr. Fingers" and artists["Fingers"].genres == [2, 3] and artists["Sun Ra"].name == "Sun Ra"
    ids = {r.link: r.node_id for r in spark.read.json(f"{out}/link_ids").collect()}
    assert ids["deep house"] == 3 and ids["house (genre)"] == 2 and "fingers" not in ids
    assert spark.read.parquet(f"{out}/search_index").count() == 7
