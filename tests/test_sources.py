import bz2
import gzip
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import extract
from quillgraph.sinks import documents as sink
from quillgraph.sources import curation, documents, dump, sqldump


def _page(n, title, body, stamp="2025-01-02T03:04:05Z"):
    return (
        f"  <page>\n    <title>{title}</title>\n    <ns>0</ns>\n    <id>{n}</id>\n    <revision>\n      <id>{n + 9000}</id>\n"
        f"      <timestamp>{stamp}</timestamp>\n      <contributor><id>5</id></contributor>\n"
        f'      <text bytes="3" xml:space="preserve">{body}</text>\n    </revision>\n  </page>\n'
    )


@pytest.fixture
def dump_file(tmp_path):
    head = (
        "<mediawiki>\n<siteinfo><sitename>W</sitename><dbname>enwiki</dbname>"
        "<base>https://en.wikipedia.org/wiki/Main_Page</base></siteinfo>\n"
    )
    streams, offsets, data = [head], [], b""
    for s in range(30):
        streams.append("".join(_page(i, f"T &amp; {i}", f"&lt;b&gt;{i}&lt;/b&gt; &amp;lt; " + f"{i} text\n" * 300) for i in range(s * 10, s * 10 + 10)))
    streams.append("</mediawiki>\n")
    for piece in streams:
        offsets.append(len(data))
        data += bz2.compress(piece.encode())
    path = tmp_path / "enwiki-20250123-pages-articles-multistream.xml.bz2"
    path.write_bytes(data)
    index = tmp_path / "index.txt.bz2"
    lines = [f"{offsets[1 + i // 10]}:{i}:T & {i}: x" for i in range(300)]
    index.write_bytes(bz2.compress("\n".join(lines).encode()))
    return str(path), str(index), offsets[1:-1]


def test_dump_is_split_and_whole(spark, dump_file):
    path, index, offsets = dump_file
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        pages = dump.read_dump_pages(spark, path)
        assert pages.select(F.spark_partition_id()).distinct().count() >= 1
        rows = {r.page_id: r for r in pages.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(rows) == list(range(300))
    row = rows[7]
    assert row.title == "T & 7" and row.ts == datetime(2025, 1, 2, 3, 4, 5)
    assert row.text.startswith("<b>7</b> &lt; 7 text\n")
    assert [r.offset for r in dump.read_dump_index(spark, index).collect()] == offsets
    assert tuple(dump.read_site_info(spark, path).first()) == ("en.wikipedia.org", "enwiki")


def test_site_info_missing_parts(spark, tmp_path):
    bad = tmp_path / "a.xml"
    bad.write_text("<mediawiki><siteinfo><base>nowhere</base></siteinfo><page></page>")
    with pytest.raises(Exception, match="no wiki domain"):
        dump.read_site_info(spark, str(bad)).collect()


def test_same_dump(spark):
    files = spark.createDataFrame([("enwiki-20250123-a", "enwiki-20250123-b")], "dump_name string, index_name string")
    assert str(dump.check_same_dump(files).first()["dump_date"]) == "2025-01-23"
    other = spark.createDataFrame([("enwiki-20250123-a", "enwiki-20250124-b")], "dump_name string, index_name string")
    with pytest.raises(Exception, match="not of one date"):
        dump.check_same_dump(other).collect()


def test_sql_dumps(spark, tmp_path):
    path = tmp_path / "lt.sql.gz"
    body = (
        "-- comment (1,0,'No')\nINSERT INTO `linktarget` VALUES (123,0,'Example_Page'),(456,1,'Another_Example'),"
        "(789,-1,'Test_Article'),(790,-2,'X');\nINSERT INTO `linktarget` VALUES (5,0,'Example\\'Page'),"
        "(6,0,'A_(b),_c\\\\_d'),(7,0,'Café_\\\"q\\\"'),(8,0,'keep\\_it');\n"
    )
    path.write_bytes(gzip.compress(body.encode()))
    rows = {r.lt_id: (r.ns, r.title) for r in sqldump.read_linktargets(spark, str(path)).collect()}
    assert rows == {
        123: (0, "Example Page"), 456: (1, "Another Example"), 789: (-1, "Test Article"), 790: (-2, "X"),
        5: (0, "Example'Page"), 6: (0, "A (b), c\\ d"), 7: (0, 'Café "q"'), 8: (0, "keep_it"),
    }
    links = tmp_path / "pl.sql"
    links.write_text("INSERT INTO `pagelinks` VALUES (1,0,123),(2,-1,456),(3,14,789);\n")
    got = sorted(tuple(r) for r in sqldump.read_pagelinks(spark, str(links)).collect())
    assert got == [(1, 0, 123), (2, -1, 456), (3, 14, 789)]


def test_mix_files(spark, tmp_path):
    folder = tmp_path / "mixes"
    folder.mkdir()
    (folder / "AC⧸DC rock").write_text("help: later")
    (folder / "Metal❏Cyber+100%").write_text("https://youtu.be/a\nhttps://youtu.be/b")
    got = {r.page: r.mixes for r in documents.parse_mix_files(documents.read_mix_files(spark, str(folder))).collect()}
    assert got["AC/DC rock"].help_reason == "later"
    assert [i.id for i in got["Metal#Cyber+100%"]["items"]] == ["a", "b"]


def test_graph_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame(
        [(0, None, "A", ["a1"], 3, 1.5, 2.0, 10.0), (1, "B page", "B \"q\"", [], 0, -1.0, 0.0, 0.0), (2, None, "[0,9]", [], 1, 0.0, 0.0, 0.0)],
        "node_id long, page_title string, label string, aliases array<string>, links long, x double, y double, hue double",
    )
    edges = spark.createDataFrame([(0, 1, 0), (0, 1, 2), (2, 0, 1)], "src long, dst long, ty byte")
    meta = spark.createDataFrame([("en.wikipedia.org", "enwiki", "2025-01-23", 3)], "domain string, db_name string, dump_date string, max_degree long")
    out = tmp_path / "graph"
    sink.write_graph(nodes, edges, meta, str(out))
    whole = "".join(p.read_text() for p in sorted(out.glob("part-*")))
    document = json.loads(whole)
    assert document["wikipedia_domain"] == "en.wikipedia.org" and document["max_degree"] == 3
    assert document["edges"] == [[0, 1, 0], [0, 1, 2], [2, 0, 1]]
    assert document["nodes"][1] == {"node_id": 1, "page_title": "B page", "label": 'B "q"', "x": -1.0, "y": 0.0, "hue": 0.0}
    single = tmp_path / "data.json"
    single.write_text(whole)
    for read in (lambda: documents.read_graph_json(spark, str(single)), lambda: documents.read_graph_lines(spark, str(out))):
        n, e = read()
        assert [(r.node_id, r.label) for r in n.orderBy("node_id").collect()] == [(0, "A"), (1, 'B "q"'), (2, "[0,9]")]
        assert sorted(tuple(r) for r in e.collect()) == [(0, 1, 0), (0, 1, 2), (2, 0, 1)]


def test_empty_graph_is_valid_json(spark, tmp_path):
    nodes = spark.createDataFrame([], "node_id long, page_title string, label string, aliases array<string>, links long, x double, y double, hue double")
    edges = spark.createDataFrame([], "src long, dst long, ty byte")
    meta = spark.createDataFrame([("d", "w", "2025-01-23", 0)], "domain string, db_name string, dump_date string, max_degree long")
    sink.write_graph(nodes, edges, meta, str(tmp_path / "g"))
    document = json.loads("".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*"))))
    assert document["nodes"] == [] and document["edges"] == []


def test_entity_docs_keyed_by_file_name(spark, tmp_path):
    (tmp_path / "A⧸B x.json").write_text(json.dumps({"name": "AB", "last_revision_date": "2025-01-02T03:04:05Z", "genres": [1, 2]}, indent=2))
    row = documents.read_entity_docs(spark, str(tmp_path), documents.ARTIST_DOC).first()
    assert row.page == "A/B x" and row.genres == [1, 2] and row.last_revision_date == datetime(2025, 1, 2, 3, 4, 5)


def test_curation_sizes(spark):
    sizes = {k: v.count() for k, v in curation.curation_tables(spark).items()}
    assert sizes == {"ignored_pages": 5, "genre_renames": 3, "artist_renames": 0, "rejected_edges": 16, "accepted_edges": 91}
    more = spark.createDataFrame([("cn", "citation_needed", "alias", None)], "name string, canonical string, kind string, text string")
    dim = curation.template_dim(spark, more)
    assert dim.count() == dim.select("name").distinct().count()
    assert dim.filter("name = 'cn'").count() == 1


def test_conditions_on_pages_do_not_scan_them_again(spark, dump_file):
    """Each tag is looked for once, whatever is asked of its text afterwards."""
    path = dump_file[0] if isinstance(dump_file, tuple) else dump_file
    pages = extract.drop_namespaced(extract.classify_pages(dump.read_dump_pages(spark, str(path))))
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("</text>") == 1 and plan.count("</title>") == 1
