"""Sources and sinks: written from the tables, read back, compared with them."""

from __future__ import annotations

import bz2
import itertools
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check
from quillgraph import scale
from quillgraph.operators import extract, graph, rank
from quillgraph.sinks import documents as sink
from quillgraph.sinks import page_files
from quillgraph.sources import curation, documents, dump, sqldump


def _page_xml(spark, sf):
    """``(value, doc_id, title)``: documents as pages of an article dump, with the title as it stands there."""
    body = F.col("text")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        body = F.replace(body, F.lit(char), F.lit(entity))
    head = (
        "<mediawiki>\n<siteinfo><sitename>W</sitename><dbname>docwiki</dbname><base>https://docs.example.org/wiki/Main</base></siteinfo>\n"
    )
    page = F.concat(
        F.lit(head + "  <page>\n    <title>"), F.col("source"), F.lit(" &amp; "), F.col("doc_id").cast("string"),
        F.lit("</title>\n    <id>"), F.col("doc_id").cast("string"), F.lit("</id>\n    <revision><id>1</id><timestamp>2025-01-0"),
        (F.col("doc_id") % 9 + 1).cast("string"), F.lit("T00:00:00Z</timestamp>\n      <text xml:space=\"preserve\">"), body,
        F.lit("</text></revision>\n  </page>"),
    )
    title = F.concat("source", F.lit(" &amp; "), F.col("doc_id").cast("string"))
    return v.table(spark, sf, "documents").select(page.alias("value"), "doc_id", title.alias("title"))


def _write_dump(spark, sf):
    """The pages compressed the way dumps are."""
    folder = v.scratch(spark) + "/dump"
    _page_xml(spark, sf).select("value").write.option("compression", "bzip2").text(folder)
    return folder


@check("read_dump_pages", """SELECT doc_id AS page_id, source || ' & ' || doc_id AS title, ('2025-01-0' || (doc_id % 9 + 1)) AS day, text FROM documents""")
def read_dump_pages(spark, sf):
    pages = dump.read_dump_pages(spark, _write_dump(spark, sf))
    return pages.select("page_id", "title", F.date_format("ts", "yyyy-MM-dd").alias("day"), "text")


def _write_streams(spark, sf):
    """The same dump as a multistream file for each task, 100 pages to a stream, with indexes: ``(dumps, indexes)``."""
    folder = v.scratch(spark) + "/streams"

    def write(batches):
        from pyarrow.fs import FileSystem

        part = TaskContext.get().partitionId()
        files, where = FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))
        files.create_dir(where)
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        at, entries, name = 0, [], f"/{part:05d}-pages.xml.bz2"
        with files.open_output_stream(where + name, compression=None) as out:
            while some := list(itertools.islice(rows, 100)):
                entries += [f"{at}:{doc_id}:{title}\n" for _, doc_id, title in some]
                at += out.write(bz2.compress("\n".join(xml for xml, _, _ in some).encode()))
        with files.open_output_stream(f"{where}/{part:05d}-index.txt.bz2", compression="bz2") as out:
            out.write("".join(entries).encode())
        yield pa.RecordBatch.from_pydict({"dump": [folder + name], "index": [f"{folder}/{part:05d}-index.txt.bz2"]})

    pages = _page_xml(spark, sf).mapInArrow(write, "dump string, index string")
    written = pages.collect()
    return [r["dump"] for r in written], [r["index"] for r in written]


PAGES_SQL = """SELECT doc_id AS page_id, source || ' & ' || doc_id AS title, ('2025-01-0' || (doc_id % 9 + 1)) AS day, text FROM documents"""


@check("read_dump_pages_by_index", PAGES_SQL)
def read_dump_pages_by_index(spark, sf):
    pages = dump.read_dump_pages(spark, *_write_streams(spark, sf))
    return pages.select("page_id", "title", F.date_format("ts", "yyyy-MM-dd").alias("day"), "text")


@check("read_dump_pages_wanted", PAGES_SQL + " WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def read_dump_pages_wanted(spark, sf):
    """The pages of documents that are labelled toxic: only their streams are read."""
    wanted = v.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("page_id"))
    pages = dump.read_dump_pages(spark, *_write_streams(spark, sf), wanted)
    return pages.select("page_id", "title", F.date_format("ts", "yyyy-MM-dd").alias("day"), "text")


@check("read_site_info", "SELECT DISTINCT 'docs.example.org' AS domain, 'docwiki' AS db_name FROM documents")
def read_site_info(spark, sf):
    return dump.read_site_info(spark, _write_dump(spark, sf))


@check("read_dump_index", 'SELECT DISTINCT l_partkey * 1000 AS "offset" FROM lineitem')
def read_dump_index(spark, sf):
    folder = v.scratch(spark) + "/index"
    line = F.concat_ws(":", (F.col("l_partkey") * 1000).cast("string"), F.col("l_orderkey").cast("string"), F.lit("a"), F.lit(" b"))
    v.table(spark, sf, "lineitem").select(line.alias("value")).write.option("compression", "bzip2").text(folder)
    return dump.read_dump_index(spark, folder)


@check("check_same_dump", "SELECT o_orderkey AS id, o_orderdate::DATE::VARCHAR AS dump_date FROM orders")
def check_same_dump(spark, sf):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    files = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("enwiki-"), day, F.lit("-pages.xml.bz2")).alias("dump_name"),
        F.concat(F.lit("enwiki-"), day, F.lit("-index.txt.bz2")).alias("index_name"),
    )
    return dump.check_same_dump(files).select("id", F.col("dump_date").cast("string").alias("dump_date"))


@check("read_linktargets", r"""SELECT p_partkey AS lt_id, p_size - 25 AS ns, p_name || '''s (' || p_brand || '), ' || p_type || '\é' AS title FROM part""")
def read_linktargets(spark, sf):
    folder = v.scratch(spark) + "/linktarget"
    title = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("\\'s_("), "p_brand", F.lit("),_"), "p_type", F.lit("\\\\é"))
    one = F.concat(F.lit("("), F.concat_ws(",", F.col("p_partkey").cast("string"), (F.col("p_size") - 25).cast("string"), F.concat(F.lit("'"), title, F.lit("'"))), F.lit(")"))
    line = F.concat(F.lit("INSERT INTO `linktarget` VALUES "), one, F.lit(";\n-- (1,2,'no')"))
    v.table(spark, sf, "part").select(line.alias("value")).write.option("compression", "gzip").text(folder)
    return sqldump.read_linktargets(spark, folder)


@check("read_pagelinks", """SELECT l_orderkey AS from_id, l_linenumber AS from_ns, l_partkey AS target_id FROM lineitem
  UNION ALL SELECT l_suppkey, -l_linenumber, l_partkey FROM lineitem""")
def read_pagelinks(spark, sf):
    folder = v.scratch(spark) + "/pagelinks"

    def one(source, ns):
        return F.concat(F.lit("("), F.concat_ws(",", F.col(source).cast("string"), ns.cast("string"), F.col("l_partkey").cast("string")), F.lit(")"))

    ns = F.col("l_linenumber")
    line = F.concat(F.lit("INSERT INTO `pagelinks` VALUES "), one("l_orderkey", ns), F.lit(","), one("l_suppkey", -ns), F.lit(";"))
    v.table(spark, sf, "lineitem").select(line.alias("value")).write.option("compression", "gzip").text(folder)
    return sqldump.read_pagelinks(spark, folder)


@check("read_mix_files", "SELECT 'help' AS kind, s_name AS help_reason, count(*) AS n FROM supplier GROUP BY ALL")
def read_mix_files(spark, sf):
    folder = v.scratch(spark) + "/mixes"
    raw = v.table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("help: "), "s_name", F.lit("\n\n")).alias("value"))
    v.write_file_per_row(raw, folder, "s_suppkey", ".txt")
    parsed = documents.parse_mix_files(documents.read_mix_files(spark, folder))
    return parsed.groupBy("mixes.kind", "mixes.help_reason").agg(F.countDistinct("page").alias("n"))


@check("read_entity_docs", "SELECT s_name AS name, s_suppkey::VARCHAR || ',' || s_nationkey AS genres, '2025-01-02 03:04:05' AS revised, 'part' AS page FROM supplier")
def read_entity_docs(spark, sf):
    folder = v.scratch(spark) + "/docs"
    docs = v.table(spark, sf, "supplier").select(
        "s_suppkey", F.to_json(F.struct(F.col("s_name").alias("name"), F.lit("2025-01-02T03:04:05Z").alias("last_revision_date"),
        F.array("s_suppkey", F.col("s_nationkey").cast("long")).alias("genres"))).alias("value"),
    )
    v.write_file_per_row(docs, folder, "s_suppkey", ".json")
    read = documents.read_entity_docs(spark, folder, documents.ARTIST_DOC)
    return read.select(
        "name", F.array_join(F.transform("genres", lambda g: g.cast("string")), ",").alias("genres"),
        F.date_format("last_revision_date", "yyyy-MM-dd HH:mm:ss").alias("revised"), F.regexp_replace("page", r"^part-.*$", "part").alias("page"),
    )


def _graph(spark, sf):
    nodes = v.nodes(spark, sf).join(v.table(spark, sf, "part"), F.col("node_id") == F.col("p_partkey")).select(
        "node_id", F.when(F.col("p_size") > 25, F.col("p_type")).alias("page_title"), "label",
        F.when(F.col("p_size") > 10, F.array("p_brand")).otherwise(F.array().cast("array<string>")).alias("aliases"),
        (F.col("p_size") % 5).cast("long").alias("links"), F.col("p_retailprice").alias("x"), (F.col("p_size") * 1.5).alias("y"), F.lit(10.0).alias("hue"),
    )
    edges = v.edges(spark, sf)
    meta = v.table(spark, sf, "region").groupBy().agg(F.min("r_name").alias("db_name")).select(
        F.lit("docs.example.org").alias("domain"), "db_name", F.lit("2025-01-02").alias("dump_date"),
        graph.max_degree(edges).scalar().alias("max_degree"),
    )
    return nodes, edges, meta


@check("write_graph_nodes", """SELECT p_partkey AS node_id, CASE WHEN p_size > 25 THEN p_type END AS page_title, p_name || ' ' || p_partkey AS label,
  CASE WHEN p_size > 10 THEN p_brand END AS alias, nullif(p_size % 5, 0)::BIGINT AS links, p_retailprice AS x, p_size * 1.5::DOUBLE AS y, 10::DOUBLE AS hue FROM part""")
def write_graph_nodes(spark, sf):
    folder = v.scratch(spark) + "/graph"
    sink.write_graph(*_graph(spark, sf), folder)
    nodes, _ = documents.read_graph_lines(spark, folder)
    return nodes.select("node_id", "page_title", "label", F.try_element_at("aliases", F.lit(1)).alias("alias"), "links", "x", "y", "hue")


@check("write_graph_edges", f"WITH {v.EDGES_SQL} SELECT src, dst, ty FROM edges")
def write_graph_edges(spark, sf):
    folder = v.scratch(spark) + "/graph"
    sink.write_graph(*_graph(spark, sf), folder)
    _, edges = documents.read_graph_lines(spark, folder)
    return edges.withColumn("ty", F.col("ty").cast("int"))


# Customers in one published document: bounds what a row and a task hold.
BLOCK = 1_000


def _published(spark, sf):
    """Published documents of blocks of customers: a node for each customer, an edge to each one's nation."""
    folder = v.scratch(spark) + "/published"
    nodes = F.sort_array(F.collect_list(F.struct("c_custkey", F.struct(
        F.col("c_name").alias("page_title"), F.col("c_mktsegment").alias("label"), F.array("c_mktsegment").alias("aliases"),
        F.when(F.col("c_nationkey") > 4, F.col("c_nationkey").cast("long")).alias("links"), F.col("c_acctbal").alias("x"), F.lit(1.5).alias("y"), F.lit(2.5).alias("hue"),
    ).alias("node"))))
    edges = F.collect_list(F.array("c_custkey", F.col("c_nationkey").cast("long"), F.col("c_custkey") % 3))
    # A document is named by its first key, which its nodes count from; edges hold whole keys.
    first = (F.col("c_custkey") - F.pmod("c_custkey", F.lit(BLOCK))).cast("string")
    blocks = v.table(spark, sf, "customer").groupBy(first.alias("wikipedia_db_name")).agg(nodes.alias("nodes"), edges.alias("edges"))
    told = blocks.select(F.lit("docs.example.org").alias("wikipedia_domain"), "wikipedia_db_name", F.transform("nodes", lambda n: n["node"]).alias("nodes"), "edges")
    told.write.option("maxRecordsPerFile", 1).json(folder)
    nodes, edges = documents.read_graph_json(spark, folder, "wikipedia_db_name")
    return nodes.withColumn("node_id", F.col("wikipedia_db_name").cast("long") + F.col("node_id")), edges.drop("wikipedia_db_name")


@check("read_graph_json", """SELECT c_custkey AS node_id, c_name AS page_title, c_mktsegment AS label, c_mktsegment AS alias,
  CASE WHEN c_nationkey > 4 THEN c_nationkey ELSE 0 END::BIGINT AS links, c_acctbal AS x FROM customer""")
def read_graph_json(spark, sf):
    nodes, _ = _published(spark, sf)
    return nodes.select("node_id", "page_title", "label", F.try_element_at("aliases", F.lit(1)).alias("alias"), "links", "x")


@check("read_graph_json_edges", "SELECT c_custkey AS src, c_nationkey::BIGINT AS dst, (c_custkey % 3)::INTEGER AS ty FROM customer")
def read_graph_json_edges(spark, sf):
    _, edges = _published(spark, sf)
    return edges.withColumn("ty", F.col("ty").cast("int"))


@check("curation_tables", """SELECT n_name AS name, n.kind AS kind, n.rows AS rows FROM nation, (VALUES ('accepted_edges', 91), ('artist_renames', 0), ('genre_renames', 3),
  ('ignored_pages', 5), ('rejected_edges', 16)) n(kind, rows)""")
def curation_tables(spark, sf):
    """The sizes of all curated tables beside each nation."""
    sizes = [t.agg(F.count(F.lit(1)).cast("int").alias("rows")).select(F.lit(k).alias("kind"), "rows") for k, t in curation.curation_tables(spark).items()]
    told = scale.union_all(sizes).agg(F.collect_list(F.struct("kind", "rows")).alias("t")).scalar()
    return v.table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.explode(told).alias("t")).select("name", "t.*")


@check("template_dim", """SELECT s_suppkey, ['cn', 'lang', 'efn', 'nobr', 'sfnp', 'unknown thing'][s_suppkey % 6 + 1] AS template,
  ['citation_needed', 'lang', 'efn', 'nowrap', 'sfn', NULL][s_suppkey % 6 + 1] AS canonical, ['bracket', 'component', 'component', 'component', 'hidden', NULL][s_suppkey % 6 + 1] AS kind,
  CASE WHEN s_suppkey % 6 = 0 THEN '[citation needed]' END AS text FROM supplier""")
def template_dim(spark, sf):
    """Each supplier uses a template by one of its names."""
    named = F.element_at(F.array(*map(F.lit, ["cn", "lang", "efn", "nobr", "sfnp", "unknown thing"])), (F.col("s_suppkey") % 6 + 1).cast("int"))
    uses = v.table(spark, sf, "supplier").select("s_suppkey", named.alias("template"))
    dim = curation.template_dim(spark).withColumnRenamed("name", "template")
    return uses.join(dim, "template", "left").select("s_suppkey", "template", "canonical", "kind", "text")


@check("write_stage", "SELECT l_partkey AS target_id, count(*) AS n FROM lineitem GROUP BY 1")
def write_stage(spark, sf):
    counted = v.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("target_id")).agg(F.count(F.lit(1)).alias("n"))
    return sink.write_stage(counted, v.scratch(spark) + "/stage")


def _ranked(spark, sf):
    scores = rank.artist_scores(v.customer_brands(spark, sf), v.customer_links(spark, sf), v.brand_links(spark, sf), "double")
    return rank.top_artists(scores.withColumn("score", F.round("score", 9)))


TOP_SQL = f"""WITH {v.CUSTOMER_BRANDS_SQL}, {v.CUSTOMER_LINKS_SQL}, scores AS (SELECT brand AS genre, artist,
  round(links * CASE WHEN total = 1 THEN 1 ELSE 0.1 + 0.9 * pow(0.5, position / (total - 1)::DOUBLE) END, 9) AS score
  FROM brands JOIN cust USING (artist) WHERE NOT starts_with(brand, 'Brand#2')),
  best AS (SELECT genre, artist, rank FROM (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY score DESC, artist) AS rank FROM scores) WHERE rank <= 10)"""


def _brand_genres(spark, sf):
    brands = v.table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_type").alias("description"))
    return brands.select(F.col("p_brand").alias("page"), "description", F.lit("2025-01-02 03:04:05").cast("timestamp").alias("revision"))


GENRE_DOCS_SQL = f"""{TOP_SQL} SELECT page, description, '2025-01-02T03:04:05Z' AS last_revision_date, coalesce(string_agg(artist, ',' ORDER BY rank), '') AS top_artists,
  CASE WHEN starts_with(page, 'Brand#1') THEN 'why ' || page END AS help, CASE WHEN starts_with(page, 'Brand#3') THEN 'L' || page END AS playlist
  FROM (SELECT p_brand AS page, min(p_type) AS description FROM part GROUP BY 1) LEFT JOIN best ON genre = page GROUP BY ALL"""
ARTIST_DOCS_SQL = f"""{TOP_SQL} SELECT c_name AS page, c_mktsegment AS name, '2025-01-02T03:04:05Z' AS last_revision_date, c_nationkey::VARCHAR AS genres
  FROM customer WHERE c_name IN (SELECT artist FROM best)"""


def _genre_docs(spark, sf):
    genres = _brand_genres(spark, sf)
    raw = F.when(F.col("page").startswith("Brand#1"), F.concat(F.lit("help: why "), "page")).when(
        F.col("page").startswith("Brand#3"), F.concat(F.lit("https://y.example/?list=L"), F.regexp_replace("page", "#", "&"))
    )
    files = genres.select("page", raw.alias("raw")).filter("raw is not null")
    return sink.genre_docs(genres, documents.parse_mix_files(files), _ranked(spark, sf))


def _shown_genres(read):
    playlist = F.get_json_object("mixes", "$[0].playlist")
    return read.select(
        "page", "description", "last_revision_date", F.array_join("top_artists", ",").alias("top_artists"),
        F.get_json_object("mixes", "$.help_reason").alias("help"),
        F.when(playlist.isNotNull(), F.concat(playlist, F.substring("page", 6, 9))).alias("playlist"),
    )


@check("write_genre_docs", GENRE_DOCS_SQL)
def write_genre_docs(spark, sf):
    folder = v.scratch(spark) + "/genres"
    sink.write_genre_docs(_genre_docs(spark, sf), folder)
    return _shown_genres(spark.read.schema("page string, description string, last_revision_date string, mixes string, top_artists array<string>").json(folder))


@check("write_genre_pages", GENRE_DOCS_SQL)
def write_genre_pages(spark, sf):
    """A file per genre, read back by its name."""
    folder = v.scratch(spark) + "/genre_pages"
    page_files.write_genre_pages(_genre_docs(spark, sf), folder)
    read = documents.read_entity_docs(spark, folder, documents.GENRE_DOC)
    return _shown_genres(read.withColumn("last_revision_date", F.date_format("last_revision_date", "yyyy-MM-dd'T'HH:mm:ss'Z'")))


def _artist_docs(spark, sf):
    customers = v.table(spark, sf, "customer")
    artists = customers.select(
        F.col("c_name").alias("page"), F.col("c_mktsegment").alias("label"), F.lit(None).cast("string").alias("description"),
        F.lit("2025-01-02 03:04:05").cast("timestamp").alias("revision"),
    )
    ids = customers.select(F.col("c_name").alias("artist"), F.array(F.col("c_nationkey").cast("long")).alias("genres"))
    return sink.artist_docs(artists, _ranked(spark, sf), ids)


@check("write_artist_docs", ARTIST_DOCS_SQL)
def write_artist_docs(spark, sf):
    folder = v.scratch(spark) + "/artists"
    sink.write_artist_docs(_artist_docs(spark, sf), folder)
    return _shown_artists(spark.read.schema("page string, name string, last_revision_date string, genres array<bigint>").json(folder))


@check("write_artist_pages", ARTIST_DOCS_SQL)
def write_artist_pages(spark, sf):
    """A file per artist, read back by its name."""
    folder = v.scratch(spark) + "/artist_pages"
    page_files.write_artist_pages(_artist_docs(spark, sf), folder)
    read = documents.read_entity_docs(spark, folder, documents.ARTIST_DOC)
    return _shown_artists(read.withColumn("last_revision_date", F.date_format("last_revision_date", "yyyy-MM-dd'T'HH:mm:ss'Z'")))


def _shown_artists(read):
    return read.select("page", "name", "last_revision_date", F.array_join(F.transform("genres", lambda g: g.cast("string")), ",").alias("genres"))


@check("write_link_ids", """SELECT lower(p_brand) || ' ' || p_partkey AS link, p_partkey AS node_id FROM part WHERE p_size > 5""")
def write_link_ids(spark, sf):
    part = v.table(spark, sf, "part").withColumn("page", F.concat_ws(" ", "p_brand", F.col("p_partkey").cast("string")))
    ids = sink.link_ids(
        part.select(F.lower("page").alias("link"), "page"), part.filter("p_size > 5").select("page", F.col("p_partkey").alias("node_id"))
    )
    folder = v.scratch(spark) + "/links"
    sink.write_link_ids(ids, folder)
    return spark.read.schema("link string, node_id bigint").json(folder)


@check("extract_from_dump", """SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'redirect' WHEN 1 THEN 'genre' ELSE 'artist' END AS kind,
  CASE WHEN doc_id % 3 = 0 THEN source || ' & ' || (doc_id + 1) END AS target FROM documents""")
def extract_from_dump(spark, sf):
    """Dump to classified pages and parsed redirects."""
    key = F.col("page_id")
    head = (
        F.when(key % 3 == 0, F.concat(F.lit("#REDIRECT [["), F.split("title", " & ")[0], F.lit(" & "), (key + 1).cast("string"), F.lit("]]\n")))
        .when(key % 3 == 1, F.lit("{{Infobox music genre}}\n")).otherwise(F.lit("{{Infobox musical artist}}\n"))
    )
    pages = dump.read_dump_pages(spark, _write_dump(spark, sf)).withColumn("text", F.concat(head, "text"))
    kept = extract.drop_namespaced(extract.classify_pages(pages))
    # The dump is read once: stored are the pages, with the text of the redirects alone.
    kept = scale.cut(kept.select(key, "title", "kind", F.when(F.col("kind") == "redirect", F.col("text")).alias("text")))
    targets = extract.resolved_only(extract.read_redirects(kept, "docs.example.org"))
    return kept.select(key.alias("id"), "title", "kind").join(targets, "title", "left").select("id", "kind", "target")
