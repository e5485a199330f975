"""Names, text functions and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check
from quillgraph.functions import names, text
from quillgraph.operators import extract


@check("page_parse", """SELECT page_id::BIGINT AS page_id, split_part(url, '#', 1) AS name,
  CASE WHEN contains(url, '#') THEN substr(url, strpos(url, '#') + 1) END AS heading, url AS joined,
  split_part(url, '#', 1) || '#top' AS moved FROM pages""")
def page_parse(spark, sf):
    parts = v.table(spark, sf, "pages").withColumn("p", names.page_parse("url"))
    return parts.select(
        "page_id", F.col("p.name").alias("name"), F.col("p.heading").alias("heading"),
        names.page_format(F.col("p.name"), F.col("p.heading")).alias("joined"), names.with_heading("url", F.lit("top")).alias("moved"),
    )


@check("sanitize_names", r"""SELECT page_id::BIGINT AS page_id, translate(url, '/\:*?"<>|#', '⧸⧵∶✱？❞❮❯❘❏') AS safe, url AS back FROM pages""")
def sanitize_names(spark, sf):
    safe = v.table(spark, sf, "pages").select("page_id", names.sanitize("url").alias("safe"))
    return safe.withColumn("back", names.unsanitize("safe"))


@check("page_url", f"""WITH {v.GENRE_PAGES_SQL} SELECT part AS id,
  'https://en.example.org/wiki/' || replace(root, ' ', '_') || coalesce('#' || heading, '') AS url FROM named""")
def page_url(spark, sf):
    pages = v.genre_pages(spark, sf)
    return pages.select(F.col("part").alias("id"), names.page_url(F.lit("en.example.org"), "page").alias("url"))


@check("url_host", """SELECT page_id::BIGINT AS page_id, nullif(regexp_extract(url, '://([^/]*)/', 1), '') AS host FROM pages""")
def url_host(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", names.url_host("url").alias("host"))


@check("dump_date", """SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE::VARCHAR END AS day,
  'https://dumps.wikimedia.org/enwiki/' || strftime(o_orderdate, '%Y%m%d') || '/' AS url FROM orders""")
def dump_date(spark, sf):
    orders = v.table(spark, sf, "orders")
    digits = F.date_format("o_orderdate", "yyyyMMdd")
    short = F.when(F.col("o_orderstatus") == "P", F.substring(digits, 1, 7)).otherwise(digits)
    name = F.concat(F.lit("enwiki-"), short, F.lit("-pages-articles"))
    return orders.select(
        F.col("o_orderkey").alias("id"), names.dump_date(name).cast("string").alias("day"),
        names.dump_url(F.lit("enwiki"), F.to_date("o_orderdate")).alias("url"),
    )


@check("normalize_text", "SELECT doc_id::BIGINT AS doc_id, lower(strip_accents(text)) AS norm FROM documents")
def normalize_text(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", names.normalize_text("text").alias("norm"))


@check("strip_qualifier", """SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_name || ' (' || p_type || ')'
  WHEN p_size % 3 = 1 THEN p_name ELSE '(' || p_type || ') ' || p_name END AS kept FROM part""")
def strip_qualifier(spark, sf):
    kind = F.col("p_size") % 3
    title = (
        F.when(kind == 0, F.concat("p_name", F.lit(" ("), "p_type", F.lit(") ("), "p_brand", F.lit(")")))
        .when(kind == 1, F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")))
        .otherwise(F.concat(F.lit("("), "p_type", F.lit(") "), "p_name"))
    )
    return v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), names.strip_qualifier(title).alias("kept"))


@check("display_title", f"""WITH {v.GENRE_PAGES_SQL} SELECT part AS id, nullif(coalesce(heading, root), label) AS page_title,
  coalesce(heading, root) AS shown FROM named""")
def display_title(spark, sf):
    pages = v.genre_pages(spark, sf).withColumn("title", F.coalesce(names.page_heading("page"), names.page_name("page")))
    out = pages.withColumn("page_title", names.display_title("title", "label"))
    return out.select(F.col("part").alias("id"), "page_title", F.coalesce("page_title", "label").alias("shown"))


@check("edge_type_codes", """SELECT ['Derivative', 'Subgenre', 'FusionGenre'][l_linenumber % 3 + 1] AS name, count(*) AS n,
  sum(l_linenumber % 3)::BIGINT AS codes FROM lineitem GROUP BY 1""")
def edge_type_codes(spark, sf):
    named = v.table(spark, sf, "lineitem").select(names.edge_type_name(F.col("l_linenumber") % 3).alias("name"))
    coded = named.withColumn("code", names.edge_type_code("name"))
    return coded.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("code").alias("codes"))


@check("snippets", r"""SELECT doc_id::BIGINT AS doc_id, split_part(text, chr(10), 1) AS paragraph,
  CASE WHEN contains(text, '.') THEN split_part(text, '.', 1) || '.' ELSE text END AS sentence,
  CASE WHEN length(split_part(text, chr(10), 1)) > 200 THEN regexp_replace(substr(split_part(text, chr(10), 1), 1, 200), '\s+$', '')
    ELSE split_part(text, chr(10), 1) END AS snippet,
  CASE WHEN length(split_part(text, chr(10), 1)) > 100 THEN regexp_replace(substr(split_part(text, chr(10), 1), 1, 100), '\s+$', '')
    ELSE split_part(text, chr(10), 1) END AS short FROM documents""")
def snippets(spark, sf):
    return v.table(spark, sf, "documents").select(
        "doc_id", text.first_paragraph("text").alias("paragraph"), text.first_sentence("text").alias("sentence"),
        text.snippet("text").alias("snippet"), text.snippet("text", 100).alias("short"),
    )


@check("strip_name_prefix", """SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'is in ' || c_mktsegment WHEN 1 THEN 'of ' || c_mktsegment
  WHEN 2 THEN 'is known' WHEN 3 THEN 'No name ' || c_name ELSE '(' || c_mktsegment || ')' END AS kept FROM customer""")
def strip_name_prefix(spark, sf):
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    kind = F.col("c_custkey") % 5
    body = (
        F.when(kind == 0, F.concat(F.lit("'''"), F.upper(name), F.lit("''' is in "), segment))
        .when(kind == 1, F.concat(F.lit("The '''"), name, F.lit("''', of "), segment))
        .when(kind == 2, F.concat(F.lit("{{Nihongo|{{x}}|"), name, F.lit("}} is known")))
        .when(kind == 3, F.concat(F.lit("No name "), name))
        .otherwise(F.concat(F.lit("the "), name, F.lit(" ("), segment, F.lit(")")))
    )
    body = F.when(kind == 1, F.regexp_replace(body, "''', ", "''' , ")).otherwise(body)
    return v.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), text.strip_name_prefix(name, body).alias("kept"))


@check("parse_mixes", """SELECT s_suppkey AS id, CASE WHEN s_nationkey < 5 THEN 'help' ELSE 'mixes' END AS kind,
  CASE WHEN s_nationkey < 3 THEN 'none for ' || s_name END AS help_reason,
  CASE WHEN s_nationkey < 5 THEN '' ELSE 'playlist:PL' || s_suppkey || ':good one,video:v' || s_nationkey || ':,video:' || s_suppkey || ':' END AS items
  FROM supplier""")
def parse_mixes(spark, sf):
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey")
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("https://www.youtube.com/playlist?list=PL"), key, F.lit("&x=1 # good one")),
        F.lit(""),
        F.concat(F.lit("  https://www.youtube.com/watch?v=v"), nation.cast("string")),
        F.concat(F.lit("https://youtu.be/"), key), F.col("s_name"),
    )
    raw = (
        F.when(nation < 3, F.concat(F.lit("help: none for "), "s_name"))
        .when(nation < 5, F.lit("help\n")).otherwise(lines)
    )
    got = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), text.parse_mixes(raw).alias("m"))
    items = F.transform("m.items", lambda i: F.concat(i["kind"], F.lit(":"), i["id"], F.lit(":"), F.coalesce(i["note"], F.lit(""))))
    return got.select("id", F.col("m.kind").alias("kind"), F.col("m.help_reason").alias("help_reason"), F.array_join(items, ",").alias("items"))


@check("parse_redirects", """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'Order ' || o_custkey WHEN 1 THEN 'Order ' || o_custkey
  WHEN 2 THEN 'Order_' || o_custkey END AS name, CASE WHEN o_orderkey % 5 = 1 THEN o_orderpriority END AS heading,
  CASE o_orderkey % 5 WHEN 3 THEN 'external' WHEN 4 THEN 'invalid' END AS error FROM orders""")
def parse_redirects(spark, sf):
    who, kind = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 5
    body = (
        F.when(kind == 0, F.concat(F.lit("#REDIRECT [[Order "), who, F.lit("]]\n{{R}}")))
        .when(kind == 1, F.concat(F.lit("#REDIRECT [[Order "), who, F.lit("#"), "o_orderpriority", F.lit("]]")))
        .when(kind == 2, F.concat(F.lit("#REDIRECT [http://w.example.org/i.php?title=Order_"), who, F.lit("&a=b x]")))
        .when(kind == 3, F.lit("#REDIRECT [http://other.example.org/i.php?title=A&a=b x]"))
        .otherwise(F.lit("#REDIRECT nowhere"))
    )
    got = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), text.parse_redirect(body, F.lit("w.example.org")).alias("r")
    )
    return got.select("id", "r.name", "r.heading", "r.error")


@check("clean_wikitext", r"""SELECT page_id::BIGINT AS page_id, regexp_replace(html, '<!--.*?-->', '', 'gs') AS cleaned FROM pages""")
def clean_wikitext(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", text.clean_wikitext("html").alias("cleaned"))


@check("extract_links", r"""SELECT page_id::BIGINT AS page_id, position - 1 AS position, link FROM (
  SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) AS position FROM (
    SELECT page_id, regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<a href="([^"]*)"[^>]*>([^<]*)</a>', 1) AS l FROM pages))""")
def extract_links(spark, sf):
    pages = v.wiki_pages(spark, sf)
    links = pages.select("page_id", F.posexplode(text.extract_links("text")).alias("position", "link"))
    return links.select("page_id", F.col("position").cast("long").alias("position"), "link")


def _entity_text():
    """Wiki text of a part: a box, lead text and a second box under a heading."""
    key = F.col("p_partkey").cast("string")
    return F.concat(
        F.lit("{{short description|x}}\n{{Infobox music genre\n| name = '''"), "p_name", F.lit(" "), key,
        F.lit("'''<br>other\n| stylistic_origins = {{hlist|[["), "p_brand", F.lit("|b]]|[["), "p_type", F.lit("]]}}\n| subgenres = * [["),
        key, F.lit("]]\n* [["), "p_name", F.lit("]]\n}}\n<!-- note -->{{Use dmy dates}}\n'''"), "p_name",
        F.lit("''' is<ref name=a>{{cite|p="), key, F.lit("}}</ref> a [["), "p_type", F.lit("]].\n\n== History of "), "p_brand",
        F.lit(" ==<!-- c -->\n{{Infobox song|year=1|module={{infobox music genre|fusiongenres=[["), "p_brand",
        F.lit("]]}}}}\n\n== Sound ==\nLoud "), key, F.lit(".\n== End ==\nnothing"),
    )


@check("extract_infobox", """SELECT p_name || '/' || p_partkey AS page, p_name || ' ' || p_partkey AS label, p_brand || ',' || p_type AS origins,
  p_partkey || ',' || p_name AS subgenres, '' AS fusions, '''''''' || p_name || ''''''' is a [[' || p_type || ']].' AS description FROM part
  UNION ALL SELECT p_name || '/' || p_partkey || '#History of ' || p_brand, p_name || '/' || p_partkey, '', '', p_brand, 'Loud ' || p_partkey || '.' FROM part""".replace("''''''''", "''''''''"))
def extract_infobox(spark, sf):
    pages = v.spread(v.table(spark, sf, "part"), "p_partkey").select(
        F.concat_ws("/", "p_name", F.col("p_partkey").cast("string")).alias("title"),
        F.lit("2025-01-01").cast("timestamp").alias("ts"), _entity_text().alias("text"),
    )
    genres = extract.process_genres(pages)
    return genres.select(
        "page", "label", F.array_join("stylistic_origins", ",").alias("origins"), F.array_join("subgenres", ",").alias("subgenres"),
        F.array_join("fusion_genres", ",").alias("fusions"), "description",
    )


@check("extract_lead", """SELECT p_name || '/' || p_partkey AS page, '''''''' || p_name || ''''''' is a [[' || p_type || ']].' AS description FROM part
  UNION ALL SELECT p_name || '/' || p_partkey || '#History of ' || p_brand, 'Loud ' || p_partkey || '.' FROM part""")
def extract_lead(spark, sf):
    pages = v.spread(v.table(spark, sf, "part"), "p_partkey").select(
        F.concat_ws("/", "p_name", F.col("p_partkey").cast("string")).alias("title"),
        F.lit("2025-01-01").cast("timestamp").alias("ts"), _entity_text().alias("text"),
    )
    return extract.extract_lead(pages, "genre")


@check("entity_name", """SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN p_name || ' live' WHEN 1 THEN p_brand WHEN 2 THEN p_name ELSE p_type END AS name FROM part""")
def entity_name(spark, sf):
    kind = F.col("p_size") % 4
    param = (
        F.when(kind == 0, F.concat(F.lit("'''"), "p_name", F.lit("''' live<br />"), "p_brand"))
        .when(kind == 1, F.concat(F.lit("[["), "p_name", F.lit("|"), "p_brand", F.lit("]]<ref>x</ref>")))
        .when(kind == 2, F.lit(" {{lang|x}} "))
    )
    page = F.when(kind == 2, F.col("p_name")).otherwise(F.col("p_type"))
    return v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.entity_name(param, page).alias("name"))


@check("classify_pages", """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'redirect'
    WHEN c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') THEN 'genre' WHEN c_mktsegment = 'FURNITURE' THEN 'artist' END AS kind, c_custkey FROM customer)
  WHERE kind = 'redirect' OR kind IS NOT NULL AND c_custkey % 10 <> 0 GROUP BY 1""")
def classify_pages(spark, sf):
    segment = F.col("c_mktsegment")
    body = (
        F.when(segment == "BUILDING", F.lit("#REDIRECT [[x]] {{Infobox music genre}}"))
        .when(segment == "MACHINERY", F.lit("{{Infobox music genre}}{{infobox musical artist}}"))
        .when(segment == "HOUSEHOLD", F.lit("a {{infobox music genre}}"))
        .when(segment == "FURNITURE", F.lit("{{Infobox musical artist}}"))
        .otherwise(F.lit("#redirect [[x]]"))
    )
    title = F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("User:"), "c_name")).otherwise(F.col("c_name"))
    pages = v.table(spark, sf, "customer").select(title.alias("title"), body.alias("text"))
    return extract.drop_namespaced(extract.classify_pages(pages)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@check("apply_renames", """SELECT c_custkey AS id, CASE WHEN n_name IS NOT NULL AND (o.day IS NULL OR c_custkey % 100 + 1 < n_nationkey * 4)
  THEN n_name ELSE c_mktsegment END AS label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT n_nationkey AS k, CASE WHEN n_regionkey > 0 THEN 1 END AS day FROM nation) o ON o.k = c_nationkey""")
def apply_renames(spark, sf):
    minute = F.lit("2025-01-01").cast("timestamp")
    entities = v.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("title"),
        F.col("c_mktsegment").alias("label"), (minute + F.make_dt_interval(mins=F.col("c_custkey") % 100)).alias("revision"),
    )
    renames = v.table(spark, sf, "nation").select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("page"), F.col("n_name").alias("new_label"),
        F.when(F.col("n_regionkey") > 0, minute + F.make_dt_interval(mins=F.col("n_nationkey") * 4)).alias("fixed_at"),
    )
    return extract.apply_renames(entities, renames).select("id", "label")


@check("drop_ignored", f"""WITH {v.GENRE_PAGES_SQL} SELECT page FROM named WHERE NOT (heading IS NULL AND p_size > 30)
  AND NOT (heading IS NOT NULL AND p_size = 7)""")
def drop_ignored(spark, sf):
    pages = v.genre_pages(spark, sf)
    part = v.table(spark, sf, "part").select(F.col("p_partkey").alias("part"), "p_size")
    parts = pages.join(part, "part").select(
        names.page_name("page").alias("name"), names.page_heading("page").alias("heading"), "p_size"
    )
    heading = F.col("heading")
    ignored = parts.filter((heading.isNull() & (F.col("p_size") > 30)) | (heading.isNotNull() & (F.col("p_size") == 7)))
    return extract.drop_ignored(pages, ignored.select("name", "heading")).select("page")


@check("duplicate_pages", """SELECT p_name AS page, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1""")
def duplicate_pages(spark, sf):
    return extract.duplicate_pages(v.table(spark, sf, "part").select(F.col("p_name").alias("page")))


@check("relation_count", "SELECT p_partkey AS part, 7::BIGINT AS relations FROM part")
def relation_count(spark, sf):
    counted = extract.relation_count(v.genre_pages(spark, sf))
    return counted.select("part", F.col("relations").cast("long").alias("relations"))
