"""Links, counts, ranking, graph build and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check
from quillgraph import scale
from quillgraph.functions import names
from quillgraph.operators import audit, build, extract, graph, links, rank
from quillgraph.sinks import documents as sink
from quillgraph.sources import curation


@check("resolve_redirects", f"""WITH RECURSIVE {v.REDIRECTS_SQL}
  SELECT 'part ' || part AS link, 'Part ' || stop AS page, CASE WHEN part <> stop THEN 'Part ' || part END AS alias FROM resolved""")
def resolve_redirects(spark, sf):
    found, aliases = links.resolve_redirects(v.real_parts(spark, sf), v.brand_redirects(spark, sf))
    named = aliases.select(F.lower("alias").alias("link"), "alias")
    return found.join(named, "link", "left").select("link", "page", "alias")


@check("lookup_links", f"""WITH {v.CUSTOMER_BRANDS_SQL} SELECT artist, position, brand AS page FROM brands WHERE NOT starts_with(brand, 'Brand#2')""")
def lookup_links(spark, sf):
    refs = v.customer_brands(spark, sf).select(F.col("page").alias("artist"), F.posexplode("genres").alias("position", "raw_link"))
    found = links.lookup_links(refs, "raw_link", v.brand_links(spark, sf))
    return found.select("artist", F.col("position").cast("long").alias("position"), "page")


def _targets(spark, sf):
    return v.table(spark, sf, "part").select(
        F.col("p_partkey").alias("lt_id"), F.when(F.col("p_size") % 7 == 0, 1).otherwise(0).alias("ns"),
        F.concat_ws(" ", F.lit("Part"), F.col("p_partkey").cast("string")).alias("title"),
    )


def _tracked(spark, sf):
    small = v.table(spark, sf, "part").filter("p_size < 10")
    return small.select(F.concat_ws(" ", F.lit("Part"), F.col("p_partkey").cast("string")).alias("title"))


def _pagelinks(spark, sf):
    return v.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("from_id"), F.col("l_linenumber").alias("from_ns"), F.col("l_partkey").alias("target_id")
    )


@check("tracked_linktargets", """SELECT p_partkey AS lt_id, 'Part ' || p_partkey AS title FROM part WHERE p_size < 10 AND p_size % 7 <> 0""")
def tracked_linktargets(spark, sf):
    return links.tracked_linktargets(_targets(spark, sf), _tracked(spark, sf))


@check("links_to_tracked", """SELECT 'Part ' || l_partkey AS title, count(*) AS n, sum(l_orderkey)::BIGINT AS sources FROM lineitem
  JOIN part ON l_partkey = p_partkey WHERE p_size < 10 AND p_size % 7 <> 0 GROUP BY 1""")
def links_to_tracked(spark, sf):
    kept = links.tracked_linktargets(_targets(spark, sf), _tracked(spark, sf))
    rows = links.links_to_tracked(_pagelinks(spark, sf), kept)
    return rows.groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.sum("from_id").alias("sources"))


@check("inbound_counts", """SELECT 'Part ' || p_partkey AS title, CASE WHEN p_size % 7 = 0 THEN 0 ELSE count(l_partkey) END AS n FROM part
  LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_size < 10 GROUP BY p_partkey, p_size""")
def inbound_counts(spark, sf):
    tracked = _tracked(spark, sf)
    return links.inbound_counts(_pagelinks(spark, sf), links.tracked_linktargets(_targets(spark, sf), tracked), tracked)


@check("aggregated_link_count", f"""WITH RECURSIVE {v.REDIRECTS_SQL}, n AS (SELECT l_partkey AS part, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT 'Part ' || stop AS page, coalesce(sum(n), 0)::BIGINT AS links FROM resolved LEFT JOIN n USING (part) GROUP BY 1""")
def aggregated_link_count(spark, sf):
    pages = v.real_parts(spark, sf)
    _, aliases = links.resolve_redirects(pages, v.brand_redirects(spark, sf))
    counted = v.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    counts = counted.select(F.concat_ws(" ", F.lit("Part"), F.col("l_partkey").cast("string")).alias("title"), "n")
    return links.aggregated_link_count(pages, aliases, counts)


@check("tracked_pages", f"""WITH {v.GENRE_PAGES_SQL} SELECT c_name AS title FROM customer UNION SELECT root FROM named
  UNION SELECT p_name FROM part UNION SELECT c_name FROM customer WHERE c_nationkey < 5""")
def tracked_pages(spark, sf):
    customers = v.table(spark, sf, "customer")
    aliases = v.table(spark, sf, "part").select(F.col("p_name").alias("alias")).unionByName(
        customers.filter("c_nationkey < 5").select(F.col("c_name").alias("alias"))
    )
    return links.tracked_pages(customers.select(F.col("c_name").alias("page")), v.genre_pages(spark, sf), aliases)


@check("position_weight", f"""WITH {v.CUSTOMER_BRANDS_SQL} SELECT artist, position, brand AS raw_link,
  round(CASE WHEN total = 1 THEN 1 ELSE 0.1 + 0.9 * pow(0.5, position / (total - 1)::DOUBLE) END, 6)::DOUBLE AS weight FROM brands""")
def position_weight(spark, sf):
    rows = rank.weighted_links(v.customer_brands(spark, sf), "double")
    return rows.select(F.col("page").alias("artist"), F.col("position").cast("long").alias("position"), "raw_link", F.round("weight", 6).alias("weight"))


SCORES_SQL = f"""WITH {v.CUSTOMER_BRANDS_SQL}, {v.CUSTOMER_LINKS_SQL}, scores AS (SELECT brand AS genre, artist,
  links * CASE WHEN total = 1 THEN 1 ELSE 0.1 + 0.9 * pow(0.5, position / (total - 1)::DOUBLE) END AS score
  FROM brands JOIN cust USING (artist) WHERE NOT starts_with(brand, 'Brand#2'))"""


def _scores(spark, sf):
    return rank.artist_scores(
        v.customer_brands(spark, sf), v.customer_links(spark, sf), v.brand_links(spark, sf), "double"
    )


@check("artist_scores", f"{SCORES_SQL} SELECT genre, artist, round(score, 6)::DOUBLE AS score FROM scores")
def artist_scores(spark, sf):
    return _scores(spark, sf).withColumn("score", F.round("score", 6))


@check("top_artists", f"""{SCORES_SQL} SELECT genre, artist, round(score, 9)::DOUBLE AS score, rank FROM (SELECT *, row_number() OVER (
  PARTITION BY genre ORDER BY round(score, 9) DESC, artist) AS rank FROM scores) WHERE rank <= 10""")
def top_artists(spark, sf):
    best = rank.top_artists(_scores(spark, sf).withColumn("score", F.round("score", 9)))
    return best.select("genre", "artist", "score", F.col("rank").cast("long").alias("rank"))


@check("artist_genres", f"""WITH {v.CUSTOMER_BRANDS_SQL} SELECT artist, brand AS genre FROM brands WHERE NOT starts_with(brand, 'Brand#2')""")
def artist_genres(spark, sf):
    return rank.artist_genres(v.customer_brands(spark, sf), v.brand_links(spark, sf))


def _genre_nodes(spark, sf):
    return build.assign_node_ids(v.genre_pages(spark, sf))


@check("assign_node_ids", f"WITH {v.GENRE_PAGES_SQL} SELECT page, node_id FROM ids")
def assign_node_ids(spark, sf):
    return _genre_nodes(spark, sf).select("page", "node_id")


@check("root_fallback", f"""WITH {v.GENRE_PAGES_SQL} SELECT page, node_id FROM ids WHERE heading IS NOT NULL
  UNION ALL SELECT root, min(node_id) FROM ids GROUP BY 1""")
def root_fallback(spark, sf):
    return build.page_ids(_genre_nodes(spark, sf))


@check("relation_edges", f"WITH {v.GENRE_PAGES_SQL}, {v.RELATIONS_SQL} SELECT src, dst, ty, src_label, dst_label FROM found")
def relation_edges(spark, sf):
    found = build.relation_edges(_genre_nodes(spark, sf), v.genre_links(spark, sf))
    return found.withColumn("ty", F.col("ty").cast("int"))


def _rejects(spark, sf):
    part = v.table(spark, sf, "part").filter("p_size > 40")
    label = F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))
    twice = part.select((F.col("p_partkey") * 2).alias("k"), label.alias("src_label"))
    target = v.nodes(spark, sf).select(F.col("node_id").alias("k"), F.col("label").alias("dst_label"))
    found = twice.join(target, "k").select("src_label", "dst_label", F.lit(1).cast("tinyint").alias("ty"))
    return found.unionByName(curation.curation_tables(spark)["rejected_edges"])


REJECTED_SQL = """kept AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM part a JOIN part b ON b.p_partkey = a.p_partkey * 2
  WHERE a.p_size > 40 AND f.ty = 1 AND f.src_label = a.p_name || ' ' || a.p_partkey AND f.dst_label = b.p_name || ' ' || b.p_partkey))"""


@check("reject_edges", f"WITH {v.GENRE_PAGES_SQL}, {v.RELATIONS_SQL}, {REJECTED_SQL} SELECT src, dst, ty FROM kept")
def reject_edges(spark, sf):
    found = build.relation_edges(_genre_nodes(spark, sf), v.genre_links(spark, sf))
    return build.reject_edges(found, _rejects(spark, sf)).select("src", "dst", F.col("ty").cast("int").alias("ty"))


PARENTS_SQL = """parents AS (SELECT p.node_id AS src, i.node_id AS dst, 1 AS ty FROM ids i JOIN (SELECT root, min(node_id) AS node_id
  FROM ids GROUP BY 1) p USING (root) WHERE i.heading IS NOT NULL AND p.node_id <> i.node_id)"""


@check("heading_parent_edges", f"WITH {v.GENRE_PAGES_SQL}, {PARENTS_SQL} SELECT src, dst, ty FROM parents")
def heading_parent_edges(spark, sf):
    return build.heading_parent_edges(_genre_nodes(spark, sf)).withColumn("ty", F.col("ty").cast("int"))


@check("edge_union", f"""WITH {v.GENRE_PAGES_SQL}, {v.RELATIONS_SQL}, {REJECTED_SQL}, {PARENTS_SQL}
  SELECT src, dst, ty FROM kept UNION SELECT src, dst, ty FROM parents""")
def edge_union(spark, sf):
    pages = _genre_nodes(spark, sf)
    found = build.reject_edges(build.relation_edges(pages, v.genre_links(spark, sf)), _rejects(spark, sf))
    return build.edge_union(found, build.heading_parent_edges(pages)).withColumn("ty", F.col("ty").cast("int"))


def _raw_aliases(spark, sf):
    """Part names of an order's parts as redirect titles of the customer."""
    lines = v.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = v.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    parts = v.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(parts, lines["l_partkey"] == parts["p_partkey"])
    plain = F.concat_ws(" ", "p_name", F.lower("p_type"))
    title = (
        F.when(F.col("l_quantity") < 10, F.concat(F.upper(plain), F.lit(" ("), "p_brand", F.lit(")")))
        .when(F.col("l_quantity") < 20, plain)
        .when(F.col("l_quantity") < 25, F.concat(plain, F.repeat(F.lit(" long"), F.lit(12))))
        .otherwise(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")))
    )
    raw = joined.select(F.concat(F.lit("Cust "), F.col("o_custkey").cast("string")).alias("page"), title.alias("alias"))
    return scale.finer(raw, "page", "alias").distinct()


ALIASES_SQL = """raw AS (SELECT DISTINCT 'Cust ' || o_custkey AS page, CASE WHEN l_quantity < 10 THEN upper(p_name || ' ' || lower(p_type)) || ' (' || p_brand || ')'
    WHEN l_quantity < 20 THEN p_name || ' ' || lower(p_type) WHEN l_quantity < 25 THEN p_name || ' ' || lower(p_type) || repeat(' long', 12)
    ELSE p_name || ' (' || p_brand || ')' END AS alias
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
shown AS (SELECT page, alias, trim(regexp_replace(alias, ' \\([^()]*\\)$', '')) AS shown FROM raw),
firsts AS (SELECT page, lower(shown) AS norm, arg_min(shown, alias) AS shown FROM shown WHERE shown <> '' AND length(shown) <= 60 GROUP BY 1, 2)"""


@check("first_alias", f"WITH {ALIASES_SQL} SELECT page, norm, shown FROM firsts")
def first_alias(spark, sf):
    raw = _raw_aliases(spark, sf).withColumn("shown", F.trim(names.strip_qualifier("alias")))
    kept = raw.filter((F.col("shown") != "") & (F.char_length("shown") <= build.MAX_ALIAS_LENGTH))
    return build.first_alias(kept.withColumn("norm", names.normalize_text("shown")))


@check("clean_aliases", f"""WITH {ALIASES_SQL}, numbered AS (SELECT page, shown, row_number() OVER (PARTITION BY page ORDER BY strlen(shown), shown) AS n
  FROM firsts JOIN customer ON page = 'Cust ' || c_custkey WHERE norm NOT IN (lower(c_mktsegment), lower(page), 'old bolt'))
  SELECT 'Cust ' || c_custkey AS page, coalesce(string_agg(shown, '|' ORDER BY n), '') AS aliases FROM customer
  LEFT JOIN numbered ON page = 'Cust ' || c_custkey AND n <= 32 GROUP BY 1""")
def clean_aliases(spark, sf):
    customers = v.table(spark, sf, "customer").select(
        F.concat(F.lit("Cust "), F.col("c_custkey").cast("string")).alias("page"), F.lit("Old bölt").alias("label"), "c_mktsegment"
    )
    segments = _raw_aliases(spark, sf).unionByName(customers.select("page", F.col("page").alias("alias")))
    lists = build.clean_aliases(customers.select("page", F.lit("OLD BOLT").alias("label")), segments)
    return lists.select("page", F.array_join("aliases", "|").alias("aliases"))


@check("artist_genre_ids", f"""WITH {v.CUSTOMER_BRANDS_SQL}, b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS node_id FROM
  (SELECT DISTINCT p_brand FROM part WHERE NOT starts_with(p_brand, 'Brand#2'))) SELECT artist, string_agg(node_id, ',' ORDER BY node_id) AS genres
  FROM brands JOIN b ON brand = p_brand GROUP BY 1""")
def artist_genre_ids(spark, sf):
    ids = build.assign_node_ids(v.brand_links(spark, sf).select("page"))
    pairs = rank.artist_genres(v.customer_brands(spark, sf), v.brand_links(spark, sf))
    lists = build.artist_genre_ids(pairs, ids)
    return lists.select("artist", F.array_join(F.transform("genres", lambda g: g.cast("string")), ",").alias("genres"))


@check("attach_mixes", f"""WITH {v.MIXES_SQL} SELECT 'Part ' || p_partkey AS page, n FROM part LEFT JOIN (
  SELECT page, count(*) AS n FROM mixes GROUP BY 1) m ON m.page = 'Part ' || p_partkey""")
def attach_mixes(spark, sf):
    pages = v.table(spark, sf, "part").select(F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("page"))
    counted = v.mixes(spark, sf).groupBy("page").agg(F.count(F.lit(1)).alias("mixes"))
    return build.attach_mixes(pages, counted).select("page", F.col("mixes").alias("n"))


LOW_SQL = f"{v.MIXES_SQL}, low AS (SELECT DISTINCT 'Part ' || l_partkey AS page FROM lineitem WHERE l_discount >= 0.1)"


def _low(spark, sf):
    rows = v.table(spark, sf, "lineitem").filter("l_discount >= 0.1").select("l_partkey").distinct()
    return rows.select(F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("page"))


def _parts(spark, sf):
    pages = v.genre_pages(spark, sf)
    return pages.withColumn("page", F.concat(F.lit("Part "), F.col("part").cast("string")))


@check("missing_mixes", f"WITH {LOW_SQL} SELECT 'Part ' || p_partkey AS page FROM part WHERE page NOT IN (SELECT page FROM low)")
def missing_mixes(spark, sf):
    return audit.missing_mixes(_parts(spark, sf), _low(spark, sf))


@check("curation_worklist", f"""WITH {LOW_SQL} SELECT page, relations, row_number() OVER (ORDER BY relations DESC, page DESC) AS place FROM (
  SELECT 'Part ' || p_partkey AS page, 7 - (p_size < 5)::INT * 2 AS relations FROM part) WHERE page NOT IN (SELECT page FROM low)""")
def curation_worklist(spark, sf):
    sizes = v.table(spark, sf, "part").select(F.col("p_partkey").alias("part"), "p_size")
    none = F.array().cast("array<string>")
    pages = _parts(spark, sf).join(sizes, "part").withColumn(
        "subgenres", F.when(F.col("p_size") < 5, none).otherwise(F.col("subgenres"))
    )
    from quillgraph import scale

    order = [F.desc("relations"), names.page_name("page").desc(), names.page_heading("page").desc_nulls_last()]
    placed = scale.with_dense_index(audit.curation_worklist(pages, _low(spark, sf)), order, "place")
    return placed.select("page", F.col("relations").cast("long").alias("relations"), (F.col("place") + 1).alias("place"))


@check("page_difference", f"WITH {LOW_SQL} SELECT page FROM low EXCEPT SELECT page FROM mixes WHERE kind = 'playlist' AND id < 'mix5'")
def page_difference(spark, sf):
    other = v.mixes(spark, sf).filter("kind = 'playlist' and id < 'mix5'")
    return audit.page_difference(_low(spark, sf), other)


@check("duplicate_mixes", f"""WITH {v.MIXES_SQL} SELECT kind, id, page, 1::BIGINT AS uses, n AS total FROM (SELECT *, count(*) OVER (PARTITION BY kind, id) AS n
  FROM mixes WHERE id <> 'mix1') WHERE n > 1""")
def duplicate_mixes(spark, sf):
    return audit.duplicate_mixes(v.mixes(spark, sf), exempt="mix1")


@check("audit_mix_status", f"""WITH {v.MIXES_SQL} SELECT page, kind, id, problem FROM (SELECT page, kind, id, unnest([
  CASE WHEN s_suppkey IS NULL OR s_nationkey = 3 THEN 'missing' END, CASE WHEN kind = 'video' AND s_nationkey <> 3 AND s_nationkey < 8 THEN 'not embeddable' END,
  CASE WHEN s_nationkey <> 3 AND s_acctbal <= 0 THEN 'not public' END]) AS problem FROM mixes LEFT JOIN supplier ON id = 'mix' || s_suppkey
  WHERE id <> 'mix1') WHERE problem IS NOT NULL""")
def audit_mix_status(spark, sf):
    status = v.table(spark, sf, "supplier").filter("s_nationkey <> 3").select(
        F.when(F.col("s_suppkey") % 2 == 0, "playlist").otherwise("video").alias("kind"),
        F.concat(F.lit("mix"), F.col("s_suppkey").cast("string")).alias("id"),
        (F.col("s_nationkey") >= 8).alias("embeddable"), (F.col("s_acctbal") > 0).alias("public"),
    )
    return audit.audit_mix_status(v.mixes(spark, sf), status, exempt="mix1")


TAGS = "<([a-z][a-z0-9]*)[^<>]*>"


@check("audit_templates", f"""WITH t AS (SELECT DISTINCT url AS page, unnest(regexp_extract_all(html, '{TAGS}', 1)) AS template FROM pages)
  SELECT template, page FROM t WHERE template NOT IN ('html', 'head', 'body', 'r', 'em_dash', 'p', 'script', 'small', 'sup', 'em', 'abbr', 'audio', 'ruby')""")
def audit_templates(spark, sf):
    docs = v.table(spark, sf, "pages").select(
        F.col("url").alias("page"), F.concat(F.regexp_replace("html", TAGS, "{{Template:$1|x}}"), F.lit("{{DEFAULTSORT:x}}{{#expr: 1}}{{em dash}}")).alias("text")
    )
    docs = docs.withColumn("text", F.replace("text", F.lit("{{Template:"), F.lit("{{template:")))
    more = spark.createDataFrame([(n, n, "component", None) for n in ("html", "head", "body", "p")], "name string, canonical string, kind string, text string")
    return audit.audit_templates(docs, curation.template_dim(spark, more)).select("template", "page")


@check("link_targets_of", r"""WITH l AS (SELECT url AS page, regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<a href="([^"]*)"[^>]*>([^<]*)</a>', 1) AS l FROM pages),
  r AS (SELECT page, unnest(l) AS link, generate_subscripts(l, 1) - 1 AS position FROM l),
  known AS (SELECT '/' || lower(word) AS link, min(doc_id) AS node_id FROM (SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS word FROM documents) GROUP BY 1)
  SELECT page, position, r.link AS link, node_id FROM r JOIN known ON lower(r.link) = known.link""")
def link_targets_of(spark, sf):
    words = v.table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("word"))
    known = words.groupBy(F.concat(F.lit("/"), F.lower("word")).alias("link")).agg(F.min("doc_id").alias("node_id"))
    found = audit.link_targets_of(v.wiki_pages(spark, sf).select("page", "text"), known)
    return found.withColumn("position", F.col("position").cast("long"))


@check("attach_revision_docs", """SELECT p_partkey AS node_id, doc.text AS description FROM part LEFT JOIN (
  SELECT doc_id, text FROM documents) doc ON doc_id = CASE WHEN p_size > 25 THEN p_partkey ELSE p_partkey // 2 END""")
def attach_revision_docs(spark, sf):
    key = F.col("p_partkey")
    title = F.when(F.col("p_size") > 25, key.cast("string"))
    nodes = v.table(spark, sf, "part").select(
        key.alias("node_id"), title.alias("page_title"), F.floor(key / 2).cast("string").alias("label")
    )
    docs = v.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("page"), F.col("text").alias("description"))
    return audit.attach_revision_docs(nodes, docs).select("node_id", "description")


@check("link_ids", f"WITH {v.GENRE_PAGES_SQL} SELECT 'part ' || part AS link, node_id FROM ids")
def link_ids(spark, sf):
    return sink.link_ids(v.genre_links(spark, sf), build.page_ids(_genre_nodes(spark, sf)))


@check("suspicious_edges", f"""WITH {v.NODES_SQL}, star AS (SELECT DISTINCT l_partkey % 5 AS dst, l_partkey AS src FROM lineitem WHERE l_partkey % 5 <> l_partkey),
  edges AS (SELECT src, dst, 0 AS ty FROM star UNION SELECT l_partkey, l_suppkey, 1 FROM lineitem WHERE l_partkey <> l_suppkey), {v.DEGREE_SQL}
  SELECT src, dst, a.label AS src_label, a.degree AS src_degree, b.label AS dst_label, b.degree AS dst_degree, round(b.degree / greatest(a.degree, 1)::DOUBLE, 6) AS ratio
  FROM edges JOIN degrees a ON src = a.node_id JOIN degrees b ON dst = b.node_id
  WHERE ty = 0 AND a.degree < b.degree AND b.degree >= 15 AND b.degree >= 5 * greatest(a.degree, 1) AND NOT starts_with(a.label, 'old')""")
def suspicious_edges(spark, sf):
    """Each part points to one of five hubs, besides its suppliers."""
    lines = v.table(spark, sf, "lineitem")
    star = lines.select(F.col("l_partkey").alias("src"), (F.col("l_partkey") % 5).alias("dst"), F.lit(0).cast("tinyint").alias("ty"))
    other = lines.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit(1).cast("tinyint").alias("ty"))
    edges = star.unionByName(other).filter("src <> dst").distinct()
    label = v.nodes(spark, sf)
    old = label.filter(F.col("label").startswith("old")).select(F.col("label").alias("src_label"), F.col("node_id"))
    hub = label.select((F.col("node_id")).alias("hub"), F.col("label").alias("dst_label"))
    reviewed = old.join(hub, F.col("node_id") % 5 == F.col("hub")).select("src_label", "dst_label", F.lit(0).cast("tinyint").alias("ty"))
    curated = curation.curation_tables(spark)
    flagged = graph.suspicious_edges(edges, label, reviewed.unionByName(curated["accepted_edges"]), curated["rejected_edges"])
    return flagged.withColumn("ratio", F.round("ratio", 6))
