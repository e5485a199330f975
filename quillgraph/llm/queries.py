"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import ann, best_position, chat, divergence, exact, lm, mixing, packing, quality, sharding, simhash, token_counts, toxicity
from quillgraph.llm.common import fold, table
from quillgraph.llm.registry import query

SHARD_BYTES = 1 << 20


@query("op3_lm_scoring")
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


@query(
    "op4_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents, by their id's CRC-32, are the history that the index is built from."""
    return exact.exact_dedup(table(spark, sf_dir, "documents"), fold("doc_id", 2) == 0)


@query(
    "op7_sharding",
    f"""
    WITH keyed AS (
        SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
               ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 10))::BIGINT AS key
        FROM documents),
    deep AS (
        SELECT doc_id, bytes, key, depth::INT AS depth, key >> (40 - depth) AS prefix FROM keyed, range(0, 41) AS r(depth)),
    summed AS (
        SELECT *, sum(bytes) OVER b AS shard_bytes, count(*) OVER b AS shard_docs
        FROM deep WINDOW b AS (PARTITION BY depth, prefix)),
    leaf AS (
        SELECT * FROM summed WHERE shard_bytes <= {SHARD_BYTES} OR shard_docs = 1
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1)
    SELECT doc_id, bytes, substr(CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END, 1) AS shard,
           depth, shard_bytes::BIGINT AS shard_bytes, shard_docs
    FROM leaf
    """,
)
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)


@query("op1_mixing")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_simhash_near_dedup")
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_nearest_neighbours")
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack_documents(table(spark, sf_dir, "documents"), digest=True)
    return placed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"
    )


@query("op10_chat_formatting")
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one, -1, whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_chat(turns), in_order=True)


@query("op13_token_counts")
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query(
    "op12_source_divergence",
    r"""
    WITH d AS (
        SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM documents),
    said AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
    counted AS (SELECT lang, source, term, count(*) AS n FROM said GROUP BY ALL),
    kept AS (SELECT lang, term FROM (SELECT DISTINCT id, lang, term FROM said) GROUP BY lang, term HAVING count(*) >= 10),
    sizes AS (SELECT lang, 2 * count(*) AS v2 FROM kept GROUP BY lang),
    groups AS (SELECT DISTINCT lang, source FROM d),
    cells AS (
        SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n, v2
        FROM groups JOIN kept USING (lang) JOIN sizes USING (lang) LEFT JOIN counted USING (lang, source, term)),
    p AS (
        SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + v2) AS p
        FROM cells),
    q AS (
        SELECT lang, term, 1 + (1000000000 * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + v2) AS q
        FROM cells GROUP BY lang, term, v2),
    summed AS (
        SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
        FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    told AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
        FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN summed AS s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        UNION ALL
        SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value::BIGINT AS value,
           (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
    FROM told QUALIFY part = 'pair' OR rank <= 10
    """,
)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query(
    "op11_ranked_search",
    r"""
    WITH said AS (
        SELECT doc_id, row_number() OVER () AS id,
               regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM documents),
    d AS (SELECT id, doc_id, terms, len(terms)::BIGINT AS n FROM said WHERE len(terms) > 0),
    total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM d),
    asked AS (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark),
    query AS (SELECT item_id, term, count(*)::BIGINT AS times FROM asked GROUP BY ALL),
    word AS (SELECT id, doc_id, n, unnest(terms) AS term FROM d),
    posting AS (SELECT id, doc_id, n, term, count(*)::BIGINT AS tf FROM word GROUP BY ALL),
    df AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM posting, total GROUP BY term, docs),
    impact AS (
        SELECT id, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))) AS score
        FROM posting JOIN df USING (term), total),
    ranked AS (
        SELECT item_id, id, doc_id, sum(times * score)::BIGINT AS score
        FROM impact JOIN query USING (term) GROUP BY ALL HAVING sum(times * score) > 0)
    SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
    FROM ranked QUALIFY rank <= 10
    """,
)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_position.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
