"""SimHash near-dedup of texts by the Jaccard similarity of their shingles: wide fingerprints find, sets decide.

A text's fingerprint has ``64 * LANES`` bits over its distinct shingles.
Documents are dealt to blocks by the number of their shingles: two sets whose
sizes differ by more than the similarity allows are never compared.  A pair of
blocks is compared in tiles of ``SLICE`` rows by numpy exclusive-or and bit
counts; tile pairs whose sizes or population counts lie too far apart are
skipped.  Pairs within the radius are only candidates: the shingles of both
whole texts are compared before a document goes.

What stays is settled in rounds, in the order of a hash of the documents.  The
pivots of a round are the documents without an earlier candidate and the first
ones of the order, so many that the largest group has about ``PIVOTS`` of them.
They are compared among themselves; those that stay meet the rest, which goes or
waits for the next round.  So all pairs of a group of near copies are never made.
A text travels with the first candidate of the pivots it may be similar to, not
once for each pair: pairs that are only candidates are compared in the tasks that
hold both texts and leave no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph import scale
from quillgraph.llm import labelled
from quillgraph.llm.common import mix64, normal_words, text_of, wrapped

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
LANES = 2
# Of all lanes, and of the first one, which is compared before the others.
RADIUS = 30
FIRST_RADIUS = 18
BLOCK = 32_768
SLICE = 512
HASHES = 1 << 14
# Pivots of a round in the largest group, and of texts that meet the same pivots in one task.
PIVOTS = 1024
MEETING = 512


def shingles(text: str | None, words: int = SHINGLE) -> set[bytes]:
    """The distinct shingles; of a shorter text its words together; none without words."""
    found = normal_words(text)
    if not found:
        return set()
    return {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}


def similarity(a: set[bytes], b: set[bytes]) -> float:
    """Jaccard similarity; two empty sets are equal."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def signature(text: str | None, words: int = SHINGLE) -> tuple[int, np.ndarray]:
    """The number of distinct shingles and ``LANES`` numbers of 64 bits, each bit set if over half of the shingles have it."""
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, words)], np.uint64)
    lanes = np.zeros(LANES, np.uint64)
    for lane in range(LANES if len(hashes) else 0):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), HASHES):
            some = hashes[at : at + HASHES]
            some = some if lane == 0 else mix64(some + np.uint64(lane * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            counts += np.unpackbits(some.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        lanes[lane] = int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")
    return len(hashes), lanes


def signatures(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """``id, hash, size, fp0, fp1`` of every row; ``hash`` is of the whole text."""
    kept = docs.select(text_of().alias("text"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_of()).alias("hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in labelled.text_blocks(batches, 0):
            found = [signature(t, words) for t in texts]
            sizes = pa.array([n for n, _ in found], pa.int64())
            lanes = np.array([lanes for _, lanes in found]).reshape(-1, LANES).view(np.int64)
            columns = [*batch.columns[1:], sizes, *(pa.array(np.ascontiguousarray(lanes[:, k])) for k in range(LANES))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "hash", "size", *(f"fp{k}" for k in range(LANES))])

    return kept.mapInArrow(run, ", ".join(["id bigint, hash bigint, size bigint", *(f"fp{k} bigint" for k in range(LANES))]))


def _tiles(size: np.ndarray, lanes: np.ndarray, step: float) -> list[tuple]:
    """Row numbers in tiles of like sizes and population counts, with the least and largest of both."""
    count = np.bitwise_count(lanes[:, 0]).astype(np.int64)
    order = np.lexsort((count, np.floor(np.log(np.maximum(size, 1)) / step)))
    cut = [order[at : at + SLICE] for at in range(0, len(order), SLICE)]
    return [(rows, size[rows].min(), size[rows].max(), count[rows].min(), count[rows].max()) for rows in cut]


def near(a: tuple, b: tuple, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the candidate pairs of two blocks ``(node, size, lanes)``: the second one's node is the smaller."""
    step = -np.log(least) / 4
    others = _tiles(b[1], b[2], step)
    for rows, low, high, thin, thick in _tiles(a[1], a[2], step):
        for cols, low2, high2, thin2, thick2 in others:
            if low2 * least > high or low * least > high2 or thin2 - thick > FIRST_RADIUS or thin - thick2 > FIRST_RADIUS:
                continue
            i, j = np.nonzero(np.bitwise_count(a[2][rows, 0, None] ^ b[2][cols, 0][None, :]) <= FIRST_RADIUS)
            i, j = rows[i], cols[j]
            bits = np.bitwise_count(a[2][i] ^ b[2][j]).sum(axis=1, dtype=np.int64)
            small, large = np.minimum(a[1][i], b[1][j]), np.maximum(a[1][i], b[1][j])
            kept = (bits <= RADIUS) & (small >= least * large) & (b[0][j] < a[0][i])
            if kept.any():
                yield i[kept], j[kept]


def _parts(banded: DataFrame) -> dict[int, int]:
    """In how many blocks each band is cut."""
    counted = banded.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("parts"))
    return {r["band"]: r["parts"] for r in counted.collect()}


def _looked_up(parts: dict[int, int], band: str) -> Column:
    known = F.create_map(*(F.lit(x) for item in sorted(parts.items()) for x in item)) if parts else F.lit(None).cast("map<int,int>")
    return F.try_element_at(known, F.col(band))


def _band(least: float) -> Column:
    return F.floor(F.log(F.greatest("size", F.lit(1))) / F.lit(-np.log(least))).cast("int")


def block_parts(nodes: DataFrame, least: float) -> dict[int, int]:
    """In how many blocks each band of sizes is cut: one number for every factor of 1 / least in size, some dozens, whatever the data."""
    return _parts(nodes.select(_band(least).alias("band")))


def candidates(
    left: DataFrame, right: DataFrame, least: float, first_only: bool, parts: dict[int, int] | None = None, told: str = "node"
) -> DataFrame:
    """``(v, u, n)``: nodes of ``left`` and earlier ones of ``right`` that may be similar.

    With ``first_only`` each comparison tells of a node only its first candidate,
    and has a row without ``v`` for every node of ``right`` that is one; ``n`` is
    the number of pairs a row stands for.  ``parts`` are the ``block_parts`` of
    rows that hold both sides; without them they are counted here.  ``told`` is
    the column of ``right`` to return as ``u``: without ``first_only`` a comparison
    tells a node only once of each of its values.
    """
    names = ["node", "size", *(f"fp{k}" for k in range(LANES)), "told"]
    own, other = (side.withColumn("told", F.col(c)).select(*names, _band(least).alias("band")) for side, c in ((left, "node"), (right, told)))
    if parts is None:
        parts = _parts(own if right is left else own.unionByName(other))
    own, other = (side.withColumn("part", F.pmod(F.xxhash64("node"), _looked_up(parts, "band")).cast("int")) for side in (own, other))

    def every(in_band: str):
        # No part for a band that has no rows.
        n = _looked_up(parts, in_band)
        return F.explode(F.when(n.isNotNull(), F.sequence(F.lit(0), n - 1)))

    # A block goes to every block of the other side in its own band and the two beside it.
    to = own.withColumn("band2", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).withColumn("part2", every("band2"))
    back = other.withColumnRenamed("band", "band2").withColumnRenamed("part", "part2")
    back = back.withColumn("band", F.explode(F.array(F.col("band2") - 1, F.col("band2"), F.col("band2") + 1))).withColumn("part", every("band"))
    keys = ["band", "part", "band2", "part2"]
    rows = to.select(*keys, F.lit(0).alias("side"), *names).unionByName(back.select(*keys, F.lit(1).alias("side"), *names))

    def compare(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        node, size = table["node"].to_numpy(), table["size"].to_numpy()
        lanes = np.stack([table[f"fp{k}"].to_numpy().view(np.uint64) for k in range(LANES)], axis=1)
        a, b = ((node[side == s], size[side == s], lanes[side == s]) for s in (0, 1))
        names_of_b = table["told"].to_numpy()[side == 1]
        out = [np.zeros((0, 3), np.int64)]
        if len(a[0]) and len(b[0]):
            none = np.iinfo(np.int64).max
            first, told_of, met = np.full(len(a[0]), none), np.zeros(len(a[0]), np.int64), np.zeros(len(b[0]), bool)
            for i, j in near(a, b, least):
                if first_only:
                    np.minimum.at(first, i, b[0][j])
                    told_of += np.bincount(i, minlength=len(told_of))
                    met[j] = True
                else:
                    met_once, n = np.unique(np.stack([a[0][i], names_of_b[j]], axis=1), axis=0, return_counts=True)
                    out.append(np.column_stack([met_once, n]))
            told, met = np.flatnonzero(first != none), b[0][met]
            out += [np.stack([a[0][told], first[told], told_of[told]], axis=1), np.stack([np.full(len(met), -1), met, np.zeros(len(met), np.int64)], axis=1)]
        pairs = np.concatenate(out)
        if not first_only:
            once, back = np.unique(pairs[:, :2], axis=0, return_inverse=True)
            pairs = np.column_stack([once, np.bincount(back.ravel(), pairs[:, 2], len(once)).astype(np.int64)])
        return pa.table({"v": pa.array(pairs[:, 0], mask=pairs[:, 0] < 0), "u": pairs[:, 1], "n": pairs[:, 2]})

    return rows.groupBy(*keys).applyInArrow(compare, "v bigint, u bigint, n bigint")


def similar_pairs(asked: DataFrame, pivots: DataFrame, texts: DataFrame, words: int, least: float, every: bool) -> DataFrame:
    """``(v, u)``: nodes and earlier pivots of a group they ask whose fingerprints are near and whose shingles have at least the similarity.

    ``asked`` has ``(v, group)`` and is stored, ``pivots`` ``(node, group)``,
    ``texts`` the node's size, fingerprint and ``text``.  Without ``every`` a node
    is told of one such pivot of a group.  Nodes that ask a large group are dealt
    to many tasks, each with the group's pivots.
    """
    counts = asked.groupBy("group").agg(F.count(F.lit(1)).alias("_n"))
    most = F.greatest(scale.fair_rows(counts), F.lit(MEETING))
    heavy = counts.withColumn("_most", most).filter("_n > _most").select("group", F.ceil(F.col("_n") / F.col("_most")).cast("int").alias("_slots"))
    heavy = scale.cut(heavy)
    second = scale.split_rows(texts.withColumnRenamed("node", "v").join(asked, "v"), "group", heavy, ["v"]).withColumnRenamed("v", "node")
    first = pivots.join(asked.select("group").distinct(), "group", "left_semi").join(texts, "node")
    first = scale.copy_to_slots(first, "group", heavy)
    columns = ["group", "_slot", "side", "node", "size", *(f"fp{k}" for k in range(LANES)), "text"]
    ordered = first.withColumn("side", F.lit(0)).select(*columns).unionByName(second.withColumn("side", F.lit(1)).select(*columns))
    ordered = ordered.repartition("group", "_slot").sortWithinPartitions("group", "_slot", "side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets, known, rows, block = None, [], {}, [], None
        for batch in batches:
            us, vs = [], []
            told = zip(*(batch.column(k).to_pylist() for k in range(5 + LANES)), batch.column(5 + LANES))
            for group, slot, side, node, size, *lanes, text in told:
                if (group, slot) != at:
                    at, sets, known, rows, block = (group, slot), [], {}, [], None
                found = shingles(text.as_py(), words)
                if side == 0:
                    # Equal shingles of the pivots are held once.
                    sets.append(frozenset(known.setdefault(x, x) for x in found))
                    rows.append((node, size, *lanes))
                    continue
                if block is None:
                    block = np.array(rows, np.int64).reshape(-1, 2 + LANES)
                bits = np.bitwise_count((block[:, 2:] ^ np.array(lanes, np.int64)).view(np.uint64)).astype(np.int64)
                kept = (block[:, 0] < node) & (bits[:, 0] <= FIRST_RADIUS) & (bits.sum(axis=1) <= RADIUS)
                kept &= np.minimum(block[:, 1], size) >= least * np.maximum(block[:, 1], size)
                for j in np.flatnonzero(kept):
                    if similarity(sets[j], found) >= least:
                        us.append(rows[j][0])
                        vs.append(node)
                        if not every:
                            break
            yield pa.RecordBatch.from_arrays([pa.array(vs, pa.int64()), pa.array(us, pa.int64())], names=["v", "u"])

    return ordered.mapInArrow(run, "v bigint, u bigint")


def later_of_similar(pairs: DataFrame) -> DataFrame:
    """``node``: those that are similar to an earlier one that stays, when all similar ``pairs`` ``(v, u)`` are known."""
    levels = []
    pairs, n = scale.cut_counted(pairs.select("v", "u"))
    while n:
        # Nobody earlier is similar to it: it stays, and all that are similar to it go.
        stay = pairs.select(F.col("u").alias("node")).distinct().join(pairs.select(F.col("v").alias("node")).distinct(), "node", "left_anti")
        out = scale.cut(pairs.join(stay.withColumnRenamed("node", "u"), "u", "left_semi").select(F.col("v").alias("node")).distinct())
        levels = scale.merge_levels([*levels, out])
        rest = pairs.join(out.withColumnRenamed("node", "v"), "v", "left_anti").join(out.withColumnRenamed("node", "u"), "u", "left_anti")
        pairs, n = scale.cut_counted(rest)
    return scale.union_all(levels) if levels else pairs.select(F.col("v").alias("node"))


def keep_dissimilar(docs: DataFrame, words: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """One document of each group of similar texts, with all its columns.

    No two documents that stay are a found pair of at least the similarity
    ``least``, and every one that goes has such a pair with one that stays.
    Null text counts as empty; texts without words are similar to each other.
    Of repeated rows of one id and text one stays.  No rows give no rows.
    """
    rows = scale.cut(signatures(docs, words).distinct())
    order = [F.xxhash64("id", "hash"), F.col("id"), F.col("hash")]
    nodes, documents = scale.cut_counted(scale.with_dense_index(rows, order, "node"))
    parts = block_parts(nodes, least)
    told = wrapped(docs, own_id=F.col("doc_id").cast("long"), own=F.xxhash64(text_of()), body=text_of())
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("hash"))
    active, texts, gone, done = nodes, None, [], 0
    columns = ["node", "size", *(f"fp{k}" for k in range(LANES))]
    while done < documents:
        first = candidates(active, active, least, first_only=True, parts=parts)
        # A node's group is that of its first candidate; without an earlier one it is that candidate of others.
        met = first.select(F.coalesce("v", "u").alias("node"), F.col("u").alias("group")).groupBy("node").agg(F.min("group").alias("group"))
        met, n = scale.cut_counted(active.join(met, "node"))
        if n == 0:
            break
        # The texts of documents that have a candidate or are one are fetched once.
        if texts is None:
            used = met.select(*columns, "id", "hash")
            texts = told.select("own_id", "own", "body").join(used, same).select(*columns, F.col("body").alias("text")).dropDuplicates(["node"])
        else:
            texts = texts.join(met, "node", "left_semi")
        texts = scale.cut(texts)
        largest = met.groupBy("group").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        # The order is that of a hash: so much of it holds about as much of each group.
        done = documents if largest <= PIVOTS else done + max(1, (documents - done) * PIVOTS // largest)
        early = (F.col("group") == F.col("node")) | (F.col("node") < done)
        pivots, later = met.filter(early), met.filter("group < node")
        asked = scale.cut(candidates(later, pivots, least, first_only=False, parts=parts, told="group").select("v", F.col("u").alias("group")).distinct())
        asked = asked.join(later.select(F.col("node").alias("v"), early.alias("early")), "v")
        own = scale.cut(asked.filter("early").drop("early"))
        out = later_of_similar(similar_pairs(own, pivots.select("node", "group"), texts, words, least, every=True))
        if done == documents:
            gone.append(out)
            break
        out = scale.cut(out)
        stay = pivots.select("node", "group").join(out, "node", "left_anti")
        rest = scale.cut(asked.filter("NOT early").drop("early"))
        meets = similar_pairs(rest, stay, texts, words, least, every=False)
        gone.append(scale.cut(out.unionByName(meets.select(F.col("v").alias("node")).distinct())))
        active = scale.cut(later.filter(~early).drop("group").join(gone[-1], "node", "left_anti"))
    kept = nodes
    if gone:
        kept = nodes.join(scale.union_all(gone), "node", "left_anti")
    kept = kept.select("id", "hash")
    return told.join(kept, same, "left_semi").dropDuplicates(["own_id", "own"]).select("doc.*")
