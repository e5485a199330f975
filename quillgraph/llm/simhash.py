"""SimHash near-dedup: every pair of fingerprints within the radius, by tiled exact comparison.

Distinct fingerprints are dealt to tiles by the population counts of their four
16-bit quarters.  Two fingerprints that differ in at most ``radius`` bits have
quarter counts that differ by at most ``radius`` in sum, so all other tile
pairs are skipped; a remaining pair is compared whole, with numpy exclusive-or
and bit counts.  A tile has at most about ``TILE`` fingerprints: larger ones
are cut in parts.  Each part streams past the tiles near it, so a task holds
two parts at a time whatever the number of fingerprints.

What a comparison sends on is a spanning forest of its links, not the pairs,
so a group of near copies gives no more rows than it has members in each tile.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillgraph import scale
from quillgraph.llm import labelled
from quillgraph.llm.common import normal_words, text_of, wrapped

SHINGLE = 4
SEED = 42
RADIUS = 4
TILE = 2_048
SLICE = 256
HASHES = 1 << 14


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits: each is set if over half of the shingle hashes have it; 0 without words."""
    words = normal_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[: len(words) - shingle] + 1).tolist()
    ends = ends[shingle - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), HASHES):
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + HASHES], ends[at : at + HASHES])]
        counts += np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, **more: Column) -> DataFrame:
    """``doc_id``, the columns of ``more`` and the fingerprint ``fp`` as a signed number, one row per document."""
    kept = docs.select(F.col("text"), F.col("doc_id").cast("long").alias("doc_id"), *(v.alias(k) for k, v in more.items()))
    names = kept.columns[1:]

    def run(batches):
        for batch, texts in labelled.text_blocks(batches, 0):
            found = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found)], names=[*names, "fp"])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[1:]] + ["fp bigint"])
    return kept.mapInArrow(run, schema)


def _quarters(fp: str) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, 48 - 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of quarter counts within the radius, one of each pair of opposite ones, and none."""
    steps = range(-radius, radius + 1)
    return [d for d in itertools.product(steps, repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]


def close(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all pairs of rows of ``a`` and ``b`` that differ in at most ``radius`` bits."""
    left, right = [], []
    for at in range(0, len(a), SLICE):
        i, j = np.nonzero(np.bitwise_count(a[at : at + SLICE, None] ^ b[None, :]) <= radius)
        left.append(i + at)
        right.append(j)
    return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])


def forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest number in the component of each of ``n`` nodes."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, left, root[right])
        np.minimum.at(root, right, root[left])
        while (root != root[root]).any():
            root = root[root]
        if (before == root).all():
            return root


def _linked(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the comparison of two tiles joins, at most one for each fingerprint."""
    left, right = close(a, b, radius)
    both = np.concatenate([a, b])
    root = forest(left, right + len(a), len(both))
    one, other = both[root], both
    apart = one != other
    return one[apart], other[apart]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, held = None, None, []

        def flush():
            one, other = _linked(own, np.concatenate(held), radius)
            held.clear()
            if len(one):
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(other.view(np.int64))], names=["src", "dst"])

        for batch in batches:
            for tile, part, role, fps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                fps = fps.values.to_numpy(zero_copy_only=False).view(np.uint64)
                if (tile, part) != key:
                    if held:
                        yield from flush()
                    key = (tile, part)
                if role == 0:
                    own = fps
                else:
                    held.append(fps)
                    if sum(map(len, held)) >= TILE:
                        yield from flush()
        if held:
            yield from flush()

    return run


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(src, dst)`` links that connect distinct fingerprints ``fp`` just as all links within the radius do."""
    code = lambda q: ((q[0] * 17 + q[1]) * 17 + q[2]) * 17 + q[3]
    coded = fps.select("fp", F.array(*_quarters("fp")).alias("q")).withColumn("tile", code([F.col("q")[i] for i in range(4)]))
    # At most 17**4 rows of two numbers, whatever the data: Spark may broadcast them.
    sizes = scale.cut(coded.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("parts")))
    dealt = coded.join(F.broadcast(sizes), "tile").withColumn("part", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    tiles = scale.cut(dealt.groupBy("tile", "part").agg(F.first("q").alias("q"), F.collect_list("fp").alias("fps")))
    near = F.explode(F.array(*(F.array(*map(F.lit, d)) for d in _offsets(radius))))
    moved = tiles.withColumn("d", near).withColumn("o", F.zip_with("q", "d", lambda q, d: q - d))
    moved = moved.filter(F.forall("o", lambda x: (x >= 0) & (x <= 16))).select(
        F.col("tile").alias("from_tile"), F.col("part").alias("from_part"), "fps", code([F.col("o")[i] for i in range(4)]).alias("tile")
    )
    there = moved.join(F.broadcast(sizes), "tile").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    there = there.filter((F.col("tile") != F.col("from_tile")) | (F.col("part") <= F.col("from_part")))
    every = tiles.select("tile", "part", F.lit(0).alias("role"), "fps").unionByName(there.select("tile", "part", F.lit(1).alias("role"), "fps"))
    ordered = every.repartition("tile", "part").sortWithinPartitions("tile", "part", "role")
    return ordered.mapInArrow(_compare(radius), "src bigint, dst bigint")


def _least(pairs: DataFrame, total: int) -> tuple[DataFrame, DataFrame | None]:
    """The smallest ``v`` of each ``u`` as ``m``, and the hubs: the ``u`` of so many of the ``total`` pairs that they are split, if any."""
    fair = scale.fair_share(pairs.sparkSession, total)
    seen = Observation()
    counted = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    counted = scale.cut(counted.observe(seen, F.count_if(F.col("n") > fair).alias("hubs")))
    hubs = counted.filter(F.col("n") > fair).select("u", F.ceil(F.col("n") / F.lit(fair)).cast("int").alias("_slots"))
    return counted.select("u", "m"), hubs if seen.get["hubs"] else None


def _hung(pairs: DataFrame, least: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """The pairs with the ``m`` of their ``u``; without hubs no key needs slots."""
    return pairs.join(least, "u") if hubs is None else scale.lookup_join(pairs, least, "u", spread=["v"], heavy=hubs)


def _stars(linked: DataFrame) -> DataFrame:
    """``(fp, component)`` of linked fingerprints, by alternating large and small stars (Kiveris et al., 2014).

    Every round hangs larger neighbours, then smaller ones, on the smallest
    neighbour, until each component is one star around its smallest member.
    """

    def stored(pairs: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        kept = scale.cut(pairs.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")))
        return kept, seen.get

    pairs, mark = stored(linked.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct())
    before = None
    while mark != before:
        before = mark
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, hubs = _least(both, 2 * mark["n"])
        least = least.select("u", F.least("u", "m").alias("m"))
        large = _hung(both.filter("v > u"), least, hubs)
        large, n = scale.cut_counted(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low, hubs = _least(large, n)
        small = _hung(large, low, hubs).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        pairs, mark = stored(small.unionByName(low.withColumnRenamed("m", "v")).distinct())
    return pairs.select(F.col("u").alias("fp"), F.col("v").alias("component"))


def components(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fp, component)`` of the fingerprints of ``rows``: a component is named by one of its fingerprints."""
    fps = scale.cut(rows.select("fp").distinct())
    joined = _stars(links(fps, radius))
    return fps.join(joined, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document.

    ``component_id`` is the smallest id of the documents that can be reached
    over links; null ids do not count unless there is no other.  Null text
    counts as empty; texts without words have fingerprint 0.  Repeated rows
    belong to one component.  No rows give no rows.
    """
    rows = scale.cut(fingerprints(docs))
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    told = scale.cut(first.join(components(rows, radius), "fp"))
    names = told.groupBy("component").agg(F.min("least").alias("component_id"))
    named = scale.lookup_join(told, names, "component", spread=["fp"], stored=True).select("fp", "component_id")
    # A text without words, or one that is copied often, is a hot fingerprint.
    hot = scale.cut(scale.heavy_of(told, "fp", "n"))
    return scale.lookup_join(rows, named, "fp", spread=["doc_id"], heavy=hot).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns."""
    text_hash = F.xxhash64(text_of())
    rows = scale.cut(fingerprints(docs, text_hash=text_hash))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = rows.groupBy("fp").agg(F.min(order).alias("first")).join(components(rows, radius), "fp")
    kept = first.groupBy("component").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_hash")
    told = wrapped(docs, own_id=F.col("doc_id"), own=text_hash)
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("text_hash"))
    return told.join(kept, same, "left_semi").dropDuplicates(["own_id", "own"]).select("doc.*")
