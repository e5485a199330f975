"""Exact dedup against a minimal perfect hash of historical digests.

The distinct SHA-256 digests of the historical documents are dealt to buckets
of about ``BUCKET`` keys.  Each bucket is one row of the index: the bit levels
of a minimal perfect hash, and for every slot the full digest, the locator of
its winner and the number of rows behind it.  A lookup computes the slot and
compares all 32 bytes, so a digest outside the history is never mistaken for a
member.  Members join the group of their slot; the others are grouped among
themselves.

Rows are looked up in groups of at most about ``ROWS`` rows: a bucket that a
hot text fills beyond that is split over several copies of its index row.
Only ids and digests are shuffled, never texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph import scale
from quillgraph.llm.common import mix64, partitions_for, text_of, wrapped

BUCKET = 2_048
ROWS = 8_192
# Positions per key and level: more give fewer levels, fewer give less space.
SPARE = 1.5

LOCATOR = "struct<doc_id: bigint, row: bigint>"
INDEX = f"bucket int, n int, sizes array<int>, bits array<binary>, digests binary, winners array<{LOCATOR}>, counts array<bigint>"
FOUND = f"row bigint, slot int, winner {LOCATOR}, count bigint"


def digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(text_of(text), 256))


def _positions(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (mix64(keys[:, 0] ^ mix64(keys[:, 1] + seed)) % np.uint64(size)).astype(np.int64)


def _keys(digests: np.ndarray) -> np.ndarray:
    """Two 64-bit words of each digest."""
    return np.ascontiguousarray(digests[:, :16]).view("<u8")


def hash_levels(digests: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit levels of a minimal perfect hash of distinct digests, and each one's slot.

    A key takes the first level where no other key wants its position; its slot
    is the number of positions taken before it.
    """
    keys = _keys(digests)
    slots = np.full(len(keys), -1, np.int64)
    left, levels, taken = np.arange(len(keys)), [], 0
    while len(left):
        size = max(1, int(len(left) * SPARE))
        at = _positions(keys[left], len(levels), size)
        bits = np.bincount(at, minlength=size) == 1
        alone = bits[at]
        rank = np.cumsum(bits) - 1
        slots[left[alone]] = taken + rank[at[alone]]
        levels.append(bits)
        taken += int(bits.sum())
        left = left[~alone]
    return levels, slots


def find_slots(digests: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The slot that each digest would have; -1 where no level takes it."""
    keys = _keys(digests)
    slots = np.full(len(keys), -1, np.int64)
    left, taken = np.arange(len(keys)), 0
    for number, bits in enumerate(levels):
        at = _positions(keys[left], number, len(bits))
        hit = bits[at]
        rank = np.cumsum(bits) - 1
        slots[left[hit]] = taken + rank[at[hit]]
        taken += int(bits.sum())
        left = left[~hit]
    return slots


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in column), np.uint8).reshape(-1, 32)


def _index_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(rows["digest"])
    levels, slots = hash_levels(digests)
    order = np.argsort(slots)
    return pd.DataFrame(
        {
            "bucket": [int(rows["bucket"].iloc[0])],
            "n": [len(rows)],
            "sizes": [[len(x) for x in levels]],
            "bits": [[np.packbits(x).tobytes() for x in levels]],
            "digests": [digests[order].tobytes()],
            "winners": [rows["winner"].iloc[order].tolist()],
            "counts": [rows["count"].iloc[order].tolist()],
        }
    )


def _look_up(rows: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    winners = np.full(len(rows), None, object)
    counts = np.full(len(rows), None, object)
    slots = np.full(len(rows), -1, np.int64)
    if len(index) and len(rows):
        slot_row = index.iloc[0]
        levels = [np.unpackbits(np.frombuffer(b, np.uint8))[:n].astype(bool) for n, b in zip(slot_row["sizes"], slot_row["bits"])]
        digests = _matrix(rows["digest"])
        slots = find_slots(digests, levels)
        stored = np.frombuffer(slot_row["digests"], np.uint8).reshape(-1, 32)
        slots[(slots >= 0) & (stored[np.maximum(slots, 0)] != digests).any(axis=1)] = -1
        for at in np.flatnonzero(slots >= 0):
            winners[at] = slot_row["winners"][slots[at]]
            counts[at] = slot_row["counts"][slots[at]]
    return pd.DataFrame({"row": rows["row"], "slot": slots, "winner": winners, "count": pd.array(counts, dtype="Int64")})


def groups_of(rows: DataFrame) -> DataFrame:
    """``(digest, winner, count)``: the largest id, of repeated rows the last, wins."""
    return rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("winner"), F.count(F.lit(1)).alias("count"))


def build_index(history: DataFrame) -> tuple[DataFrame, int]:
    """Index rows of the distinct digests in ``(digest, winner, count)``, and the number of buckets."""
    history, n = scale.cut_counted(history)
    buckets = partitions_for(n, BUCKET)
    dealt = history.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))
    return scale.cut(dealt.groupBy("bucket").applyInPandas(_index_bucket, INDEX)), buckets


def look_up(rows: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """``(row, slot, winner, count)`` of each ``(row, digest)``; slot -1 and nulls outside the history."""
    rows = rows.select("row", "digest", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket"))
    shares = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(ROWS)).cast("int").alias("shares"))
    parts = rows.join(shares, "bucket").withColumn("part", F.pmod(F.xxhash64("row"), "shares").cast("int"))
    copies = index.join(shares, "bucket").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    left = parts.select("row", "digest", "bucket", "part").groupBy("bucket", "part")
    return left.cogroup(copies.drop("shares").groupBy("bucket", "part")).applyInPandas(_look_up, FOUND)


def exact_dedup(docs: DataFrame, historical: Column | None = None) -> DataFrame:
    """Groups of equal texts: ``doc_id, keep_id, group_size, kept, text_sha256``, one row per document.

    ``historical`` marks the documents that were there before; the others are
    looked up in their index.  Null text counts as empty, a null id as the
    smallest.  Of equal texts the row with the largest id stays; of repeated
    rows with that id exactly one.  No rows give no rows, all rows historical
    or none are both fine, and other columns do not matter.
    """
    old = F.lit(True) if historical is None else F.coalesce(historical, F.lit(False))
    rows = scale.cut(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
            digest().alias("digest"), old.alias("old"),
        )
    )
    index, buckets = build_index(groups_of(rows.filter("old")))
    found = look_up(rows, index, buckets)
    # What came later: repeats of a slot and groups of non-members alike.
    later = groups_of(rows.filter("NOT old")).select("digest", F.col("winner").alias("late"), F.col("count").alias("later"))
    hot = scale.cut(scale.heavy_keys(rows, "digest"))
    merged = scale.lookup_join(rows, later, "digest", "left", spread=["row"], heavy=hot).join(found, "row")
    keep = F.when(F.col("winner").isNull() | (F.col("late") > F.col("winner")), F.col("late")).otherwise(F.col("winner"))
    size = F.coalesce("count", F.lit(0)) + F.coalesce("later", F.lit(0))
    return merged.select(
        "doc_id", keep["doc_id"].alias("keep_id"), size.cast("long").alias("group_size"),
        (F.col("row") == keep["row"]).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The documents that stay, each once, with all their columns."""
    kept = exact_dedup(docs).filter("kept").select("doc_id", F.unhex("text_sha256").alias("digest"))
    told = wrapped(docs, own_id=F.col("doc_id"), own=digest())
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("digest"))
    # Of repeated rows with one id and text any one stays.
    return told.join(kept, same, "left_semi").dropDuplicates(["own_id", "own"]).select("doc.*")
