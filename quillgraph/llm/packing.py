"""Best-fit packing of tokenised documents by hierarchical residual packing.

Every partition packs its own pieces best-fit by decreasing length.  Bins that
are nearly full are done; the others go up a tree as items of the next round,
where fewer partitions pack them best-fit again, until one partition is left or
a round merges nothing any more.  What goes up is short: most bins are full
after the first round, and a partition never gets more than ``ITEMS`` items.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph import scale
from quillgraph.llm import tokens
from quillgraph.llm.common import partitions_for

LENGTH = 1_024
END = 2
# Residual tokens of a bin that counts as nearly full.
SLACK = 2
FAN_IN = 8
ITEMS = 100_000

_PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32())]
_BIN = pa.schema([("fill", pa.int32()), ("members", pa.list_(pa.struct([("uid", pa.int64()), ("offset", pa.int32())])))])
BIN = "fill int, members array<struct<uid: bigint, offset: int>>"


def default_tokenizer() -> str:
    """Path of the tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut_documents(docs: DataFrame, length: int = LENGTH, end: int = END, tokenizer: str | None = None, digest: bool = False) -> DataFrame:
    """Pieces ``doc_id, piece, start, length, ids`` of every document's ids and the end id.

    Only documents of more than ``length`` ids are cut, the first piece taking
    the remainder.  ``ids`` are little-endian unsigned 32-bit numbers; with
    ``digest`` there is their CRC-32 ``ids_crc32`` instead.  Null text counts as
    empty, so such a document is the end id alone.
    """
    path = tokenizer or default_tokenizer()
    schema = pa.schema([*_PIECE, ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path).encode
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "")
                ids.append(end)
                n = len(ids)
                starts = [0, *range(n % length or length, n, length)]
                for piece, start in enumerate(starts):
                    part = ids[start : starts[piece + 1] if piece + 1 < len(starts) else n]
                    if sys.byteorder == "big":
                        part.byteswap()
                    packed = part.tobytes()
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(packed) if digest else packed))
                size += n
                if size > 1 << 20:
                    yield _batch(rows, schema)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, schema)

    kept = "ids_crc32 bigint" if digest else "ids binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(
        run, f"doc_id bigint, piece int, start bigint, length int, {kept}"
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Bins of item numbers: items by decreasing size, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_rest: list[list[int]] = [[] for _ in range(length + 1)]
    rests = 0  # bit r is set while some bin has r left
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = rests >> size
        if fits:
            rest = size + (fits & -fits).bit_length() - 1
            number = by_rest[rest].pop()
            if not by_rest[rest]:
                rests ^= 1 << rest
            bins[number].append(item)
        else:
            rest, number = length, len(bins)
            bins.append([item])
        rest -= size
        by_rest[rest].append(number)
        rests |= 1 << rest
    return bins


def _pack(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fills: list[int] = []
        members: list[list] = []

        def packed():
            for chosen in best_fit(np.array(fills, np.int64), length):
                held, base = [], 0
                for i in chosen:
                    held += [(m["uid"], m["offset"] + base) for m in members[i]]
                    base += fills[i]
                yield base, held

        def out():
            held = []
            for row in packed():
                held.append(row)
                if len(held) == 4_096:
                    yield _batch(held, _BIN)
                    held = []
            if held:
                yield _batch(held, _BIN)

        for batch in batches:
            fills += batch.column(0).to_pylist()
            members += batch.column(1).to_pylist()
            if len(fills) >= 2 * ITEMS:
                yield from out()
                fills.clear()
                members.clear()
        if fills:
            yield from out()

    return run


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``uid, sequence_id, offset`` for every ``(uid, length)``; pieces of full length are sequences of their own."""
    item = F.struct("uid", F.lit(0).alias("offset"))
    items = pieces.select(F.col("length").cast("int").alias("fill"), F.array(item).alias("members"))
    full = F.col("fill") >= length - SLACK
    done = [items.filter(F.col("fill") == length)]
    bins, n = scale.cut_counted(items.filter(F.col("fill") < length).mapInArrow(_pack(length), BIN))
    parts = bins.rdd.getNumPartitions()
    while n:
        done.append(bins.filter(full))
        rest = bins.filter(~full)
        before, last = rest.count(), parts == 1
        if before == 0:
            break
        parts = max(parts // FAN_IN, partitions_for(before, ITEMS), 1)
        # Dealt by a hash of the first member: reruns agree.
        merged, n = scale.cut_counted(rest.repartition(parts, F.xxhash64(F.col("members")[0]["uid"])).mapInArrow(_pack(length), BIN))
        if last or n > 0.99 * before and parts == 1:
            done.append(merged)
            break
        if n > 0.99 * before:
            parts = 1 if partitions_for(n, ITEMS) == 1 else parts
            if parts > 1:  # nothing merges any more, and one task must not get it all
                done.append(merged)
                break
        bins = merged
    numbered = scale.union_all(done).withColumn("sequence_id", F.monotonically_increasing_id())
    placed = numbered.select("sequence_id", F.explode("members").alias("member"))
    return placed.select(F.col("member")["uid"].alias("uid"), "sequence_id", F.col("member")["offset"].cast("long").alias("offset"))


def pack_documents(docs: DataFrame, length: int = LENGTH, end: int = END, tokenizer: str | None = None, digest: bool = False) -> DataFrame:
    """Every piece of ``cut_documents`` with its place: columns ``sequence_id, offset`` more.

    Repeated rows are packed each; a null id stays null; no rows give no rows.
    """
    pieces = scale.cut(cut_documents(docs, length, end, tokenizer, digest).withColumn("uid", F.monotonically_increasing_id()))
    return pieces.join(pack(pieces.select("uid", "length"), length), "uid").drop("uid")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id, ids, starts``; at most ``length`` ids each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    grouped = placed.groupBy("sequence_id").agg(parts.alias("parts"))
    whole = F.aggregate("parts", F.unhex(F.lit("")), lambda out, p: F.concat(out, p["ids"]))
    return grouped.select("sequence_id", whole.alias("ids"), F.transform("parts", lambda p: p["offset"]).alias("starts"))
