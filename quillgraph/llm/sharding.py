"""Sharding by extendible hashing: buckets split on one more hash bit until they fit.

All in DataFrame operations.  A round sums bytes per cell, a cell being a
bucket's hash prefix with ``STEP`` more bits, and finds for each cell the
shortest prefix that fits.  Cells that still hold too much are split in the
next round; only their rows take part in it.

The key has 40 bits of the id's MD5 and 20 bits of the row's number, so rows
that repeat one id are split as well once the id's bits are used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph import scale
from quillgraph.llm.common import text_of, wrapped

ID_BITS, ROW_BITS, STEP = 40, 20, 10
BITS = ID_BITS + ROW_BITS


def _bits_of(text: Column, bits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, bits // 4), 16, 10).cast("long")


def _prefix(key: str, depth: int) -> Column:
    return F.shiftright(key, BITS - depth)


def _split(rows: DataFrame, depth: int, limit: int) -> DataFrame:
    """Leaves per cell: ``bucket, cell, depth, prefix, shard_bytes, shard_docs``; depth null where none fits yet."""
    width = min(STEP, BITS - depth)
    cells = rows.groupBy(_prefix("key", depth).alias("bucket"), _prefix("key", depth + width).alias("cell")).agg(
        F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")
    )
    first = None
    for k in range(0 if depth == 0 else 1, width + 1):
        prefix = F.shiftright("cell", width - k)
        over = Window.partitionBy("bucket", prefix)
        b, n = F.sum("b").over(over), F.sum("n").over(over)
        # A single document cannot be split: it is a shard of its own, whatever its size.
        fits = (b <= limit) | (n == 1) | F.lit(depth + k == BITS)
        leaf = F.struct(F.lit(depth + k).alias("depth"), prefix.alias("prefix"), b.alias("shard_bytes"), n.alias("shard_docs"))
        first = F.when(fits, leaf) if first is None else first.when(fits, leaf)
    return cells.select("bucket", "cell", first.alias("leaf")).select("cell", "leaf.*")


def shard(docs: DataFrame, limit: int = 512 << 20) -> DataFrame:
    """One row per document: ``doc_id, bytes, shard, depth, shard_bytes, shard_docs``.

    ``shard`` is the hash prefix as a bit string, empty while all fits into
    one.  Null texts hold 0 bytes, a null id counts as empty text, repeated
    rows are rows of their own.  A document above the limit is alone in its
    shard.  No rows give no rows.
    """
    id_bits = _bits_of(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), ID_BITS)
    row_bits = _bits_of(F.monotonically_increasing_id().cast("string"), ROW_BITS)
    key = F.shiftleft(id_bits, ROW_BITS) + row_bits
    return _placed(docs.select("doc_id", F.octet_length(text_of()).cast("long").alias("bytes"), key.alias("key")), ["doc_id"], limit)


def _placed(rows: DataFrame, ids: list[str], limit: int) -> DataFrame:
    """The columns ``ids`` of ``rows(ids, bytes, key)`` with bytes and shard of each row."""
    left, n = scale.cut_counted(rows)
    depth, placed = 0, []
    while n or not placed:
        width = min(STEP, BITS - depth)
        cells = scale.cut(_split(left, depth, limit))
        dealt = left.withColumn("cell", _prefix("key", depth + width)).join(cells, "cell")
        placed.append(dealt.filter("depth IS NOT NULL").select(*ids, "bytes", "depth", "prefix", "shard_bytes", "shard_docs"))
        depth += width
        if depth == BITS:
            break
        left, n = scale.cut_counted(dealt.filter("depth IS NULL").select(*ids, "bytes", "key"))
    name = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return scale.union_all(placed).select(*ids, "bytes", name.alias("shard"), "depth", "shard_bytes", "shard_docs")


def write_shards(docs: DataFrame, path: str, limit: int = 512 << 20) -> None:
    """Write every row once, one folder ``shard=b<bits>`` for each shard (a ``b``, as bits alone would be read as a number).

    Rows are told apart by their place in the stored input, so rows that repeat
    an id, or are equal altogether, keep their number.  All columns are written;
    where one is called ``shard``, the folders take the first free name of
    ``shard_1``, ``shard_2`` and so on.
    """
    taken = {c.lower() for c in docs.columns}
    folder = next(n for n in ("shard", *(f"shard_{i}" for i in range(1, len(taken) + 2))) if n not in taken)
    rows = scale.cut(wrapped(docs, row=F.monotonically_increasing_id()))
    text, doc_id = F.coalesce(F.col("doc.text"), F.lit("")), F.coalesce(F.col("doc.doc_id").cast("string"), F.lit(""))
    key = F.shiftleft(_bits_of(doc_id, ID_BITS), ROW_BITS) + _bits_of(F.col("row").cast("string"), ROW_BITS)
    placed = _placed(rows.select("row", F.octet_length(text).cast("long").alias("bytes"), key.alias("key")), ["row"], limit)
    out = rows.join(placed.select("row", F.concat(F.lit("b"), "shard").alias("_name")), "row").select("doc.*", F.col("_name").alias(folder))
    # A shard is at most ``limit`` bytes, or one document.
    out.repartition(folder).write.partitionBy(folder).parquet(path)
