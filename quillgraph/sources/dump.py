"""Article dumps: pages, stream index and site info.

The dump is read as text records that end at ``</page>``.  Spark splits bzip2
files at block boundaries, so one large dump file is read by many tasks on any
file system Spark can read, and a record is never cut.

With the index of a multistream dump only the streams of wanted pages are
read: the index is filtered first, and tasks seek to the offsets that are left.
"""

from __future__ import annotations

import bz2
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import scale
from quillgraph.functions import names

# Streams per task, about 20 MB of a dump with 100 pages to a stream.
STREAMS = 64
# Bytes that a task reads at a time, and characters of records that it hands on at a time.
BLOCK, HANDED = 1 << 16, 4 << 20


def _records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("lineSep", "</page>").text(path)


def _unescape(value: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(char))
    return value


def _tag(record: Column, tag: str) -> Column:
    return F.regexp_extract(record, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)


def read_dump_pages(
    spark: SparkSession,
    path: str | list[str],
    index: str | list[str] | None = None,
    wanted: DataFrame | Column | None = None,
) -> DataFrame:
    """``(page_id, title, ts, text)`` of every page.

    ``page_id`` is the first ``<id>`` after ``<page>``, not that of a revision.

    ``index`` names the index of the multistream dump ``path``, or one index for
    each of several dump files, in their order.  Then pages are read by stream.
    ``wanted`` is a condition on ``page_id`` and ``title``, or a table with one
    or both of these columns: the index is filtered by it, streams without a
    wanted page are not read, and only wanted pages come back.
    """
    if index is None:
        if wanted is not None:
            raise ValueError("wanted pages are found through an index")
        return _pages(_records(spark, path))
    entries = _wanted(_index_entries(spark, _listed(path), _listed(index)), wanted)
    return _wanted(_pages(read_streams(entries).select("value")), wanted)


def _listed(path: str | list[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def _pages(records: DataFrame) -> DataFrame:
    record = F.regexp_extract("value", r"(?s)<page>.*", 0)
    pages = records.filter(F.col("value").contains("<page>")).select(record.alias("record"))
    body = F.col("record")
    fields = F.struct(
        F.try_to_number(_tag(body, "id"), F.lit("999999999999999999")).cast("long").alias("page_id"),
        _unescape(_tag(body, "title")).alias("title"),
        F.try_to_timestamp(_tag(body, "timestamp")).alias("ts"),
        _unescape(_tag(body, "text")).alias("text"),
    )
    # Generated rows are filtered as they are: a condition on a field does not scan the page for it again.
    return pages.select(F.inline(F.array(fields)))


def _wanted(rows: DataFrame, wanted: DataFrame | Column | None) -> DataFrame:
    if wanted is None:
        return rows
    if isinstance(wanted, Column):
        return rows.filter(wanted)
    on = [c for c in ("page_id", "title") if c in wanted.columns]
    return rows.join(wanted.select(*on), on, "left_semi")


def _index_entries(spark: SparkSession, paths: list[str], indexes: list[str]) -> DataFrame:
    """``(dump, offset, page_id, title)`` of the ``offset:id:title`` lines of every index."""
    if len(paths) != len(indexes):
        raise ValueError("every dump file needs its own index")
    dump_of = {name.rstrip("/").rsplit("/", 1)[-1]: path for name, path in zip(indexes, paths)}
    if len(dump_of) != len(indexes):
        raise ValueError("index files need different names")
    named = F.create_map(*(F.lit(x) for pair in dump_of.items() for x in pair))
    rest = F.substr("value", F.length(F.substring_index("value", ":", 1)) + 2)
    return spark.read.text(indexes).select(
        named[F.col("_metadata.file_name")].alias("dump"),
        F.substring_index("value", ":", 1).cast("long").alias("offset"),
        F.substring_index(rest, ":", 1).cast("long").alias("page_id"),
        _unescape(F.substr(rest, F.length(F.substring_index(rest, ":", 1)) + 2)).alias("title"),
    )


def read_streams(entries: DataFrame) -> DataFrame:
    """``(value, n_bytes)``: the records of the streams at ``(dump, offset)``.

    ``n_bytes`` is the compressed size of a stream on its last record, else 0.
    Neighbouring streams go to one task, which reads forward.
    """
    offsets, n = scale.cut_counted(entries.select("dump", "offset").distinct())
    tasks = max(-(-n // STREAMS), min(n, entries.sparkSession.sparkContext.defaultParallelism), 1)
    dealt = offsets.repartitionByRange(tasks, "dump", "offset").sortWithinPartitions("dump", "offset")
    return dealt.mapInArrow(_read_streams, "value string, n_bytes bigint")


def _read_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow.fs import FileSystem

    name, file = None, None
    for batch in batches:
        for dump, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if dump != name:
                # Hadoop writes local paths with one slash.
                files, where = FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", dump))
                name, file = dump, files.open_input_file(where)
            yield from _stream(file, offset)


def _stream(file: pa.NativeFile, offset: int) -> Iterator[pa.RecordBatch]:
    """The records of the stream at ``offset``, decompressed piece by piece; a stream that breaks off fails."""
    file.seek(offset)
    unpack, taken = bz2.BZ2Decompressor(), 0
    records: list[str] = []
    last, size = b"", 0
    while not unpack.eof:
        block = file.read(BLOCK)
        if not block:
            raise EOFError(f"the stream at {offset} breaks off")
        taken += len(block)
        *whole, last = (last + unpack.decompress(block)).split(b"</page>")
        records += [r.decode("utf-8", "replace") for r in whole]
        size += sum(map(len, whole))
        if size > HANDED:
            yield _handed(records, 0)
            records, size = [], 0
    yield _handed([*records, last.decode("utf-8", "replace")], taken - len(unpack.unused_data))


def _handed(records: list[str], n_bytes: int) -> pa.RecordBatch:
    sizes = [0] * (len(records) - 1) + [n_bytes]
    return pa.RecordBatch.from_arrays([pa.array(records, pa.string()), pa.array(sizes, pa.int64())], names=["value", "n_bytes"])


def read_dump_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Distinct stream offsets of an ``offset:id:title`` index, ascending."""
    offset = F.substring_index("value", ":", 1).cast("long")
    return spark.read.text(path).select(offset.alias("offset")).distinct().orderBy("offset")


def read_site_info(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row ``(domain, db_name)`` from the header of the dump.

    The header is in the first record, so ``limit`` stops after one split.
    """
    header = _records(spark, path).filter(F.col("value").contains("<siteinfo>")).limit(1)
    domain = names.url_host(_unescape(_tag(F.col("value"), "base")))
    db_name = F.nullif(_unescape(_tag(F.col("value"), "dbname")), F.lit(""))
    return header.select(
        F.coalesce(domain, F.raise_error(F.lit("no wiki domain in the dump"))).alias("domain"),
        F.coalesce(db_name, F.raise_error(F.lit("no database name in the dump"))).alias("db_name"),
    )


def check_same_dump(files: DataFrame, db_name: str = "enwiki") -> DataFrame:
    """``files(dump_name, index_name)`` plus their date; fails if they differ."""
    dump = names.dump_date("dump_name", db_name)
    index = names.dump_date("index_name", db_name)
    same = F.coalesce(dump == index, F.lit(False))
    wrong = F.raise_error(F.lit("dump and index are not of one date")).cast("date")
    return files.withColumn("dump_date", F.when(same, dump).otherwise(wrong))
