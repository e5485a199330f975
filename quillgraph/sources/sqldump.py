"""Link tables published as SQL ``INSERT`` statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TARGET = r"\((-?\d+),(-?\d+),'((?:[^'\\]++|\\.)*+)'\)"
_LINK = r"\((-?\d+),(-?\d+),(-?\d+)\)"


def _statements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``INSERT`` lines, spread by hash: a gzip file arrives as a single task."""
    lines = spark.read.text(path).filter(F.col("value").startswith("INSERT INTO"))
    return lines.repartition(F.xxhash64("value"))


def parse_linktargets(lines: DataFrame) -> DataFrame:
    """``(lt_id, ns, title)`` of every tuple; a backslash keeps the next character.

    An unescaped ``_`` stands for a space.
    """
    tuples = lines.select(F.explode(F.regexp_extract_all("value", F.lit(f"({_TARGET})"), 1)).alias("t"))
    title = F.regexp_replace(F.regexp_extract("t", _TARGET, 3), r"(?<!\\)((?:\\\\)*)_", "$1 ")
    return tuples.select(
        F.regexp_extract("t", _TARGET, 1).cast("long").alias("lt_id"),
        F.regexp_extract("t", _TARGET, 2).cast("int").alias("ns"),
        F.regexp_replace(title, r"(?s)\\(.)", "$1").alias("title"),
    )


def parse_pagelinks(lines: DataFrame) -> DataFrame:
    """``(from_id, from_ns, target_id)`` of every tuple, from any namespace."""
    tuples = lines.select(F.explode(F.regexp_extract_all("value", F.lit(f"({_LINK})"), 1)).alias("t"))
    return tuples.select(
        F.regexp_extract("t", _LINK, 1).cast("long").alias("from_id"),
        F.regexp_extract("t", _LINK, 2).cast("int").alias("from_ns"),
        F.regexp_extract("t", _LINK, 3).cast("long").alias("target_id"),
    )


def read_linktargets(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_linktargets(_statements(spark, path))


def read_pagelinks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_pagelinks(_statements(spark, path))
