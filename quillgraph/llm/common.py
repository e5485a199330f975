"""Small pieces that the operators of this package share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wrapped(docs: DataFrame, **more: Column) -> DataFrame:
    """The documents as one column ``doc``, so that no name of theirs clashes with ``more``."""
    return docs.select(F.struct("*").alias("doc"), *(value.alias(name) for name, value in more.items()))


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def fold(doc_id: str, modulus: int) -> Column:
    """CRC-32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def normal_words(text: str | None) -> list[bytes]:
    """UTF-8 words with A-Z lowered; ``bytes.split`` knows just the ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def partitions_for(rows: int, per_partition: int) -> int:
    """How many partitions keep about ``per_partition`` rows each."""
    return max(1, -(-rows // per_partition))


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit keys evenly."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
