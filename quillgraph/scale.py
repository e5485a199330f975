"""Shared ways of keeping jobs whole and balanced on a large cluster.

Three things every operator leans on:

* ``cut`` ends a lineage with a reliable checkpoint, so a lost executor costs
  one round and not the whole loop;
* ``lookup_join`` joins rows to a table whose key is hot without sending the
  hot key to one task;
* ``with_dense_index`` numbers rows in a total order without a one-task sort.
"""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

# A key is heavy if it holds more rows than this share of an even task's.
SHARE = 0.25
# So many tasks for each shuffle partition take rows of several texts, which would fill a task's memory.
FINER = 8
# A stored table whose estimated bytes take more bits than this is planned as one of unknown size.
SANE_BITS = 64


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def finer(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by ``keys`` to ``FINER`` times as many tasks as a shuffle has, for sorts and groups of wide rows."""
    return df.repartition(FINER * _tasks(df.sparkSession), *keys)


def fair_rows(counts: DataFrame, n: str = "_n") -> Column:
    """Rows that a key may hold without being split: a share of the rows per task, as a scalar."""
    spark = counts.sparkSession
    share = float(spark.conf.get("quillgraph.heavyShare", str(SHARE)))
    fair = F.coalesce(F.floor(F.sum(n) * share / _tasks(spark)), F.lit(0))
    return counts.agg(F.greatest(fair, F.lit(2)).cast("long").alias("fair")).scalar()


def fair_share(spark: SparkSession, total: int) -> int:
    """``fair_rows`` of ``total`` rows that are counted already."""
    share = float(spark.conf.get("quillgraph.heavyShare", str(SHARE)))
    return max(2, int(total * share / _tasks(spark)))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of its own only for a session without executors elsewhere."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quillgraph.checkpointDir", None)
    if folder is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("quillgraph.checkpointDir", folder)
    return folder


def cut(df: DataFrame, placed: bool = False) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names.

    The shuffle files it was made from go as soon as it is written, not when the
    driver happens to collect its garbage.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    # A frame reads the setting when it is planned, so this takes one of its own.
    with _setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        stored = df.select("*").checkpoint(eager=True)
    return stored if placed else _estimated(stored)


def _estimated(stored: DataFrame) -> DataFrame:
    """``stored``, without its estimated size if that is beyond all tables.

    Spark takes the size of a join for the product of both sides and carries it
    through checkpoints, so it has a multiple of its digits after each round of
    a loop, until planning a join of a few rows takes minutes.
    """
    spark = stored.sparkSession
    plan = stored._jdf.queryExecution()
    if plan.optimizedPlan().stats().sizeInBytes().bit_length() <= SANE_BITS:
        return stored
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), stored._jdf.schema(), False), spark)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    """Spark's setting ``name`` is ``value`` within the block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut`` and the number of rows, counted while they are written."""
    seen = Observation()
    stored = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return stored, seen.get["n"]


def heavy_keys(df: DataFrame, key: str) -> DataFrame:
    """The keys worth splitting: ``(key, _slots)``.

    A key is split when it holds more than ``SHARE`` of an even task's rows, so
    there are at most tasks / ``SHARE`` such keys, whatever the data: the list
    may be broadcast, and no key outside it weighs on a task.
    """
    return heavy_of(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key)


def heavy_of(counts: DataFrame, key: str, n: str = "_n") -> DataFrame:
    """``heavy_keys`` from rows that have been counted already."""
    told = counts.withColumn("_fair", fair_rows(counts, n)).filter(F.col(n) > F.col("_fair"))
    return told.select(key, F.ceil(F.col(n) / F.col("_fair")).cast("int").alias("_slots"))


def split_rows(facts: DataFrame, key: str, heavy: DataFrame, spread: list[str] | None = None) -> DataFrame:
    """Give every row of a heavy key one of its slots, by a hash of ``spread``."""
    columns = [F.col(c) for c in (spread or [c for c in facts.columns if c != key])]
    slot = F.pmod(F.xxhash64(*columns), F.coalesce("_slots", F.lit(1))).cast("int")
    return facts.join(F.broadcast(heavy), key, "left").withColumn("_slot", slot).drop("_slots")


def copy_to_slots(dim: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """Repeat every row of a heavy key once per slot."""
    slots = F.sequence(F.lit(0), F.coalesce("_slots", F.lit(1)) - 1)
    return dim.join(F.broadcast(heavy), key, "left").withColumn("_slot", F.explode(slots)).drop("_slots")


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    how: str = "inner",
    spread: list[str] | None = None,
    heavy: DataFrame | None = None,
    stored: bool = False,
) -> DataFrame:
    """``facts`` joined to ``dim`` on ``key`` where ``facts`` may hold hot keys.

    The few heavy keys of ``facts`` are split over slots and the matching rows
    of ``dim`` repeated once per slot, so the result is the plain join's.
    ``how`` may be ``inner``, ``left``, ``left_semi`` or ``left_anti``.  The
    keys are counted before the join: facts that are not ``stored`` yet are
    stored first, so that they are made once.
    """
    if heavy is None:
        facts = facts if stored else cut(facts)
        heavy = heavy_keys(facts, key)
    left = split_rows(facts, key, heavy, spread)
    right = copy_to_slots(dim, key, heavy)
    return left.join(right, [key, "_slot"], how).drop("_slot")


def for_lookups(facts: DataFrame, key: str, spread: list[str], stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """Store ``facts`` for many joins on ``key``: the rows with ``_slot``, the heavy keys.

    The rows are stored as they are placed by ``[key, "_slot"]``.  Join
    ``copy_to_slots(other, key, heavy)`` to them on these two columns: only the
    other side moves.
    """
    facts = facts if stored else cut(facts)
    heavy = cut(heavy_keys(facts, key))
    placed = split_rows(facts, key, heavy, spread).repartition(_tasks(facts.sparkSession), key, "_slot")
    return cut_placed(placed), heavy


def lists_for_lookups(facts: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """``for_lookups`` with one row per key and slot: ``(key, _slot, value)``, its values in a sorted list.

    Facts are ``stored``.  A key that holds more than a share of an even task's
    rows has several slots, so no list holds many more than that share.
    """
    heavy = cut(heavy_keys(facts, key))
    placed = split_rows(facts, key, heavy, [value]).repartition(_tasks(facts.sparkSession), key, "_slot")
    lists = placed.groupBy(key, "_slot").agg(F.sort_array(F.collect_list(value)).alias(value))
    return cut_placed(lists), heavy


def cut_placed(df: DataFrame) -> DataFrame:
    """``cut`` that remembers how the rows are placed: a plan that may still be changed at run time tells no placement."""
    with _setting(df.sparkSession, "spark.sql.adaptive.enabled", "false"):
        return cut(df, placed=True)


def with_dense_index(df: DataFrame, order: list[Column], name: str = "index") -> DataFrame:
    """Add the 0-based position of each row in ``order`` (which must be total).

    Range partitions are sorted side by side; only their row counts, one number
    per partition, are summed up in one place.
    """
    parts = _tasks(df.sparkSession)
    local_row = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    ranged = cut(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", local_row)
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_row") + F.col("_offset"))
        .drop("_part", "_row", "_offset")
    )


def merge_levels(levels: list[DataFrame], every: int = 8) -> list[DataFrame]:
    """Keep the union of loop results shallow: fold the pieces now and then."""
    if len(levels) < every:
        return levels
    folded = levels[0]
    for level in levels[1:]:
        folded = folded.unionByName(level)
    return [cut(folded)]


def union_all(pieces: list[DataFrame]) -> DataFrame:
    result = pieces[0]
    for piece in pieces[1:]:
        result = result.unionByName(piece)
    return result
