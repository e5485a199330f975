"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Of all document rates that take a source's target number of words, with no rate
above ``CAP``, entropy balancing picks those closest to 1 in relative entropy.
The solution tilts rates exponentially: ``rate = min(CAP, exp(tilt * size))``
with one tilt per source, the root of a convex dual's slope.  Newton steps find
all tilts side by side; a step that leaves the known bracket is replaced by its
middle.  A step sums over the distinct sizes of each source, not over documents.

Rates become whole copies: copy ``u`` of a document is taken where ``u`` plus a
hash of its id in [0, 1) is below its rate.  That threshold is moved a little
for each source and size class, from the longest documents to the shortest, so
that what the longer ones miss the shorter ones make up.  Sums are decimals, so
reruns agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph import scale
from quillgraph.llm.common import WORD, text_of, wrapped

CAP = 3
CYCLE = 3
# Bins per copy of the distance between a copy's hash and the rate.
BINS = 128
CLOSE = 1e-7
ROUNDS = 200
# Rows of a table of sources that are still broadcast.
BROADCAST_ROWS = 50_000
_EXACT = "decimal(38,6)"


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: str = "source") -> Column:
    """A key that tells a null source from any other."""
    return F.when(F.col(source).isNull(), "-").otherwise(F.concat(F.lit("+"), source))


def _joined(rows: DataFrame, table: DataFrame, on: list[str], n: int, how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(table) if n <= BROADCAST_ROWS else table, on, how)


def source_targets(rows: DataFrame) -> tuple[DataFrame, int]:
    """``(key, source_size, target)`` from ``(key, source, size)`` rows, and the number of sources.

    Weights 1, 2, 3 repeat over the sources by code point, null last.  A target
    stops at ``CAP`` times its source's size and the rest is shared again.
    """
    sizes = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    ranked = scale.with_dense_index(sizes, [F.col("source").asc_nulls_last()], "rank")
    sources, n = scale.cut_counted(ranked.select("key", "source_size", (F.col("rank") % CYCLE + 1).alias("weight")))
    most, unit, before = F.col("source_size") * CAP, 0.0, None
    while unit != before:
        before = unit
        stopped = F.col("weight") * F.lit(unit) > most
        got = sources.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(stopped, most)).alias("stopped"), F.sum(F.when(~stopped, F.col("weight"))).alias("weights")
        ).first()
        if got["weights"]:
            unit = (got["total"] - (got["stopped"] or 0)) / got["weights"]
    target = F.least(F.col("weight") * F.lit(unit), most.cast("double"))
    return sources.select("key", "source_size", target.alias("target")), n


def tilts(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``(key, source_size, target, tilt)``: the Newton iterations on the dual."""
    sizes = scale.cut(rows.filter("size > 0").groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")))
    least = sizes.groupBy("key").agg(F.min("size").alias("least"))
    ratio = F.log(F.try_divide("target", "source_size"))
    state = targets.join(least, "key", "left").select(
        "key", "source_size", "target", F.lit(0.0).alias("tilt"),
        # At the lower end no rate is above target / size, at the upper end all are at the cap.
        F.when(ratio < 0, ratio / F.col("least")).otherwise(0.0).alias("lo"),
        F.when(ratio > 0, F.log(F.lit(float(CAP))) / F.col("least")).otherwise(0.0).alias("hi"),
        ((F.col("target") == 0) | F.col("least").isNull()).alias("done"),
    )
    state = scale.cut(state)
    for _ in range(ROUNDS):
        if state.filter("NOT done").isEmpty():
            break
        power = F.col("tilt") * F.col("size")
        part = F.col("n") * F.col("size") * F.exp(F.least(power, F.log(F.lit(float(CAP)))))
        sums = sizes.join(state.filter("NOT done").select("key", "tilt"), "key").groupBy("key").agg(
            F.sum(part.cast(_EXACT)).cast("double").alias("taken"),
            F.sum(F.when(power < F.log(F.lit(float(CAP))), (part * F.col("size")).cast(_EXACT))).cast("double").alias("slope"),
        )
        miss = F.col("taken") - F.col("target")
        lo, hi = F.when(miss < 0, F.col("tilt")).otherwise(F.col("lo")), F.when(miss > 0, F.col("tilt")).otherwise(F.col("hi"))
        step = F.col("tilt") - F.try_divide(miss, F.col("slope"))
        close = (F.abs(miss) <= CLOSE * F.col("target")) | (hi - lo <= 1e-15 * F.greatest(F.abs(lo), F.abs(hi)))
        inside = (step > lo) & (step < hi)
        done = F.col("done") | F.coalesce(close, F.lit(True))
        tilt = F.when(done, F.col("tilt")).otherwise(F.when(inside, step).otherwise((lo + hi) / 2))
        old = state.join(sums, "key", "left")
        state = scale.cut(
            old.select("key", "source_size", "target", tilt.alias("tilt"), F.when(done, F.col("lo")).otherwise(lo).alias("lo"), F.when(done, F.col("hi")).otherwise(hi).alias("hi"), done.alias("done"))
        )
    return state.select("key", "source_size", "target", "tilt")


def _rate(rows: DataFrame) -> DataFrame:
    """Adds the size ``class``, the ``rate``, and the ``bins`` of the copies 0 to ``CAP - 1``."""
    rate = F.least(F.exp(F.least(F.col("tilt") * F.col("size"), F.lit(1.2))), F.lit(float(CAP)))
    uniform = F.shiftrightunsigned(F.xxhash64("doc_id", "size", F.lit("mix")), 11) / F.lit(float(1 << 53))
    rows = rows.withColumn("class", F.length(F.bin("size"))).withColumn("rate", F.when(F.col("target") == 0, 0.0).otherwise(rate))
    above = uniform - F.col("rate") + CAP
    return rows.withColumn("bins", F.array(*(F.floor((above + u) * BINS).cast("int") for u in range(CAP))))


def _thresholds(rows: DataFrame, tilted: DataFrame, n: int) -> DataFrame:
    """``(key, class, below)``: of that class copies with a bin under ``below`` are taken."""
    rated = _rate(_joined(rows, tilted, ["key"], n)).filter("size > 0").select("key", "class", "size", "rate", F.posexplode("bins").alias("u", "bin"))
    bins = rated.groupBy("key", "class", "bin").agg(
        F.sum("size").alias("s"), F.sum(F.when(F.col("u") == 0, F.col("rate") * F.col("size")).otherwise(0.0).cast(_EXACT)).alias("e")
    )
    classes = bins.groupBy("key", "class").agg(F.sort_array(F.collect_list(F.struct("bin", "s"))).alias("bins"), F.sum("e").cast("double").alias("e"))
    walks = classes.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("class", "e", "bins")), asc=False).alias("classes"),
        F.sum(F.col("e").cast(_EXACT)).cast("double").alias("e"),
    ).join(tilted.select("key", "target"), "key")

    def nearest(want: Column, bins: Column) -> Column:
        """How far to go through the bins so that their words come nearest to ``want``."""
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("below"), F.lit(0.0).alias("got"))

        def step(acc: Column, b: Column) -> Column:
            total = acc["sum"] + b["s"]
            better = F.abs(total - want) < F.abs(acc["got"] - want)
            return F.struct(
                total.alias("sum"), F.when(better, b["bin"] + 1).otherwise(acc["below"]).alias("below"), F.when(better, total).otherwise(acc["got"]).alias("got")
            )

        return F.aggregate(bins, start, step)

    empty = F.expr("cast(array() as array<struct<class: int, below: int>>)")
    begin = F.struct((F.col("target") - F.col("e")).alias("carry"), empty.alias("out"))

    def walk(acc: Column, c: Column) -> Column:
        want = acc["carry"] + c["e"]
        # Bound once: a lambda over an array of one keeps the inner walk from running twice.
        found = F.transform(F.array(nearest(want, c["bins"])), lambda x: F.struct(
            (want - x["got"]).alias("carry"), F.concat(acc["out"], F.array(F.struct(c["class"].alias("class"), x["below"].alias("below")))).alias("out")
        ))
        return found[0]

    walked = walks.select("key", F.explode(F.aggregate("classes", begin, walk)["out"]).alias("at"))
    return walked.select("key", F.col("at")["class"].alias("class"), F.col("at")["below"].alias("below"))


def plan(docs: DataFrame) -> tuple[DataFrame, int]:
    """What each source and size class gets: ``key, class, source_size, target, tilt, below``; and its rows."""
    rows = scale.cut(docs.select("doc_id", "source", _source_key().alias("key"), words().alias("size")))
    targets, n = source_targets(rows)
    tilted = scale.cut(tilts(rows, targets))
    below = _thresholds(rows, tilted, n)
    every = below.join(tilted, "key").unionByName(tilted.select("*", F.lit(1).alias("class"), F.lit(0).alias("below")).join(below, ["key", "class"], "left_anti"))
    return scale.cut_counted(every)


def mix(docs: DataFrame, whole: bool = False) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, rate`` of every document.

    With ``whole`` it is the documents themselves, each as often as the mix
    takes it.  A null text holds 0 words, documents without words count once
    and take nothing, a null source is a source, repeated rows are rows of
    their own with equal copies.  No rows give no rows.
    """
    dealt, n = plan(docs)
    more = {"doc_id": F.col("doc_id"), "key": _source_key(), "size": words()}
    rows = wrapped(docs, **more) if whole else docs.select(*(v.alias(k) for k, v in more.items()))
    rows = rows.withColumn("class", F.greatest(F.length(F.bin("size")), F.lit(1)))
    rated = _rate(_joined(rows, dealt, ["key", "class"], n))
    taken = F.size(F.filter("bins", lambda b: b < F.col("below")))
    copies = F.when(F.col("size") == 0, 1).otherwise(taken).cast("int")
    if whole:
        return rated.select("doc", F.explode(F.array_repeat(F.lit(1), copies))).select("doc.*")
    return rated.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "rate")
