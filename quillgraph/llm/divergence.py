"""Divergence of each source from its language, term by term, by in-mapper stripes.

A task folds whole documents into a hash of stripes: for a term of a language
its document frequency and its count in each source.  When the hash holds
``ENTRIES`` counts it is spilled as rows and begun anew.  The rows are sorted by
key in their partition of the shuffle and merged as they stream by, so a term
that every task has seen costs one row per spill and never a group in memory.

A merged stripe holds all there is to know of its term, so the divergences of
all pairs of sources, and of each source from the language, come from it alone:
the tasks sum up one matrix per language and keep ten terms per group.  Only
these sums meet in a last shuffle.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph import scale

LEAST_DOCS = 10
TOP = 10
UNIT = 1_000_000_000
# Counts that a task holds before it spills; cells of a matrix and of one step's arrays; groups described to the tasks at once; rows of a batch.
ENTRIES = 1_000_000
CELLS = 1 << 20
STEP = 1 << 18
GROUPS = 100_000
ROWS = 8_192

LIST = pa.list_
_STRIPE = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("df", pa.int64()), ("sources", LIST(pa.string())), ("counts", LIST(pa.int64()))])
STRIPE = "lang string, term binary, df bigint, sources array<string>, counts array<bigint>"
_SUM = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
SUM = "lang string, source string, part string, item string, value bigint"

# Letters of ASCII lowered, all else of ASCII a blank; bytes from 0x80 up belong to terms.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters and characters outside ASCII, A-Z lowered, as UTF-8."""
    return text.encode("utf-8").translate(_LETTERS).split(b" ")


class Language(NamedTuple):
    """What a task must know of a language: how many terms are kept, its sources and their counts of kept terms."""

    kept: int
    sources: list[str]
    sizes: list[int]


class Stripes:
    """The hash of one task: per language document frequencies, per group counts."""

    def __init__(self) -> None:
        self.df: dict[str, Counter] = defaultdict(Counter)
        self.counts: dict[tuple[str, str], Counter] = {}

    def add(self, lang: str, source: str, text: str) -> None:
        words = Counter(terms(text))
        words.pop(b"", None)
        self.df[lang].update(words.keys())
        group = self.counts.get((lang, source))
        if group is None:
            group = self.counts[lang, source] = Counter()
        group.update(words)

    def __len__(self) -> int:
        return sum(map(len, self.counts.values()))

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The stripes as rows; one without term lists the sources of its language."""
        for lang, df in self.df.items():
            stripes: dict[bytes | None, list] = {None: [0]}
            for (of, source), counts in self.counts.items():
                if of == lang:
                    stripes[None] += (source, 0)
                    for term, count in counts.items():
                        if (stripe := stripes.get(term)) is None:
                            stripes[term] = [df[term], source, count]
                        else:
                            stripe += (source, count)
            words, rows = list(stripes), list(stripes.values())
            for at in range(0, len(rows), ROWS):
                part = rows[at : at + ROWS]
                yield _stripe_batch([lang] * len(part), words[at : at + ROWS], [r[0] for r in part], [r[1::2] for r in part], [r[2::2] for r in part])


def _stripe_batch(langs: list, words: list, dfs: list, sources: list[list], counts: list[list]) -> pa.RecordBatch:
    ends = pa.array(np.cumsum([0, *map(len, sources)]), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(list(chain.from_iterable(v)), t)) for v, t in ((sources, pa.string()), (counts, pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(dfs, pa.int64()), *lists], schema=_STRIPE)


def _fold(entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes, read = Stripes(), 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py()
                stripes.add(lang, source, text)
                read += len(text)
                if read > 2 * entries:  # that many characters add at most ``entries`` counts
                    read = 0
                    if len(stripes) > entries:
                        yield from stripes.batches()
                        stripes = Stripes()
        yield from stripes.batches()

    return run


def _runs(batch: pa.RecordBatch) -> np.ndarray:
    """Where rows of another key begin in a sorted batch, and its end."""
    changed = np.zeros(len(batch) - 1, bool)
    for column in (batch.column(0), pc.fill_null(batch.column(1), b"")):  # no term is empty
        changed |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(changed) + 1, [len(batch)]])


def _merge(least: int):
    """Merge the sorted stripes of a partition; terms of fewer than ``least`` documents go.

    The rows of the last key of a batch are merged into one and wait for the next batch.
    """

    def merged(batch: pa.RecordBatch, runs: np.ndarray, chosen: np.ndarray) -> pa.RecordBatch:
        ends = batch.column(3).offsets.to_numpy() - batch.column(3).offsets[0].as_py()
        names, values = batch.column(3).flatten(), batch.column(4).flatten()
        sources, counts = [], []
        for run in chosen.tolist():
            held: dict[str, int] = {}
            entries = slice(ends[runs[run]], ends[runs[run + 1]])
            for source, count in zip(names[entries].to_pylist(), values[entries].to_pylist()):
                held[source] = held.get(source, 0) + count
            sources.append(list(held))
            counts.append(list(held.values()))
        first = pa.array(runs[chosen])
        dfs = np.add.reduceat(batch.column(2).to_numpy(), runs[:-1])[chosen]
        return _stripe_batch(batch.column(0).take(first).to_pylist(), batch.column(1).take(first).to_pylist(), dfs.tolist(), sources, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            if not len(batch):
                continue
            if waiting is not None:
                batch = pa.Table.from_batches([waiting, batch.cast(_STRIPE)]).combine_chunks().to_batches()[0]
            runs = _runs(batch)
            dfs = np.add.reduceat(batch.column(2).to_numpy(), runs[:-1])
            known = batch.column(1).is_null().to_numpy(zero_copy_only=False)[runs[:-1]] | (dfs >= least)
            chosen = np.flatnonzero(known[:-1])
            if len(chosen):
                yield merged(batch, runs, chosen)
            waiting = merged(batch, runs, np.array([len(runs) - 2]))
        if waiting is not None and (waiting.column(1)[0].as_py() is None or waiting.column(2)[0].as_py() >= least):
            yield waiting

    return run


def merged_stripes(docs: DataFrame, least: int = LEAST_DOCS, entries: int = ENTRIES) -> DataFrame:
    """The stripes ``lang, term, df, sources, counts`` of terms in at least ``least`` documents of their language.

    One stripe per language has no term; it lists the language's sources.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    spilled = docs.select(*named).mapInArrow(_fold(entries), STRIPE)
    return spilled.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merge(least), STRIPE)


def shares(counts: np.ndarray, total: np.ndarray, unit: int = UNIT) -> np.ndarray:
    """``1 + floor(unit * (counts + 2) / total)`` in exact steps of 1,000, so that no product leaves 64 bits."""
    rest, out = counts + 2, np.zeros(np.broadcast_shapes(counts.shape, total.shape), np.int64)
    for _ in range(3):
        whole, rest = np.divmod(rest * 1_000, total)
        out = out * 1_000 + whole
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q)^2 / (p + q))``."""
    return (p - q) ** 2 // (p + q)


def _tile_rows(language: Language, cells: int) -> int:
    """Sources of one tile: the matrix of a task holds their lines of all pairs of the language's sources."""
    return max(1, cells // len(language.sources))


def _diverge(described: dict[str, Language], top: int, cells: int, step: int):
    """Sums of one task's stripes, which come sorted by language and tile."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, begin, matrix, best = None, 0, None, {}

        def out() -> Iterator[tuple]:
            if now is None:
                return
            lang, sources = now[0], described[now[0]].sources
            for i, line in enumerate(matrix):
                yield from ((lang, sources[begin + i], "pair", sources[j], v) for j, v in enumerate(line.tolist()) if j != begin + i)
            for source, heap in best.items():
                yield from ((lang, source, "term", last.key.decode("utf-8"), value) for value, last in heap)

        for batch in batches:
            langs, words, tiles, sources, counts = (c.to_pylist() for c in batch.columns)
            at = 0
            while at < len(langs):
                key = langs[at], tiles[at]
                if key != now:
                    yield from out()
                    now, best = key, defaultdict(list)
                    language = described[key[0]]
                    names, height = language.sources, _tile_rows(language, cells)
                    begin, end = key[1] * height, min((key[1] + 1) * height, len(names))
                    matrix, numbers = np.zeros((end - begin, len(names)), np.int64), {s: i for i, s in enumerate(names)}
                    total = np.array(language.sizes, np.int64) + 2 * language.kept
                    whole = np.array(sum(language.sizes) + 2 * language.kept, np.int64)
                most = max(1, step // matrix.size)
                stop = at
                while stop < min(len(langs), at + most) and (langs[stop], tiles[stop]) == key:
                    stop += 1
                table = np.zeros((stop - at, len(names)), np.int64)
                for i in range(at, stop):
                    table[i - at, [numbers[s] for s in sources[i]]] = counts[i]
                p = shares(table, total)
                matrix += apart(p[:, begin:end, None], p[:, None, :]).sum(0)
                own = table[:, begin:end]
                q = shares(table.sum(1), whole)[:, None]
                told = (own > 0) & (p[:, begin:end] > q)
                values = apart(p[:, begin:end], q)
                for i, j in zip(*np.nonzero(told)):
                    word, heap = words[at + i], best[names[begin + j]]
                    entry = int(values[i, j]), _Last(word)
                    if len(heap) < top:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                at = stop
        yield from out()

    return lambda batches: _batches(rows(batches), _SUM)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = ROWS) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


class _Last:
    """A term that counts as larger the earlier its UTF-8 is."""

    __slots__ = ("key",)

    def __init__(self, term: bytes):
        self.key = term

    def __lt__(self, other: _Last) -> bool:
        return self.key > other.key

    def __eq__(self, other: object) -> bool:
        return self.key == other.key


def _described(stripes: DataFrame, limit: int) -> Iterator[dict[str, Language]]:
    """The languages, whole ones, at most ``limit`` groups at a time.

    Only a language with more sources than that comes as one; the result has a
    row for each pair of its sources, so their list is small beside it.
    """
    entries = stripes.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("e"))
    groups = entries.groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("n"))
    kept = stripes.groupBy("lang").agg(F.count("term").alias("v"))
    told = scale.cut(groups.join(kept, "lang").repartitionByRange("lang").sortWithinPartitions("lang", "source"))
    held: dict[str, Language] = {}
    size, last = 0, None
    for row in told.toLocalIterator():
        if row.lang != last and size >= limit:
            yield held
            held, size = {}, 0
        last = row.lang
        language = held.setdefault(row.lang, Language(row.v, [], []))
        language.sources.append(row.source)
        language.sizes.append(row.n)
        size += 1
    if held:
        yield held


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, cells: int = CELLS, step: int = STEP, entries: int = ENTRIES, groups: int = GROUPS) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every group of a language and a source.

    With p the smoothed share of a term in the group, in units of 10^-9, and q
    that of another source (``pair``) or of the language (``term``), the value
    is ``floor((p - q)^2 / (p + q))``: summed over all kept terms for a pair,
    of one term whose count is not 0 and whose p is above q for a term.  Ranks
    run from 1 by falling value, ties by the UTF-8 of the item; terms are told
    up to rank ``top``.  A term is kept if at least ``least`` documents of its
    language hold it.  Null text, language and source count as empty.  Repeated
    rows are documents of their own.  A language with one source has no pairs,
    one without kept terms has pairs of value 0; no rows give no rows.
    """
    stripes = scale.cut(merged_stripes(docs, least, entries))
    parts = []
    for described in _described(stripes, groups):
        parts.append(_sums(stripes, described, top, cells, step))
    if not parts:
        return stripes.sparkSession.createDataFrame([], f"{SUM}, rank int")
    sums = scale.cut(scale.union_all(parts))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.encode("item", "UTF-8"))).alias("rank")
    pairs = sums.filter(F.col("part") == "pair").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).select("*", rank)
    # A term has one stripe, so its values are whole already.
    return pairs.unionByName(sums.filter(F.col("part") == "term").select("*", rank).filter(F.col("rank") <= top))


def _sums(stripes: DataFrame, described: dict[str, Language], top: int, cells: int, step: int) -> DataFrame:
    tiles = [(lang, -(-len(d.sources) // _tile_rows(d, cells))) for lang, d in described.items()]
    info = stripes.sparkSession.createDataFrame(tiles, "lang string, _tiles int")
    told = stripes.filter(F.col("term").isNotNull()).join(F.broadcast(info), "lang")
    tile: Column = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("tile")
    dealt = told.select("lang", "term", tile, "sources", "counts").sortWithinPartitions("lang", "tile")
    sums = dealt.mapInArrow(_diverge(described, top, cells, step), SUM)
    # Every pair of a language's sources is there, also where no term is kept.
    names = stripes.filter(F.col("term").isNull()).join(F.broadcast(info), "lang").select("lang", F.explode("sources").alias("source"))
    other = names.select("lang", F.col("source").alias("item"))
    pairs = names.join(other, "lang").filter(F.col("source") != F.col("item"))
    return sums.unionByName(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value")))
