"""Ranked lexical search by the Best Position Algorithm over impact lists.

Documents are cut into blocks of a bounded number of postings.  In a block each
term of the queries has an impact list, its postings by falling impact, and
every posting knows its position there.  A query reads its lists side by side;
each document met is scored at once by direct access to all its postings, which
also marks their positions as seen.  The *best position* of a list is the end
of its seen prefix, so documents met through other lists move it ahead of what
has been read.  No unseen document can score more than the sum of the scores at
the best positions; the query stops in a block when that is strictly below the
score of its k-th document, which later blocks of the task begin with.

Queries come in slices of at most ``SLICE`` terms, whose dictionary goes to the
tasks; a slice reads the documents once.  What leaves a task is k rows a query.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph import scale
from quillgraph.llm.common import text_of

TOP = 10
# Terms of a slice of queries, postings of a block, positions that the first round reads of each list.
SLICE = 200_000
BLOCK = 1_000_000
READ = 8

_POSTINGS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])
POSTINGS = "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"
_HIT = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
HIT = "query int, doc_id bigint, score bigint"
# Stands for a null id, which comes last among equal scores.
NO_ID = (1 << 63) - 1

# Letters of ASCII lowered, digits kept, all else of ASCII a blank; bytes from 0x80 up belong to terms.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters outside ASCII, A-Z lowered, as UTF-8."""
    return text.encode("utf-8").translate(_WORDS).split()


class Found(NamedTuple):
    """The best documents of one query so far, best first, and what was read for them."""

    scores: np.ndarray
    ids: np.ndarray
    read: int = 0
    direct: int = 0


NOTHING = Found(np.zeros(0, np.int64), np.zeros(0, np.int64))


class Block:
    """Impact lists of some documents.

    ``starts`` cuts ``terms`` and ``impacts`` into documents; the lists hold
    the same postings by term and falling impact.
    """

    def __init__(self, ids: np.ndarray, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int):
        self.ids, self.starts, self.terms, self.impacts = ids, starts, terms, impacts
        order = np.lexsort((-impacts, terms))
        self.listed_doc = np.repeat(np.arange(len(ids)), np.diff(starts))[order]
        self.listed = impacts[order]
        self.position = np.empty(len(order), np.int64)
        self.position[order] = np.arange(len(order))
        self.lists = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.which = np.full(n_terms, -1, np.int64)

    def score(self, docs: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Direct access: the documents' scores, and list and position of each posting in the query's lists."""
        lengths = self.starts[docs + 1] - self.starts[docs]
        total = int(lengths.sum())
        owner = np.repeat(np.arange(len(docs)), lengths)
        at = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(self.starts[docs], lengths)
        which = self.which[self.terms[at]]
        asked = which >= 0
        at, which, owner = at[asked], which[asked], owner[asked]
        scores = np.zeros(len(docs), np.int64)
        np.add.at(scores, owner, weights[which] * self.impacts[at])
        return scores, which, self.position[at]

    def search(self, query: np.ndarray, weights: np.ndarray, found: Found, k: int = TOP, read: int = READ) -> Found:
        """``found`` with the block's documents; ``query``: distinct term numbers with ``weights`` above 0."""
        begins, ends = self.lists[query], self.lists[query + 1]
        there = ends > begins
        query, weights, begins, ends = query[there], weights[there], begins[there], ends[there]
        if not len(query):
            return found
        self.which[query] = np.arange(len(query))
        sizes = ends - begins
        bases = np.cumsum(sizes) - sizes
        seen = np.zeros(int(sizes.sum()) + 1, bool)
        best = np.zeros(len(query), np.int64)
        done = np.zeros(len(self.ids), bool)
        scores, ids, n_read, n_direct = found
        depth, most = 0, int(sizes.max())
        while depth < most:
            upto = np.minimum(sizes, depth + read)
            took = np.maximum(upto - depth, 0)
            rows = np.arange(int(took.sum())) - np.repeat(np.cumsum(took) - took, took) + np.repeat(begins + depth, took)
            docs = np.unique(self.listed_doc[rows])
            docs = docs[~done[docs]]
            done[docs] = True
            n_read, n_direct, depth = n_read + len(rows), n_direct + len(docs), depth + read
            fresh, which, position = self.score(docs, weights)
            seen[bases[which] + position - begins[which]] = True
            scores, ids = np.concatenate([scores, fresh]), np.concatenate([ids, self.ids[docs]])
            order = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[order], ids[order]
            # All that was read is seen, so the search for the end of the seen prefix begins there.
            for i, (base, size, first) in enumerate(zip(bases.tolist(), sizes.tolist(), np.maximum(best, upto).tolist())):
                ahead = seen[base + first : base + size]
                best[i] = first + (int(ahead.argmin()) if not ahead.all() else size - first)
            at_best = np.where(best < sizes, self.listed[begins + best - 1], 0)
            if len(scores) == k and int((weights * at_best).sum()) < scores[-1]:
                break
            read *= 2
        self.which[query] = -1
        return Found(scores, ids, n_read, n_direct)


def length_norms(n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """``100 - 75 + (75 * n * N) div L`` in whole numbers of any size."""
    return np.array([25 + 75 * x * docs // words for x in n.tolist()], np.int64)


def _fold(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, ends, numbers, tfs = [], [], [0], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms(text.as_py())
                if not words:
                    continue
                for term, n in Counter(words).items():
                    if (number := vocabulary.get(term)) is not None:
                        numbers.append(number)
                        tfs.append(n)
                ids.append(doc_id)
                sizes.append(len(words))
                ends.append(len(numbers))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, t)) for v, t in ((numbers, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], schema=_POSTINGS)

    return run


def _ask(queries: list[dict[int, int]], weights: np.ndarray, docs: int, words: int, k: int, block: int):
    """Run the queries, term numbers with their repeats, over each block of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = []
        for query in queries:
            numbers = np.array(sorted(query), np.int64)
            weight = weights[numbers] * np.array([query[t] for t in numbers.tolist()], np.int64)
            asked.append((numbers[weight > 0], weight[weight > 0]))
        found = [NOTHING] * len(asked)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> None:
            ids, n, counts, numbers, tfs = (np.concatenate(c) for c in zip(*held))
            norms = np.repeat(length_norms(n, docs, words), counts)
            impacts = (1_000_000_000 * tfs) // (1_000 * tfs + 8 * norms)
            cut = Block(ids, np.concatenate([[0], np.cumsum(counts)]), numbers, impacts, len(weights))
            for i, (query, weight) in enumerate(asked):
                found[i] = cut.search(query, weight, found[i], k)

        for batch in batches:
            lists = batch.column(2)
            counts = lists.value_lengths().to_numpy()
            held.append(
                (batch.column(0).fill_null(NO_ID).to_numpy(), batch.column(1).to_numpy(), counts.astype(np.int64),
                 lists.flatten().to_numpy().astype(np.int64), batch.column(3).flatten().to_numpy())
            )
            size += int(counts.sum()) + len(batch)
            if size >= block:
                flush()
                held, size = [], 0
        if held:
            flush()
        rows = [(i, None if d == NO_ID else d, s) for i, f in enumerate(found) for s, d in zip(f.scores.tolist(), f.ids.tolist()) if s > 0]
        for at in range(0, len(rows), 10_000):
            columns = zip(*rows[at : at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _HIT.types)], schema=_HIT)

    return run


def _slices(items: DataFrame, limit: int) -> Iterator[list[tuple[object, dict[bytes, int]]]]:
    """Whole queries ``(item_id, terms and their repeats)``, as many at a time as have at most ``limit`` terms, one at least."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                counted = Counter(terms(text.as_py()))
                row = [pa.array([batch.column(0)[i].as_py()] * len(counted), batch.column(0).type)]
                yield pa.RecordBatch.from_arrays([*row, pa.array(list(counted), pa.binary()), pa.array(list(counted.values()), pa.int64())], ["item_id", "term", "times"])

    kind = items.schema["item_id"].dataType.simpleString()
    said = items.select("item_id", text_of().alias("text")).mapInArrow(split, f"item_id {kind}, term binary, times bigint")
    counted = scale.cut(said.groupBy("item_id", "term").agg(F.sum("times").alias("times")).repartitionByRange("item_id").sortWithinPartitions("item_id"))
    held: list[tuple[object, dict[bytes, int]]] = []
    size = 0
    for row in counted.toLocalIterator():
        if not held or held[-1][0] != row.item_id:
            if size >= limit:
                yield held
                held, size = [], 0
            held.append((row.item_id, {}))
        held[-1][1][bytes(row.term)] = row.times
        size += 1
    if held:
        yield held


def _search_slice(docs: DataFrame, queries: list[tuple[object, dict[bytes, int]]], kind: str, k: int, block: int) -> DataFrame | None:
    spark = docs.sparkSession
    vocabulary = {term: i for i, term in enumerate(sorted({t for _, q in queries for t in q}))}
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    postings = scale.cut(told.mapInArrow(_fold(vocabulary), POSTINGS))
    total = postings.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words")).first()
    if not total.docs:
        return None
    weights = np.zeros(len(vocabulary), np.int64)
    # One number for each term of the slice.
    for row in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[row.term] = math.floor(1_000 * math.log((2 * total.docs + 2) / (2 * row["count"] + 1)))
    numbered = [{vocabulary[t]: n for t, n in q.items()} for _, q in queries]
    hits = postings.mapInArrow(_ask(numbered, weights, total.docs, total.words, k, block), HIT)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(queries)], f"query int, item_id {kind}")
    return hits.join(F.broadcast(names), "query").select("item_id", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, slice_terms: int = SLICE, block: int = BLOCK) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each item the ``k`` documents of the highest score above 0.

    A document's score is the sum over the item's terms, repeats included, of
    ``w * ((10^9 * tf) div (1000 * tf + 8 * m))`` with the term's weight
    ``w = floor(1000 ln((2N + 2) / (2 df + 1)))`` and the length norm ``m``.
    Equal scores rank by rising ``doc_id``, null last.  Null text has no terms;
    an item without terms, or without a document that scores, has no rows.
    Repeated document rows are documents of their own; rows of one ``item_id``
    are one item with the terms of all.  No documents or no items: no rows.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    hits = [h for queries in _slices(items, slice_terms) if (h := _search_slice(docs, queries, kind, k, block)) is not None]
    if not hits:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = scale.union_all(hits).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
