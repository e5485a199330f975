"""Nearest neighbours by collision-counting hashing (Gan et al., 2012; Huang et al., 2015).

Vectors are dealt to blocks.  A block keeps ``PROJECTIONS`` sorted arrays, each
of all its vectors projected on one random direction.  A query opens a window
around its own projection in every array and widens all windows by ``GROWTH``,
round after round; a vector that lies in at least ``SHARE`` of the windows is
verified, its true distance taken.  A query is done in a block when a vector as
near as its k-th best would lie in ``SURE`` of the windows on average: one that
is still short of the threshold is then very unlikely to be nearer.

All queries meet all blocks, in batches that stream past a block's arrays; a
block sends on its ``k`` best for each query.  Every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph import scale
from quillgraph.llm.common import partitions_for

PROJECTIONS = 40
SHARE = 0.6
SURE = 0.8
GROWTH = 1.3
# The first window holds about so many vectors on either side.
FIRST = 16
BLOCK = 8_192
BATCH = 1_024
SEED = 11


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, v, dim)``: the distinct vectors of each id; none that is null, zero or holds null or non-finite numbers."""
    v = F.col(embedding)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    told = vectors.filter(F.col(vec_id).isNotNull() & v.isNotNull()).filter(sound)
    doubles = v.cast("array<double>")
    return told.select(F.col(vec_id).cast("long").alias("vec_id"), doubles.alias("v")).distinct().withColumn("dim", F.size("v"))


class Block:
    """Sorted projections of a block's vectors; an id may have several."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.names, self.name = np.unique(ids, return_inverse=True)
        self.directions = np.random.default_rng(SEED).normal(size=(vectors.shape[1], PROJECTIONS))
        projected = vectors @ self.directions
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(projected, self.order.T, axis=0).T.copy()

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(query id, vector ids, distances)`` of each query's best ids, nearest first, ties to the smaller id."""
        at = queries @ self.directions
        for number, query in enumerate(queries):
            yield (int(ids[number]), *self._one(int(ids[number]), query, at[number], k))

    def _one(self, query_id: int, query: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.ids)
        need = int(np.ceil(SHARE * PROJECTIONS))
        reach = NormalDist().inv_cdf((1 + SURE) / 2)
        middle = np.array([np.searchsorted(s, x) for s, x in zip(self.sorted, at)])
        rows = np.arange(PROJECTIONS)
        near = self.sorted[rows, np.minimum(middle + FIRST, n - 1)] - self.sorted[rows, np.maximum(middle - FIRST, 0)]
        half = max(float(np.median(near)) / 2, 1e-12)
        farthest = float(np.maximum(np.abs(self.sorted[:, 0] - at), np.abs(self.sorted[:, -1] - at)).max())
        seen = np.zeros(n, np.int64)
        low = high = middle
        distance = np.full(len(self.names), np.inf)  # of each id's nearest vector
        verified = self.ids == query_id  # a query is no candidate of its own
        while True:
            left = np.array([np.searchsorted(s, x - half, "left") for s, x in zip(self.sorted, at)])
            right = np.array([np.searchsorted(s, x + half, "right") for s, x in zip(self.sorted, at)])
            left, right = np.minimum(left, low), np.maximum(right, high)
            fresh = [o[a:b] for o, a, b in zip(self.order, left, low)] + [o[a:b] for o, a, b in zip(self.order, high, right)]
            seen += np.bincount(np.concatenate(fresh), minlength=n)
            low, high = left, right
            found = np.flatnonzero((seen >= need) & ~verified)
            if len(found):
                verified[found] = True
                np.minimum.at(distance, self.name[found], np.sqrt(((self.vectors[found] - query) ** 2).sum(axis=1)))
            best = np.partition(distance, k - 1)[k - 1] if len(distance) >= k else np.inf
            if best * reach <= half or half > farthest:
                break
            half *= GROWTH
        found = np.flatnonzero(distance < np.inf)
        found = found[np.lexsort((self.names[found], distance[found]))][:k]
        return self.names[found], distance[found]


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _search(k: int):
    """Rows by block: its vectors (role 0), then the queries (role 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, block = None, [], [], None
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def answer():
            nonlocal block
            if not waiting or not ids:
                waiting.clear()
                return
            if block is None:
                block = Block(np.concatenate(ids), np.concatenate(vectors))
            found = list(block.search(*(np.concatenate(x) for x in zip(*waiting)), k))
            waiting.clear()
            query = np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate([i for _, i, _ in found])), pa.array(np.concatenate([d for _, _, d in found]))], schema=_FOUND)

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for begin, end in zip(edges, edges[1:]):
                if begin == end:
                    continue
                dim, number, role = keys[begin]
                if (dim, number) != key:
                    yield from answer()
                    key, ids, vectors, block = (dim, number), [], [], None
                some = batch.slice(begin, end - begin)
                pair = some.column(3).to_numpy(), _matrix(some.column(4), dim)
                if role == 0:
                    ids.append(pair[0])
                    vectors.append(pair[1])
                else:
                    waiting.append(pair)
                    if sum(len(i) for i, _ in waiting) >= BATCH:
                        yield from answer()
        yield from answer()

    return run


def nearest(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest vectors of each query, by Euclidean distance.

    ``is_query`` is a condition on ``vec_id``.  Every distinct vector of an id
    is indexed and asked: the distance of two ids is that of their nearest
    vectors.  Vectors without an id, and those that ``usable`` leaves out, take
    no part; an id is no neighbour of its own.  Vectors of another length are no
    neighbours.  With fewer than ``k`` candidates all are returned; no rows
    give no rows.
    """
    kept = scale.cut(usable(vectors))
    counts = kept.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    counts = scale.cut(counts)
    dealt = kept.join(counts, "dim")
    block = F.pmod(F.xxhash64("vec_id", "v"), "blocks").cast("int")
    own = dealt.select("dim", block.alias("block"), F.lit(0).alias("role"), "vec_id", "v")
    asked = dealt.filter(is_query).select("dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "vec_id", "v")
    ordered = own.unionByName(asked).repartition("dim", "block").sortWithinPartitions("dim", "block", "role", "vec_id")
    found = ordered.mapInArrow(_search(k), "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
