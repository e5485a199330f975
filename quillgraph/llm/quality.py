"""Quality: random-indexing word vectors, pooled per document, under a two-layer network.

Random indexing (Kanerva et al., 2000) gives every word a fixed sparse vector of
a few +1 and -1; a word's meaning vector is the sum of the sparse vectors of the
words around it, over the whole corpus.  Words are runs of letters and digits or
runs of other signs, as written, hashed to ``WORDS`` rows, so the table of
vectors has a fixed size.  Tasks sum whole numbers per row and Spark adds them
up by row: the result does not depend on the order.

A document is the mean and the spread of its words' unit vectors, and its
length.  A two-layer network (numpy, Adam) learns the label from at most
``rows`` labelled documents outside the held-out fold; a fifth of them only
sets the temperature that makes its probabilities calibrated.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import labelled
from quillgraph.llm.common import mix64

WORDS = 1 << 14
DIM = 32
ONES = 4
WINDOW = 2
HIDDEN = 32
ROWS = 6_000
THRESHOLD = 0.3
EPOCHS = 60
SEED = 7

_TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\sA-Za-z0-9\x80-\xff]+")


class _Buckets(dict):
    """Remembers the row of a word; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        row = self[word] = zlib.crc32(word) % WORDS
        return row


_buckets = _Buckets()


def word_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' rows of all texts one after the other, and how many each text has."""
    found, counts = [], []
    for text in texts:
        words = _TOKEN.findall(text.encode("utf-8", "surrogatepass"))
        counts.append(len(words))
        found.append(np.fromiter(map(_buckets.__getitem__, words), np.int32, len(words)))
    return np.concatenate([np.zeros(0, np.int32), *found]), np.array(counts, np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the ones in every row's sparse vector."""
    drawn = mix64(np.arange(WORDS * ONES, dtype=np.uint64) + np.uint64(SEED)).reshape(WORDS, ONES)
    return (drawn % np.uint64(DIM)).astype(np.int64), np.where(drawn >> np.uint64(63), 1.0, -1.0)


def context_sums(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(sums, counts)`` per row of the neighbours' sparse vectors, within each text."""
    rows, counts = word_rows(texts)
    owner = np.repeat(np.arange(len(counts)), counts)
    places, signs = index_vectors()
    sums = np.zeros(WORDS * DIM)
    for away in range(1, WINDOW + 1):
        same = owner[away:] == owner[:-away]
        left, right = rows[:-away][same], rows[away:][same]
        for of, near in ((left, right), (right, left)):
            base = of.astype(np.int64) * DIM
            for one in range(ONES):
                sums += np.bincount(base + places[near, one], signs[near, one], WORDS * DIM)
    return sums.astype(np.int64).reshape(WORDS, DIM), np.bincount(rows, minlength=WORDS)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all rows from the whole corpus; zero for rows that no word has."""

    def run(batches):
        sums, counts = np.zeros((WORDS, DIM), np.int64), np.zeros(WORDS, np.int64)
        for _, texts in labelled.text_blocks(batches, 0):
            some, n = context_sums(texts)
            sums += some
            counts += n
        seen = np.flatnonzero(counts)
        if len(seen):
            flat = pa.array(sums[seen].ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, DIM), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen]), lists], names=["word", "n", "v"])

    parts = docs.select("text").mapInArrow(run, "word bigint, n bigint, v array<bigint>")
    totals = [F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIM)]
    table = np.array(parts.groupBy("word").agg(F.sum("n").alias("n"), *totals).collect(), np.float64).reshape(-1, DIM + 2)
    vectors, counts = np.zeros((WORDS, DIM)), np.zeros(WORDS)
    at = table[:, 0].astype(np.int64)
    counts[at] = table[:, 1]
    vectors[at] = table[:, 2:] / table[:, 1:2]
    vectors[at] -= counts @ vectors / max(counts.sum(), 1)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors and the log of the number of words of each text."""
    rows, counts = word_rows(texts)
    sums, squares = np.zeros((len(texts), DIM)), np.zeros((len(texts), DIM))
    full = np.flatnonzero(counts)
    if len(full):
        own = vectors[rows]
        starts = (np.cumsum(counts) - counts)[full]
        sums[full] = np.add.reduceat(own, starts, axis=0)
        squares[full] = np.add.reduceat(own * own, starts, axis=0)
    n = np.maximum(counts, 1)[:, None]
    mean = sums / n
    return np.hstack([mean, np.sqrt(np.maximum(squares / n - mean**2, 0)), np.log1p(counts)[:, None]])


@dataclass
class Network:
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return (np.tanh((x - self.mean) / self.spread @ a + b) @ c + d)[:, 0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return labelled.sigmoid(self.logits(x) / self.temperature)


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Fit by Adam in a fixed order of batches."""
    rng = np.random.default_rng(SEED)
    net = Network(x.mean(axis=0), x.std(axis=0) + 1e-6, [
        rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)
    ])
    first, second = [np.zeros_like(w) for w in net.layers], [np.zeros_like(w) for w in net.layers]
    z, t = (x - net.mean) / net.spread, 0
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            a, b, c, d = net.layers
            hidden = np.tanh(z[batch] @ a + b)
            error = (labelled.sigmoid(hidden @ c + d) - y[batch, None]) / len(batch)
            back = error @ c.T * (1 - hidden**2)
            t += 1
            for i, slope in enumerate((z[batch].T @ back + 1e-3 * a, back.sum(axis=0), hidden.T @ error + 1e-3 * c, error.sum(axis=0))):
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope**2
                net.layers[i] = net.layers[i] - 3e-3 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return net


def calibrate(net: Network, x: np.ndarray, y: np.ndarray) -> Network:
    """Set the temperature with the least log loss on rows that the network has not learnt from."""
    logits = net.logits(x)

    def loss(t: float) -> float:
        p = np.clip(labelled.sigmoid(logits / t), 1e-9, 1 - 1e-9)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    net.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return net


def learn(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, label: str = "quality", rows: int = ROWS) -> Network | float:
    """A network, or a constant where the labels at hand are too few or all alike."""

    def run(batches):
        for batch, texts in labelled.text_blocks(batches, 2):
            x = pooled(texts, vectors)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    ids = labelled.sample_ids(labels, label, rows)
    told = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "y", "text")
    found = sorted(told.mapInArrow(run, "doc_id bigint, y int, x binary").collect())
    y = np.array([r["y"] for r in found], np.float64)
    if len(y) < 20 or y.min() == y.max():
        return float((y.sum() + 0.5) / (len(y) + 1))
    x = np.array([np.frombuffer(r["x"]) for r in found])
    held = np.arange(len(y)) % 5 == 0
    return calibrate(train(x[~held], y[~held]), x[held], y[held])


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, rows: int = ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, from its whole text alone.

    Null text counts as empty and has a score like any other.  Repeated rows
    are scored each; with too few labels every score is their share.  No rows
    give no rows.
    """
    vectors = word_vectors(docs)
    model = learn(docs, labels, vectors, label, rows)

    def score(texts: list[str]) -> np.ndarray:
        return np.full(len(texts), model) if isinstance(model, float) else model.probabilities(pooled(texts, vectors))

    return labelled.scored(docs, score, threshold)
