"""The labelled rows that classifiers learn from, and the driver of scoring by batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import fold

FOLDS = 5
# Characters of text taken at once: bounds what a worker holds.
CHARS = 2 << 20


def told_labels(labels: DataFrame, label: str) -> DataFrame:
    """``(doc_id, y)`` outside the held-out fold.

    Rows without an id or label do not take part; of several labels of one id
    the largest counts.
    """
    told = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id", FOLDS) != 0))
    return told.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def sample_ids(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids, those with the smallest hash."""
    return told_labels(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def training_ids(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled ids of either label, those with the smallest hash."""
    told = told_labels(labels, label)
    parts = [told.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def prior_shift(labels: DataFrame, label: str, y: np.ndarray) -> float:
    """What the log odds of a fit on the sampled labels ``y`` lack to those of all told rows; 0 if a label is missing."""
    told = told_labels(labels, label).agg(F.sum("y").alias("one"), F.sum(1 - F.col("y")).alias("other")).first()
    one, other = float(np.sum(y)), float(np.sum(1 - y))
    if not (told["one"] and told["other"] and one and other):
        return 0.0
    return float(np.log(told["one"] / told["other"]) - np.log(one / other))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """``(doc_id, y, text)`` of the training rows; at most ``2 * per_class`` ids are broadcast."""
    ids = training_ids(labels, label, per_class)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def text_blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about ``CHARS`` characters, and their texts; null is empty."""
    for batch in batches:
        begin, size, texts = 0, 0, []
        for at, value in enumerate(batch.column(column)):
            text = value.as_py() or ""
            texts.append(text)
            size += len(text)
            if size >= CHARS:
                yield batch.slice(begin, at + 1 - begin), texts
                begin, size, texts = at + 1, 0, []
        if texts:
            yield batch.slice(begin), texts


def scored(docs: DataFrame, score: Callable[[list[str]], np.ndarray], threshold: float) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; ``score`` gets lists of whole texts."""

    def run(batches):
        for batch, texts in text_blocks(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(texts), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
    return rows.select(
        "doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))
