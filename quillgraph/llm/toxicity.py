"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is its lower-case UTF-8 bytes with single spaces between words.  The
n-grams that occur in it, whatever their number, are hashed to ``2**BITS``
features.  Each feature is scaled by the logarithm of the ratio of its smoothed
shares in toxic and other training texts; a logistic regression with quadratic
penalty learns the weights of the scaled features (Wang and Manning, 2012).

It learns from at most ``per_class`` labelled texts of either label.  The
executors count their features and pick those whose shares in the two classes
differ clearly; the driver fits the weights of these.  The bias is shifted to
the shares of the labels in all training rows, so the sample's balance, which
depends on the size of the table, does not decide.  The model is one number per
feature, 2 MB whatever the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph import scale
from quillgraph.llm import labelled
from quillgraph.llm.common import normal_words

BITS = 19
ORDERS = (4, 5, 6)
PER_CLASS = 1_500
THRESHOLD = 0.5
SMOOTHING = 0.3
PENALTY = 1e-2
STEPS = 800
# A feature counts if its shares in the two classes differ by so many standard errors.
CLEAR = 4.0


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, feature)`` of every distinct feature of every text, sorted."""
    parts = [b" " + b" ".join(normal_words(t)) + b" " for t in texts]
    ends = np.cumsum([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    owner = np.repeat(np.arange(len(parts), dtype=np.uint64), [len(p) for p in parts])
    keys = []
    code = data.astype(np.uint64)
    for order in range(2, max(ORDERS) + 1):
        n = len(data) - order + 1
        if n <= 0:
            break
        code = (code[:n] << np.uint64(8)) | data[order - 1 :]
        if order in ORDERS:
            bucket = ((code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(order)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)
            whole = np.ones(n, bool)
            for back in range(1, order):  # n-grams that reach into the next text
                at = ends[:-1] - back
                whole[at[(at >= 0) & (at < n)]] = False
            keys.append(((owner[:n] << np.uint64(BITS)) | bucket)[whole])
    found = np.sort(np.concatenate([np.zeros(0, np.uint64), *keys]))
    found = found[np.append(True, found[1:] != found[:-1])[: len(found)]]
    return (found >> np.uint64(BITS)).astype(np.int64), (found & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        text, feature = features(texts)
        return labelled.sigmoid(self.bias + np.bincount(text, self.weights[feature], len(texts)))


def fit(text: np.ndarray, feature: np.ndarray, y: np.ndarray, ratio: np.ndarray) -> Model:
    """Fit on ``(text number, feature)`` pairs and the features' log-count ratios.

    One label alone gives its constant, none gives 0.5.
    """
    n, size = len(y), 1 << BITS
    if n == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (n + 1)
        return Model(np.zeros(size, np.float32), float(np.log(share / (1 - share))))
    # Texts have unit length in scaled features on average, so one step size suits all data.
    values = ratio[feature]
    scale_ = np.sqrt(max(np.bincount(text, values**2, n).mean(), 1e-12))
    values = values / scale_
    used, place = np.unique(feature, return_inverse=True)
    weights, bias = np.zeros(len(used)), 0.0
    momentum, bias_momentum = np.zeros(len(used)), 0.0
    for step in range(STEPS):
        ahead, bias_ahead = weights + momentum * step / (step + 3), bias + bias_momentum * step / (step + 3)
        error = labelled.sigmoid(bias_ahead + np.bincount(text, values * ahead[place], n)) - y
        slope = np.bincount(place, values * error[text], len(used)) / n + PENALTY / n * ahead
        new, new_bias = ahead - 2.0 * slope, bias_ahead - 2.0 * error.mean()
        momentum, bias_momentum, weights, bias = new - weights, new_bias - bias, new, new_bias
    scaled = np.zeros(size, np.float32)
    scaled[used] = weights * ratio[used] / scale_
    return Model(scaled, float(bias))


def clear_ratios(told: DataFrame) -> np.ndarray:
    """Log-count ratios of the features whose shares in the two classes differ clearly; 0 for others.

    Counted by the executors; at most ``2**BITS`` features, in practice some
    thousands, come to the driver.
    """

    def run(batches):
        counts = np.zeros((2, 1 << BITS), np.int64)
        for batch, texts in labelled.text_blocks(batches, 2):
            text, feature = features(texts)
            label = batch.column(1).to_numpy()[text]
            for y in (0, 1):
                counts[y] += np.bincount(feature[label == y], minlength=1 << BITS)
        seen = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[1, seen]), pa.array(counts[0, seen])], names=["feature", "p", "q"])

    parts = told.mapInArrow(run, "feature bigint, p bigint, q bigint")
    counts = scale.cut(parts.groupBy("feature").agg((F.sum("p") + SMOOTHING).alias("p"), (F.sum("q") + SMOOTHING).alias("q")))
    sums = counts.agg(F.sum("p").alias("p"), F.sum("q").alias("q")).first()
    n = told.agg(F.sum("y").alias("one"), F.sum(1 - F.col("y")).alias("other")).first()
    ratio = np.zeros(1 << BITS)
    if n["one"] and n["other"]:
        share = (F.col("p") + F.col("q")) / F.lit(n["one"] + n["other"] + 2 * SMOOTHING)
        error = F.sqrt(share * F.greatest(1 - share, F.lit(0.0)) * F.lit(1 / n["one"] + 1 / n["other"]))
        for r in counts.filter(F.abs(F.col("p") / n["one"] - F.col("q") / n["other"]) > CLEAR * error).collect():
            ratio[r["feature"]] = np.log((r["p"] / sums["p"]) / (r["q"] / sums["q"]))
    return ratio


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Learn from at most ``per_class`` training rows of either label; the held-out fold is never read for it."""
    told = scale.cut(labelled.training_texts(docs, labels, label, per_class).select("doc_id", "y", "text"))
    ratio = clear_ratios(told)

    def run(batches):
        for batch, texts in labelled.text_blocks(batches, 2):
            text, feature = features(texts)
            kept = ratio[feature] != 0
            text, feature = text[kept], feature[kept].astype(np.int32)
            split = np.split(feature, np.searchsorted(text, np.arange(1, len(texts))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f.tobytes() for f in split], pa.binary())], names=["doc_id", "y", "found"])

    rows = sorted(told.mapInArrow(run, "doc_id bigint, y int, found binary").collect())
    found = [np.frombuffer(r["found"], np.int32) for r in rows]
    text = np.repeat(np.arange(len(rows)), [len(f) for f in found])
    feature = np.concatenate([np.zeros(0, np.int32), *found]).astype(np.int64)
    y = np.array([r["y"] for r in rows], np.float64)
    model = fit(text, feature, y, ratio)
    return Model(model.weights, model.bias + labelled.prior_shift(labels, label, y))


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD, per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, from its whole text alone.

    Null text counts as empty; a text without features gets the bias alone.
    Repeated rows are scored each; without labels every score is 0.5.  No rows
    give no rows.
    """
    model = learn(docs, labels, label, per_class)
    return labelled.scored(docs, model.score, threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below ``threshold``, with all their columns."""
    model = learn(docs, labels)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch, texts in labelled.text_blocks(batches, at):
            yield batch.filter(pa.array(model.score(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)
