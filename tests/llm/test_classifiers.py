import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quillgraph.llm import labelled, quality, toxicity


def _corpus(n, seed=3):
    """Toxic texts hold a bad word, poor ones end words in signs."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(["an", "be", "co", "du", "é"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 60))]
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        if toxic:
            words[rng.randrange(len(words))] = "Scoundrel"
        if not good:
            words = [w + "***" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def _frames(spark, make_docs, n=500, extra=()):
    rows, labels = _corpus(n)
    df = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (99_999, 1, 1)], "doc_id bigint, quality int, toxic int")
    return make_docs([*rows, *extra]), df, {d: (q, t) for d, q, t in labels}


EXTRA = [(5_000, None), (5_001, ""), (5_002, "x"), (5_003, "word " * 50_000), (None, "an be co"), (5_004, "same"), (5_004, "same")]


def _check(got, truth, at, threshold):
    assert len(got) == len(truth) + len(EXTRA)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50
    assert np.mean([r.predicted == truth[r.doc_id][at] for r in held]) >= 0.95


def test_toxicity(spark, make_docs):
    docs, labels, truth = _frames(spark, make_docs, extra=EXTRA)
    got = toxicity.score_toxicity(docs, labels).collect()
    _check(got, truth, 1, 0.5)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)


def test_quality(spark, make_docs):
    docs, labels, truth = _frames(spark, make_docs, extra=EXTRA)
    got = quality.score_quality(docs, labels).collect()
    _check(got, truth, 0, 0.3)
    again = quality.score_quality(docs.repartition(5), labels).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in got) == sorted((str(r.doc_id), round(r.score, 9)) for r in again)


def test_held_out_labels_are_never_read(spark, make_docs):
    docs, labels, _ = _frames(spark, make_docs, 120)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = toxicity.score_toxicity(docs, labels).select("doc_id", "score").collect()
    b = toxicity.score_toxicity(docs, other).select("doc_id", "score").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_no_labels_and_no_rows(spark, make_docs):
    docs, labels, _ = _frames(spark, make_docs, 30)
    for score in (toxicity.score_toxicity, quality.score_quality):
        assert score(make_docs([]), labels).count() == 0
        assert {r.score for r in score(docs, labels.limit(0)).collect()} == {0.5}
        one = labels.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
        assert len({round(r.score, 6) for r in score(docs, one).collect()}) == 1


def test_sampled_balance_is_corrected(spark, make_docs):
    """Texts that tell nothing get the share of toxic rows in all training rows, whatever the sample's balance."""
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(600)], "doc_id bigint, toxic int")
    docs = make_docs([(i, "the same words in every text") for i in range(600)], clash=False)
    told = labelled.told_labels(labels, "toxic")
    share = told.agg(F.avg("y")).first()[0]
    for per_class in (20, 100, 1_500):
        scores = {round(r.score, 3) for r in toxicity.score_toxicity(docs, labels, per_class=per_class).collect()}
        assert len(scores) == 1 and abs(scores.pop() - share) < 0.01
    assert labelled.prior_shift(labels, "toxic", np.zeros(4)) == 0.0


def test_random_index_sums():
    texts = ["aa bb cc", "", "aa"]
    sums, counts = quality.context_sums(texts)
    rows, n = quality.word_rows(texts)
    assert n.tolist() == [3, 0, 1] and counts.sum() == 4
    places, signs = quality.index_vectors()
    want = np.zeros((quality.WORDS, quality.DIM))
    for i in range(3):
        for j in range(3):
            if i != j:
                np.add.at(want[rows[i]], places[rows[j]], signs[rows[j]])
    assert (sums == want).all()


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4_000, 6))
    y = (rng.random(4_000) < labelled.sigmoid(x @ np.array([2, -1, 0.5, 0, 0, 0]))).astype(float)
    net = quality.calibrate(quality.train(x[:2_000], y[:2_000]), x[2_000:3_000], y[2_000:3_000])
    p = net.probabilities(x[3_000:])
    for low in (0.1, 0.3, 0.5, 0.7):
        some = (p >= low) & (p < low + 0.2)
        assert abs(p[some].mean() - y[3_000:][some].mean()) < 0.12


def test_features_stay_within_texts():
    whole = ["abc", "", "x", "Hello  World"]
    text, feature = toxicity.features(whole)
    for i, t in enumerate(whole):
        _, own = toxicity.features([t])
        assert sorted(feature[text == i]) == sorted(own)
