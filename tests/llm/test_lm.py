import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quillgraph.llm import lm


def _kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Plain:
    """The same model by recursion over dictionaries."""

    def __init__(self, texts):
        self.counts = Counter()
        for text in texts:
            data = b"\n" * lm.DEPTH + text
            for i in range(lm.DEPTH, len(data)):
                for j in range(8):
                    node, bit = 1 << j | data[i] >> (8 - j), data[i] >> (7 - j) & 1
                    for d in range(lm.DEPTH + 1):
                        self.counts[data[i - d : i], node, bit] += 1
        self.children, self.memo = {}, {}
        for context, node, _ in list(self.counts):
            if context:
                self.children.setdefault((context[1:], node), set()).add(context)

    def weighted(self, context, node):
        if (context, node) not in self.memo:
            own = _kt(self.counts[context, node, 0], self.counts[context, node, 1])
            if len(context) == lm.DEPTH:
                self.memo[context, node] = own, own
            else:
                below = sum(self.weighted(c, node)[0] for c in self.children.get((context, node), ()))
                self.memo[context, node] = np.logaddexp(own, below) - math.log(2), own
        return self.memo[context, node]

    def one(self, context, node):
        mixed, rest, ended = 0.0, 1.0, 0.5
        for d in range(lm.DEPTH + 1):
            at = context[len(context) - d :]
            a, b = self.counts[at, node, 0], self.counts[at, node, 1]
            if not a + b:
                break
            p = (b + 0.5) / (a + b + 1)
            ended = mixed + rest * p
            weighted, own = self.weighted(at, node)
            stop = 1.0 if d == lm.DEPTH else math.exp(own - weighted - math.log(2))
            mixed, rest = mixed + rest * stop * p, rest * (1 - stop)
        return ended

    def score(self, text):
        data, total = b"\n" * lm.DEPTH + text, 0.0
        for i in range(lm.DEPTH, len(data)):
            for j in range(8):
                p = self.one(data[i - lm.DEPTH : i], 1 << j | data[i] >> (8 - j))
                total += math.log10(p if data[i] >> (7 - j) & 1 else 1 - p)
        return total


def _rows():
    rng = random.Random(8)
    words = ["the", "The", "cat", "sat", "mät", "on", "a", "zebra"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25)))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, "\t\n"), (103, "unseen-äöü words"), (104, "x" * 3_000), (105, "A\x0bB\x85C D")]


@pytest.mark.parametrize(("block", "per_part"), [(8 << 20, 32 << 20), (300, 700)])
def test_against_brute_force(make_docs, monkeypatch, block, per_part):
    monkeypatch.setattr(lm, "BLOCK", block)
    monkeypatch.setattr(lm, "BYTES_PER_PARTITION", per_part)
    monkeypatch.setattr(lm, "MERGE", 50)
    rows = _rows()
    got = {r.doc_id: r for r in lm.score_documents(make_docs(rows)).collect()}
    assert len(got) == len(rows)
    texts = {d: lm.normal_text(t) for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    assert any(held.values())
    plain = Plain([t for d, t in texts.items() if not held[d]])
    tokens = {d: [*t.split(), "end"] for d, t in texts.items()}
    c = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    for d, r in got.items():
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[d], len(tokens[d]), n)
        assert r.n_known == sum(c[w] > 0 for w in tokens[d])
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[d]))
        assert r.score == pytest.approx(plain.score(texts[d]), rel=1e-5, abs=1e-5)


def test_probabilities_sum_to_one():
    texts = [lm.normal_text(t) for _, t in _rows()]
    plain = Plain(texts[:40])
    for context in (b"e cat", b"\n\n\n\n\n", b"qqqqq", b" the "):
        probability = [1.0]
        for j in range(8):
            probability = [p * (q if bit else 1 - q) for k, p in enumerate(probability) for q in [plain.one(context, 1 << j | k)] for bit in (0, 1)]
        assert sum(probability) == pytest.approx(1)


def test_kt_for_large_counts():
    for a, b in [(0, 0), (1, 0), (3, 5), (10**6, 0), (10**6, 10**5)]:
        assert lm.log_kt(np.float64(a), np.float64(b)) == pytest.approx(_kt(a, b), rel=1e-9, abs=1e-9)


def test_no_rows_and_nothing_to_learn(make_docs):
    assert lm.score_documents(make_docs([])).count() == 0
    from pyspark.sql import functions as F

    got = lm.score_documents(make_docs([(None, "ab"), (1, None)]), F.lit(True)).collect()
    bits = {r.doc_id: r.score for r in got}
    assert bits == {None: pytest.approx(-24 * math.log10(2), rel=1e-5), 1: pytest.approx(-8 * math.log10(2), rel=1e-5)}
    assert {r.train_tokens for r in got} == {0}
