import random
import re
from collections import Counter

import numpy as np
import pytest

from quillgraph.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=10, top=10):
    docs = [(lang or "", source or "", Counter(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [(s, c) for of, s, c in docs if of == lang]
        df = Counter(t for _, c in own for t in c)
        kept = [t for t in df if df[t] >= least]
        counts = {s: Counter() for s, _ in own}
        for s, c in own:
            counts[s].update({t: c[t] for t in kept if c[t]})

        def shares(c):
            return {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def rows_of(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdé日" for b in "xyzñ"]
    out = []
    for i in range(n):
        source = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "é", None, ""])
        words = rng.choices(vocabulary, [1 + (len(source or "") + j) % 7 for j in range(len(vocabulary))], k=rng.randrange(12))
        out.append((rng.choice([" ", "1", "--"]).join(words).upper() if i % 3 else " ".join(words), rng.choice(["en", "en", "fr", None]), source))
    return out + [(None, "en", "silent"), ("", "de", "alone"), ("x", "nl", "a"), ("x y", "nl", "b")]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    return df.selectExpr("*", "1 AS term", "2 AS df", "lang AS item", "text AS sources", "3 AS counts", "4 AS rank", "5 AS value", "6 AS tile")


def got(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("more", [{}, {"entries": 20, "cells": 4, "step": 6, "groups": 2}, {"cells": 12}])
def test_against_brute_force(spark, more, monkeypatch):
    rows = rows_of(3)
    assert got(dv.audit(frame(spark, rows), **more)) == brute(rows)


def test_spills_are_merged(spark):
    rows = rows_of(5)
    spilled = dv.Stripes()
    for text, lang, source in rows[:100]:
        spilled.add(lang or "", source or "", text or "")
    assert len(spilled) == sum(len(c) for c in spilled.counts.values()) and sum(len(b) for b in spilled.batches()) > 20
    for entries in (1, 10**6):
        merged = dv.merged_stripes(frame(spark, rows), 1, entries).collect()
        assert len({(r.lang, r.term) for r in merged}) == len(merged)


def test_few_documents_ties_and_no_rows(spark):
    assert dv.audit(frame(spark, rows_of(1)[:0])).count() == 0
    rows = [("same words here", "en", s) for s in ("b", "a", "c")] * 5
    assert got(dv.audit(frame(spark, rows))) == brute(rows)
    rare = [("rare", "en", "a"), ("other", "en", "b")]
    assert got(dv.audit(frame(spark, rare))) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)] == brute(rare)
    long = [("ab " * 200_000 + "cd", "en", "a"), ("cd ab", "en", "b")] * 10
    assert got(dv.audit(frame(spark, long))) == brute(long)


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(2_000):
        total = rng.randrange(3, 10 ** rng.randrange(1, 16))
        count = rng.randrange(0, max(1, total - 2))
        assert int(dv.shares(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * (count + 2) // total
