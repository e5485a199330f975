import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillgraph.llm import simhash


def _plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def _texts():
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "delta", "eps", "é"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    long = [f"w{i}" for i in range(400)]
    for i in range(40):
        copy = list(long)
        copy[rng.randrange(400)] = f"other{i}"
        rows.append((100 + i, " ".join(copy)))
    return rows + [(200, None), (201, ""), (202, " \n"), (203, "A b\tc"), (204, "a B c"), (205, "word " * 60_000), (206, "a b c d e")]


def test_against_brute_force(make_docs, monkeypatch):
    rows = _texts()
    fps = {d: _plain_fingerprint(t) for d, t in rows}
    component = _components(sorted(set(fps.values())))
    least = {}
    for d, f in fps.items():
        least[component[f]] = min(d, least.get(component[f], d))
    for tile in (2_048, 3):
        monkeypatch.setattr(simhash, "TILE", tile)
        got = simhash.near_duplicates(make_docs(rows)).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.fingerprint for r in got} == {d: f"{f:016x}" for d, f in fps.items()}
        assert {r.doc_id: r.component_id for r in got} == {d: least[component[f]] for d, f in fps.items()}
    kept = simhash.keep_one(make_docs(rows + rows[:5])).collect()
    assert sorted(r.doc_id for r in kept) == sorted(least.values())


def test_links_connect_all_close_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    fps = sorted({int(x) for x in np.concatenate([base, near, np.array([0, 2**64 - 1], np.uint64)])})
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp bigint")
    got = simhash.components(df).collect()
    want = _components(fps)
    groups = {}
    for r in got:
        groups.setdefault(r.component, set()).add(r.fp % 2**64)
    wanted = {}
    for f, c in want.items():
        wanted.setdefault(c, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_null_ids_and_no_rows(make_docs):
    got = simhash.near_duplicates(make_docs([(None, "same text here now"), (7, "same text here now"), (None, "quite another one of four")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 7), (7, 7)]
    assert simhash.near_duplicates(make_docs([])).count() == 0 and simhash.keep_one(make_docs([])).count() == 0
    assert simhash.keep_one(make_docs([(None, "a"), (None, "a")])).count() == 1


def test_native_hash_agrees(spark):
    text = "one two three four"
    got = spark.range(1).select(F.xxhash64(F.lit(text)).alias("h")).first().h
    assert got % 2**64 == simhash.fingerprint(text)


def test_hot_keys(spark, make_docs, tiny_heavy):
    """One text on half of the rows and one large component: split keys give the rows of plain joins."""
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[:k] + ["x"] + words[k + 1 :]) for k in range(0, 300, 12)]
    rows = [(i, "the very same text in many rows" if i % 2 else texts[i // 2 % len(texts)]) for i in range(80)]
    docs = make_docs(rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = {i: simhash.fingerprint(t) for i, t in rows}
    root = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i in root:
            for j in root:
                if (fps[i] ^ fps[j]).bit_count() <= 4 and root[j] < root[i]:
                    root[i], changed = root[j], True
    assert got == {i: (f"{fps[i]:016x}", root[i]) for i in root}


def test_links_without_hubs_need_no_slots(spark, monkeypatch):
    """Splitting keys costs the driver a broadcast per join; a chain has no key to split."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    spark.conf.set("quillgraph.heavyShare", "100")
    monkeypatch.setattr(simhash.scale, "split_rows", lambda *a, **k: pytest.fail("no key is heavy"))
    try:
        got = {r.fp: r.component for r in simhash._stars(chain).collect()}
    finally:
        spark.conf.unset("quillgraph.heavyShare")
    assert got == {i: 0 for i in range(1, 41)}
