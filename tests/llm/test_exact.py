import hashlib

import numpy as np
from pyspark.sql import functions as F

from quillgraph.llm import exact


def _expected(rows):
    out = {}
    for doc_id, text in rows:
        out.setdefault(text or "", []).append(doc_id)
    return out


def test_groups_against_brute_force(make_docs):
    rows = [(i, f"text {i % 7}") for i in range(60)] + [(100 + i, "hot") for i in range(80)]
    rows += [(200, None), (201, ""), (202, " "), (203, "é" * 50_000), (204, "only")]
    groups = _expected(rows)
    for old in (F.col("doc_id") % 2 == 0, None, F.lit(False), F.col("doc_id") > 150):
        got = exact.exact_dedup(make_docs(rows), old).collect()
        assert len(got) == len(rows)
        texts = dict(rows)
        for r in got:
            group = groups[texts[r.doc_id] or ""]
            assert (r.keep_id, r.group_size, r.kept) == (max(group), len(group), r.doc_id == max(group))
            assert r.text_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_repeated_rows_and_null_ids_keep_one(make_docs):
    docs = make_docs([(5, "a")] * 4 + [(None, "a"), (None, "b"), (None, "b"), (3, None)])
    got = exact.exact_dedup(docs, F.col("doc_id") == 5).collect()
    assert sum(r.kept for r in got) == 3 and len(got) == 8
    assert {r.keep_id for r in got} == {5, None, 3}
    kept = exact.drop_repeats(docs).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == [(-1, "b"), (3, ""), (5, "a")]


def test_no_rows(make_docs):
    assert exact.exact_dedup(make_docs([])).count() == 0
    assert exact.drop_repeats(make_docs([])).count() == 0


def test_split_hot_bucket(make_docs, monkeypatch):
    monkeypatch.setattr(exact, "ROWS", 3)
    monkeypatch.setattr(exact, "BUCKET", 4)
    rows = [(i, f"t{max(0, i - 30)}") for i in range(50)]
    got = exact.exact_dedup(make_docs(rows), F.col("doc_id") < 20).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(30, 31), *((i, 1) for i in range(31, 50))}


def test_hash_is_minimal_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1_000):
        digests = rng.integers(0, 256, (n, 32), np.uint8)
        levels, slots = exact.hash_levels(digests)
        assert sorted(slots) == list(range(n))
        assert (exact.find_slots(digests, levels) == slots).all()


def test_outsiders_are_not_members():
    rng = np.random.default_rng(2)
    levels, _ = exact.hash_levels(rng.integers(0, 256, (100, 32), np.uint8))
    slots = exact.find_slots(rng.integers(0, 256, (1_000, 32), np.uint8), levels)
    assert slots.max() < 100 and (slots >= 0).any()  # some fall on a slot: the byte check is needed


def test_hot_digest(spark, make_docs, tiny_heavy):
    """One text on half of the rows, old and new ones, with its key split."""
    rows = [(i, "the same" if i % 2 else f"text {i // 8}") for i in range(60)]
    docs = make_docs(rows)
    got = {r.doc_id: r for r in exact.exact_dedup(docs, docs["doc_id"] % 3 == 0).collect()}
    groups = {}
    for i, text in rows:
        groups.setdefault(text, []).append(i)
    assert len(got) == 60
    for i, text in rows:
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(groups[text]), len(groups[text]), i == max(groups[text]))
