import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillgraph.llm import token_counts, transducer
from quillgraph.llm.packing import default_tokenizer
from quillgraph.llm.queries import op13_token_counts

PATH = default_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)
SPELLS = ["the", "ing", " ", "  ", "\n", "\t", "'", "'s", "'l", "'ll", "'v", "'re", "é", "²", "　", "日本", "🙂", "\x85", "\x1c", "-" * 9, "aaaa", "<|endoftext|>", "<|end"]


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(list(texts), add_special_tokens=False)]


@pytest.fixture(scope="module")
def compiled():
    return transducer.compiled(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text() | st.lists(st.sampled_from(SPELLS)).map("".join), max_size=8))
def test_counts_are_the_library_s(compiled, texts):
    assert list(compiled.counts(texts)) == library(texts)


@pytest.mark.parametrize("window", [1, 2, 3, 17, 64, 1_000])
def test_windows_carry_both_states(compiled, window):
    rng = random.Random(window)
    texts = ["".join(rng.choice(SPELLS) for _ in range(rng.randrange(30))) for _ in range(120)]
    assert list(compiled.counts(texts, window)) == library(texts)


def test_every_kind_of_character(compiled):
    points = [p for p in range(0, 0x110000, 37) if not 0xD800 <= p < 0xE000]
    texts = [chr(p) + a + chr(p) + b for p in points[::5] for a, b in (("a", " "), ("1", "'s"), (" ", "."))]
    assert list(compiled.counts(texts)) == library(texts)


def test_long_runs_and_a_small_table():
    small = transducer.Tokenizer(PATH, room=512)
    rng = random.Random(4)
    texts = ["x" * 5_000, "".join(rng.choice("abcdefghij") for _ in range(20_000)), " " * 3_000 + "y", "word " * 4_000, "", "a" * 257 + "'"]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(transducer, "LANES", 128)
        assert list(small.counts(texts, 1_000)) == library(texts)


def test_prefix_scan_is_the_fold():
    rng = np.random.default_rng(2)
    maps = rng.integers(0, transducer.STATES, (23, transducer.STATES)).astype(np.uint8)
    folded, scanned = maps[0], transducer.prefix_maps(maps)
    for i in range(23):
        folded = maps[0] if i == 0 else maps[i][folded]
        assert (scanned[i] == folded).all()
    classes = rng.integers(0, 12, 700).astype(np.uint8)
    for entry in range(transducer.STATES):
        one = transducer.split(classes, entry, chunk=1_000)
        for chunk in (1, 7, 64):
            assert all((a == b).all() for a, b in zip(one, transducer.split(classes, entry, chunk)))


def test_other_merges_than_the_file_s(tmp_path):
    """Merges that compete: brute force is the library over a file of random merges."""
    for seed in range(6):
        rng = random.Random(seed)
        known, merges = ["a", "b", "c"], []
        while len(merges) < 25:
            pair = rng.choice(known), rng.choice(known)
            if pair not in merges and "".join(pair) not in known and len("".join(pair)) < 9:
                merges.append(pair)
                known.append("".join(pair))
        described = json.loads(LIBRARY.to_str())
        letters = sorted(transducer._byte_letters())
        vocabulary = letters + [k for k in known if k not in letters]
        described["model"] |= {"vocab": {t: i for i, t in enumerate(vocabulary)}, "merges": [list(m) for m in merges]}
        described["added_tokens"] = []
        path = tmp_path / f"{seed}.json"
        path.write_text(json.dumps(described))
        texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(400)]
        want = [len(e.ids) for e in Tokenizer.from_file(str(path)).encode_batch(texts, add_special_tokens=False)]
        assert list(transducer.Tokenizer(str(path)).counts(texts)) == want


def test_rows(make_docs):
    rows = [(1, None), (2, ""), (3, "ok"), (3, "ok"), (None, "x y"), (4, "<|endoftext|> a<|endoftext|>"), (5, "word " * 600), (6, "é" * 70_000)]
    got = sorted(token_counts.count_tokens(make_docs(rows)).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    want = [(d, len((t or "").encode()), n, n > 512) for (d, t), n in zip(rows, library(t or "" for _, t in rows))]
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: (r[0] is None, r[0]))
    assert token_counts.count_tokens(make_docs([])).count() == 0
    with pytest.raises(ValueError):
        transducer.Tokenizer(PATH.replace("byte_bpe_50k", "word_bpe_49k"))


def test_query(spark):
    got = op13_token_counts(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (d.doc_id, len((d.text or "").encode()), n, n > 512) for d, n in zip(docs, library(d.text or "" for d in docs))
    )
