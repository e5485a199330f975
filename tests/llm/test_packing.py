import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillgraph.llm import packing, tokens

PATH = packing.default_tokenizer()


@settings(max_examples=200, deadline=None)
@given(st.text() | st.lists(st.sampled_from(["the", " ", "\n", "\t", "'s", "don't", "é", "1 000", "<|endoftext|>", "　", "..."])).map("".join))
def test_ids_are_the_library_s(text):
    assert tokens.encoder(PATH).encode(text).tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_best_fit():
    rng = np.random.default_rng(3)
    for most in (10, 60, 100):
        sizes = rng.integers(1, most + 1, 500)
        bins = packing.best_fit(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(500))
        assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
        assert len(bins) <= math.ceil(sizes.sum() / 100 * 11 / 9) + 1


def _texts(n, seed=5):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(["alpha", "be", "c", "delta's"]) for _ in range(rng.randrange(0, 90)))) for i in range(n)]


@pytest.mark.parametrize("length", [16, 64])
def test_pieces_and_places(make_docs, length):
    rows = [*_texts(150), (900, None), (901, ""), (901, ""), (None, "x y"), (902, "word " * 3_000)]
    got = packing.pack_documents(make_docs(rows), length).collect()
    library = Tokenizer.from_file(PATH)
    want = sorted((d is None, d or 0, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows)
    docs, bins = {}, {}
    for r in got:
        docs.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    for doc_id, ids in {(None if null else d): ids for null, d, ids in want}.items():
        if doc_id == 901:
            assert [tuple(np.frombuffer(r.ids, "<u4")) for r in docs[901]] == [(2,), (2,)]
            continue
        pieces = sorted(docs[doc_id], key=lambda r: r.piece)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]).tolist() == ids
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert all(r.length == length for r in pieces[1:])
        assert len(pieces) == max(1, math.ceil(len(ids) / length))
    for held in bins.values():
        end = 0
        for offset, n in sorted(held):
            assert offset == end
            end += n
        assert end <= length
    assert len(bins) <= math.ceil(sum(r.length for r in got) / length) * 1.15 + 2
    whole = {r.sequence_id: r for r in packing.sequences(packing.pack_documents(make_docs(rows), length)).collect()}
    assert sorted(len(r.ids) // 4 for r in whole.values()) == sorted(sum(n for _, n in held) for held in bins.values())


def test_digest_and_small_blocks(make_docs, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 7)
    docs = make_docs(_texts(120))
    got = packing.pack_documents(docs, 64, digest=True).collect()
    plain = {(r.doc_id, r.piece): r.ids for r in packing.pack_documents(docs, 64).collect()}
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in got} == {k: zlib.crc32(v) for k, v in plain.items()}
    bins = {}
    for r in got:
        bins[r.sequence_id] = bins.get(r.sequence_id, 0) + r.length
    assert max(bins.values()) <= 64


def test_nothing_fits_together_and_no_rows(make_docs):
    docs = make_docs([(i, "word " * 40) for i in range(30)])
    got = packing.pack_documents(docs, 64).collect()
    assert len({r.sequence_id for r in got}) == len(got) == 30
    assert packing.pack_documents(make_docs([])).count() == 0
