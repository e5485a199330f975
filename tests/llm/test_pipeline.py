import os
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quillgraph.llm import packing, similar, tokens

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs.collect()]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        if number < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        kept.append(docs.collect())
    raw, clean, single, apart, mixed, packed = kept

    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    benign = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").collect()}
    left = {r.doc_id for r in clean}
    assert left < {r.doc_id for r in raw}
    assert len(benign - left) <= 0.03 * len(benign) and len(toxic - left) >= 0.5 * len(toxic)

    largest = {}
    for r in clean:
        largest[r.text] = max(r.doc_id, largest.get(r.text, r.doc_id))
    assert sorted(r.doc_id for r in single) == sorted(largest.values())

    sets = {r.doc_id: similar.shingles(r.text) for r in single}
    stays = {r.doc_id for r in apart}
    assert len(stays) == len(apart) and stays <= set(sets)
    close = [(a, b) for a in sets for b in sets if a < b and similar.similarity(sets[a], sets[b]) >= 0.8]
    assert close and not any(a in stays and b in stays for a, b in close)
    for gone in set(sets) - stays:
        assert any((a == gone and b in stays) or (b == gone and a in stays) for a, b in close)

    copies = Counter(r.doc_id for r in mixed)
    assert set(copies) <= {r.doc_id for r in apart} and max(copies.values()) <= 3

    encode = tokens.encoder(packing.default_tokenizer()).encode
    texts = {r.doc_id: r.text for r in apart}
    pieces = {}
    for r in packed:
        pieces.setdefault((r.doc_id, r.piece), []).append(np.frombuffer(r.ids, "<u4").tolist())
    for doc_id, n in copies.items():
        ids = []
        for piece in range(sum(d == doc_id for d, _ in pieces)):
            assert len(pieces[doc_id, piece]) == n
            ids += pieces[doc_id, piece][0]
        assert ids == [*encode(texts[doc_id]), 2]
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1_024
    assert len(fill) <= 1.05 * sum(fill.values()) / 1_024 + 2


def test_query_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
    assert set(entry.oracle_sql()) <= set(names)
