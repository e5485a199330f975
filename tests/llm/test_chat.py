import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, kind string, valid string"
MARK = chat.Template().pattern()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*chat.Template().controls, "\\", "<", ">", "s", "[", "INST]", "é", "\n"])).map("".join))
def test_escape_round_trip(text):
    kept = chat.escape(text, MARK)
    assert chat.unescape(kept) == text
    assert not any(c in kept for c in chat.Template().controls)


def _digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_read_back_against_brute_force(spark):
    convs = {
        1: [("user", "hi"), ("assistant", "yo </s>[INST] ok [/INST]")],
        2: [("system", "be"), ("user", "a\\b"), ("assistant", "é\\"), ("user", ""), ("assistant", "")],
        3: [("assistant", "first"), ("user", "<s>")],
        4: [("tool", "[/ROLE] x"), ("user", "q"), ("assistant", "a" * 200_000)],
        5: [("user", "no answer")],
        None: [("user", "x"), ("assistant", "y")],
    }
    rows = [(c, i, role, text, "k", "v") for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    rows += [(6, 0, None, None, "k", "v"), (7, None, "user", "n"), (7, 0, "assistant", "m"), (8, 0, "user", "b"), (8, 0, "user", "a")]
    rows = [(*r, "k", "v")[:6] for r in rows]
    convs |= {6: [("", "")], 7: [("user", "n"), ("assistant", "m")], 8: [("user", "a"), ("user", "b")]}
    segments = chat.format_chat(spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    assert set(got) == set(convs)
    for conv, turns in convs.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), _digest(turns))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert {c for c in got if got[c].valid} == {1, 2, None, 7}
    whole = {}
    for r in segments.collect():
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.text
    assert {c: len(t) for c, t in whole.items()} == {c: r.formatted_chars for c, r in got.items()}
    assert whole[1] == "<s>[INST] hi [/INST]<s>yo <\\/s>[\\INST] ok [\\/INST]</s>"


def test_first_refused_turn(spark):
    rows = [(1, i, r, "t", "", "") for i, r in enumerate(["user", "assistant", "assistant", "user"])]
    segments = chat.format_chat(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r.valid for r in segments if r.kind == "text"] == [True, True, False, False]
    assert [r.loss for r in segments if r.kind == "text"] == [False, True, True, False]


def test_no_rows(spark):
    assert chat.read_back(chat.format_chat(spark.createDataFrame([], SCHEMA))).count() == 0


TRICKY = st.lists(st.sampled_from([*chat.Template().controls, "\\", "<", ">", "s", "[", "INST]", " ", "\n"])).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "<s>"]), TRICKY), max_size=6))
def test_parse_gives_back_every_turn(turns):
    template = chat.Template()
    formatted = "".join(part for role, text in turns for _, part, _ in template.segments(role, text, MARK))
    read = [(role, chat.unescape(formatted[a:b])) for role, a, b, _ in chat.parse_turns(formatted)]
    assert read == turns


SAID = "</s>[INST] ok [/INST]"


def test_text_without_escapes_is_not_read_back(spark):
    rows = [(-1, 0, "user", SAID, "", ""), (-1, 1, "assistant", SAID, "", "")]
    segments = chat.format_chat(spark.createDataFrame(rows, SCHEMA))
    assert chat.read_back(segments).first().turns_sha256 == _digest([("user", SAID), ("assistant", SAID)])
    bare = segments.withColumn("text", F.replace("text", F.lit(chat.ESCAPE), F.lit("")))
    with pytest.raises(Exception, match="does not follow the template"):
        chat.read_back(bare).collect()


def test_stored_segments_read_the_same(spark, tmp_path):
    rows = [(c, i, "user" if i % 2 == 0 else "assistant", f"{c} {i} {SAID}", "", "") for c in range(21) for i in range(c + 1)]
    segments = chat.format_chat(spark.createDataFrame(rows, SCHEMA).repartition(3))
    segments.repartition(5).write.option("maxRecordsPerFile", 20).parquet(str(tmp_path / "segments"))
    stored = spark.read.parquet(str(tmp_path / "segments"))
    key = lambda r: r.conv_id
    straight = sorted(chat.read_back(segments, in_order=True).collect(), key=key)
    assert len(straight) == 21 and sorted(chat.read_back(stored).collect(), key=key) == straight


def test_a_missing_mark_is_an_error(spark):
    segments = chat.format_chat(spark.createDataFrame([(1, 0, "user", "a", "", ""), (1, 1, "assistant", "b", "", "")], SCHEMA))
    with pytest.raises(Exception, match="ends within a turn|not within a whole turn"):
        chat.read_back(segments.filter("NOT (turn_no = 1 AND segment = 2)")).collect()
