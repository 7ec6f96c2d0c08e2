import os

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kugiri.llm import bpe, chat

needs_vocabulary = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(bpe.VOCABULARY)


@needs_vocabulary
def test_tree_is_the_whole(ranks):
    whole = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    small = [bpe.Codec(ranks, leaf=n) for n in (1, 3, 7)]
    cases = ["", "a", "it's  they'll\n\n  x", "   ", "a   ", "  a", "x'" + "s" * 9, "日本語のテキスト、二行目　三", "né 🤌🏿🤌🏿 'll 're", "1234567 89,,,, !!'s", "\t\r\n \x1c\x1d y\x85z", "<|endoftext|> a"]
    for t in cases:
        for c in small:
            assert c.encode(t) == whole(t), t
            assert c.decode(c.encode(t)) == t

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.sampled_from(list("ab 's1,\n\t.é日🤌‍\xa0　\x1c’")), max_size=60))
    def random(t):
        for c in small:
            assert c.encode(t) == whole(t)
            assert c.decode(c.encode(t)) == t

    random()


@needs_vocabulary
def test_bpe_tables(docs, clashing, none, ranks):
    whole = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    got = bpe.encode(clashing)
    rows = got.join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    for r in rows:
        assert (r.tokens is None) == (r.text is None)
        assert r.text is None or list(r.tokens) == whole(r.text) and r.n_tokens == len(r.tokens)
    assert got.count() == docs.count()
    back = {r.doc_id: r.text for r in bpe.decode(got).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}
    assert bpe.encode(none[0]).count() == 0


def test_fingerprints_are_distinct_and_ignore_the_rest():
    assert len(chat.MAPPINGS) == len(chat.ALL)
    assert chat.hashed(["a.b", "prompt", "completion"]) == chat.hashed(["completion", "prompt", "zz"])


def test_json_layouts(spark):
    import json

    rows = [
        {"messages": [{"role": "system", "content": "s"}, {"role": "human", "content": "q"}, {"role": "assistant", "content": "a"}, {"role": "user", "content": ""}], "id": 3},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "i", "input": "x", "output": "o"}, {"Instruction": "i", "output": "o"}, {"prompt": "p", "completion": None}, {"system": "s", "prompt": "p", "response": "r"},
        {"unknown": 1}, [], "text", {"messages": []},
        {"instruction": "i", "input": "x", "output": "o", "text": "whole"}, {"prompt": "p", "messages": [{"role": "user", "content": "q"}]}, {"messages": [{"content": "q"}, {"content": "a"}]},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "q1"}, {"type": "image", "url": "u"}, {"type": "text", "text": "q2"}]}]},
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": [{"text": "a"}]}, {"role": "tool", "content": None}]}, {"conv_id": 1, "turn": 2, "role": "user", "text": "t"},
        {"prompt": "p", "completion": "c", "response": "r"}, {"dialogue": [{"text": "w " * 300_000}, {"text": ""}, {"text": "b"}]},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)] + [(90, None), (91, "{"), (92, "")], "id int, j string")
    got = {r.id: (r.s.layout, r.s.turns and [(t.role, t.content) for t in r.s.turns]) for r in df.select("id", chat.canonical_json(F.col("j")).alias("s")).collect()}
    assert got[0] == ("messages", [("system", "s"), ("user", "q"), ("assistant", "a")])
    assert got[1] == ("conversations", [("user", "q"), ("assistant", "a")])
    assert got[2] == ("instruction and input", [("user", "i\n\nx"), ("assistant", "o")])
    assert got[3] == ("instruction", [("user", "i"), ("assistant", "o")])
    assert got[4] == ("prompt and completion", [("user", "p")])
    assert got[5] == ("prompt and response, system", [("system", "s"), ("user", "p"), ("assistant", "r")])
    assert all(got[i] == (None, None) for i in (6, 7, 8, 15, 90, 91, 92))
    assert got[9] == ("messages", [])
    assert got[10] == ("instruction and input", [("user", "i\n\nx"), ("assistant", "o")])
    assert got[11] == ("messages", [("user", "q")])
    assert got[12] == ("messages, no roles", [("user", "q"), ("assistant", "a")])
    assert got[13] == ("messages, parts", [("user", "q1\n\nq2")])
    assert got[14] == ("messages", [("user", "q"), ("assistant", "a")])
    assert got[16] == ("prompt and completion", [("user", "p"), ("assistant", "c")])
    assert got[17] == ("dialogue, no roles", [("user", "w " * 300_000), ("user", "b")])


def test_column_layouts(spark):
    df = spark.createDataFrame([("q", "a", 7), ("q", None, 8), (None, "", 9)], "Prompt string, completion string, layout int")
    got = chat.canonical(df)
    assert got.columns == ["layout", "turns"]
    assert [[(t.role, t.content) for t in r.turns] for r in got.collect()] == [[("user", "q"), ("assistant", "a")], [("user", "q")], []]
    df = spark.createDataFrame([(1, "s", [("Human", "q"), ("gpt", "a"), (None, "z")]), (2, None, None)], "id int, system string, conversations array<struct<from string, value string>>")
    got = {r.id: [(t.role, t.content) for t in r.turns] for r in chat.canonical(df).collect()}
    assert got == {1: [("system", "s"), ("user", "q"), ("assistant", "a"), ("user", "z")], 2: []}
    with pytest.raises(ValueError):
        chat.canonical(spark.createDataFrame([(1,)], "x int"))


def test_turn_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s"), (1, 2, None, ""), (None, 0, "user", "x"), (2, 0, "Human", "z"), (3, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = {r.conv_id: (r.layout, [(t.role, t.content) for t in r.turns]) for r in chat.canonical(df).collect()}
    assert got == {1: ("turn rows", [("system", "s"), ("user", "a"), ("assistant", "b")]), 2: ("turn rows", [("user", "z")]), 3: ("turn rows", [])}
    assert chat.canonical(df.where("1 = 0")).count() == 0


def test_long_turns_are_whole(spark):
    text = "wörd " * 300_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text + "b"), (1, 1, "assistant", text + "b")], "conv_id long, turn long, role string, text string")
    (row,) = chat.canonical(df).collect()
    assert [(t.role, t.content) for t in row.turns] == [("user", text), ("assistant", text + "b")]


@pytest.mark.parametrize("extra", [("content",), ("system",), ("prompt", "completion"), ("instruction", "input", "output", "system"), ("layout", "turns", "chat", "t", "some", "roles", "n_turns")])
def test_turn_rows_with_clashing_columns(spark, tmp_path, extra):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "Human", "z"), (4, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in extra})
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.layout, r.n_turns, r.roles, r.chat) for r in chat.op3_chat(spark, str(tmp_path)).collect()}
    assert got == {1: ("turn rows", 2, "user,assistant", "<|user|>\na\n<|assistant|>\nb\n"), 2: ("turn rows", 1, "user", "<|user|>\nz\n"), 4: ("turn rows", 0, "", "")}


def test_columns_in_parts_or_without_roles(spark):
    df = spark.createDataFrame([(1, [("user", [("text", "a"), ("image", None), ("text", "b")])]), (2, [])], "id int, messages array<struct<role string, content array<struct<type string, Text string>>>>")
    got = {r.id: (r.layout, [(t.role, t.content) for t in r.turns]) for r in chat.canonical(df).collect()}
    assert got == {1: ("messages, parts", [("user", "a\n\nb")]), 2: ("messages, parts", [])}
    df = spark.createDataFrame([(1, [("q",), ("a",)])], "id int, turns array<struct<text string>>")
    assert [[(t.role, t.content) for t in r.turns] for r in chat.canonical(df).collect()] == [[("user", "q"), ("assistant", "a")]]
