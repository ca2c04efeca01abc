import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from parley.llm import chat_format as chat

from .helpers import rows

PARTS = ["<|im_start|>", "<|im_end|>", "<|", "<\\|", "<", "\\", "|", "<\\\\|", "assistant", "\n", "ok", "%", "%0A", "é", "$1"]


def test_round_trip(spark):
    texts = st.lists(st.sampled_from(PARTS), max_size=8).map("".join)
    cases = []

    @settings(max_examples=200, deadline=None, database=None)
    @given(st.lists(st.tuples(texts, texts), max_size=4))
    def gather(turns):
        cases.append([(r or "assistant", t) for r, t in turns] + [("assistant", "last")])

    gather()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "conv_id long, turns array<struct<role:string,text:string>>").withColumn("layout", F.lit("x"))
    formatted = chat.format_turns(df)
    for r in rows(chat.read_back(formatted)):
        want = cases[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == want
        assert r["loss_text"] == "".join(t for role, t in want if role == "assistant")
        assert r["formatted"].count("<|im_start|>") == len(want) == r["formatted"].count("<|im_end|>")


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, "messages", [("user", "a"), ("assistant", "b")]),
    ({"id": 7, "messages": []}, "no messages", []),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "from-value", [("user", "a"), ("assistant", "b")]),
    ({"turns": [{"role": "bot", "text": "x"}]}, "role-text", [("assistant", "x")]),
    ({"prompt": "p", "response": "r", "meta": {"k": 1}}, "prompt-response", [("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "completion": None}, "prompt-completion", [("user", "p"), ("assistant", "")]),
    ({"system": "s", "prompt": "p", "response": "r"}, "system-prompt-response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"question": "q", "answer": "a"}, "question-answer", [("user", "q"), ("assistant", "a")]),
    ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "x", "output": "o"}, "instruction-input", [("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": "o"}, "instruction-input", [("user", "i"), ("assistant", "o")]),
    ({"something": "else"}, None, []),
]


def test_layouts(spark):
    records = [json.dumps(r) for r, _, _ in LAYOUTS] + [None, "", "{no json", "[]", "null"]
    df = spark.createDataFrame([(i, r, "clash") for i, r in enumerate(records)], "conv_id long, record string, turns string")
    got = {r["conv_id"]: r for r in rows(chat.canonical_turns(df))}
    for i, (_, layout, turns) in enumerate(LAYOUTS):
        assert (got[i]["layout"], [(t["role"], t["text"]) for t in got[i]["turns"]]) == (layout, turns), layout
    for i in range(len(LAYOUTS), len(records)):
        assert got[i]["layout"] is None and got[i]["turns"] == []


def test_report_on_odd_rows(spark, tmp_path):
    data = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 0, "user", None), (None, 0, None, "x"), (2, None, "assistant", ""), (3, 0, "assistant", "y" * 300_000)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("record", F.lit("clash")).withColumn("layout", F.lit(1))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in rows(chat.chat_report(spark, str(tmp_path)))}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in got.items()} == {-1: (2, len(chat.PROBE)), 1: (3, 1), None: (1, 0), 2: (1, 0), 3: (1, 300_000)}
    assert chat.records_of(df.limit(0)).count() == 0


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "{}")], "conv_id long, record string")
    plan = chat.read_back(chat.format_turns(chat.canonical_turns(df)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_text_longer_than_a_json_string_can_be(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "user", "short"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    df = df.withColumn("text", F.coalesce("text", F.repeat(F.lit("y"), F.lit(21_000_000))))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in rows(chat.chat_report(spark, str(tmp_path)))}
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["layout"]) == (2, 21_000_000, "from-value")
    with pytest.raises(Exception, match="can't be read as JSON"):
        chat.canonical_turns(chat.records_of(spark.read.parquet(f"{tmp_path}/conversations.parquet"))).collect()


def test_typed_records_have_the_turns_of_their_json(spark):
    data = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", None), (2, 0, None, "\u0000\"\\\n\u20ac"), (3, 0, "user", "a"), (3, 1, "assistant", "b"),
            (5, 0, "bot", "renamed elsewhere"), (6, 0, "system", ""), (7, 0, "system", "s"), (7, 1, "user", None), (7, 2, "assistant", "r"), (11, 0, "user", "x"),
            (None, 0, "user", "n"), (-1, 0, "user", "a"), (-2, 0, "x,y", "b"), (-3, 0, None, None)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("record", F.lit("clash"))
    order = lambda x: sorted(rows(x), key=str)
    records = chat.unlike_records(df)
    typed = chat.typed_turns(records)
    assert order(typed) == order(chat.canonical_turns(records.withColumn("record", F.to_json("record"))))
    assert order(typed.drop("layout")) == order(chat.canonical_turns(chat.records_of(df)).drop("layout"))
    layouts = {r["conv_id"]: r["layout"] for r in rows(typed)}
    assert layouts == {1: "from-value", 2: "role-text", 3: "prompt-response", 5: "messages", 6: "role-text", 7: "system-prompt-response", 11: "messages",
                       None: "messages", -1: "messages", -2: "role-text", -3: "from-value"}


def test_typed_records_of_no_layout(spark):
    df = spark.sql("""select 1 as conv_id, named_struct('prompt', 'p', 'answer', cast(null as string)) as record union all select 2, null
                      union all select 3, named_struct('prompt', null, 'answer', null)""")
    assert [(r["layout"], r["turns"]) for r in rows(chat.typed_turns(df))] == [(None, [])] * 3
    empty = spark.sql("select 1 as conv_id, named_struct('messages', cast(array() as array<struct<role:string,content:string>>)) as record")
    assert [(r["layout"], r["turns"]) for r in rows(chat.typed_turns(empty))] == [("no messages", [])]


def test_query_picks_the_layout_by_the_hash_of_each_row(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    plan = chat.chat_report(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(" in plan and "Python" not in plan
