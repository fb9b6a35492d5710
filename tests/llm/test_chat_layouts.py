"""Which layout a table or record has, with fields of other layouts beside its own."""

import json

import pytest
from pyspark.sql import functions as F

from grainlake.llm import chat
from grainlake.llm import queries as Q

FOREIGN = ("input", "prompt", "output", "instruction", "completion", "response", "messages", "thread_id", "body", "record", "formatted", "mark")


def test_columns_of_other_layouts_change_nothing(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    want = sorted(map(tuple, Q.op3_chat_formatting(spark, folder).collect()))
    assert len(want) == 21
    for k, extra in enumerate((FOREIGN[:1], FOREIGN)):
        more = table
        for name in extra:
            more = more.withColumn(name, F.lit("x"))
        more.write.parquet(str(tmp_path / str(k) / "conversations.parquet"))
        assert sorted(map(tuple, Q.op3_chat_formatting(spark, str(tmp_path / str(k))).collect())) == want


def test_table_of_no_layout_is_an_error(spark):
    with pytest.raises(ValueError, match="no layout"):
        chat.turns_of_rows(spark.createDataFrame([(1, "a")], "conv_id long, text string"))


def test_most_specific_table_layout(spark):
    both = spark.createDataFrame([(1, 0, "user", "a", 5, 6, "bot", "b")], "conv_id long, turn int, role string, text string, thread_id long, position int, author_role string, body string")
    assert [tuple(r) for r in chat.turns_of_rows(both).collect()] == [(1, 0, "user", "a")]
    assert chat.turns_of_rows(both.where("false")).count() == 0


RECORDS = {
    1: ({"messages": [{"role": "user", "content": "a"}], "prompt": "x"}, [("user", "a")]),
    2: ({"messages": [{"content": "no role"}, {"role": "gpt", "content": "b", "id": 4}], "id": 3}, [(None, "no role"), ("assistant", "b")]),
    3: ({"instruction": "do", "input": "it", "output": "done", "prompt": "p", "messages": []}, [("user", "do\nit"), ("assistant", "done")]),
    4: ({"instruction": "do", "output": "done", "response": "r"}, [("user", "do"), ("assistant", "done")]),
    5: ({"prompt": "p", "completion": "c", "response": "r"}, [("user", "p"), ("assistant", "c")]),
    6: ({"prompt": None, "response": "r", "x": {"y": [1]}}, [("user", ""), ("assistant", "r")]),
    7: ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, [("user", "q"), ("assistant", "")]),
    8: ({"nothing": 1}, None),
}


def test_records_with_further_fields(spark):
    rows = [(k, json.dumps(r)) for k, (r, _) in RECORDS.items()] + [(9, None), (10, "{not json")]
    got = chat.turns_of_json(spark.createDataFrame(rows, "rec long, json string"), "rec", "json")
    turns = {}
    for r in sorted(got.collect(), key=lambda r: (r.record, r.turn or 0)):
        turns.setdefault(r.record, []).append((r.role, r.text) if r.turn is not None else None)
    assert turns == {k: w or [None] for k, (_, w) in RECORDS.items()} | {9: [None], 10: [None]}
