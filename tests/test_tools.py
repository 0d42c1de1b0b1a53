from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.templates import TEMPLATES
from corpusloom.operators import chat, tools

TOOL = json.dumps([{"name": "get", "description": "Gets.", "parameters": {"properties": {"a": {"type": "integer", "description": "n", "enum": ["1", "2"]}, "b": {"type": "array", "items": {"type": "string"}}}, "required": ["a"]}}])
CALL = '{"name": "get", "arguments": {"a": 1}}'


@pytest.mark.parametrize("dialect", tools.DIALECTS)
def test_calls_are_read_back(spark, dialect):
    df = spark.createDataFrame([(CALL,), ("plain words",), (None,)], "c string").withColumn("t", chat.call_text(F.col("c"), dialect))
    got = [r.x for r in df.select(tools.extract_calls(F.col("t"), dialect).alias("x")).collect()]
    assert [(c.name, json.loads(c.arguments)) for c in got[0]] == [("get", {"a": 1})] and got[1] is None and got[2] is None
    text = spark.range(1).select(tools.describe_tools(F.lit(TOOL), dialect).alias("d")).collect()[0].d
    assert "get" in text and "Gets." in text


def test_several_calls():
    assert tools.extract("<tool_call>\n" + CALL + "\n</tool_call>\n<tool_call>" + CALL + "</tool_call>", "qwen") == [("get", '{"a": 1}')] * 2
    assert tools.extract('Action: f\nAction Input: {"x": 1}\nAction: g\nAction Input: {"y": 2}', "default") == [("f", '{"x": 1}'), ("g", '{"y": 2}')]
    assert tools.extract("Action: f\nAction Input: {broken", "default") is None
    assert "  - a (integer, required): n, should be one of [1, 2]" in tools.describe(TOOL, "default")
    assert tools.describe("[]", "qwen") is None


def test_replies(spark):
    df = spark.createDataFrame([("Thought: hm\nAction: get\nAction Input: {}\nObservation: x",), ("Thought: hm\nFinal Answer: 4\nFinal Answer: 5",), ("just text",)], "r string")
    got = [tuple(x.p) for x in df.select(tools.parse_reply(F.col("r")).alias("p")).collect()]
    assert got == [("hm", "get", "{}", "tool_calls"), ("5", None, None, "stop"), ("just text", None, None, "stop")]
    assert spark.range(1).select(tools.stop_at(F.lit("a STOP b END"), ["END", "STOP"]).alias("x")).collect()[0].x == "a "


def test_react_turns(spark):
    kind = "m array<struct<role: string, content: string, name: string, arguments: string>>"
    rows = [("system", "s", None, None), ("user", "q", None, None), ("assistant", "look", "get", "{}"), ("function", "7", None, None), ("assistant", "it is 7", None, None)]
    got = spark.createDataFrame([(rows,)], kind).select(tools.react_turns(F.col("m"), True).alias("t")).collect()[0].t
    assert [tuple(x) for x in got] == [("user", "q"), ("assistant", "Thought: look\nAction: get\nAction Input: {}\nObservation: 7\nThought: I now know the final answer.\nFinal Answer: it is 7")]
    for bad in (rows[3:4], rows[2:3], [("robot", "x", None, None)]):
        with pytest.raises(Exception, match="needs|unknown"):
            spark.createDataFrame([(bad,)], kind).select(tools.react_turns(F.col("m"))).collect()


def test_templates(spark):
    pairs = F.array(F.struct(F.lit("a").alias("user"), F.lit("b").alias("assistant")), F.struct(F.lit("c").alias("user"), F.lit("d").alias("assistant")))
    assert len(TEMPLATES) == 33
    for name, (system, prompt, sep) in TEMPLATES.items():
        d = spark.range(1).select(chat.render(pairs, name).alias("d")).collect()[0].d
        head = system + sep if system else ""
        assert d == [head + prompt.replace("{query}", "a"), "b", sep + prompt.replace("{query}", "c"), "d"]
