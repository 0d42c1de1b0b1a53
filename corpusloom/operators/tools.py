"""Tool use in five dialects: descriptions of tools, extraction of calls, and the thought/action text form of messages."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIALECTS = ("default", "glm4", "llama3", "mistral", "qwen")
CALLS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())]))
INTRO = {
    "default": "These tools can be used:\n{tools}To use one, write two lines, `Action:` with one of [{names}] and `Action Input:` with its arguments as JSON.\n",
    "glm4": "# 可用工具{tools}",
    "llama3": "These functions can be called with a JSON object of \"name\" and \"parameters\".\n\n{tools}",
    "mistral": "[AVAILABLE_TOOLS] {tools}[/AVAILABLE_TOOLS]",
    "qwen": "\n\n# Tools\n\nSignatures are in <tools></tools>; answer with calls in <tool_call></tool_call>.\n<tools>{tools}\n</tools>",
}


def _parameters(tool: dict) -> str:
    spec = tool.get("parameters") or {}
    lines = []
    for name, p in (spec.get("properties") or {}).items():
        kind = p.get("type", "") + (", required" if name in (spec.get("required") or []) else "")
        more = (f", should be one of [{', '.join(map(str, p['enum']))}]" if p.get("enum") else "") + (f", each item is {p['items'].get('type', '')}" if p.get("items") else "")
        lines.append(f"  - {name} ({kind}): {p.get('description', '')}{more}\n")
    return "".join(lines)


def describe(tools: str | None, dialect: str) -> str | None:
    """System text about a JSON array of tools; null for none."""
    if not tools or not (parsed := json.loads(tools)):
        return None
    dump = lambda x, **k: json.dumps(x, ensure_ascii=False, **k)
    wrapped = [{"type": "function", "function": t} for t in parsed]
    body = {
        "default": lambda: "".join(f"> Tool Name: {t['name']}\nTool Description: {t.get('description', '')}\nTool Args:\n{_parameters(t)}\n" for t in parsed),
        "glm4": lambda: "".join(f"\n\n## {t['name']}\n\n{dump(t, indent=4)}" for t in parsed),
        "llama3": lambda: "".join(dump(w, indent=4) + "\n\n" for w in wrapped),
        "mistral": lambda: dump(wrapped),
        "qwen": lambda: "".join("\n" + dump(w) for w in wrapped),
    }[dialect]()
    return INTRO[dialect].replace("{tools}", body).replace("{names}", ", ".join(t["name"] for t in parsed))


def _load(x: str) -> object | None:
    try:
        return json.loads(x)
    except ValueError:
        return None


def extract(text: str | None, dialect: str) -> list[tuple[str, str]] | None:
    """(name, arguments as JSON) of a reply's calls; None where it isn't one, or not wholly readable."""
    if text is None:
        return None
    arg = "parameters" if dialect == "llama3" else "arguments"
    if dialect == "default":
        found = re.findall(r"Action:\s*(\w+)\s+Action Input:\s*(.+?)\s*(?=Action:|\Z)", text, re.S | re.A)
        calls = [{"name": n, arg: _load(re.sub(r'^["`\s]+|["`\s]+$', "", a))} for n, a in found]
    elif dialect == "glm4":
        name, sep, rest = text.partition("\n")
        calls = [{"name": name, arg: _load(rest.strip())}] if sep else []
    elif dialect == "qwen":
        calls = [_load(x.strip()) for x in re.findall(r"<tool_call>\s*(\{.+?\})\s*</tool_call>", text, re.S)]
    else:
        got = _load(text.strip())
        calls = got if isinstance(got, list) else [got]
    ok = calls and all(isinstance(c, dict) and "name" in c and c.get(arg) is not None for c in calls)
    return [(c["name"], json.dumps(c[arg], ensure_ascii=False)) for c in calls] if ok else None


def describe_tools(tools: Column, dialect: str) -> Column:
    if dialect not in DIALECTS:
        raise ValueError(dialect)

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: describe(x, dialect))

    return run(tools)


def extract_calls(reply: Column, dialect: str) -> Column:
    """array<struct<name, arguments>>, null for a plain reply."""
    if dialect not in DIALECTS:
        raise ValueError(dialect)

    @F.pandas_udf(CALLS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if (c := extract(x, dialect)) is None else [{"name": n, "arguments": a} for n, a in c])

    return run(reply)


def stop_at(text: Column, stops: Sequence[str]) -> Column:
    """A text up to the first of any stop words."""
    for s in stops:
        text = F.substring_index(text, s, 1)
    return text


def parse_reply(reply: Column) -> Column:
    """struct<content, name, arguments, finish> of a thought/action text: a call if it names an action and its input, else
    what follows the last final answer."""
    form = r"(?s)^(.*?)\nAction:(.*?)\nAction Input:(.*?)(?:\nObservation:.*)?$"
    name = F.trim(F.regexp_extract(reply, form, 2))
    called = F.rlike(reply, F.lit(form)) & (name != "")
    thought = F.trim(F.regexp_replace(F.regexp_extract(reply, form, 1), r"(?s)^.*?Thought: ", ""))
    final = F.regexp_replace(reply, r"(?s)^.*\nFinal Answer: ", "")
    return F.struct(
        F.when(called, thought).otherwise(final).alias("content"),
        F.when(called, name).alias("name"),
        F.when(called, F.trim(F.regexp_extract(reply, form, 3))).alias("arguments"),
        F.when(called, "tool_calls").otherwise("stop").alias("finish"),
    )


def react_turns(messages: Column, with_tools: bool = False) -> Column:
    """array<struct<role, content>> in thought/action form of messages (role, content, name, arguments): calls and function
    results are written into the assistant's turn before them; turns of one role in a row are joined. A function result without
    an assistant's turn before it, an answer at the start or an unknown role is an error; a leading system message is dropped."""
    turn = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
    msgs = F.when(F.get(messages, F.lit(0))["role"] == "system", F.slice(messages, F.lit(2), F.greatest(F.lit(0), F.size(messages) - 1))).otherwise(messages)
    clean = lambda c: F.rtrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\n+", ""))

    def step(acc: Column, m: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        body = clean(m["content"])
        thought = F.when(F.startswith(body, F.lit("Thought:")), body).otherwise(F.concat(F.lit("Thought: "), body))
        call = F.concat(thought, F.lit("\nAction: "), m["name"], F.lit("\nAction Input: "), m["arguments"])
        plain = F.concat(F.lit("Thought: I now know the final answer.\nFinal Answer: "), body) if with_tools else body
        said = F.when(m["name"].isNotNull(), call).otherwise(plain)
        grown = lambda more: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["role"].alias("role"), F.concat(last["content"], more).alias("content"))))
        new = lambda role, c: F.concat(acc, F.array(F.struct(F.lit(role).alias("role"), c.alias("content"))))
        fail = lambda why: F.raise_error(F.lit(why)).cast(turn)
        return (
            F.when(m["role"] == "user", new("user", body))
            .when((m["role"] == "function") & (last["role"] == "assistant"), grown(F.concat(F.lit("\nObservation: "), body)))
            .when(m["role"] == "function", fail("a function's result needs an assistant's turn before it"))
            .when((m["role"] == "assistant") & last["role"].isNull(), fail("an answer needs a question before it"))
            .when((m["role"] == "assistant") & (last["role"] == "user"), new("assistant", said))
            .when(m["role"] == "assistant", grown(F.concat(F.lit("\n"), said)))
            .otherwise(fail("unknown role"))
        )

    return F.aggregate(msgs, F.array().cast(turn), step)
