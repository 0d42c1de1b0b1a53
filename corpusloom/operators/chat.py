"""Chat data: validation, conversion, turns, samples for supervised, preference and reinforcement training.

A conversation is one row with an array of (from, value), or flat rows (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import tokens
from corpusloom.functions.templates import TEMPLATES
from corpusloom.functions.text import words

ROLES = {"human": "user", "user": "user", "observation": "user", "gpt": "assistant", "assistant": "assistant", "function_call": "assistant", "system": "system"}
OBSERVATION = {"qwen": ("<tool_response>\n", "\n</tool_response>"), "glm4": ("<|observation|>\n", ""), "mistral": ("[TOOL_RESULTS] {\"content\": ", "}[/TOOL_RESULTS]")}


def nested(flat: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Flat turns as conversations (conv_id, conversations array<struct<from, value>>) in turn order."""
    item = F.struct("turn", F.col(role).alias("from"), F.col(text).alias("value"))
    return flat.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("conversations"))


def validate_lines(lines: DataFrame, allowed: tuple[str, ...] = ("system", "human", "gpt")) -> DataFrame:
    """One row (total, valid, invalid) of JSON lines (column value): valid lines hold turns, each with a known speaker and a text."""
    doc = F.from_json("value", "conversations array<struct<`from`: string, value: string>>")
    turns = doc["conversations"]
    ok = F.coalesce((F.size(turns) > 0) & F.forall(turns, lambda t: t["from"].isin(*allowed) & t["value"].isNotNull()), F.lit(False))
    return lines.filter(F.trim("value") != "").select(ok.alias("ok")).agg(F.count("*").alias("total"), F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid"))


def validate(flat: DataFrame, allowed: tuple[str, ...] = ("system", "user", "assistant")) -> DataFrame:
    """(conv_id, n_turns, valid): known roles, non-blank texts, turns numbered without gaps."""
    ok = F.col("role").isin(*allowed) & (F.trim("text") != "")
    return flat.groupBy("conv_id").agg(F.count("*").alias("n_turns"), (F.coalesce(F.bool_and(ok), F.lit(False)) & (F.max("turn") - F.min("turn") + 1 == F.count_distinct("turn"))).alias("valid"))


def from_pairs(df: DataFrame, question: Column, answer: Column) -> DataFrame:
    """conversations of one question and one answer."""
    turn = lambda who, v: F.struct(F.lit(who).alias("from"), v.alias("value"))
    return df.withColumn("conversations", F.array(turn("human", question), turn("gpt", answer)))


def instruction_text(instruction: Column, extra: Column) -> Column:
    """Question of an instruction with an optional input."""
    return F.when(F.coalesce(F.trim(extra), F.lit("")) != "", F.concat(instruction, F.lit("\n\n"), extra)).otherwise(instruction)


def observation_text(value: Column, dialect: str | None = None) -> Column:
    a, z = OBSERVATION.get(dialect or "", ("Observation: ", ""))
    return F.concat(F.lit(a), value, F.lit(z))


def call_text(value: Column, dialect: str | None = None) -> Column:
    """A function call {"name", "arguments"} in a dialect; other values as they are."""
    name = F.get_json_object(value, "$.name")
    args = F.get_json_object(value, "$.arguments")
    forms = {
        "glm4": F.concat(name, F.lit("\n"), args),
        "llama3": F.concat(F.lit('{"name": "'), name, F.lit('", "parameters": '), args, F.lit("}")),
        "mistral": F.concat(F.lit('[{"name": "'), name, F.lit('", "arguments": '), args, F.lit("}]")),
        "qwen": F.concat(F.lit('<tool_call>\n{"name": "'), name, F.lit('", "arguments": '), args, F.lit("}\n</tool_call>")),
    }
    plain = F.concat(F.lit("Action: "), name, F.lit("\nAction Input: "), args)
    out = forms.get(dialect or "", F.concat(plain, F.lit("\n")) if dialect == "default" else plain)
    return F.when(name.isNotNull() & args.isNotNull(), out).otherwise(value)


def messages(conversations: Column, dialect: str | None = None, system: Column | None = None, tools: Column | None = None) -> Column:
    """array<struct<role, content>>: system prompt (the conversation's last one, else `system`) with the tools' text
    behind it, then user and assistant turns; unknown speakers are left out."""
    kind = lambda t, who: t["from"].isin(*who)
    said = F.filter(conversations, lambda t: kind(t, [r for r, to in ROLES.items() if to != "system"]))
    turns = F.transform(said, lambda t: F.struct(
        F.when(kind(t, ["human", "user", "observation"]), "user").otherwise("assistant").alias("role"),
        F.when(t["from"] == "observation", observation_text(t["value"], dialect)).when(t["from"] == "function_call", call_text(t["value"], dialect)).otherwise(t["value"]).alias("content"),
    ))
    prompts = F.filter(conversations, lambda t: t["from"] == "system")
    prompt = F.when(F.size(prompts) > 0, F.element_at(prompts, -1)["value"]).otherwise(F.coalesce(system, F.lit("")) if system is not None else F.lit(""))
    if tools is not None:
        given = F.coalesce(tools, F.lit(""))
        prompt = F.concat(prompt, F.when((prompt != "") & (given != ""), F.lit("\n\n")).otherwise(F.lit("")), given)
    return F.when(prompt != "", F.concat(F.array(F.struct(F.lit("system").alias("role"), prompt.alias("content"))), turns)).otherwise(turns)


def history_pairs(msgs: Column) -> Column:
    """array<struct<user, assistant>>: user texts in a row are joined by line ends; an answer without a question is
    dropped, as is a question without an answer."""
    zero = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast("array<struct<user: string, assistant: string>>").alias("done"))

    def step(s: Column, m: Column) -> Column:
        asked = F.struct(F.when(s["open"].isNull(), m["content"]).otherwise(F.concat(s["open"], F.lit("\n"), m["content"])).alias("open"), s["done"].alias("done"))
        pair = F.array(F.struct(s["open"].alias("user"), m["content"].alias("assistant")))
        answered = F.struct(F.lit(None).cast("string").alias("open"), F.concat(s["done"], pair).alias("done"))
        return F.when(m["role"] == "user", asked).when((m["role"] == "assistant") & s["open"].isNotNull(), answered).otherwise(s)

    return F.aggregate(msgs, zero, step, lambda s: s["done"])


def merged_turns(flat: DataFrame) -> DataFrame:
    """(conv_id, island, role, text): turns of one role in a row joined by line ends."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    new = F.when(F.col("role").eqNullSafe(F.lag("role").over(w)), 0).otherwise(1)
    return flat.withColumn("new", new).withColumn("island", F.sum("new").over(w)).groupBy("conv_id", "island", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))


def prefix_samples(df: DataFrame, msgs: str = "messages") -> DataFrame:
    """One row per assistant turn behind the first user turn: the messages up to it."""
    role = F.transform(F.col(msgs), lambda m: m["role"])
    ends = F.filter(F.sequence(F.lit(1), F.size(msgs)), lambda i: (F.element_at(role, i) == "assistant") & (F.array_position(role, "user") > 0) & (F.array_position(role, "user") < i))
    return df.filter(F.size(msgs) > 0).withColumn("upto", F.explode(ends)).withColumn(msgs, F.slice(F.col(msgs), F.lit(1), F.col("upto")))


def strict_pairs(conversations: Column) -> Column:
    """Prompts' history under strict alternation: a first turn that isn't a user's is dropped; from an unknown speaker on
    nothing counts; turns out of turn are skipped; null unless an even number of at least two texts is left."""
    known = lambda t: t["from"].isin("human", "user", "gpt", "assistant")
    is_user = lambda t: t["from"].isin("human", "user")
    src = F.when(is_user(F.get(conversations, F.lit(0))), conversations).otherwise(F.slice(conversations, F.lit(2), F.greatest(F.lit(0), F.size(conversations) - 1)))
    stop = F.array_position(F.transform(src, lambda t: known(t)), False)
    seen = F.when(stop > 0, F.slice(src, F.lit(1), (stop - 1).cast("int"))).otherwise(src)
    kept = F.filter(seen, lambda t, i: F.when(i % 2 == 0, is_user(t)).otherwise(~is_user(t)))
    return F.when((F.size(src) >= 2) & (F.size(kept) >= 2) & (F.size(kept) % 2 == 0), F.transform(kept, lambda t: t["value"]))


def sft_rows(df: DataFrame, limit: int = 256, eos: str = "</s>", dialogs: str = "pairs") -> DataFrame:
    """input_ids and labels (as words) of history pairs: each turn fits the limit in proportion, the first turn that
    doesn't fit any more ends the sample, prompts are masked."""
    zero = F.struct(F.array().cast("array<string>").alias("ids"), F.array().cast("array<string>").alias("labels"), F.lit(False).alias("full"))

    def step(s: Column, p: Column) -> Column:
        src, tgt = tokens.fit_turn(words(p["user"]), words(p["assistant"]), limit)
        full = s["full"] | (F.size(s["ids"]) + F.size(src) + F.size(tgt) + 1 > limit)
        end = F.array(F.lit(eos))
        more = F.struct(F.concat(s["ids"], src, tgt, end).alias("ids"), F.concat(s["labels"], F.array_repeat(F.lit(str(tokens.IGNORE)), F.size(src)), tgt, end).alias("labels"), F.lit(False).alias("full"))
        return F.when(full, F.struct(s["ids"].alias("ids"), s["labels"].alias("labels"), F.lit(True).alias("full"))).otherwise(more)

    out = df.withColumn("__s", F.aggregate(F.col(dialogs), zero, step))
    return out.withColumns({"input_ids": F.col("__s.ids"), "labels": F.col("__s.labels")}).drop("__s").filter(F.exists("labels", lambda x: x != str(tokens.IGNORE)))


def preference_rows(df: DataFrame, pairs: str, chosen: str, rejected: str, limit: int | None = None) -> DataFrame:
    """(prompt, chosen, rejected): the prompt is the history's text; rows whose prompt and answers are empty or longer than
    `limit` characters are dropped."""
    prompt = F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("User: "), p["user"], F.lit("\nAssistant: "), p["assistant"])), "\n")
    out = df.select(*[c for c in df.columns if c not in ("prompt", chosen, rejected)], prompt.alias("prompt"), F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected")).filter((F.length("chosen") > 0) & (F.length("rejected") > 0))
    return out if limit is None else out.filter((F.length(F.concat("prompt", "chosen")) <= limit) & (F.length(F.concat("prompt", "rejected")) <= limit))


def rl_rows(df: DataFrame, source: str, question: Column, golds: Column, split: str, index: Column, prefix: str = "Answer the question. Think first, search when you lack knowledge. Question: ") -> DataFrame:
    """Nested rows for reinforcement training."""
    return df.select(
        F.lit(source).alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit(prefix), question).alias("content"))).alias("prompt"),
        F.lit("fact-reasoning").alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.struct(golds.alias("target")).alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), index.cast("bigint").alias("index")).alias("extra_info"),
    )


def grpo_rows(df: DataFrame, question: Column, answer: Column, system: str) -> DataFrame:
    msg = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return df.withColumns({"prompt": F.array(msg("system", F.lit(system)), msg("user", question)), "answer": answer})


def first_split(splits: dict[str, DataFrame], order: tuple[str, ...] = ("test", "dev", "train")) -> DataFrame:
    """The first split that there is."""
    return next(splits[s] for s in order if s in splits)


def render(pairs: Column, template: str, system: Column | None = None) -> Column:
    """array<string> dialog of prompts and answers in turn by a template."""
    own, prompt, sep = TEMPLATES[template]
    head = F.coalesce(F.when(system != "", system), F.lit(own)) if system is not None else F.lit(own)
    head = F.when(head != "", F.concat(head, F.lit(sep))).otherwise(F.lit(""))
    return F.flatten(F.transform(pairs, lambda p, i: F.array(F.concat(F.when(i == 0, head).otherwise(F.lit(sep)), F.replace(F.lit(prompt), F.lit("{query}"), p["user"])), p["assistant"])))


def bounded_prompts(df: DataFrame, tokens_of: Column, least: int, most: int) -> DataFrame:
    """Rows whose prompt has at least `least` and at most `most` tokens."""
    return df.filter(F.size(tokens_of).between(least, most))


def preference_ids(prompt: Column, chosen: Column, rejected: Column, eos: int, size: int, pad: int = 0) -> tuple[Column, Column, Column, Column]:
    """Token ids of prompt and answer with an end mark, padded or cut to `size`, and their masks: for the chosen and the rejected one."""
    row = lambda a: F.concat(prompt, a, F.array(F.lit(eos)))
    mask = lambda a: F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: (i <= F.size(row(a))).cast("int"))
    return tokens.pad(row(chosen), size, pad), mask(chosen), tokens.pad(row(rejected), size, pad), mask(rejected)


def fitting_pairs(df: DataFrame, prompt: Column, chosen: Column, rejected: Column, limit: int) -> DataFrame:
    """Preference rows whose prompt with either answer (arrays of tokens) is within the limit."""
    return df.filter((F.size(prompt) + F.size(chosen) <= limit) & (F.size(prompt) + F.size(rejected) <= limit))
