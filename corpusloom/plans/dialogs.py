"""Chat-data and answer queries on the conversations table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import rewards, text
from corpusloom.operators import agent, chat
from corpusloom.plans.registry import query
from corpusloom.runtime import table
from corpusloom.sources import readers

SPACE = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
NA = r"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({}), '[[:punct:]]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"
#: Turns dressed as trajectories, so that tag parsers have something to find.
TAGGED = """tg AS (SELECT conv_id, turn, role, text, CASE WHEN (conv_id + turn) % 4 = 0 THEN '<answer>x</answer> then <answer>' || text || '</answer>' WHEN (conv_id + turn) % 4 = 1 THEN '<think>t</think><search> ' || text || ' </search> rest' WHEN (conv_id + turn) % 4 = 2 THEN 'plain ' || text ELSE '<|im_start|>assistant <think>' || text || '</think>' || chr(10) || '<answer>y</answer>' END AS t FROM conversations)"""


def flat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def tagged(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("conv_id") + F.col("turn")) % 4
    t = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    x = F.col("text")
    return flat(spark, d).withColumn("t", F.when(k == 0, t("<answer>x</answer> then <answer>", x, "</answer>")).when(k == 1, t("<think>t</think><search> ", x, " </search> rest")).when(k == 2, t("plain ", x)).otherwise(t("<|im_start|>assistant <think>", x, "</think>\n<answer>y</answer>")))


@query("SELECT conv_id, count(*) AS n_turns, bool_and(role IN ('system', 'user', 'assistant') AND trim(text) <> '') AND max(turn) - min(turn) + 1 = count(DISTINCT turn) AS valid FROM conversations GROUP BY 1")
def chat_validate(spark: SparkSession, d: str) -> DataFrame:
    return chat.validate(flat(spark, d))


def convs(spark: SparkSession, d: str) -> DataFrame:
    return chat.nested(flat(spark, d)).withColumn("messages", chat.messages(F.col("conversations")))


@query("""WITH s AS (SELECT conv_id, arg_max(text, turn) FILTER (role = 'system') AS sys, list({'role': role, 'content': text} ORDER BY turn) FILTER (role <> 'system') AS m FROM conversations GROUP BY 1)
SELECT conv_id, CAST(coalesce(len(m), 0) + CASE WHEN coalesce(sys, '') <> '' THEN 1 ELSE 0 END AS INTEGER) AS n, CASE WHEN coalesce(sys, '') <> '' THEN 'system: ' || sys || chr(10) ELSE '' END || coalesce(array_to_string(list_transform(m, lambda x: x.role || ': ' || x.content), chr(10)), '') AS messages FROM s""")
def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    out = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    head = F.when((F.element_at("messages", 1)["role"] == "system") & (F.size("messages") == 1), F.concat(out, F.lit("\n"))).otherwise(out)
    return convs(spark, d).select("conv_id", F.size("messages").alias("n"), head.alias("messages"))


@query("""WITH n AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS island FROM n)
SELECT conv_id, island, role, string_agg(text, chr(10) ORDER BY turn) AS text FROM i GROUP BY 1, 2, 3""")
def turn_merge(spark: SparkSession, d: str) -> DataFrame:
    return chat.merged_turns(flat(spark, d))


PAIRS = """pq AS (SELECT conv_id, turn, role, text, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM conversations WHERE role <> 'system'),
pr AS (SELECT conv_id, g, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user') AS u, max(text) FILTER (role = 'assistant') AS a FROM pq GROUP BY 1, 2), pairs AS (SELECT * FROM pr WHERE u IS NOT NULL AND a IS NOT NULL)"""


@query(f"WITH {PAIRS} SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY g) - 1 AS INTEGER) AS n, u AS \"user\", a AS assistant FROM pairs")
def history_pairs(spark: SparkSession, d: str) -> DataFrame:
    return convs(spark, d).select("conv_id", F.posexplode(chat.history_pairs(F.col("messages"))).alias("n", "p")).select("conv_id", "n", "p.user", "p.assistant")


@query("""WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, min(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS fu FROM conversations)
SELECT a.conv_id, CAST(a.i AS INTEGER) AS upto, string_agg(b.role || ': ' || b.text, chr(10) ORDER BY b.turn) AS messages FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.turn <= a.turn WHERE a.role = 'assistant' AND a.turn > a.fu GROUP BY 1, 2""")
def prefix_samples(spark: SparkSession, d: str) -> DataFrame:
    out = chat.prefix_samples(convs(spark, d))
    return out.select("conv_id", "upto", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("messages"))


@query()
def sft_labels(spark: SparkSession, d: str) -> DataFrame:
    pairs = convs(spark, d).withColumn("pairs", chat.history_pairs(F.col("messages")))
    return chat.sft_rows(pairs.filter("size(pairs) > 0"), 128).select("conv_id", F.array_join("input_ids", " ").alias("input_ids"), F.array_join("labels", " ").alias("labels"))


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), f AS (SELECT conv_id, max(role) FILTER (i = 1) AS r1 FROM m GROUP BY 1),
s AS (SELECT conv_id, role, text, i - CASE WHEN r1 = 'user' THEN 0 ELSE 1 END AS j FROM m JOIN f USING (conv_id)), k AS (SELECT *, min(j) FILTER (role NOT IN ('user', 'assistant')) OVER (PARTITION BY conv_id) AS stop, count(*) FILTER (j >= 1) OVER (PARTITION BY conv_id) AS n FROM s WHERE j >= 1)
SELECT conv_id, count(*)::INTEGER AS n, string_agg(text, ' | ' ORDER BY j) AS prompt FROM k WHERE n >= 2 AND (stop IS NULL OR j < stop) AND role = CASE WHEN j % 2 = 1 THEN 'user' ELSE 'assistant' END GROUP BY 1 HAVING count(*) >= 2 AND count(*) % 2 = 0""")
def ppo_prompts(spark: SparkSession, d: str) -> DataFrame:
    out = convs(spark, d).withColumn("h", chat.strict_pairs(F.col("conversations"))).filter("h is not null")
    return out.select("conv_id", F.size("h").alias("n"), F.array_join("h", " | ").alias("prompt"))


@query(f"WITH {PAIRS}, l AS (SELECT conv_id, string_agg('User: ' || u || chr(10) || 'Assistant: ' || a, chr(10) ORDER BY g) AS p, arg_max(a, g) AS last, arg_min(u, g) AS other FROM pairs GROUP BY 1) SELECT conv_id, p AS prompt, last AS chosen, other AS rejected FROM l WHERE length(last) > 0 AND length(other) > 0 AND length(p || last) <= 4000 AND length(p || other) <= 4000")
def preference_pairs(spark: SparkSession, d: str) -> DataFrame:
    x = convs(spark, d).withColumn("pairs", chat.history_pairs(F.col("messages"))).filter("size(pairs) > 0")
    x = x.withColumns({"good": F.try_element_at("pairs", F.lit(-1))["assistant"], "bad": F.try_element_at("pairs", F.lit(1))["user"]}).select("conv_id", "pairs", "good", "bad")
    return chat.preference_rows(x, F.col("pairs"), "good", "bad", 4000).select("conv_id", "prompt", "chosen", "rejected")


@query("SELECT 'bench' AS data_source, 'user' AS role, 'Answer the question. Think first, search when you lack knowledge. Question: ' || CASE WHEN trim(text) LIKE '%?' THEN trim(text) ELSE trim(text) || '?' END AS content, 'fact-reasoning' AS ability, 'rule' AS style, item_id::VARCHAR AS target, 'train' AS split, item_id AS \"index\" FROM benchmark")
def rl_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = chat.rl_rows(table(spark, d, "benchmark"), "bench", text.question_form("text"), F.array(F.col("item_id").cast("string")), "train", F.col("item_id"))
    return rows.select("data_source", F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"), "ability", "reward_model.style", F.col("reward_model.ground_truth.target")[0].alias("target"), "extra_info.split", "extra_info.index")


@query("SELECT conv_id, turn, last_value(q IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS input, text AS output FROM (SELECT *, CASE WHEN role = 'user' THEN text END AS q FROM conversations) QUALIFY role = 'assistant' AND input IS NOT NULL")
def answer_pairs(spark: SparkSession, d: str) -> DataFrame:
    return readers.answer_pairs(flat(spark, d))


@query(f"""WITH {PAIRS}, o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY g) AS i, u, a FROM pairs)
SELECT conv_id, string_agg(CASE WHEN i = 1 THEN 'A chat between a curious user and an assistant.</s>' ELSE '</s>' END || 'USER: ' || u || ' ASSISTANT:' || a, '' ORDER BY i) AS dialog FROM o GROUP BY 1""")
def template_render(spark: SparkSession, d: str) -> DataFrame:
    x = convs(spark, d).withColumn("pairs", chat.history_pairs(F.col("messages"))).filter("size(pairs) > 0")
    return x.select("conv_id", F.array_join(chat.render(F.col("pairs"), "vicuna"), "").alias("dialog"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return flat(spark, d).withColumn("gold", F.element_at(F.split(F.lower("text"), r"\s+"), 1))


@query(f"SELECT conv_id, turn, {NA.format('text')} AS norm, {NA.format('text')} = {NA.format('lower(text)')} AS em FROM conversations")
def answer_em(spark: SparkSession, d: str) -> DataFrame:
    return flat(spark, d).select("conv_id", "turn", text.normalize_answer("text").alias("norm"), text.exact_match("text", F.array(F.lower("text"))).alias("em"))


@query(rf"WITH g AS (SELECT *, regexp_split_to_array(lower(text), '\s+')[1] AS gold FROM conversations) SELECT conv_id, turn, contains({NA.format('text')}, {NA.format('gold')}) AS sub, CASE WHEN {NA.format('text')} <> '' AND {NA.format('gold')} <> '' AND contains({NA.format('text')}, {NA.format('gold')}) THEN 1 ELSE 0 END AS contain FROM g")
def answer_subem(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("conv_id", "turn", text.sub_match("text", F.array("gold")).alias("sub"), text.contains_answer("text", "gold").alias("contain"))


@query(f"WITH {TAGGED}, b AS (SELECT conv_id, turn, regexp_extract_all(t, '(?s)<answer>(.*?)</answer>', 1) AS b FROM tg) SELECT conv_id, turn, CASE WHEN len(b) >= 2 THEN {SPACE.format('b[-1]')} END AS answer FROM b")
def answer_extract(spark: SparkSession, d: str) -> DataFrame:
    return tagged(spark, d).select("conv_id", "turn", text.last_answer("t").alias("answer"))


@query(f"""WITH {TAGGED}, p AS (SELECT conv_id, turn, t, strpos(t, '<search>') AS s, strpos(t, '<answer>') AS a FROM tg)
SELECT conv_id, turn, CASE WHEN s > 0 AND (a = 0 OR s < a) THEN 'search' WHEN a > 0 THEN 'answer' END AS action, CASE WHEN s > 0 AND (a = 0 OR s < a) THEN {SPACE.format("regexp_extract(t, '(?s)<search>(.*?)</search>', 1)")} WHEN a > 0 THEN {SPACE.format("regexp_extract(t, '(?s)<answer>(.*?)</answer>', 1)")} ELSE '' END AS content FROM p""")
def action_parse(spark: SparkSession, d: str) -> DataFrame:
    return tagged(spark, d).select("conv_id", "turn", text.action("t").alias("a")).select("conv_id", "turn", "a.action", "a.content")


@query(f"WITH {TAGGED} SELECT conv_id, turn, (conv_id + turn) % 4 = 3 AND text NOT LIKE '%<%' AS valid FROM tg")
def format_check(spark: SparkSession, d: str) -> DataFrame:
    return tagged(spark, d).select("conv_id", "turn", text.valid_trajectory("t").alias("valid"))


@query(f"""WITH {TAGGED}, p AS (SELECT conv_id, turn, (conv_id + turn) % 4 AS k, turn % 3 <> 0 AS active FROM tg)
SELECT conv_id, turn, CAST(NOT active OR k IN (0, 3) AS INTEGER) AS done, CAST(active AND k <> 2 AS INTEGER) AS valid, CAST(active AND k = 1 AS INTEGER) AS is_search, CASE WHEN active AND k = 1 THEN chr(10) || chr(10) || '<information>none</information>' || chr(10) || chr(10) WHEN active AND k = 2 THEN {"'" + agent.RETRY.replace(chr(10), "' || chr(10) || '") + "'"} ELSE '' END AS observation FROM p""")
def environment_step(spark: SparkSession, d: str) -> DataFrame:
    rows = tagged(spark, d).withColumns({"active": F.col("turn") % 3 != 0, "found": F.lit(" none ")})
    return agent.step(rows, "t").select("conv_id", "turn", "done", "valid", "is_search", "observation")


NUM = "(-?[0-9.,]+)"


@query(f"""WITH x AS (SELECT conv_id, turn, list_filter(regexp_extract_all(text, '{NUM}', 1), lambda v: v <> '.' AND v <> '') AS l, regexp_extract('so #### ' || conv_id || ',000 ' || text, '#### {NUM}', 1) AS s FROM conversations)
SELECT conv_id, turn, l[-1] AS last, replace(s, ',', '') AS strict, CASE WHEN replace(s, ',', '') = conv_id || '000' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM x""")
def gsm8k_extract(spark: SparkSession, d: str) -> DataFrame:
    x = flat(spark, d).withColumn("s", F.concat(F.lit("so #### "), F.col("conv_id").cast("string"), F.lit(",000 "), F.col("text"))).withColumn("g", F.concat(F.col("conv_id").cast("string"), F.lit("000")))
    return x.select("conv_id", "turn", rewards.last_number("text").alias("last"), rewards.strict_number("s").alias("strict"), rewards.number_reward("s", "g").alias("reward"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 0.0::DOUBLE WHEN o_orderkey % 3 = 0 AND o_custkey <> 0 THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS reward FROM orders WHERE o_orderkey <= 500""")
def countdown_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Equations over an order's two keys: wrong numbers, the right sum, none."""
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    eq = F.concat(F.lit("Assistant: <answer>("), a.cast("string"), F.lit(" + "), F.when(a % 3 == 0, F.lit("0")).otherwise(b.cast("string")), F.lit(") * 1"), F.when(a % 3 == 2, F.lit("")).otherwise(F.lit("</answer>")))
    x = table(spark, d, "orders").filter("o_orderkey <= 500").withColumn("t", eq)
    return x.select("o_orderkey", rewards.equation_reward("t", (a + b).cast("double"), F.array(a, b, F.lit(1).cast("bigint"))).alias("reward"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN (CASE WHEN text LIKE '% %' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) ELSE 0.0::DOUBLE END AS reward FROM conversations")
def reward_dispatch(spark: SparkSession, d: str) -> DataFrame:
    r = {"user": F.when(F.contains("text", F.lit(" ")), 1.0).otherwise(0.5)}
    return flat(spark, d).select("conv_id", "turn", rewards.dispatch("role", r).alias("reward"))
