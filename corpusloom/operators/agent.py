"""Search agents: one step of the environment as columns, and the loop over turns with a pluggable generator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.runtime import cut

RETRY = "\nThat was no action. Put a query in a search tag or the result in an answer tag, then go on.\n"


def step(rows: DataFrame, response: str = "response", active: str = "active", retry: str = RETRY, searching: bool = True) -> DataFrame:
    """Adds action, content, done, valid and is_search; for inactive rows done is 1 and the rest 0. Search results, where
    there are any, are in column `found` and become the observation."""
    a = text.action(response)
    out = rows.withColumns({"action": a["action"], "content": a["content"]})
    on = F.col(active)
    kind = F.when(on, F.coalesce("action", F.lit("none"))).otherwise("off")
    flag = lambda *k: kind.isin(*k).cast("int")
    found = F.trim(F.coalesce("found", F.lit(""))) if searching and "found" in rows.columns else F.lit("")
    obs = F.when(kind == "search", F.concat(F.lit("\n\n<information>"), found, F.lit("</information>\n\n"))).when(kind == "none", F.lit(retry)).otherwise("")
    return out.withColumns({"done": flag("answer", "off"), "valid": flag("answer", "search"), "is_search": flag("search"), "observation": obs})


def run(rows: DataFrame, generate: Callable[[DataFrame], DataFrame], retrieve: Callable[[DataFrame], DataFrame], turns: int, limit: int | None = None) -> DataFrame:
    """Trajectories (id, prompt) through at most `turns` turns and a last one without search: text, turns, n_valid, n_search, done.

    generate adds `response` to rows (id, text); retrieve gives (id, found) for rows (id, content). Finished rows take no
    part in later turns; each turn is checkpointed."""
    state = rows.select("id", F.col("prompt").alias("text"), F.lit(0).alias("turns"), F.lit(0).alias("n_valid"), F.lit(0).alias("n_search"), F.lit(False).alias("done"))
    for t in range(turns + 1):
        last = t == turns
        live = state.filter(~F.col("done"))
        said = generate(live.select("id", "text")).select("id", text.cut_response("response").alias("response"))
        acted = live.join(said, "id").withColumn("active", F.lit(True))
        if not last:
            asked = acted.select("id", text.action("response").alias("a")).filter("a.action = 'search'").select("id", "a.content")
            acted = acted.join(retrieve(asked), "id", "left")
        s = step(acted.drop("done"), searching=not last)
        grown = F.concat("text", "response", F.when(F.lit(last), F.lit("")).otherwise(F.col("observation")))
        new = s.select("id", (F.right(grown, F.lit(limit)) if limit else grown).alias("text"), (F.col("turns") + 1).alias("turns"), (F.col("n_valid") + F.col("valid")).alias("n_valid"), (F.col("n_search") + F.col("is_search")).alias("n_search"), (F.col("action") == "answer").eqNullSafe(F.lit(True)).alias("done"))
        state = cut(state.filter("done").unionByName(new))
    return state


def follow_ups(response: Column) -> Column:
    """Queries of a reply's "output" list, without their numbers."""
    listed = F.from_json(F.regexp_extract(response, r"(?s)\"?output\"?\s*:\s*(\[.*?\])", 1), "array<string>")
    return F.transform(listed, lambda q: F.regexp_replace(q, r"^\d+\.\s*", ""))


def iterative_answers(questions: DataFrame, ask: Callable[[DataFrame], DataFrame], answer: Callable[[DataFrame], DataFrame], rounds: int) -> DataFrame:
    """Context (id, question, context) of rounds of follow-up questions and their answers: ask adds `queries` (array), answer
    gives (id, query, reply) rows."""
    state = questions.select("id", "question", F.lit("").alias("context"))
    for _ in range(rounds):
        q = ask(state).select("id", F.posexplode("queries").alias("n", "query"))
        got = q.join(answer(q.select("id", "query")), ["id", "query"])
        text_ = got.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "query", "reply"))), lambda x: F.concat(F.lit("\n\nQuery: "), x["query"], F.lit("\nAnswer: "), x["reply"])), "").alias("more"))
        state = cut(state.join(text_, "id", "left").select("id", "question", F.concat("context", F.coalesce("more", F.lit(""))).alias("context")))
    return state
