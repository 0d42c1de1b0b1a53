"""Answers from evidence: retrieval, numbered passages, a prompt, a generator, the answer out of its reply, and its score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators.ranking import chosen
from corpusloom.runtime import cut

Retrieve = Callable[[DataFrame, DataFrame], DataFrame]
PROMPT = "Evidence:\n{context}\n\nQuestion: {question}\nGive your reasons, then the result after 'Answer:'."

#: Retrievers by name: functions of documents and questions that give a ranking.
RETRIEVERS: dict[str, Retrieve] = {}


def retriever(name: str, otherwise: str = "dense") -> Retrieve:
    """A registered retriever; an unknown name is the other one."""
    return RETRIEVERS.get(name) or RETRIEVERS[otherwise]


def evidence(ranking: DataFrame, docs: DataFrame, k: int, chars: int | None = None) -> DataFrame:
    """(query_id, context): the first k documents as numbered passages in rank order, each of at most `chars` characters."""
    best = cut(ranking.filter(F.col("rank") <= k).select("query_id", "doc_id", "rank"))
    own = F.col("text") if chars is None else F.left("text", F.lit(chars))
    full = best.join(chosen(docs.select("doc_id", own.alias("content")), best, "doc_id"), "doc_id")
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"])
    return full.groupBy("query_id").agg(F.array_join(text.citations(items), "\n").alias("context"))


def prompts(questions: DataFrame, contexts: DataFrame, query_id: str = "item_id", question: str = "text", form: str = PROMPT) -> DataFrame:
    """(query_id, prompt); a question without evidence has an empty context."""
    q = questions.select(F.col(query_id).alias("query_id"), F.col(question).alias("question"))
    filled = F.replace(F.replace(F.lit(form), F.lit("{context}"), F.coalesce("context", F.lit(""))), F.lit("{question}"), F.col("question"))
    return q.join(contexts, "query_id", "left").select("query_id", filled.alias("prompt"))


def answered(asked: DataFrame, generate: Callable[[Column], Column], mark: str = "Answer:") -> DataFrame:
    """(query_id, answer) from the generator's replies (a column of prompts to one of replies)."""
    return asked.select("query_id", text.after_mark(generate(F.col("prompt")), mark).alias("answer"))


def scored(answers: DataFrame, golds: DataFrame) -> DataFrame:
    """One row (n, accuracy, contains): exact and contained short answers against (query_id, golds array)."""
    both = answers.join(golds, "query_id")
    return both.agg(F.count("*").alias("n"), F.round(F.avg(text.exact_match("answer", F.col("golds")).cast("double")), 6).alias("accuracy"), F.round(F.avg(text.sub_match("answer", F.col("golds")).cast("double")), 6).alias("contains"))
