from __future__ import annotations

import ast
from collections import Counter
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from checks import DATA
from test_decontam_suffix import brute_matches
from test_sharding_mixing import jump
from test_simhash import brute_groups

from corpusloom.llm import queries, toxicity

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and every stage's result, written and read again."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        f(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = spark.read.parquet(path)
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_have_the_columns_of_documents(stages):
    want = ["doc_id", "text", "lang", "source", "n_chars"]
    assert len(stages) == 5 and all(b.columns == want for _, b in stages[:-1]) and stages[-1][1].columns == [*want, "shard"]


def test_toxic_documents_go(spark, stages):
    a, b = stages[0]
    model = toxicity.model_for(a, spark.read.parquet(f"{SF}/labels.parquet"))
    _, code = toxicity.process_cache("toxicity").setdefault("tables", toxicity._tables())
    kept = set()
    for d, t in rows(a):
        vocab: dict[bytes, int] = {}
        units = toxicity._train_units(t, vocab)
        v = toxicity.score_words([code[np.frombuffer(w, np.uint8)] for w in vocab], model.weight)
        if not any(v[s].sum() > model.threshold for s in units):
            kept.add(d)
    assert {d for d, _ in rows(b)} == kept


def test_one_of_each_group_stays(stages):
    a, b = stages[1]
    want = brute_groups(rows(a))
    empty = {d for d, _ in rows(a)} - set(want)
    assert {d for d, _ in rows(b)} == set(want.values()) | empty


def test_leaks_go(spark, stages):
    a, b = stages[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {i: t for i, t in items}
    suspects = [(d, t) for d, t in rows(a) if any(w in t for w in (" ".join(x.split()[3:8]) for x in grams.values()))]
    gone = {m[0] for m in brute_matches(suspects, items, 13)}
    assert {d for d, _ in rows(a)} - {d for d, _ in rows(b)} == gone


def test_mixing_follows_the_square_roots(stages):
    a, b = stages[3]
    n, m = (Counter(r.source for r in x.select("source").collect()) for x in (a, b))
    total, w = sum(n.values()), sum(v**0.5 for v in n.values())
    assert all(abs(m[s] - total * n[s] ** 0.5 / w) <= 1 for s in n)
    assert {d for d, _ in rows(b)} <= {d for d, _ in rows(a)}


def test_shards_are_those_of_the_loop(stages):
    a, b = stages[4]
    assert b.count() == a.count() and all(r.shard == jump(r.doc_id, 1024) for r in b.collect())


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.exceptAll(stages[-1][1]).count() == 0 and got.count() == stages[-1][1].count()


def test_stages_bear_messy_and_empty_tables(spark, messy, none):
    for docs in (messy, none):
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, docs, SF)
            assert set(docs.columns) <= set(out.columns), name
            out.count()


def test_queries_are_named_by_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_nothing_else_imports_the_subpackage():
    root = Path(corpus_pipeline.__file__).parent
    for p in (root / "corpusloom").rglob("*.py"):
        if "llm" in p.relative_to(root / "corpusloom").parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [n.name for n in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), p
