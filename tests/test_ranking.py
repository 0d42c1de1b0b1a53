from __future__ import annotations

import math

import numpy as np
import pytest
from checks import DATA
from pyspark.sql import functions as F

from corpusloom.operators import dense, evaluate, graph, lexical, ranking


def run(spark, lists):
    return spark.createDataFrame([(q, d, float(-i), i + 1) for q, ds in lists.items() for i, d in enumerate(ds)], "query_id string, doc_id string, score double, rank int")


def gold(spark, rel):
    return spark.createDataFrame([(q, d) for q, ds in rel.items() for d in ds], "query_id string, doc_id string")


def order(df):
    return [r.doc_id for r in df.orderBy("rank").collect()]


@pytest.fixture
def hits(spark):
    h = spark.createDataFrame([("q", "c1", 1, 4.0), ("q", "c3", 2, 5.0), ("q", "c4", 3, 5.0), ("q", "c2", 4, 6.0)], "query_id string, chunk_id string, chunk_rank int, score double")
    c = spark.createDataFrame([("c1", "d1"), ("c2", "d1"), ("c3", "d2"), ("c4", "d0")], "chunk_id string, doc_id string")
    return h, c


def test_collapse(hits):
    rows = ranking.collapse(*hits).orderBy("rank").collect()
    assert " ".join(r.doc_id for r in rows) == "d1 d2 d0"
    assert (rows[0].score, rows[0].best_chunk, rows[1].best_rank) == (6.0, "c2", 2)


def test_collapse_errors(hits):
    with pytest.raises(Exception, match="unknown chunk"):
        ranking.collapse(hits[0], hits[1].filter("chunk_id <> 'c3'")).collect()
    with pytest.raises(Exception, match="fewer than 4"):
        ranking.collapse(*hits, min_docs=4).collect()
    assert ranking.collapse(*hits, min_docs=3).count() == 3


def test_fusion(spark):
    assert order(ranking.rrf([run(spark, {"q": "d1 d2 d3".split()}), run(spark, {"q": "d2 d1 d4".split()})])) == "d1 d2 d3 d4".split()
    assert order(ranking.rrf([run(spark, {"q": ["d1", "d2"]}), run(spark, {"q": ["d2", "d3"]})], 1))[0] == "d2"
    with pytest.raises(ValueError):
        ranking.rrf([run(spark, {"q": ["d1"]})], 0)
    assert order(ranking.dedup_ranking(run(spark, {"q": "x x d1".split()}))) == ["x", "d1"]
    assert ranking.overfetch(10) == 100 and ranking.overfetch(80) == 160


def test_merge_of_one_retriever_keeps_scores(spark):
    h = run(spark, {"q": ["a", "b", "c"]}).drop("rank")
    assert order(ranking.merge_sources([(h, False)], 2)) == ["a", "b"]
    assert order(ranking.merge_sources([(h, True)], 2)) == ["c", "b"]


def metric(spark, lists, rel):
    return evaluate.metrics(run(spark, lists), gold(spark, rel), (1, 2, 5, 10)).collect()[0]


def test_metrics(spark):
    m = metric(spark, {"q1": "d1 x y".split(), "q2": "x d2 y".split()}, {"q1": ["d1"], "q2": ["d2"]})
    assert (m.recall_1, m.recall_2, m.mrr_10) == (0.5, 1.0, 0.75) and m.ndcg_10 == round((1 + 1 / math.log2(3)) / 2, 6)
    m = metric(spark, {"q": "x x d1".split()}, {"q": ["d1"]})
    assert (m.recall_2, m.mrr_10) == (1.0, 0.5)
    m = metric(spark, {"q": "d1 d3 d2".split()}, {"q": ["d1", "d2"]})
    assert (m.recall_1, m.recall_5, m.mrr_10) == (0.5, 1.0, 1.0) and m.ndcg_10 == round(1.5 / (1 + 1 / math.log2(3)), 6)
    m = metric(spark, {"q": ["d1"]}, {"q": ["d1"], "silent": ["d9"]})
    assert (m.n_queries, m.recall_1) == (2, 0.5)
    with pytest.raises(Exception, match="no judged query"):
        metric(spark, {"q": ["d1"]}, {})


def test_percentile(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double")
    assert df.agg(evaluate.percentile("v", 0.95).alias("p")).collect()[0].p == pytest.approx(3.8)
    assert df.filter("v > 9").agg(evaluate.percentile("v", 0.5).alias("p")).collect()[0].p == 0.0


def test_rank_violations(spark):
    good = run(spark, {"q": ["a", "b"]})
    assert ranking.rank_violations(good).count() == 0
    assert ranking.rank_violations(good.withColumn("rank", F.col("rank") + 1)).count() == 2
    assert ranking.rank_violations(good.withColumn("score", F.lit(float("nan")))).count() == 2


def test_lineage(spark):
    a = spark.createDataFrame([("x", 1, None)], "m string, n int, o string")
    assert evaluate.lineage_differences(a, a, ["m", "n", "o"]).count() == 0
    assert [r.key for r in evaluate.lineage_differences(a, a.withColumn("n", F.lit(2)), ["m", "n", "o"]).collect()] == ["n"]


def test_matrix_and_joined_bm25_agree(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17}" for k in range(1, 3 + i % 9))) for i in range(200)] + [(None, "w1"), (500, None), (501, "")], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "w1 w2 w2 zzz"), (2, "W3, w4!"), (3, "none"), (4, "")], "item_id bigint, text string")
    a, b = (sorted(map(tuple, f(docs.filter("doc_id is not null and text is not null"), q, 7).collect())) for f in (lexical.search, lexical.search_joined))
    assert a == b and a
    assert sorted(map(tuple, lexical.search(docs, q, 7).select("query_id", "doc_id").collect()))[:1]
    assert lexical.search(docs, q.limit(0), 7).count() == 0


def test_sliced_search_is_the_same(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(300)], "vec_id bigint, embedding array<float>").repartition(5)
    q = v.filter("vec_id < 40")
    whole = sorted(map(tuple, dense.search(v, q, 5).collect()))
    monkeypatch.setattr(dense, "SLICE_CELLS", 50)
    assert sorted(map(tuple, dense.search(v, q, 5).collect())) == whole
    x = np.array([r.embedding for r in v.orderBy("vec_id").collect()], np.float64)
    best = np.argsort(-np.round(x[:40] @ x.T, 6), axis=1, kind="stable")[:, :5]
    assert [(r[0], r[1]) for r in sorted(whole, key=lambda r: (r[0], r[3]))] == [(i, int(j)) for i in range(40) for j in best[i]]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_lsh_recall(spark, sf):
    e = spark.read.parquet(f"{DATA}/{sf}/embeddings.parquet")
    q = e.filter("vec_id < 50")
    pairs = lambda df: {(r.query_id, r.doc_id) for r in df.collect()}
    got, true = pairs(dense.lsh_search(e, q, 10)), pairs(dense.search(e, q, 10, "l2"))
    assert len(got) == len(true) == 10 * q.count()
    assert len(got & true) / len(true) >= 0.9


def test_lsh_query_takes_every_vector(spark):
    from corpusloom.plans import registry

    d = f"{DATA}/sf0.001"
    assert registry.QUERIES["lsh_topk"](spark, d).select("query_id").distinct().count() == spark.read.parquet(f"{d}/embeddings.parquet").count()


def test_lsh_finds_k_however_far(spark):
    """Vectors that share no bucket with any other are searched exactly."""
    v = spark.createDataFrame([(i, [float(100 * i), float(i % 3)]) for i in range(30)], "vec_id bigint, embedding array<float>")
    got = dense.lsh_search(v, v, 4).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, dense.search(v, v, 4, "l2").collect())) and len(got) == 120


def test_edges(spark):
    b = spark.createDataFrame([("c1", "Aspirin", 2), ("c1", "pain", 1), ("c2", "Aspirin", 1), ("c2", "bleeding", 1)], "doc_id string, entity string, occ int")
    w = {(r.doc_id, r.entity): r.weight for r in graph.edges(b).collect()}
    assert w[("c1", "Aspirin")] == pytest.approx(2 / 3, abs=1e-8) and w[("c2", "bleeding")] == 0.5


def test_pagerank(spark):
    e = spark.createDataFrame([("0", "2", 0.5), ("1", "2", 0.5), ("1", "3", 1.0)], "src string, dst string, weight double")
    r = spark.createDataFrame([(1, "0", 0.6), (1, "2", 0.3), (1, "3", 0.1), (1, "1", -5.0), (1, "0", float("nan")), (2, "1", 0.0), (3, "lone", 1.0), (3, "0", 1.0)], "query_id int, vertex string, weight double")
    got = {(x.query_id, x.vertex): x.rank for x in graph.pagerank(e, r, iterations=30).collect()}
    for v, want in zip("0123", (0.39242424, 0.14090909, 0.36969697, 0.09696970), strict=True):
        assert got[(1, v)] == pytest.approx(want, abs=1e-7)
    assert not [k for k in got if k[0] == 2]
    # a vertex without an edge gives its mass back to the reset vertices; the whole stays 1
    assert sum(v for k, v in got.items() if k[0] == 3) == pytest.approx(1, abs=1e-8) and got[(3, "lone")] > 0.25


def test_graph_search_of_whole_tables(spark):
    from corpusloom.plans import registry

    d = f"{DATA}/sf0.001"
    found = registry.QUERIES["graph_search"](spark, d).select("query_id").distinct().count()
    assert found == spark.read.parquet(f"{d}/benchmark.parquet").count()


def test_graph_search_bounds_entities_by_the_corpus(spark):
    docs = spark.createDataFrame([(i, f"aspirin helps number{i}" if i < 60 else f"other number{i}") for i in range(400)], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "aspirin")], "item_id bigint, text string")
    assert graph.search(docs, q, run(spark, {"1": ["0"]}).selectExpr("cast(query_id as bigint) query_id", "cast(doc_id as bigint) doc_id", "score", "rank").filter("rank > 1")).count() == 10


def test_label_metrics_equal_those_of_the_pairs(spark):
    rows = [(i, None if i % 11 == 0 else "alone" if i == 1 else f"l{i % 3}") for i in range(40)]
    labels = spark.createDataFrame([*rows, rows[2]], "id bigint, label string")
    hits = spark.createDataFrame([(i, (i * 7 + j * j) % 43, float(-j), j + 1) for i in range(45) for j in range(12)], "query_id bigint, doc_id bigint, score double, rank int")
    known = labels.filter("label is not null").distinct()
    pairs = known.select(F.col("id").alias("query_id"), "label").join(known.select(F.col("id").alias("doc_id"), "label"), "label").filter("query_id <> doc_id").drop("label")
    rounded = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.fillna(-1).collect())
    assert rounded(evaluate.per_query_by_label(hits, labels)) == rounded(evaluate.per_query(hits, pairs)) != []


def test_label_metrics_make_no_pairs(spark):
    """Of 300,000 ids of one label there would be 9e10 pairs."""
    labels = spark.range(300_000).select("id", F.lit(1).alias("label"))
    hits = spark.range(300_000).select(F.col("id").alias("query_id"), F.pmod(F.col("id") + 1, F.lit(300_000)).alias("doc_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    got = evaluate.means(evaluate.per_query_by_label(hits, labels)).first()
    assert (got.n_queries, got.mrr_10) == (300_000, 1.0)


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("scale", [1.0, 1e16])
def test_search_finds_what_single_precision_cannot_tell_apart(spark, metric, scale, monkeypatch):
    """Scores that differ in the sixth digit, many equal ones, vectors that aren't finite, and more batches than one."""
    monkeypatch.setattr(dense, "BLOCK", 70)
    rng = np.random.default_rng(3)
    x = (np.array([3.0, 5.0, 7.0]) + 1e-6 * rng.integers(0, 9, size=(3000, 3))) * scale
    x[::50] = rng.normal(size=(60, 3)) * scale
    x[17], x[18] = np.nan, np.inf
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>").coalesce(1)
    got = {}
    for r in dense.search(v, v.filter("vec_id % 13 = 0"), 5, metric, exclude_self=True).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.doc_id, r.score)
    for q in range(0, 3000, 13):
        with np.errstate(all="ignore"):
            s = np.round(np.sqrt(((x[q] - x) ** 2).sum(1)) if metric == "l2" else -np.einsum("ij,ij->i", np.broadcast_to(x[q], x.shape), x), 6)
        s[q] = s[17] = s[18] = np.inf
        assert [got[q][i + 1][0] for i in range(5)] == np.lexsort((np.arange(3000), s))[:5].tolist()


def test_search_holds_slices_of_a_bounded_size(spark):
    """Each Python worker has a copy of a slice's queries, in double and single precision."""
    assert dense.SLICE_CELLS * 12 <= 64e6


def test_hashed_embedding_is_zero_for_no_words_only(spark):
    """Of 400 words many pairs fall on one place with opposite signs."""
    w = spark.range(400).select(F.concat(F.lit("w"), F.col("id")).alias("w"))
    pairs = w.crossJoin(w.withColumnRenamed("w", "z")).select(F.array("w", "z").alias("words")).unionByName(spark.createDataFrame([([],), (["one"],)], "words array<string>"))
    sums = pairs.select(F.size("words").alias("n"), F.aggregate(dense.hashed_embedding(F.col("words"), 16), F.lit(0.0), lambda a, x: a + x * x).alias("s"))
    assert {(r.empty, round(r.s, 9)) for r in sums.select((F.col("n") == 0).alias("empty"), "s").distinct().collect()} == {(True, 0.0), (False, 1.0)}
