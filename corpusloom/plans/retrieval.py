"""Lexical and dense search, fusion, reranking and their evaluation on the test tables.

Benchmark passages are questions; a document that contains a passage as it stands is relevant to it. Vectors of one label
are relevant to each other."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import vector
from corpusloom.operators import dense, evaluate, lexical, lexical_index, quality, ranking
from corpusloom.plans.registry import query
from corpusloom.runtime import shared_dir, table

QRELS = "qrels AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
K = 10
#: Folders of indexes that this application has built.
BUILT: set[str] = set()
VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
DENSE = f"{VEC}, dn AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_inner_product(q.e, c.e), 6) AS score FROM v q, v c WHERE q.vec_id <> c.vec_id), dense AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM dn QUALIFY rank <= {K})"
L2 = f"{VEC}, ln2 AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_distance(q.e, c.e), 6) AS score FROM v q, v c WHERE q.vec_id <> c.vec_id), l2 AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS INTEGER) AS rank FROM ln2 QUALIFY rank <= {K})"
LABELS = f"lq AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)"
OVERLAP = r"""ow AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM documents),
oq AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM benchmark)"""


def bm25(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    return lexical.search(table(spark, d, "documents"), table(spark, d, "benchmark"), k)


def qrels(spark: SparkSession, d: str) -> DataFrame:
    return quality.containment(table(spark, d, "documents"), table(spark, d, "benchmark"))


def near(spark: SparkSession, d: str, metric: str = "ip", k: int = K) -> DataFrame:
    e = table(spark, d, "embeddings")
    return dense.search(e, e, k, metric, exclude_self=True)


def by_label(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each vector's ranking, where vectors of one label are relevant to each other."""
    return evaluate.per_query_by_label(near(spark, d), table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"))


def other_legs(spark: SparkSession, d: str) -> list[DataFrame]:
    """BM25 of two corpora: documents of even and of odd ids."""
    docs, q = table(spark, d, "documents"), table(spark, d, "benchmark")
    return [lexical.search(docs.filter(F.col("doc_id") % 2 == r), q, 20) for r in (0, 1)]


@query(f"WITH {lexical.oracle(K)} SELECT query_id, doc_id, score, rank FROM bm25")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25(spark, d)


def index_path(spark: SparkSession, d: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/bm25-{spark.sparkContext.applicationId}-{d.strip('/').replace('/', '-')}"


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents)
SELECT count(*) AS n_terms, sum(df) AS n_postings, max(df) AS max_df, (SELECT count(*) FROM w) AS n_docs, (SELECT sum(len(w)) FROM w) AS n_words FROM (SELECT t, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(w) AS t FROM w) GROUP BY 1)""")
def bm25_index_build(spark: SparkSession, d: str) -> DataFrame:
    """The stored index is built anew, and described."""
    path = index_path(spark, d)
    stats = lexical_index.build(table(spark, d, "documents"), path)
    BUILT.add(path)
    per = lexical_index.terms(lexical_index.load(spark, path)).agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"), F.max("df").alias("max_df"))
    return per.crossJoin(stats.select("n_docs", "n_words"))  # one row each


@query(f"WITH {lexical.oracle(K)} SELECT query_id, doc_id, score, rank FROM bm25")
def bm25_index_search(spark: SparkSession, d: str) -> DataFrame:
    """Search in the stored index, which is built if this application hasn't yet."""
    path = index_path(spark, d)
    if path not in BUILT:
        lexical_index.build(table(spark, d, "documents"), path)
        BUILT.add(path)
    return lexical_index.search(lexical_index.load(spark, path), table(spark, d, "benchmark"), K)


@query(f"WITH {lexical.oracle(K)}, {QRELS} {evaluate.oracle_metrics('bm25', 'qrels')}")
def bm25_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.metrics(bm25(spark, d), qrels(spark, d))


@query(f"WITH {QRELS} SELECT * FROM qrels")
def containment_qrels(spark: SparkSession, d: str) -> DataFrame:
    return qrels(spark, d)


@query(f"WITH {DENSE} SELECT query_id, doc_id, score, rank FROM dense")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return near(spark, d)


@query(f"WITH {L2} SELECT query_id, doc_id, score, rank FROM l2")
def dense_l2_topk(spark: SparkSession, d: str) -> DataFrame:
    return near(spark, d, "l2")


@query(f"WITH {DENSE}, {LABELS} {evaluate.oracle_metrics('dense', 'lq')}")
def dense_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.means(by_label(spark, d))


@query(f"WITH {VEC} SELECT q.vec_id AS query_id, arg_max(c.vec_id, (round(list_inner_product(q.e, c.e), 6), -c.vec_id)) AS doc_id, max(round(list_inner_product(q.e, c.e), 6)) AS score FROM v q, v c WHERE q.vec_id % 2 = 1 AND c.vec_id % 2 = 0 GROUP BY 1")
def seed_argmax(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return dense.nearest(e.filter("vec_id % 2 = 1"), e.filter("vec_id % 2 = 0"))


@query(f"WITH {DENSE} SELECT query_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6) ELSE 0 END AS norm FROM dense WINDOW w AS (PARTITION BY query_id)")
def minmax_scores(spark: SparkSession, d: str) -> DataFrame:
    return near(spark, d).select("query_id", "doc_id", F.round(vector.min_max(F.col("score"), "query_id"), 6).alias("norm"))


@query(f"""WITH {DENSE}, {L2.replace(VEC + ', ', '')}, f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM dense UNION ALL SELECT query_id, doc_id, rank FROM l2) GROUP BY 1, 2)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 10""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rrf([near(spark, d), near(spark, d, "l2")], 60, 10)


MULTI = f"""WITH {lexical.oracle(20, '(SELECT * FROM documents WHERE doc_id % 2 = 0)').replace('bm_', 'a_').replace('bm25 AS', 'e25 AS')},
{lexical.oracle(20, '(SELECT * FROM documents WHERE doc_id % 2 = 1)').replace('bm_', 'b_').replace('bm25 AS', 'o25 AS')}, {lexical.oracle(20)}"""


@query(f"""{MULTI}, u AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT * FROM e25 UNION ALL SELECT * FROM o25)),
f AS (SELECT query_id, doc_id, round(sum(1.0 / (100 + rank)), 9) AS score FROM (SELECT * FROM u UNION ALL SELECT query_id, doc_id, rank FROM bm25) GROUP BY 1, 2)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 10""")
def rrf_multi_source(spark: SparkSession, d: str) -> DataFrame:
    a, b = other_legs(spark, d)
    return ranking.merge_sources([(a.unionByName(b).drop("rank"), False), (bm25(spark, d, 20).drop("rank"), False)], 10)


@query(f"""{MULTI} SELECT DISTINCT query_id, doc_id FROM (SELECT * FROM e25 UNION ALL SELECT * FROM o25 UNION ALL SELECT * FROM bm25) WHERE rank <= 5""")
def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    return ranking.candidates([*other_legs(spark, d), bm25(spark, d, 20)], 5)


@query(f"""WITH {lexical.oracle(20)}, {OVERLAP}, s AS (SELECT query_id, doc_id, round(len(list_intersect(oq.w, ow.w))::DOUBLE / (len(oq.w) + len(ow.w) - len(list_intersect(oq.w, ow.w))), 6) AS score FROM bm25 JOIN oq USING (query_id) JOIN ow USING (doc_id))
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""")
def rerank_overlap(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rerank(bm25(spark, d, 20).select("query_id", "doc_id"), table(spark, d, "benchmark"), table(spark, d, "documents"), 10)


CHUNKED = f"WITH {lexical.oracle(30)}"


@query(f"""{CHUNKED}, h AS (SELECT query_id, doc_id AS chunk_id, doc_id // 4 AS parent, rank, score FROM bm25),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, parent ORDER BY score DESC, rank, chunk_id) = 1)
SELECT query_id, parent AS doc_id, score, chunk_id AS best_chunk, rank AS best_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, parent) AS INTEGER) AS rank FROM b""")
def chunk_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Documents stand for chunks, four to a parent."""
    hits = bm25(spark, d, 30).select("query_id", F.col("doc_id").alias("chunk_id"), F.col("rank").alias("chunk_rank"), "score")
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 4).alias("doc_id"))
    return ranking.collapse(hits, chunks)


@query(f"WITH {lexical.oracle(K)} SELECT query_id, doc_id, score, rank FROM bm25 WHERE rank % 7 = 0")
def rank_validate(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of which every seventh was moved by one; these rows are found."""
    r = bm25(spark, d)
    bad = r.withColumn("rank", F.when(F.col("rank") % 7 == 0, F.col("rank") + 100).otherwise(F.col("rank")))
    found = ranking.rank_violations(bad).filter("rank > 100")
    return found.select("query_id", "doc_id", "score", (F.col("rank") - 100).cast("int").alias("rank"))


@query(f"WITH {lexical.oracle(K)}, n AS (SELECT item_id, count(doc_id) AS n_hits FROM benchmark LEFT JOIN bm25 ON item_id = query_id AND score > 20 GROUP BY 1) SELECT n_hits, count(*) AS n_queries, n_hits < 5 AS short FROM n GROUP BY 1")
def hit_histogram(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.hit_histogram(bm25(spark, d).filter("score > 20"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id")), 5)


FIRST = "fg AS (SELECT g.query_id, CAST(min(rank) AS INTEGER) AS first_gold FROM qrels g LEFT JOIN bm25 r USING (query_id, doc_id) GROUP BY 1)"


@query(f"""WITH {lexical.oracle(3)}, {QRELS}, {FIRST}, k AS (SELECT query_id, first_gold, CASE WHEN first_gold <= 10 THEN 'success' ELSE 'failure' END AS kind FROM fg)
SELECT query_id, first_gold, kind, count(*) OVER (PARTITION BY kind) AS n_kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY query_id) AS INTEGER) AS place FROM k QUALIFY place <= 5""")
def case_selection(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.cases(evaluate.per_query(bm25(spark, d, 3), qrels(spark, d)))


@query(f"WITH {lexical.oracle(K)}, {QRELS}, {FIRST}, f3 AS (SELECT g.query_id, CAST(min(rank) FILTER (rank <= 2) AS INTEGER) AS r FROM qrels g LEFT JOIN bm25 USING (query_id, doc_id) GROUP BY 1) SELECT item_id AS query_id, first_gold AS rank_bm25, r AS rank_short FROM benchmark LEFT JOIN fg ON item_id = fg.query_id LEFT JOIN f3 ON item_id = f3.query_id")
def known_failures(spark: SparkSession, d: str) -> DataFrame:
    g, r = qrels(spark, d), bm25(spark, d)
    legs = {"bm25": evaluate.per_query(r, g), "short": evaluate.per_query(r.filter("rank <= 2"), g)}
    return evaluate.known_failures(legs, table(spark, d, "benchmark").select(F.col("item_id").alias("query_id")))


@query("SELECT event_type AS split, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("split"), F.col("value").alias("latency_ms"))
    return evaluate.latency(e)


@query(f"""WITH {DENSE}, {LABELS}, pq AS (SELECT g.query_id, count(*) FILTER (rank <= 10)::DOUBLE / count(*) AS r10 FROM lq g LEFT JOIN dense r USING (query_id, doc_id) GROUP BY 1)
SELECT label, count(*) AS n_queries, round(avg(r10), 6) AS recall_10 FROM pq JOIN embeddings ON vec_id = query_id GROUP BY ROLLUP (label)""")
def metric_rollup(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    return evaluate.means(by_label(spark, d), by=by).select("label", "n_queries", "recall_10")


@query(f"""WITH {lexical.oracle(3)} SELECT query_id, CAST(to_json(list({{'document': {{'doc_id': doc_id, 'contents': text}}, 'score': score}} ORDER BY rank)) AS VARCHAR) AS result FROM bm25 JOIN documents USING (doc_id) GROUP BY 1""")
def service_response(spark: SparkSession, d: str) -> DataFrame:
    return ranking.response(bm25(spark, d, 3), table(spark, d, "documents"))


@query()
def lsh_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return dense.lsh_search(e, e, K)


@query("SELECT count(*) AS n, count(DISTINCT text) AS n_stored, 16 AS width, count(DISTINCT text) AS n_unit FROM documents WHERE regexp_matches(text, '[a-zA-Z]')")
def dense_index_build(spark: SparkSession, d: str) -> DataFrame:
    """A stored index in two runs: the second encodes only what the first lacks; all vectors have unit length."""
    from corpusloom.functions.text import words

    path = f"{shared_dir(spark).rstrip('/')}/dense-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").filter(F.rlike("text", F.lit("[a-zA-Z]")))
    encode = lambda c: dense.hashed_embedding(words(c), 16)
    dense.build_index(docs.filter("doc_id % 3 = 0"), path, encode)
    index = dense.build_index(docs, path, encode)
    size = F.sqrt(vector.dot(F.col("embedding"), F.col("embedding")))
    return index.agg(F.count("*").alias("n_stored"), F.max(F.size("embedding")).alias("width"), F.count(F.when((size > 0.999) & (size < 1.001), 1)).alias("n_unit")).crossJoin(docs.agg(F.count("*").alias("n")))  # one row


@query("""SELECT hash_id, text FROM (SELECT 'd-' || md5(text) AS hash_id, min(text) AS text FROM documents GROUP BY 1)""")
def embedding_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A store of the documents of even ids gets all documents; only new texts are encoded."""
    from corpusloom.functions.text import words

    docs = table(spark, d, "documents")
    encode = lambda c: dense.hashed_embedding(words(c), 16)
    empty = spark.createDataFrame([], "hash_id string, text string, embedding array<double>")
    store = dense.upsert(empty, docs.filter("doc_id % 2 = 0"), encode, "d-")
    return dense.upsert(store, docs, encode, "d-").select("hash_id", "text")
