"""BM25: as matrix products over Arrow batches for question sets that fit a broadcast slice, and as joins over a postings table."""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import words
from corpusloom.functions.wordhash import hashed_words, norm
from corpusloom.operators.ranking import TopK, top_k
from corpusloom.runtime import small_batches, spread

#: Cells (terms x questions) of the weight matrix that is broadcast at once; larger question sets are searched in slices of that size.
SLICE_CELLS = 8_000_000


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, term, tf, dl): how often each document has each term, and the document's number of terms."""
    tok = docs.select(F.col(id_col).alias("doc"), words(text_col).alias("w")).select("doc", F.size("w").alias("dl"), F.explode("w").alias("term"))
    return tok.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("dl").cast("bigint").alias("dl"))


def _slices(queries: DataFrame, query_id: str, text_col: str) -> Iterator[SimpleNamespace]:
    """Question sets of a bounded size: ids, sorted hashes of their terms, counts (terms x questions)."""
    q = queries.select(F.col(query_id).cast("bigint").alias("i"), norm(text_col).alias("t")).filter("i is not null and t <> ''")
    size = q.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(F.split("t", " "))), F.lit(0)).alias("w")).first()
    n = max(1, -(-size["n"] * min(size["w"], 200_000) // SLICE_CELLS))
    for k in range(n):
        part = (q if n == 1 else q.filter(F.pmod(F.xxhash64("i"), F.lit(n)) == k)).toArrow()
        ids, hs, sizes = part.column("i").to_numpy(), [], []
        for chunk in part.column("t").chunks:
            for _, _, h, at in hashed_words(chunk):
                hs.append(h)
                sizes.append(np.diff(at))
        if not len(ids):
            continue
        vocab, inv = np.unique(np.concatenate(hs), return_inverse=True)
        counts = np.zeros((len(vocab), len(ids)))
        np.add.at(counts, (inv, np.repeat(np.arange(len(ids)), np.concatenate(sizes))), 1)
        yield SimpleNamespace(ids=ids, vocab=vocab, counts=counts)


def _counts(h: np.ndarray, at: np.ndarray, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the terms that texts and the vocabulary share."""
    term = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
    hit = np.flatnonzero(vocab[term] == h)
    row = np.searchsorted(at, hit, "right") - 1
    key, n = np.unique(row * len(vocab) + term[hit], return_counts=True)
    return key // len(vocab), key % len(vocab), n


def search(docs: DataFrame, queries: DataFrame, k: int = 10, b: float = 0.4, k1: float = 0.9, doc_id: str = "doc_id", query_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of every query. Equal scores (to 6 digits) go by id.

    Two scans of the text, no shuffle of it: the first counts in how many documents each question term is (a row per
    term and task), the second multiplies documents' term weights with the questions' and keeps each task's k best per
    question. Questions are broadcast in slices of a bounded size. Ids are integers; a null id or text takes no part
    as a question, and documents without an id aren't found."""
    small_batches(docs.sparkSession)
    texts = spread(docs.select(F.col(doc_id), F.col(text_col))).select(F.col(doc_id).cast("bigint").alias("i"), norm(text_col).alias("t"))
    out = None
    for s in _slices(queries, query_id, text_col):
        found = _search_slice(texts, s, k, k1=k1, b=b)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "query_id bigint, doc_id bigint, score double")
    return top_k(out, k, ["query_id"], [F.desc("score"), F.asc("doc_id")])


def _search_slice(texts: DataFrame, s: SimpleNamespace, k: int, *, k1: float, b: float) -> DataFrame:
    sc = texts.sparkSession.sparkContext
    vocab = sc.broadcast(s.vocab)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        df, n, total = np.zeros(len(v), np.int64), 0, 0
        for batch in batches:
            for a, z, h, at in hashed_words(batch.column(1)):
                n, total = n + z - a, total + len(h)
                _, term, _ = _counts(h, at, v)
                df += np.bincount(term, minlength=len(v))
        on = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], on])), pa.array(np.concatenate([[n], df[on]])), pa.array(np.concatenate([[total], np.zeros(len(on), np.int64)]))], ["term", "n", "words"])

    got = texts.mapInArrow(count, "term bigint, n bigint, words bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).toArrow()  # a row per question term
    term, n = got.column("term").to_numpy(), got.column("n").to_numpy()
    n_docs = int(n[term < 0].sum())
    avg = got.column("words").to_numpy().sum() / max(1, n_docs)
    df = np.zeros(len(s.vocab))
    df[term[term >= 0]] = n[term >= 0]
    shared = sc.broadcast((s.ids, np.log(1 + (n_docs - df + 0.5) / (df + 0.5))[:, None] * s.counts))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, (ids, weight) = vocab.value, shared.value
        best = TopK(len(ids), k)
        for batch in batches:
            own = batch.column(0)
            for a, z, h, at in hashed_words(batch.column(1)):
                row, term, tf = _counts(h, at, v)
                present, col = np.unique(term, return_inverse=True)
                size = np.diff(at)[row]
                m = np.zeros((z - a, len(present)))
                m[row, col] = tf / (tf + k1 * (1 - b + b * size / avg))
                best.add(own.slice(a, z - a), np.round((m @ weight[present]).T, 6), positive=True)
        yield best.batch(ids)

    return texts.filter("i is not null").mapInArrow(score, "query_id bigint, doc_id bigint, score double")


def search_joined(docs: DataFrame, queries: DataFrame, k: int = 10, b: float = 0.4, k1: float = 0.9, doc_id: str = "doc_id", query_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """The same as joins and aggregates, for question sets as large as the corpus, or ids of any type.

    Only terms of the queries are followed from the scan on: the term list is joined before the documents' counts are
    shuffled, so the shuffle holds postings of query terms alone."""
    q = queries.select(F.col(query_id).alias("query_id"), F.explode(words(text_col)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    terms = q.select("term").distinct()
    tok = docs.select(F.col(doc_id).alias("doc"), words(text_col).alias("w")).withColumn("dl", F.size("w").cast("bigint"))
    stats = tok.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    tf = tok.select("doc", "dl", F.explode("w").alias("term")).join(terms, "term", "left_semi").groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = df.crossJoin(F.broadcast(stats)).select("term", idf.alias("idf"), "avgdl")  # one row of statistics
    hits = tf.join(q.join(weight, "term"), "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") / (F.col("tf") + F.lit(k1) * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scores = hits.groupBy("query_id", F.col("doc").alias("doc_id")).agg(F.round(F.sum(part), 6).alias("score"))
    return top_k(scores, k, ["query_id"], [F.desc("score"), F.asc("doc_id")])


def oracle(k: int = 10, docs: str = "documents", queries: str = "benchmark", b: float = 0.4, k1: float = 0.9) -> str:
    """The same as DuckDB SQL: common table expressions up to `bm25`."""
    w = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"""bm_d AS (SELECT doc_id, {w} AS w FROM {docs}), bm_s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM bm_d),
bm_tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM bm_d) GROUP BY ALL),
bm_q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({w}) AS term FROM {queries}) GROUP BY ALL),
bm_df AS (SELECT term, count(*) AS df FROM bm_tf GROUP BY 1),
bm_sc AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))), 6) AS score FROM bm_tf JOIN bm_q USING (term) JOIN bm_df USING (term), bm_s GROUP BY 1, 2),
bm25 AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM bm_sc QUALIFY rank <= {k})"""
