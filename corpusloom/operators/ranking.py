"""Rankings: top k, folding of chunk hits into documents, fusion, reranking. A ranking is (query_id, doc_id, score, rank)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import words
from corpusloom.runtime import cut

#: Ids that are broadcast to a scan at most.
BROADCAST_IDS = 1_000_000


class TopK:
    """The k best (score, id) of each of n queries seen by a task; equal scores go by id."""

    def __init__(self, n: int, k: int, least: bool = False) -> None:
        self.k, self.sign = k, 1.0 if least else -1.0
        self.key, self.id = np.full((n, 0), np.inf), np.zeros((n, 0), np.int64)

    def add(self, ids: pa.Array, scores: np.ndarray, positive: bool = False) -> None:
        """Scores of queries (rows) and documents (columns); with positive, others than these don't count."""
        c = ids.to_numpy(zero_copy_only=False)
        key = self.sign * scores + 0.0
        if positive:
            key = np.where(scores > 0, key, np.inf)
        on = np.isfinite(key)
        if key.shape[1] > self.k:  # whoever is over the k-th can't be in; ties with it stay
            on &= key <= np.partition(key, self.k - 1, axis=1)[:, self.k - 1 : self.k]
        r, j = np.nonzero(on)
        self._merge(r, c[j], key[r, j])

    def merge(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of single pairs of query (by place) and id."""
        key = self.sign * scores + 0.0
        on = np.isfinite(key)
        self._merge(rows[on], ids[on], key[on])

    def worst(self) -> np.ndarray:
        """The k-th score of each query; infinite, on the far side, where there are fewer."""
        last = self.key[:, self.k - 1] if self.key.shape[1] else np.full(len(self.key), np.inf)
        return self.sign * last

    def _merge(self, row: np.ndarray, c: np.ndarray, key: np.ndarray) -> None:
        if not self.key.shape[1]:
            self.key, self.id = np.full((len(self.key), self.k), np.inf), np.zeros((len(self.key), self.k), np.int64)
        touched = np.unique(row)
        old, at = np.nonzero(np.isfinite(self.key[touched]))
        old = touched[old]
        row, key, c = np.concatenate([old, row]), np.concatenate([self.key[old, at], key]), np.concatenate([self.id[old, at], c])
        order = np.lexsort((c, key, row))
        row, key, c = row[order], key[order], c[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, key, c, place = (x[place < self.k] for x in (row, key, c, place))
        self.key[touched], self.id[touched] = np.inf, 0
        self.key[row, place], self.id[row, place] = key, c

    def batch(self, queries: np.ndarray) -> pa.RecordBatch:
        r, c = np.nonzero(np.isfinite(self.key))
        return pa.RecordBatch.from_arrays([pa.array(queries[r]), pa.array(self.id[r, c]), pa.array(self.sign * self.key[r, c] + 0.0)], ["query_id", "doc_id", "score"])


def top_k(df: DataFrame, k: int | None, keys: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Rows with their rank within the keys, the first k only (Spark cuts before and after the shuffle)."""
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out if k is None else out.filter(F.col(rank) <= k)


def collapse(hits: DataFrame, chunks: DataFrame, min_docs: int = 0) -> DataFrame:
    """Fold chunk hits (query_id, chunk_id, chunk_rank, score) into documents: a document has its best chunk's score (of
    equal ones the better rank, then the lesser id); documents are ordered by score, best rank, id. A hit on an unknown
    chunk, or a query with fewer documents than min_docs, ends the query with an error."""
    known = hits.join(chunks.select("chunk_id", "doc_id"), "chunk_id", "left").withColumn("doc_id", F.coalesce("doc_id", F.raise_error(F.concat(F.lit("unknown chunk "), F.col("chunk_id").cast("string"))).cast(chunks.schema["doc_id"].dataType)))
    best = top_k(known, 1, ["query_id", "doc_id"], [F.desc("score"), F.asc("chunk_rank"), F.asc("chunk_id")]).drop("rank")
    out = top_k(best.withColumnsRenamed({"chunk_id": "best_chunk", "chunk_rank": "best_rank"}), None, ["query_id"], [F.desc("score"), F.asc("best_rank"), F.asc("doc_id")])
    if min_docs:
        n = F.count("*").over(Window.partitionBy("query_id"))
        out = out.withColumn("rank", F.when(n >= min_docs, F.col("rank")).otherwise(F.raise_error(F.lit(f"a query has fewer than {min_docs} documents")).cast("int")))
    return out.select("query_id", "doc_id", "score", "best_chunk", "best_rank", "rank")


def dedup_ranking(ranking: DataFrame) -> DataFrame:
    """Keep a document's first place and close the gaps."""
    first = ranking.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    return top_k(first.withColumnRenamed("rank", "__r"), None, ["query_id"], [F.asc("__r"), F.asc("doc_id")]).drop("__r")


def rrf(rankings: Sequence[DataFrame], k: int = 60, top: int | None = None, dedup: bool = True) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (k + rank) over rankings; ties by id."""
    if k <= 0:
        raise ValueError("k must be positive")
    all_ = reduce(DataFrame.unionByName, [(dedup_ranking(r) if dedup else r).select("query_id", "doc_id", "rank") for r in rankings])
    fused = all_.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 9).alias("score"))
    return top_k(fused, top, ["query_id"], [F.desc("score"), F.asc("doc_id")])


def overfetch(k: int) -> int:
    """How many hits each retriever gives to a fusion of k."""
    return max(2 * k, 100)


def merge_sources(lists: Sequence[tuple[DataFrame, bool]], k: int, rrf_k: int = 100) -> DataFrame:
    """Fusion over retrievers, each of which ranks the union of its corpora by score (the flag: smaller is better)."""
    if len(lists) == 1:
        hits, up = lists[0]
        return top_k(hits, k, ["query_id"], [F.asc("score") if up else F.desc("score"), F.asc("doc_id")])
    return rrf([top_k(h, None, ["query_id"], [F.asc("score") if up else F.desc("score"), F.asc("doc_id")]) for h, up in lists], rrf_k, k, dedup=False)


def candidates(rankings: Sequence[DataFrame], n: int) -> DataFrame:
    """Distinct (query_id, doc_id) among the first n of each ranking."""
    return reduce(DataFrame.unionByName, [r.filter(F.col("rank") <= n).select("query_id", "doc_id") for r in rankings]).distinct()


def overlap_score(query: Column, document: Column) -> Column:
    """Jaccard overlap of distinct words: the pair scorer that needs no model."""
    q, d = F.array_distinct(words(query)), F.array_distinct(words(document))
    both = F.size(F.array_intersect(q, d))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(q) + F.size(d) - both), F.lit(0.0))


def chosen(docs: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Rows of docs whose key is in the pairs (a table that is computed already): up to BROADCAST_IDS ids are broadcast to the scan, so other texts aren't moved."""
    ids = pairs.select(key).distinct()
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")


def rerank(pairs: DataFrame, queries: DataFrame, docs: DataFrame, k: int | None = None, scorer: Callable[[Column, Column], Column] = overlap_score, query_id: str = "item_id") -> DataFrame:
    """Candidates by a pair score, ties by id. scorer takes the columns of query and document texts (a Pandas UDF for a model)."""
    pairs = cut(pairs)
    texts = chosen(docs.select("doc_id", F.col("text").alias("d_text")), pairs, "doc_id")
    both = pairs.join(queries.select(F.col(query_id).alias("query_id"), F.col("text").alias("q_text")), "query_id").join(texts, "doc_id")
    scored = both.select("query_id", "doc_id", F.round(scorer(F.col("q_text"), F.col("d_text")), 6).alias("score"))
    return top_k(scored, k, ["query_id"], [F.desc("score"), F.asc("doc_id")])


def rank_violations(ranking: DataFrame) -> DataFrame:
    """Rows whose rank isn't their place (from 1 without gaps) or whose score isn't finite."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id"))
    return ranking.withColumn("place", place).filter((F.col("rank") != F.col("place")) | F.isnan("score") | F.col("score").isin(float("inf"), float("-inf")))


def response(ranking: DataFrame, docs: DataFrame) -> DataFrame:
    """Service form: per query a JSON array of {document, score} in rank order."""
    full = ranking.join(docs.select("doc_id", F.col("text").alias("contents")), "doc_id")
    item = F.struct("rank", F.struct("doc_id", "contents").alias("document"), "score")
    return full.groupBy("query_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["document"].alias("document"), x["score"].alias("score")))).alias("result"))
