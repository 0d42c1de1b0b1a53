"""Dense retrieval: exact inner product or L2 search, nearest entities, an incremental store, an approximate index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import vector
from corpusloom.functions.text import content_id
from corpusloom.operators.ranking import TopK, top_k
from corpusloom.runtime import cut, spread

#: Cells of query vectors that are broadcast at once; more queries are searched in slices of that size.
SLICE_CELLS = 4_000_000
#: Queries and vectors whose scores are in memory at once, and pairs that are scored exactly at once.
BLOCK, VECTORS, PAIRS = 1024, 4096, 1 << 16


def search(corpus: DataFrame, queries: DataFrame, k: int = 10, metric: str = "ip", corpus_id: str = "vec_id", query_id: str = "vec_id", exclude_self: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): exact nearest vectors by inner product ('ip') or distance ('l2').

    Queries are broadcast (in slices of a fixed size), the corpus is scanned once per slice in Arrow batches and multiplied as a matrix; each task sends on
    its k best of every query only, so the shuffle is k rows a query and task."""
    if metric not in ("ip", "l2"):
        raise ValueError(metric)
    return _search(corpus, queries, k, metric, corpus_id, query_id, exclude_self)


def _search(corpus: DataFrame, queries: DataFrame, k: int, metric: str, corpus_id: str, query_id: str, exclude_self: bool, buckets: tuple[float, int] | None = None) -> DataFrame:
    slices = max(1, -(-(queries.agg(F.sum(F.size("embedding"))).first()[0] or 0) // SLICE_CELLS))
    out = None
    for s in range(slices):
        part = queries if slices == 1 else queries.filter(F.pmod(F.xxhash64(query_id), F.lit(slices)) == s)
        found = _search_slice(corpus, part, k, metric, corpus_id, query_id, exclude_self, buckets)
        out = found if out is None else out.unionByName(found)
    order = [F.desc("score") if metric == "ip" else F.asc("score"), F.asc("doc_id")]
    return top_k(out, k, ["query_id"], order)


def _search_slice(corpus: DataFrame, queries: DataFrame, k: int, metric: str, corpus_id: str, query_id: str, exclude_self: bool, buckets: tuple[float, int] | None) -> DataFrame:
    """buckets: width and number of tables of random projections; only pairs that share a bucket in one of the tables are scored.

    A product in single precision finds whoever can be among the k best of a query so far, with a margin for its error; those alone are scored in double precision.
    Vectors with a value that isn't finite have no score and are left out."""
    q = queries.select(F.col(query_id).cast("bigint").alias("i"), "embedding").filter("i is not null and embedding is not null").toArrow()
    ids = q.column("i").to_numpy()
    vectors = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in q.column("embedding").chunks] or [np.zeros(0)]).astype(np.float64).reshape(len(ids), -1)
    on = np.isfinite(vectors).all(1)
    shared = corpus.sparkSession.sparkContext.broadcast((ids[on], vectors[on]))
    l2 = metric == "l2"

    def named(v: np.ndarray) -> np.ndarray:
        """Number of each vector's bucket, by table and vector."""
        lines = np.random.default_rng(7).normal(size=(buckets[1], v.shape[1]))
        return np.floor(lines / np.linalg.norm(lines, axis=1, keepdims=True) @ v.T / buckets[0]).astype(np.int32)

    def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.round(np.sqrt(np.square(a - b).sum(1)) if l2 else np.einsum("ij,ij->i", a, b), 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qi, qv = shared.value
        width = qv.shape[1] + 9
        norm2 = np.square(qv).sum(1)
        # nearness: the product, or half of what the squared norm of the query is over the squared distance
        left = np.hstack([qv, np.ones((len(qv), 1))]) if l2 else qv
        single = left.astype(np.float32)
        blocks = [(slice(a, a + BLOCK), TopK(len(qi[a : a + BLOCK]), k, l2)) for a in range(0, len(qi), BLOCK)]
        qb = named(qv) if buckets and len(qi) else None
        for batch in batches:
            for a in range(0, batch.num_rows if len(qi) else 0, VECTORS):
                part = batch.slice(a, VECTORS)
                v, vi = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1), part.column(0).to_numpy()
                sound = np.isfinite(v).all(1)
                v, vi = v[sound], vi[sound]
                if not len(v):
                    continue
                vb = named(v) if buckets else None
                size2 = np.square(v).sum(1)
                right = np.hstack([v, size2[:, None] / -2]) if l2 else v
                small = max(size2.max(), norm2.max()) < 1e30
                right = np.ascontiguousarray((right.astype(np.float32) if small else right).T)
                slack = width * 2.0**-23 * np.sqrt(norm2 * size2.max())
                if l2:
                    slack += width * 2.0**-23 * size2.max() + 1e-12 * norm2
                for at, best in blocks:
                    s = (single if small else left)[at] @ right
                    worst = best.worst()
                    low = (norm2[at] - np.square(worst + 1e-6)) / 2 if l2 else worst - 1e-6
                    if (fresh := not np.isfinite(worst).all()):  # fewer than k so far: the k-th of this batch is a bound as well
                        apart = qi[at][:, None] == vi[None, :] if exclude_self else np.zeros(s.shape, bool)
                        if buckets:
                            together = np.zeros(s.shape, bool)
                            for x, y in zip(qb[:, at], vb, strict=True):
                                together |= x[:, None] == y[None, :]
                            apart |= ~together
                        s[apart] = -np.inf
                        low[np.isinf(worst)] = -np.inf
                        if len(v) > k:
                            low = np.maximum(low, np.partition(s, len(v) - k, axis=1)[:, len(v) - k].astype(float) - slack[at] - 1e-6)
                    low -= slack[at]
                    near = s >= np.nextafter(low.astype(s.dtype), s.dtype.type(-np.inf))[:, None]
                    if fresh:
                        near &= ~apart
                    r, j = np.divmod(_places(near), len(v))
                    if not fresh and exclude_self:
                        r, j = (x[qi[at][r] != vi[j]] for x in (r, j))
                    if not fresh and buckets:
                        r, j = (x[(qb[:, at][:, r] == vb[:, j]).any(0)] for x in (r, j))
                    for b in range(0, len(r), PAIRS):
                        rb, jb = r[b : b + PAIRS], j[b : b + PAIRS]
                        best.merge(rb, vi[jb], exact(qv[at][rb], v[jb]))
        for at, best in blocks:
            yield best.batch(qi[at])

    return spread(corpus.select(corpus_id, "embedding")).select(F.col(corpus_id).cast("bigint").alias("i"), "embedding").filter("i is not null and embedding is not null").mapInArrow(run, "query_id bigint, doc_id bigint, score double")


def _places(on: np.ndarray) -> np.ndarray:
    """flatnonzero() for few that are true: eight cells are passed over at once."""
    flat = on.ravel()
    whole = len(flat) // 8 * 8
    at = np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)
    return np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])


def nearest(left: DataFrame, right: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): for each left vector the right one with the greatest inner product, of equal ones the least id."""
    return search(right, left, 1).select("query_id", "doc_id", "score")


def hashed_embedding(words: Column, width: int = 64) -> Column:
    """Unit vector of signed word counts: the encoder that needs no model. Where all counts cancel each other out, they are taken
    without their signs, so only a text without words has the zero vector."""
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  (a lambda's argument is computed once)
    hits = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(width)).cast("int").alias("i"), F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    counts = lambda hs, sign: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(hs, F.lit(0.0), lambda a, h: a + F.when(h["i"] == i, sign(h)).otherwise(0.0)))
    raw = once(hits, lambda hs: once(counts(hs, lambda h: h["s"]), lambda v: F.when(F.exists(v, lambda x: x != 0), v).otherwise(counts(hs, lambda h: F.lit(1.0)))))
    return once(raw, vector.normalized)


def upsert(store: DataFrame, texts: DataFrame, encode: Callable[[Column], Column], namespace: str = "") -> DataFrame:
    """Store (hash_id, text, embedding) with the texts that it lacks encoded and added; texts it has aren't encoded again."""
    new = texts.select(content_id("text", namespace).alias("hash_id"), "text").dropDuplicates(["hash_id"]).join(store.select("hash_id"), "hash_id", "left_anti")
    return store.select("hash_id", "text", "embedding").unionByName(new.withColumn("embedding", encode(F.col("text"))))


def build_index(texts: DataFrame, path: str, encode: Callable[[Column], Column], namespace: str = "") -> DataFrame:
    """A store (hash_id, text, embedding) as Parquet at a path, which is made or extended: only texts that it lacks are encoded, and appended."""
    spark = texts.sparkSession
    new = texts.select(content_id("text", namespace).alias("hash_id"), "text").filter("hash_id is not null").dropDuplicates(["hash_id"])
    try:
        new = new.join(spark.read.parquet(path).select("hash_id"), "hash_id", "left_anti")
    except AnalysisException as e:  # a new store
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.withColumn("embedding", encode(F.col("text"))).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def lsh_search(corpus: DataFrame, queries: DataFrame, k: int = 10, bucket: float = 0.5, tables: int = 8, id_col: str = "vec_id") -> DataFrame:
    """Approximate L2 search by random projections: only vectors that share a bucket in one of the tables are compared, at
    any distance. Queries that meet fewer than k vectors in their buckets are searched exactly."""
    near = cut(_search(corpus, queries, k, "l2", id_col, id_col, False, (bucket, tables)))
    whole = near.filter(F.col("rank") == k).select(F.col("query_id").alias(id_col))
    short = cut(queries.join(whole, id_col, "left_anti"))
    if short.isEmpty():
        return near
    return near.join(whole.withColumnRenamed(id_col, "query_id"), "query_id", "left_semi").unionByName(search(corpus, short, k, "l2", id_col, id_col))
