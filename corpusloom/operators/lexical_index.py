"""A stored BM25 index: built once, loaded by its path, searched without a scan of the texts.

Documents are divided into blocks by a hash of their id. The index has a row for each block and term: the term's hash
and the block's documents that have it with their counts and lengths; in how many documents of the corpus a term is stands in a table beside it. The postings are a table bucketed
by block, so a task has whole blocks without an exchange, and a search reads no other terms' postings into it than the questions'.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import words
from corpusloom.operators.ranking import TopK, top_k
from corpusloom.runtime import small_batches, spread

#: Documents of a block.
BLOCK = 2048
#: Terms of questions in a broadcast; larger question sets are searched in slices.
SLICE_TERMS = 2_000_000
#: Scores (questions x documents of a block) in memory at once.
CELLS = 4_000_000
#: Tasks that build an index at most.
PARTS = 4096
COLUMNS = "block int, term bigint, docs array<bigint>, tfs array<int>, dls array<int>"


def build(docs: DataFrame, path: str, tokens: Callable[[Column], Column] = words, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the index of documents with an id to a folder, and returns its statistics (n_docs, n_words, n_blocks, n_buckets), which are stored beside it.
    tokens gives a text's terms (functions.stem.stemmed(words(...)) for stems); a search must use the same. A null text counts as an empty document."""
    spark = docs.sparkSession
    texts = spread(docs.select(F.col(doc_id), F.col(text_col))).select(F.col(doc_id).cast("bigint").alias("doc"), F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>")).alias("w"))
    n_docs, n_words = docs.count(), texts.agg(F.coalesce(F.sum(F.size("w")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-n_docs // BLOCK))
    n_buckets = min(n_blocks, max(spark.sparkContext.defaultParallelism, min(4096, n_blocks // 64)))
    small_batches(spark)
    block = F.pmod(F.xxhash64("doc"), F.lit(n_blocks)).cast("int")
    hashed = texts.filter("doc is not null").select(block.alias("block"), "doc", F.transform("w", lambda t: F.xxhash64(t)).alias("h"))
    # the only exchange of postings: a document's words as hashes, to its block; a task has one block, or few
    parts = hashed.repartitionById(n_parts := min(n_blocks, PARTS), F.pmod("block", F.lit(n_parts))).sortWithinPartitions("block")
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    parts.mapInArrow(_invert, COLUMNS).write.mode("overwrite").bucketBy(n_buckets, "block").sortBy("block", "term").option("path", f"{path}/postings").format("parquet").saveAsTable(_name(path))
    spark.table(_name(path)).groupBy("term").agg(F.sum(F.size("docs")).alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    stats = spark.createDataFrame([(n_docs, n_words, n_blocks, n_buckets)], "n_docs bigint, n_words bigint, n_blocks bigint, n_buckets int")
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    return spark.read.parquet(f"{path}/stats")


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (block, doc, h: hashes of the words) that come by block the postings of each block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column("block").to_numpy()
        at = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)] if len(block) else []
        for a, z in zip(at[:-1], at[1:], strict=True):
            if held and held[0].column("block")[0].as_py() != block[a]:
                yield _postings(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(a, z - a))
    if held:
        yield _postings(pa.Table.from_batches(held))


def _postings(t: pa.Table) -> pa.RecordBatch:
    """Rows that repeat a document's id count as one, with the length of the first."""
    lists = t.column("h").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    term, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    docs, first, own = np.unique(t.column("doc").to_numpy(), return_index=True, return_inverse=True)
    row = np.repeat(own, size)
    order = np.lexsort((row, term))
    term, row = term[order], row[order]
    at = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (row[1:] != row[:-1])])) if len(term) else np.zeros(0, np.int64)
    tf, term, row = np.diff(np.append(at, len(term))), term[at], row[at]
    begin = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    off = pa.array(np.append(begin, len(term)).astype(np.int32))
    listed = lambda x: pa.ListArray.from_arrays(off, pa.array(x))
    block = np.full(len(begin), t.column("block")[0].as_py(), np.int32)
    return pa.RecordBatch.from_arrays([pa.array(block), pa.array(term[begin]), listed(docs[row]), listed(tf.astype(np.int32)), listed(size[first][row].astype(np.int32))], ["block", "term", "docs", "tfs", "dls"])


def _name(path: str) -> str:
    return f"loom_bm25_{hashlib.md5(path.encode()).hexdigest()}"


def load(spark: SparkSession, path: str) -> SimpleNamespace:
    """An index that any session has built: its postings, terms and statistics."""
    stats = spark.read.parquet(f"{path}/stats").first()
    if not spark.catalog.tableExists(_name(path)):
        spark.sql(f"CREATE TABLE {_name(path)} ({COLUMNS}) USING parquet CLUSTERED BY (block) SORTED BY (block, term) INTO {stats['n_buckets']} BUCKETS LOCATION '{path}/postings'")
    return SimpleNamespace(postings=spark.table(_name(path)), terms=spark.read.schema("term bigint, df bigint").parquet(f"{path}/terms"), stats=stats)


def terms(index: SimpleNamespace) -> DataFrame:
    """(term, df) of all terms, by their hashes."""
    return index.terms


def search(index: SimpleNamespace, queries: DataFrame, k: int = 10, b: float = 0.4, k1: float = 0.9, tokens: Callable[[Column], Column] = words, query_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of every question, as lexical.search() gives them. One pass over the postings of the
    questions' terms for all questions (of up to SLICE_TERMS terms); each task sends on the k best it has seen."""
    q = queries.select(F.col(query_id).cast("bigint").alias("q"), F.explode(tokens(F.col(text_col))).alias("t")).filter("q is not null").groupBy("q", F.xxhash64("t").alias("term")).agg(F.count("*").cast("double").alias("n")).toArrow() if not isinstance(queries, pa.Table) else queries
    out = None
    ids = np.unique(q.column("q").to_numpy())
    slices = max(1, -(-q.num_rows // SLICE_TERMS))
    for part in np.array_split(ids, slices):
        lo, hi = (part[0], part[-1]) if len(part) else (0, -1)
        own = (q.column("q").to_numpy() >= lo) & (q.column("q").to_numpy() <= hi)
        found = _search_slice(index, *(q.column(c).to_numpy()[own] for c in ("q", "term", "n")), k, k1, b)
        out = found if out is None else out.unionByName(found)
    return top_k(out, k, ["query_id"], [F.desc("score"), F.asc("doc_id")])


def _search_slice(index: SimpleNamespace, q: np.ndarray, term: np.ndarray, n: np.ndarray, k: int, k1: float, b: float) -> DataFrame:
    spark = index.postings.sparkSession
    ids, row = np.unique(q, return_inverse=True)
    vocab, col = np.unique(term, return_inverse=True)
    order = np.argsort(row, kind="stable")
    first = np.searchsorted(row[order], np.arange(len(ids) + 1))
    wanted = spark.createDataFrame(pa.table({"term": vocab}))
    known = index.terms.join(F.broadcast(wanted), "term", "left_semi").toArrow()
    count = np.zeros(len(vocab))
    count[np.searchsorted(vocab, known.column("term").to_numpy())] = known.column("df").to_numpy()
    shared = spark.sparkContext.broadcast((ids, vocab, count, col[order], n[order], first))
    n_docs, avg = index.stats["n_docs"], index.stats["n_words"] / max(1, index.stats["n_docs"])

    def run(t: pa.Table) -> pa.Table:
        ids, vocab, count, col, n, first = shared.value
        t = t.combine_chunks()
        term = np.searchsorted(vocab, t.column("term").to_numpy())
        df = count[term]
        lists = [t.column(c).chunk(0) if t.num_rows else pa.array([], pa.list_(pa.int64())) for c in ("docs", "tfs", "dls")]
        doc, tf, dl = (x.flatten().to_numpy() for x in lists)
        r = np.repeat(np.arange(t.num_rows), np.diff(lists[0].offsets.to_numpy()))
        docs, place = np.unique(doc, return_inverse=True)
        idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        m = np.zeros((t.num_rows + 1, len(docs)))  # the last row is of terms that the block hasn't
        m[r, place] = idf[r] * tf / (tf + k1 * (1 - b + b * dl / avg))
        mine = np.full(len(vocab), t.num_rows)
        mine[term] = np.arange(t.num_rows)
        best, step = [], max(1, CELLS // max(1, len(docs)))
        for a in range(0, len(ids), step):
            z = min(len(ids), a + step)
            top = TopK(z - a, k)
            s = np.stack([n[first[i] : first[i + 1]] @ m[mine[col[first[i] : first[i + 1]]]] for i in range(a, z)])
            top.add(pa.array(docs), np.round(s, 6), positive=True)
            best.append(top.batch(ids[a:z]))
        return pa.Table.from_batches(best)

    # the questions' terms are as many as the broadcast above has, at most
    return index.postings.join(F.broadcast(wanted), "term", "left_semi").groupBy("block").applyInArrow(run, "query_id bigint, doc_id bigint, score double")
