"""Shared pieces: sorted-run streaming and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.wordhash import CHUNK, _powers, buffers, hash_list, hashed_words, mix, norm, pair_rank, process_cache
from corpusloom.runtime import cut, shared_dir, table, written

__all__ = ["CHUNK", "_powers", "buffers", "components", "cut", "hash_list", "hashed_words", "mix", "new_folder", "norm", "pair_rank", "process_cache", "run_bounds", "shared_dir", "sorted_runs", "table", "written"]


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder within the one that all executors share."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, p = pafs.FileSystem.from_uri(path)
    fs.create_dir(p)
    return path


def sorted_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Rebatch rows that come sorted by key so that no run of equal keys is divided between two batches."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        first = int(np.searchsorted(k, k[-1], "left")) if k[0] != k[-1] else 0
        if first == 0 and (not rest or rest[-1].column(key)[-1].as_py() == k[0]):
            rest.append(batch)  # one run so far
            continue
        whole = [*rest, batch.slice(0, first)] if first else rest
        if whole:
            yield pa.Table.from_batches(whole).combine_chunks().to_batches()[0]
        rest = [batch.slice(first)]
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def run_bounds(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (id, root) with the least id of the component, for every id that an
    edge names. Alternates large-star and small-star steps, so the rounds grow with the logarithm of the longest path;
    each round is checkpointed."""
    cur = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    last = None
    while True:
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        cur = cut(small)
        sign = tuple(cur.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first())
        if sign == last:
            break
        last = sign
    roots = cur.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
