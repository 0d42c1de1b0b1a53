"""Data quality: identity, deduplication, exclusion, sampling, splitting, validation, audit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import hash_number, normalize_text
from corpusloom.functions.wordhash import hashed_words, norm, run_names
from corpusloom.operators.ranking import chosen, top_k
from corpusloom.runtime import bucket_of, cut, small_batches, spread

#: Passages whose runs are broadcast at once.
MAX_KEYS = 2_000_000
#: Characters of short passages that are broadcast at once.
MAX_CHARS = 4_000_000


def first_of_each(df: DataFrame, key: Column, order: Sequence[Column]) -> DataFrame:
    """Rows that come first among those of the same key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, content_hash, copies): the first document of each normalised text."""
    h = docs.select("doc_id", F.sha2(normalize_text("text"), 256).alias("content_hash"))
    return h.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "content_hash", "copies")


def last_wins(df: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """One row per key: the last value, at the first place."""
    return df.groupBy(key).agg(F.max_by(value, seq).alias(value), F.min(seq).alias(seq))


def merge_maps(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Dictionary update: new values win, keys of both stay."""
    return old.select(key, F.col(value).alias("__old")).join(new.select(key, F.col(value).alias("__new")), key, "full_outer").select(key, F.coalesce("__new", "__old").alias(value))


def exclude(rows: DataFrame, gold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows none of whose keys is among the gold rows' (one anti join per key)."""
    return reduce(lambda df, k: df.join(gold.select(k).distinct(), k, "left_anti"), keys, rows)


def containment(docs: DataFrame, passages: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, doc_id) of documents that contain a passage as it stands.

    A scan names every run of k - 2 words of a document and keeps pairs whose run is that behind a passage's first word
    (its ends may be parts of words); only these pairs are compared as texts. The passages' runs are broadcast in slices of a bounded size.
    Passages of at most k words have no such run; they are broadcast as texts, in slices too, and looked for in every document."""
    small_batches(docs.sparkSession)
    keys = passages.select(F.col("item_id").cast("bigint").alias("i"), norm("text").alias("t")).filter(F.size(F.split("t", " ")) > k)
    slices = max(1, -(-keys.count() // MAX_KEYS))
    out = None
    for n in range(slices):
        part = (keys if slices == 1 else keys.filter(F.pmod(F.xxhash64("i"), F.lit(slices)) == n)).toArrow()
        ids, names = part.column("i").to_numpy(), []
        for chunk in part.column("t").chunks:
            for _, _, h, at in hashed_words(chunk):
                names.append(run_names(h, k - 2)[at[:-1] + 1])
        names = np.concatenate(names) if names else np.zeros(0, np.uint64)
        order = np.argsort(names, kind="stable")
        shared = docs.sparkSession.sparkContext.broadcast((names[order], ids[order]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            name, query = shared.value
            for batch in batches:
                for a, z, h, at in hashed_words(batch.column(1)) if len(name) else ():
                    r = run_names(h, k - 2)
                    lo, hi = np.searchsorted(name, r, "left"), np.searchsorted(name, r, "right")
                    hit = np.flatnonzero(hi > lo)
                    hit = np.repeat(hit, (hi - lo)[hit])
                    first = np.concatenate([[True], hit[1:] != hit[:-1]]) if len(hit) else np.zeros(0, bool)
                    nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0)) if len(hit) else hit
                    doc = np.searchsorted(at, hit, "right") - 1
                    pairs = np.unique(np.stack([query[lo[hit] + nth], doc]), axis=1) if len(hit) else np.zeros((2, 0), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), batch.column(0).slice(a, z - a).take(pa.array(pairs[1]))], ["query_id", "doc_id"])

        found = spread(docs.select("doc_id", "text")).select(F.col("doc_id").cast("bigint").alias("doc_id"), norm("text").alias("t")).filter("doc_id is not null").mapInArrow(run, "query_id bigint, doc_id bigint")
        out = found if out is None else out.unionByName(found)
    texts = passages.select(F.col("item_id").alias("query_id"), F.col("text").alias("p_text"))
    pairs = cut(out.distinct())  # few: their texts alone are moved
    pairs = pairs.join(chosen(docs.select("doc_id", "text"), pairs, "doc_id"), "doc_id").join(texts, "query_id").filter(F.contains("text", "p_text")).select("query_id", "doc_id")
    short = texts.filter("query_id is not null and p_text is not null").filter(F.size(F.split(norm("p_text"), " ")) <= k)
    n, chars = short.agg(F.count("*"), F.sum(F.length("p_text"))).first()
    slices = -(-max(chars or 0, n) // MAX_CHARS)
    for i in range(slices):
        part = short if slices == 1 else short.filter(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i)
        pairs = pairs.unionByName(docs.filter("doc_id is not null").join(F.broadcast(part), F.contains("text", "p_text")).select("query_id", "doc_id"))
    return pairs.distinct()


def hash_order(key: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash of their keys: the same rows in every layout."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def shard_sample(df: DataFrame, shard: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows of each shard by seeded hash; every row has the chance that a reservoir would give it."""
    return top_k(df, k, [shard], [hash_order(F.concat_ws(":", F.col(shard), F.col(key).cast("string")), seed), F.asc(key)], "place")


def shards_until(df: DataFrame, shard: str, needed: int, seed: int = 42) -> DataFrame:
    """Rows of as many shards, in seeded order, as hold `needed` rows."""
    sizes = df.groupBy(shard).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(hash_order(F.col(shard), seed)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per shard
    return df.join(sizes.withColumn("before", before).filter(F.col("before") < needed).select(shard), shard, "left_semi")


def distractors(docs: DataFrame, gold: DataFrame, n: int, per_shard: int, seed: int = 42) -> DataFrame:
    """Documents that are no gold document's copy: k per shard, no blanks, none with a gold text, each text once, n by hash."""
    sampled = shard_sample(docs.filter(F.trim("text") != ""), "source", "doc_id", per_shard, seed).drop("place").withColumn("h", F.sha2(normalize_text("text"), 256))
    clean = exclude(sampled, gold.select(F.sha2(normalize_text("text"), 256).alias("h")), ["h"])
    return hash_sample(first_of_each(clean, F.col("h"), [F.asc("doc_id")]), "doc_id", n, seed).select("doc_id", "source", F.col("h").alias("content_hash"))


def hash_split(df: DataFrame, key: str, test: float, seed: int = 42) -> DataFrame:
    """A split column by a seeded hash of the key, the same for a key forever."""
    return df.withColumn("split", F.when(hash_number(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))) % 10000 < int(test * 10000), "test").otherwise("train"))


def positional_split(df: DataFrame, key: str, percent: int, bucket: int = 100_000) -> DataFrame:
    """The first p percent of rows (by key) are 'train'. Places are found in two levels, buckets of keys and rows in them."""
    rows = df.withColumn("__b", bucket_of(df, key, bucket))
    sizes = rows.groupBy("__b").agg(F.count("*").alias("__n"))
    at = sizes.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__0"), F.sum("__n").over(Window.partitionBy()).alias("__all"))  # one row per bucket
    place = F.col("__0") + F.row_number().over(Window.partitionBy("__b").orderBy(key))
    return rows.join(at, "__b").withColumn("split", F.when(place <= F.floor(F.col("__all") * percent / 100), "train").otherwise("test")).drop("__b", "__0", "__all")


def violations(rules: dict[str, DataFrame]) -> DataFrame:
    """(rule, key) rows of all rules; none: valid. Each rule is a frame of one column, the offending keys."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("rule"), F.col(df.columns[0]).cast("string").alias("key")) for name, df in rules.items()])


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().filter("count > 1").select(key)


def missing_keys(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.select(key).distinct().join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def id_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): ids that only one of two tables has."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("right")))


def audit(queries: DataFrame, qrels: DataFrame, docs: DataFrame) -> DataFrame:
    """Per question: number and list of relevant documents, whether one has a copy outside of them, and whether it passes."""
    h = docs.select("doc_id", F.sha2(normalize_text("text"), 256).alias("h"))
    gold = qrels.join(h, "doc_id")
    outside = gold.select("query_id", "h").distinct().join(h, "h").join(qrels, ["query_id", "doc_id"], "left_anti").groupBy("query_id").agg(F.count("*").alias("outside"))
    per = gold.groupBy("query_id").agg(F.count("*").alias("n_qrels"), F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("doc_ids"))
    out = queries.select(F.col("item_id").alias("query_id")).join(per, "query_id", "left").join(outside, "query_id", "left")
    return out.select("query_id", F.coalesce("n_qrels", F.lit(0)).alias("n_qrels"), F.coalesce("doc_ids", F.lit("")).alias("doc_ids"), (F.coalesce("outside", F.lit(0)) > 0).alias("copy_outside"), ((F.coalesce("n_qrels", F.lit(0)) > 0) & (F.coalesce("outside", F.lit(0)) == 0)).alias("passed"))


def digest(df: DataFrame) -> DataFrame:
    """One row (n_rows, digest): digest over the digests of groups of rows, each over its rows' sorted digests. Rows are grouped by
    the first digits of their digest (at most 16^5 groups), so no task sorts the table."""
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    per = df.select(row.alias("d")).groupBy(F.substring("d", 1, 5).alias("b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ""), 256).alias("d"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))
