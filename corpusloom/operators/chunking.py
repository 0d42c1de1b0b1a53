"""Cutting texts: token windows, sentence packing, token packing, balanced parts."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import tokens
from corpusloom.functions.text import words
from corpusloom.runtime import bucket_of, spread


def blank_separated(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def chunk_windows(docs: DataFrame, size: int = 128, overlap: int = 32, tokenize: Callable[[Column], Column] = blank_separated, joined: Callable[[Column], Column] = lambda w: F.array_join(w, " ")) -> DataFrame:
    """(doc_id, chunk_id, order, content): windows over the tokens of each section (line), by default its blank-separated words; a window never
    crosses a section; order counts through the document; blank sections have none. tokenize gives a text's tokens as an array of strings, joined
    the text of such an array."""
    per = F.flatten(F.filter(F.transform(F.split("text", "\n"), lambda s: tokens.windows(tokenize(s), size, overlap)), lambda w: w.isNotNull()))
    out = spread(docs.select("doc_id", "text")).select("doc_id", F.posexplode(per).alias("order", "w"))
    return out.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("order").cast("string")).alias("chunk_id"), "order", joined(F.col("w")).alias("content"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentence_chunks(text: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
    """Sentences packed into chunks of at most `size` characters (a longer sentence is a chunk), each with the first
    `overlap` characters of the next one at its end."""
    import re

    def pack(t: str | None, n: int, o: int) -> list[str] | None:
        if t is None:
            return None
        chunks, cur = [], ""
        for s in re.split(r"(?<=[.!?。！？])\s*", t):
            if not s.strip():
                continue
            if cur and len(cur) + 1 + len(s) > n:
                chunks.append(cur)
                cur = s
            else:
                cur = f"{cur} {s}" if cur else s
        chunks += [cur] if cur else []
        return [c + (" " + chunks[i + 1][:o] if o and i + 1 < len(chunks) else "") for i, c in enumerate(chunks)]

    return pd.Series([pack(t, n, o) for t, n, o in zip(text, size, overlap, strict=True)])


def pack_tokens(docs: DataFrame, block: int, group: str, eos: str = "</s>", bucket: int = 1000, tokens: Callable[[Column], Column] = words) -> DataFrame:
    """(group, block_no, input_ids): a group's documents in id order, each with an end mark, as one sequence cut into
    blocks; the short last block is kept only if it is the group's only one. Labels are the ids. Documents without a group or an
    id are left out. A document's place is found in two levels, buckets of ids and documents in them, so a large group isn't sorted by one task."""
    d = spread(docs.select(group, "doc_id", "text")).filter(F.col(group).isNotNull() & F.col("doc_id").isNotNull()).select(group, "doc_id", bucket_of(docs, "doc_id", bucket).alias("bucket"), F.concat(F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")), F.array(F.lit(eos))).alias("w"))
    sums = d.groupBy(group, "bucket").agg(F.sum(F.size("w").cast("bigint")).alias("n"))
    at = sums.select(group, "bucket", F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    end = F.col("before") + F.sum(F.size("w").cast("bigint")).over(Window.partitionBy(group, "bucket").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    d = d.join(at, [group, "bucket"])
    # positions are known from sizes; tokens are cut by block within their document, not one row per token
    at = d.withColumn("begin", end - F.size("w")).withColumn("size", F.size("w"))
    first, last = F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block)
    piece = at.withColumn("block_no", F.explode(F.sequence(first, last))).withColumn("from", F.greatest(F.lit(0), F.col("block_no") * block - F.col("begin")).cast("int"))
    piece = piece.withColumn("part", F.slice("w", F.col("from") + 1, F.least(F.col("size") - F.col("from"), (F.col("block_no") + 1) * block - F.col("begin") - F.col("from")).cast("int")))
    out = piece.groupBy(group, "block_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("begin", "part"))), lambda x: x["part"])).alias("input_ids"))
    return out.filter((F.size("input_ids") == block) | (F.col("block_no") == 0))


def largest_difference(sizes: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """Indices in k parts with sums as equal as the largest differencing method makes them; equal: parts of one size
    (the number of items must be a multiple of k)."""
    if equal and len(sizes) % k:
        raise ValueError("the number of items isn't a multiple of the parts")
    order = sorted(range(len(sizes)), key=lambda i: sizes[i])
    starts = [[[i] for i in order[a : a + k]] for a in range(0, len(order), k)] if equal else [[[i]] for i in order]
    heap = []
    for n, parts in enumerate(starts):
        parts = sorted(((sum(sizes[i] for i in p), p) for p in parts + [[]] * (k - len(parts))), key=lambda x: (-x[0], x[1]))
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], n, parts))
    n = len(starts)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        parts = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)), key=lambda x: (-x[0], x[1]))
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], n, parts))
        n += 1
    return [sorted(p) for _, p in heap[0][2]] if heap else [[] for _ in range(k)]


def greedy_parts(sizes: list[int], k: int, equal: bool = False, largest_first: bool = False) -> list[list[int]]:
    """Each item to the least loaded part (in the given order, or largest first); equal: parts are full at len / k items."""
    heap, full = [(0, p) for p in range(k)], -(-len(sizes) // k) if equal else len(sizes)
    out: list[list[int]] = [[] for _ in range(k)]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]) if largest_first else range(len(sizes)):
        s, p = heapq.heappop(heap)
        out[p].append(i)
        if len(out[p]) < full:
            heapq.heappush(heap, (s + sizes[i], p))
    return out


def balanced(df: DataFrame, group: str, key: str, size: str, k: int, equal: bool = False) -> DataFrame:
    """(group, key, size, part): largest differencing within each group (a batch, which fits one task)."""
    kinds = f"{group} {df.schema[group].dataType.simpleString()}, {key} {df.schema[key].dataType.simpleString()}, {size} bigint, part int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, ignore_index=True)
        part = [0] * len(pdf)
        for p, ids in enumerate(largest_difference(pdf[size].tolist(), k, equal)):
            for i in ids:
                part[i] = p
        return pdf[[group, key, size]].assign(part=pd.Series(part, dtype="int32"))

    return df.select(group, key, F.col(size).cast("bigint").alias(size)).groupBy(group).applyInPandas(run, kinds)


def micro_batches(df: DataFrame, group: str, key: str, size: str, max_size: int) -> DataFrame:
    """Like balanced, with as many parts as the sum needs at max_size each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, ignore_index=True)
        k = max(1, -(-int(pdf[size].sum()) // max_size))
        part = [0] * len(pdf)
        for p, ids in enumerate(largest_difference(pdf[size].tolist(), k)):
            for i in ids:
                part[i] = p
        return pdf.assign(part=pd.Series(part, dtype="int32"))

    return df.select(group, key, F.col(size).cast("bigint").alias(size)).groupBy(group).applyInPandas(run, f"{group} {df.schema[group].dataType.simpleString()}, {key} {df.schema[key].dataType.simpleString()}, {size} bigint, part int")


def part_sums(parts: DataFrame, group: str, size: str) -> DataFrame:
    """How unequal the parts are: least, greatest and mean sum."""
    s = parts.groupBy(group, "part").agg(F.sum(size).alias("s"))
    return s.groupBy(group).agg(F.min("s").alias("min_sum"), F.max("s").alias("max_sum"), F.round(F.avg("s"), 6).alias("mean_sum"))


def pages_of(texts: Iterator[str]) -> Iterator[str]:
    """Lines of a paged document joined until one ends a sentence."""
    cur = ""
    for line in texts:
        cur += line.strip()
        if cur.endswith((".", "!", "?", "。", "！", "？", "…", ";", ":", "”", "）", "】", "》", "；", "：")):
            yield cur
            cur = ""
    if cur:
        yield cur
