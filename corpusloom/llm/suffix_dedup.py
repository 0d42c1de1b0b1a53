"""Passages of at least THRESHOLD words that repeat across documents, by distributed prefix doubling.

A rank names the words that follow a position: equal ranks, equal words. Up to START words ranks are made within a
task, by doubling the hashes of words. From there on every position of the corpus is in the sort: Spark sorts the positions by
rank, a position whose rank no other document has is dropped for good (no longer stretch that begins there can
repeat), and the others get new ranks from the sort, the numbers of their runs. Then the pairs rank(i), rank(i + offset)
are sorted in the same way, at growing offsets (32, then 50 words; for other thresholds the widths double), until
all are unique or the width is the threshold.

The first sort has 56 bits of a hash of START words; later sorts compare numbers given by the sort before, so a false match needs two equal hashes of
different words at one position together with a true repeat at the offset: some 10^-4 of a match at 10^13 positions. Runs of equal ranks are read
as a stream that holds one document's part of a run, so nothing depends on how often a passage repeats. Whole copies of a document
are found by their text and stand aside, with one of them in the sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, hashed_words, norm, sorted_runs
from corpusloom.functions.wordhash import run_names
from corpusloom.runtime import small_batches

THRESHOLD = 50
#: Ids that are broadcast at most (of whole copies, of documents with several texts); more are joined by shuffle.
BROADCAST_IDS = 4_000_000
LOW = (1 << 32) - 1


def widths(threshold: int) -> list[int]:
    """Widths at which positions are sorted: from the greatest power of two within two thirds of the threshold, doubled up to it."""
    out = [1]
    while out[0] * 3 <= threshold:
        out[0] *= 2
    while out[-1] < threshold:
        out.append(min(2 * out[-1], threshold))
    return out


def _emit(width: int, threshold: int):  # noqa: ANN202
    """(doc, key, rest) of all positions that have `width` words before the text's end. Texts of a document that has several
    differ in the upper half of the position. A text with fewer words than the threshold can't hold a passage.

    This is by far the largest shuffle, so rows are laid out for its compression: what differs from row to row is side by side (the document's
    last bytes, by swapping them; in the key the position's last byte below the rank), and all else is equal to the row before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tag = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for a, _, h, at in hashed_words(batch.column(1)):
                r, n = run_names(h, width), np.diff(at)
                n = np.where(n >= threshold, n - width + 1, 0)
                d = np.repeat(np.arange(len(n)), n)
                local = np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n)
                pos, rank = tag[d + a] << 32 | local, r[at[d] + local].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[d + a].byteswap()), pa.array(rank & ~255 | pos & 255), pa.array(pos >> 8)], ["doc", "key", "rest"])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        doc, key, rest = (batch.column(i).to_numpy() for i in range(3))
        yield [doc.byteswap(), key >> 8, rest << 8 | key & 255]


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        yield [batch.column(i).to_numpy() for i in range(batch.num_columns)]


def _rerank(read, last: bool):  # noqa: ANN001, ANN202
    """Positions whose keys (columns between document and position; rows come sorted by them and by document) several documents have: with the number of
    their run, which no other run in the sort has, or at last with the least document of the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, number = None, TaskContext.get().partitionId() << 36
        for cols in read(batches):
            if carry is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(carry, cols, strict=True)]
            if not len(cols[0]):
                continue
            doc, pos = cols[0], cols[-1]
            new = np.ones(len(doc), bool)
            new[1:] = False
            for k in cols[1:-1]:
                new[1:] |= k[1:] != k[:-1]
            at = np.flatnonzero(new)
            end = np.concatenate([at[1:], [len(doc)]])
            many = (doc[at] != doc[end - 1]) | (pos[at] < 0)
            out = np.flatnonzero(np.repeat(many, end - at) & (pos >= 0))
            low = np.minimum.reduceat(doc, at)
            which = (np.cumsum(new) - 1)[out]
            if len(out):
                own = [pa.array(pos[out] & LOW), pa.array(low[which])] if last else [pa.array(pos[out]), pa.array(which + number)]
                yield pa.RecordBatch.from_arrays([pa.array(doc[out]), *own], ["doc_id", "pos", "first_id" if last else "rank"])
            number += len(at) - 1
            # of the last run, which may go on, one row is enough once there are two documents (marked, as all have been returned)
            carry = [c[at[-1] : at[-1] + 1] for c in cols] if many[-1] else [c[at[-1] :] for c in cols]
            if many[-1]:
                carry[0], carry[-1] = low[-1:], np.full(1, -1)

    return run


def _pairs(offset: int):  # noqa: ANN202
    """(doc_id, a, b, pos): ranks of positions, sorted by document and position, and those at the offset; a position without the latter goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sorted_runs(batches, "doc_id"):
            doc, pos, rank = (batch.column(c).to_numpy() for c in ("doc_id", "pos", "rank"))
            text = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (pos[1:] >> 32 != pos[:-1] >> 32)]))
            key = text << 32 | pos & LOW
            to = np.searchsorted(key, key + offset)
            i = np.flatnonzero(to < len(key))
            i = i[key[to[i]] == key[i] + offset]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[i], rank[i], rank[to[i]], pos[i])], ["doc_id", "a", "b", "pos"])

    return run


def _spans(threshold: int):  # noqa: ANN202
    """Positions, sorted by document and position, as maximal stretches of repeated words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sorted_runs(batches, "doc_id"):
            doc, pos, first = (batch.column(c).to_numpy() for c in ("doc_id", "pos", "first_id"))
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + threshold)])
            at = np.flatnonzero(new)
            end = np.concatenate([at[1:], [len(doc)]]) - 1
            yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(pos[at]), pa.array(pos[end] + threshold), pa.array(np.minimum.reduceat(first, at))], ["doc_id", "start_word", "end_word", "first_id"])

    return run


def repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Rows (doc_id, start_word, end_word, first_id): the maximal stretches of each document (words from 0, end
    exclusive) every word of which is in a passage of at least `threshold` words that some other document has too;
    first_id is the least doc_id that shares a passage with the stretch (its own id where the document is the first).
    Deleting a stretch where first_id < doc_id leaves one copy of each passage.

    Words are compared without case and punctuation; passages don't cross the end of a document; repeats within one
    document don't count. Long texts are read whole. Null and empty texts and texts under `threshold` words have no row; rows without a doc_id are
    left out; rows that repeat a doc_id with the same text count once, and with another text their passages are
    those of one document; further columns are ignored; an empty table has no repeats."""
    small_batches(docs.sparkSession)
    texts = docs.filter("doc_id is not null and text is not null").select("doc_id", norm("text").alias("t")).filter(F.length("t") >= 2 * threshold - 1)
    n_words = F.length("t") - F.length(F.replace("t", F.lit(" "), F.lit(""))) + 1
    # whole copies: the text's digest is all that is shuffled; a doc_id with several texts stays in the sort with all of them
    digests = texts.select("doc_id", F.unhex(F.sha2("t", 256)).alias("d"), n_words.alias("n")).distinct()
    per = cut(digests.groupBy("doc_id").agg(F.first("d").alias("d"), F.first("n").alias("n"), F.count("*").alias("texts")))
    single = per.filter(F.col("n") >= threshold).filter("texts = 1")
    named = single.groupBy("d").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")
    copies = cut(single.join(named, "d").select("doc_id", "first_id", F.col("n").cast("bigint").alias("n")))
    aside, several = copies.filter("doc_id <> first_id").select("doc_id"), per.filter("texts > 1").select("doc_id", F.lit(True).alias("several"))
    n_aside, n_several = aside.count(), several.count()
    tag = F.lit(0)
    if n_several:
        texts = texts.join(F.broadcast(several) if n_several <= BROADCAST_IDS else several, "doc_id", "left")
        tag = F.when(F.col("several"), F.pmod(F.xxhash64("t"), F.lit(1 << 30)) + 1).otherwise(0)
    if n_aside <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(aside), "doc_id", "left_anti")
    width, *wider = widths(threshold)
    rank = F.shiftright("key", 8)
    found = texts.select("doc_id", "t", tag.cast("bigint").alias("tag")).mapInArrow(_emit(width, threshold), "doc bigint, key bigint, rest bigint")
    found, read = found.repartition(rank).sortWithinPartitions(rank, "doc"), _unpacked
    for w in wider:
        found = found.mapInArrow(_rerank(read, False), "doc_id bigint, pos bigint, rank bigint")
        if read is _unpacked and n_aside > BROADCAST_IDS:
            found = found.join(aside, "doc_id", "left_anti")
        pairs = found.repartition(F.col("doc_id")).sortWithinPartitions("doc_id", "pos").mapInArrow(_pairs(w - width), "doc_id bigint, a bigint, b bigint, pos bigint")
        found = pairs.repartition(F.col("a"), F.col("b")).sortWithinPartitions("a", "b", "doc_id")
        width, read = w, _columns
    found = found.mapInArrow(_rerank(read, True), "doc_id bigint, pos bigint, first_id bigint")
    spans = found.repartition(F.col("doc_id")).sortWithinPartitions("doc_id", "pos").mapInArrow(_spans(threshold), "doc_id bigint, start_word bigint, end_word bigint, first_id bigint")
    spans = cut(spans if wider or n_aside <= BROADCAST_IDS else spans.join(aside, "doc_id", "left_anti"))
    # a first copy may also share passages with other documents: its stretches are within the whole, for all copies
    earlier = spans.groupBy(F.col("doc_id").alias("first_id")).agg(F.min("first_id").alias("earlier_id"))
    whole = copies.join(earlier, "first_id", "left").select("doc_id", F.lit(0).cast("bigint").alias("start_word"), F.col("n").alias("end_word"), F.coalesce(F.least("first_id", "earlier_id"), "first_id").alias("first_id"))
    return whole.unionByName(spans.join(copies.select("doc_id"), "doc_id", "left_anti"))


def oracle(threshold: int = THRESHOLD) -> str:
    k = threshold
    return rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i+{k - 1}], ' ')) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {k - 1})) AS i FROM d)),
r AS (SELECT g, min(doc_id) AS lo FROM g GROUP BY g HAVING min(doc_id) <> max(doc_id)),
p AS (SELECT doc_id, i - 1 AS pos, lo FROM g JOIN r USING (g)),
m AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + {k} THEN 0 ELSE 1 END AS new FROM (SELECT doc_id, pos, min(lo) AS lo FROM p GROUP BY doc_id, pos)),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM m)
SELECT doc_id, min(pos) AS start_word, max(pos) + {k} AS end_word, min(lo) AS first_id FROM s GROUP BY doc_id, run"""
