"""Benchmark decontamination with suffix arrays of the training text.

Every shard (a run of documents within a task, about SHARD_WORDS words) gets a suffix array over its words: suffixes
are sorted by their first three words, then ranks are doubled, only within ties, until every suffix is unique or the
sorted depth passes the longest test item; a deeper order can't be told apart by any test suffix. Every suffix of every
test item is binary-searched in every shard for the range of suffixes that share at least MIN_WORDS words with it, and
each occurrence is extended to its longest verbatim match. Training text is never shuffled; the test set is broadcast in
slices of a bounded size, of which the driver and each worker hold one at a time; all are searched in the one array of a shard.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import hashed_words, norm
from corpusloom.runtime import small_batches

MIN_WORDS = 13
SHARD_WORDS = 1 << 20
#: Words of test items that are broadcast at once.
SLICE_WORDS = 2_000_000


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a sequence of ids (1 and up; 0 ends a document) in the order of their first `depth` ids at least,
    and the packed first three ids of each suffix in that order."""
    n = len(ids)
    wide = np.concatenate([ids, np.zeros(3, np.int64)])
    key = (wide[:n] << 42) | (wide[1 : n + 1] << 21) | wide[2 : n + 2]
    sa = np.argsort(key, kind="stable" if n < 2 else None)
    first = key[sa]
    rank = np.empty(n + 1, np.int64)
    new = np.concatenate([[True], first[1:] != first[:-1]]) if n else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else new
    rank[sa], rank[n] = head + 1, 0
    # a suffix whose first ids reach a document's end ties with others there; the end is as good as any order
    h = 3
    while h < depth:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        pos = sa[at]
        second = rank[np.minimum(pos + h, n)]
        order = np.argsort(head[at] * (n + 2) + second)
        pos, second, group = pos[order], second[order], head[at]
        sa[at] = pos
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        new[at] = fresh
        head[at] = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[pos] = head[at] + 1
        h *= 2
    return sa, first


def _compare(text: np.ndarray, at: np.ndarray, test: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Sign of the comparison of text[at:at+width] with test[start:start+width], row by row."""
    out = np.zeros(len(at), np.int64)
    for k in range(width):
        open_ = out == 0
        if not open_.any():
            break
        out = np.where(open_, np.sign(text[at + k] - test[start + k]), out)
    return out


def search(ids: np.ndarray, sa: np.ndarray, first: np.ndarray, test: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds in the suffix array of the suffixes whose first `width` ids are test[start:start+width], by binary
    search: over the packed first three ids, then over whole prefixes."""
    text = np.concatenate([ids, np.zeros(width + 1, np.int64)])
    key = (test[starts] << 42) | (test[starts + 1] << 21) | test[starts + 2]
    lo, hi = np.searchsorted(first, key, "left"), np.searchsorted(first, key, "right")
    bounds = []
    for low_bound in (True, False):
        a, z = lo.copy(), hi.copy()
        while (a < z).any():
            run = np.flatnonzero(a < z)
            mid = (a[run] + z[run]) // 2
            c = _compare(text, sa[mid], test, starts[run], width)
            right = c < 0 if low_bound else c <= 0
            a[run] = np.where(right, mid + 1, a[run])
            z[run] = np.where(right, z[run], mid)
        bounds.append(a)
    return bounds[0], bounds[1]


class TestSet:
    """Test items as one sequence of words' hashes, each item followed by a gap, and the places where a match can begin."""

    def __init__(self, items: list[tuple[int, np.ndarray]], min_words: int) -> None:
        items = [(i, h) for i, h in items if len(h) >= min_words]
        sizes = np.array([len(h) for _, h in items], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes + 1)])[: len(items)]
        self.gap = np.zeros(int((sizes + 1).sum()) + 3, bool)
        self.gap[first + sizes] = self.gap[-3:] = True
        self.hash = np.zeros(len(self.gap), np.uint64)
        self.hash[~self.gap] = np.concatenate([h for _, h in items]) if items else 0
        n = sizes - min_words + 1
        self.begin = np.repeat(first, n)
        self.starts = self.begin + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.item = np.repeat(np.array([i for i, _ in items], np.int64), n)


def _numbered(t: SimpleNamespace | TestSet, words: np.ndarray) -> np.ndarray:
    """The test's words by their numbers among a shard's (from 1); a word that the shard lacks has one that it doesn't use, a gap 0."""
    k = np.minimum(np.searchsorted(words, t.hash), max(0, len(words) - 1))
    return np.where(t.gap, 0, np.where(words[k] == t.hash, k + 1, len(words) + 1))


def shard_matches(h: np.ndarray, at: np.ndarray, tests: Iterable, min_words: int, depth: int) -> tuple[np.ndarray, ...]:
    """Of one shard (hashes of words, begins of documents): document, its matched word, item, item's matched word and
    length of the longest match for each (document, item), the first where several are longest. The shard has one suffix array,
    in which all slices of the test set are searched one after the other."""
    n_docs = len(at) - 1
    none = (np.zeros(0, np.int64),) * 5
    if not len(h):
        return none
    words, inv = np.unique(h, return_inverse=True)
    if len(words) + 2 >= 1 << 21:
        half = n_docs // 2
        if half:  # too many words for the packed keys: two smaller shards
            x, y = shard_matches(h[: at[half]], at[: half + 1], tests, min_words, depth), shard_matches(h[at[half] :], at[half:] - at[half], tests, min_words, depth)
            return tuple(np.concatenate([p, q + half * (c == 0)]) for c, (p, q) in enumerate(zip(x, y, strict=True)))
        # one text with over two million different words: those that a slice lacks become one, in an array for each slice
        parts = [none]
        for t in tests:
            own = words[np.isin(words, t.hash[~t.gap])]
            k = np.minimum(np.searchsorted(own, h), max(0, len(own) - 1))
            number = np.where(own[k] == h, k + 1, len(own) + 2) if len(own) else np.full(len(h), 2)
            parts.append(_found(np.concatenate([number, [0]]), np.array([0, len(h) + 1]), [(t, own)], min_words, depth))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    ids = np.zeros(len(h) + n_docs, np.int64)
    ids[np.arange(len(h)) + np.repeat(np.arange(n_docs), np.diff(at))] = inv + 1
    return _found(ids, at + np.arange(n_docs + 1), ((t, words) for t in tests), min_words, depth)


def _found(ids: np.ndarray, begins: np.ndarray, tests: Iterable, min_words: int, depth: int) -> tuple[np.ndarray, ...]:
    sa, first = suffix_array(ids, depth)
    text = np.concatenate([ids, [0]])
    out = [(np.zeros(0, np.int64),) * 5]
    for t, words in tests:
        if not len(t.starts):
            continue
        test = _numbered(t, words)
        lo, hi = search(ids, sa, first, test, t.starts, min_words)
        n = hi - lo
        if not n.sum():
            continue
        which = np.repeat(np.arange(len(n)), n)
        pos = sa[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        start = t.starts[which]
        # only left ends of matches: those to the right of one are parts of it
        inner = (start > t.begin[which]) & (pos > 0) & (ids[np.maximum(pos - 1, 0)] == test[np.maximum(start - 1, 0)])
        which, pos, start = which[~inner], pos[~inner], start[~inner]
        size = np.full(len(pos), min_words)
        grow = np.arange(len(pos))
        while len(grow):
            a, b = text[np.minimum(pos[grow] + size[grow], len(ids))], test[start[grow] + size[grow]]
            grow = grow[(a == b) & (b != 0)]
            size[grow] += 1
        doc = np.searchsorted(begins, pos, "right") - 1
        order = np.lexsort((start, pos, -size, t.item[which], doc))
        d, i = doc[order], t.item[which][order]
        best = order[np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] != i[:-1])])] if len(order) else order
        out.append((doc[best], pos[best] - begins[doc[best]], t.item[which[best]], start[best] - t.begin[which[best]], size[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _test_sets(bench: DataFrame, min_words: int) -> Iterator[tuple[TestSet, int]]:
    """Slices of the test set, one at a time, and the length of their longest item."""
    words = bench.filter("item_id is not null").select("item_id", norm("text").alias("t")).withColumn("n", F.size(F.split("t", " ")))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    slices = -(-total // SLICE_WORDS) or 1
    for k in range(slices):
        part = words.filter(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k).select("item_id", "t").toArrow()
        items: list[tuple[int, np.ndarray]] = []
        ids = part.column("item_id").to_pylist()
        row = 0
        for chunk in part.column("t").chunks:
            for a, z, h, at in hashed_words(chunk):
                items += [(ids[row + i], h[at[i - a] : at[i - a + 1]]) for i in range(a, z)]
            row += len(chunk)
        yield TestSet(sorted(items, key=lambda x: x[0]), min_words), max((len(h) for _, h in items), default=0)


def matches(docs: DataFrame, bench: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, item_id, doc_word, item_word, n_words): for each affected document and each test item that it
    shares at least min_words consecutive words with, the longest verbatim match and where it begins (words from 0);
    of equally long ones the first in the document. Words are compared without case and punctuation.

    Documents with null or empty texts match nothing; a null doc_id is kept as null; items without an id or
    with fewer words than min_words are never matched; long texts are read whole; repeated rows are each reported; further columns are ignored; empty tables give an
    empty result. A match never crosses the end of a document. The test set is read when this is called, slice by slice."""
    sc = docs.sparkSession.sparkContext
    shared, depth = [], 0
    for t, longest in _test_sets(bench, min_words):
        shared.append(sc.broadcast(vars(t)))
        depth = max(depth, longest)

    def tests() -> Iterator[SimpleNamespace]:
        for b in shared:
            yield SimpleNamespace(**b.value)
            if len(shared) > 1 and hasattr(b, "_value"):
                del b._value  # a worker holds one slice at a time

    class Tests:
        def __iter__(self) -> Iterator[SimpleNamespace]:
            return tests()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "item_id", "doc_word", "item_word", "n_words"]
        hs, ids, sizes, n = [], [], [], 0

        def flush() -> pa.RecordBatch:
            at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            d, p, i, q, k = shard_matches(np.concatenate(hs), at, Tests(), min_words, depth)
            doc = pa.chunked_array(ids).combine_chunks() if len(ids) > 1 else ids[0]
            return pa.RecordBatch.from_arrays([doc.take(pa.array(d)), *map(pa.array, (i, p, q, k))], names)

        for batch in batches:
            for a, z, h, at in hashed_words(batch.column(1)):
                hs.append(h)
                ids.append(batch.column(0).slice(a, z - a))
                sizes.append(np.diff(at))
                n += len(h)
                if n >= SHARD_WORDS:
                    yield flush()
                    hs, ids, sizes, n = [], [], [], 0
        if ids:
            yield flush()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", norm("text").alias("t")).mapInArrow(run, "doc_id bigint, item_id bigint, doc_word bigint, item_word bigint, n_words bigint")


def without_leaks(docs: DataFrame, bench: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents that share no such passage, with all columns. Rows that repeat a doc_id go if any of them is
    affected; a row without a doc_id always stays (it can't be named)."""
    gone = matches(docs, bench, min_words).filter("doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle(min_words: int = MIN_WORDS) -> str:
    k = min_words
    words = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT item_id, {words} AS w FROM benchmark),
dg AS (SELECT doc_id, i, array_to_string(w[i:i+{k - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {k - 1})) AS i FROM d)),
bg AS (SELECT item_id, j, array_to_string(w[j:j+{k - 1}], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - {k - 1})) AS j FROM b)),
hit AS (SELECT doc_id, item_id, i, j, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run FROM dg JOIN bg USING (g)),
runs AS (SELECT doc_id, item_id, min(i) - 1 AS doc_word, min(j) - 1 AS item_word, count(*) + {k - 1} AS n_words FROM hit GROUP BY doc_id, item_id, i - j, run)
SELECT doc_id, item_id, doc_word, item_word, n_words FROM runs
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_words DESC, doc_word, item_word) = 1"""
