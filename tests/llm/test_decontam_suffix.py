from __future__ import annotations

import random
import re

import numpy as np
from checks import DATA, same_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import decontam, suffix_dedup
from corpusloom.llm.common import hash_list, hashed_words


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


@given(st.lists(st.integers(0, 3), min_size=0, max_size=60), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_suffix_array_is_sorted_to_the_depth(ids, depth):
    a = np.array(ids, np.int64)
    sa, _ = decontam.suffix_array(a, depth)
    assert sorted(sa.tolist()) == list(range(len(ids)))
    rows = [(ids[i : i + depth] + [0] * depth)[:depth] for i in sa]  # 0 is the end, and behind the end
    assert rows == sorted(rows)


def brute_matches(docs, items, k):
    out = set()
    for d, t in docs:
        w = words(t)
        for i, s in items:
            v, best = words(s), None
            for a in range(len(w)):
                for b in range(len(v)):
                    n = 0
                    while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                        n += 1
                    if n >= k and (best is None or (-n, a, b) < best):
                        best = (-n, a, b)
            if best:
                out.add((d, i, best[1], best[2], -best[0]))
    return out


def test_matches_equal_brute_force(spark):
    r = random.Random(3)
    base = [" ".join(r.choice("abcd") for _ in range(40)) for _ in range(6)]
    items = [(i, t) for i, t in enumerate(base)] + [(90, "a b"), (91, ""), (92, base[0])]
    docs = []
    for d in range(40):
        t = " ".join(r.choice("abcd") for _ in range(r.randint(0, 30)))
        if d % 3 == 0:
            b = base[d % 6].split()
            s = r.randint(0, 20)
            t += " " + "! ".join(b[s : s + r.randint(5, 20)]).upper() + " " + t
        docs.append((d, t))
    got = decontam.matches(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string"), 8)
    assert {tuple(x) for x in got.select("doc_id", "item_id", "doc_word", "item_word", "n_words").collect()} == brute_matches(docs, items, 8)


def test_small_shards_find_the_same(spark, monkeypatch):
    d = f"{DATA}/sf0.001"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    whole = {tuple(r) for r in decontam.matches(docs, bench).collect()}
    monkeypatch.setattr(decontam, "SHARD_WORDS", 500)
    monkeypatch.setattr(decontam, "SLICE_WORDS", 300)
    assert {tuple(r) for r in decontam.matches(docs, bench).collect()} == whole and whole


def test_decontamination_edge_cases(spark, messy, none, prose):
    bench = spark.createDataFrame([(1, prose(1, 80)), (2, None), (3, ""), (None, prose(2, 80)), (5, prose(1, 80)), (5, prose(1, 80))], "item_id bigint, text string")
    got = decontam.matches(messy, bench)
    assert {(r.doc_id, r.item_id, r.n_words) for r in got.collect()} == {(d, i, 80) for d in (1, 2) for i in (1, 5)}
    left = decontam.without_leaks(messy, bench)
    assert left.columns == messy.columns and left.count() == messy.count() - 3
    assert decontam.matches(none, bench).count() == 0
    assert decontam.matches(messy, bench.limit(0)).count() == 0
    assert decontam.without_leaks(messy, bench.limit(0)).count() == messy.count()


def test_sql(spark, duck):
    d = f"{DATA}/sf0.001"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    same_rows(decontam.matches(docs, bench), duck("sf0.001").sql(decontam.oracle()))
    same_rows(suffix_dedup.repeats(docs), duck("sf0.001").sql(suffix_dedup.oracle()))
    same_rows(suffix_dedup.repeats(docs, 13), duck("sf0.001").sql(suffix_dedup.oracle(13)))


def brute_repeats(docs, k):
    at = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - k + 1):
            at.setdefault(tuple(w[i : i + k]), set()).add(d)
    out = set()
    for d, t in docs:
        w, spans = words(t), []
        for i in range(len(w) - k + 1):
            ds = at[tuple(w[i : i + k])]
            if len(ds) > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + k, min(spans[-1][2], min(ds)))
                else:
                    spans.append((i, i + k, min(ds)))
        out |= {(d, *s) for s in spans}
    return out


def test_repeats_equal_brute_force(spark):
    for seed in range(4):
        r = random.Random(seed)
        pool = [" ".join(r.choice("abcde") for _ in range(25)) for _ in range(5)]
        docs = []
        for d in range(60):
            parts = [" ".join(r.choice("abcdefghij") for _ in range(r.randint(0, 15))) for _ in range(3)]
            if d % 2:
                p = r.choice(pool).split()
                parts.insert(1, " ".join(p[r.randint(0, 8) : r.randint(12, 25)]))
            docs.append((d, " ".join(parts)))
        docs += [(100, docs[7][1]), (101, docs[7][1].upper() + "."), (102, "x " * 40), (103, "y x x x x x x x x x x x x x x z")]
        for k in (3, 10, 12):
            got = suffix_dedup.repeats(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), k)
            assert {(r.doc_id, r.start_word, r.end_word, r.first_id) for r in got.collect()} == brute_repeats(docs, k), (seed, k)


def test_repeats_edge_cases(spark, messy, none, prose):
    got = {(r.doc_id, r.start_word, r.end_word, r.first_id) for r in suffix_dedup.repeats(messy).collect()}
    assert got == {(1, 0, 80, 1), (2, 0, 80, 1)}
    assert suffix_dedup.repeats(none).count() == 0
    other = messy.unionByName(spark.createDataFrame([(50, prose(8, 30) + " " + prose(4, 60)), (51, prose(7, 60))], "doc_id bigint, text string"), allowMissingColumns=True)
    got = {(r.doc_id, r.start_word, r.end_word, r.first_id) for r in suffix_dedup.repeats(other).collect()}
    assert {(50, 30, 90, 9), (51, 0, 60, 9)} <= got


def test_repeats_keep_the_other_text_of_a_copy(spark, prose):
    """Document 2 has a copy of document 1's text, and another text that shares a passage with document 3 only."""
    rows = [(1, prose(1, 80)), (2, prose(1, 80)), (2, prose(20, 90) + " " + prose(21, 60)), (3, prose(21, 60)), (4, prose(1, 80))]
    got = suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {(r.doc_id, r.start_word, r.end_word, r.first_id) for r in got.collect()} == {(1, 0, 80, 1), (2, 0, 80, 1), (2, 90, 150, 2), (3, 0, 60, 2), (4, 0, 80, 1)}


def test_hashes_of_words_are_those_of_texts():
    import pyarrow as pa

    texts = ["", "one two", "two", "été two one", "x" * 3000]
    out = {}
    for a, z, h, at in hashed_words(pa.array(texts)):
        for i in range(a, z):
            out[i] = h[at[i - a] : at[i - a + 1]].tolist()
    assert [out[i] for i in range(5)] == [hash_list([w]).tolist() if len(t.split()) == 1 else [int(hash_list([w])[0]) for w in t.split()] for t in texts for w in [t]]


def test_repeats_do_not_depend_on_how_ids_are_joined(spark, prose, monkeypatch):
    rows = [(1, prose(1, 80)), (2, prose(1, 80)), (2, prose(20, 90) + " " + prose(21, 60)), (3, prose(21, 60)), (4, prose(1, 80)), (5, prose(30, 20) + " " + prose(1, 80))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {tuple(r) for r in suffix_dedup.repeats(docs).collect()}
    monkeypatch.setattr(suffix_dedup, "BROADCAST_IDS", 0)
    assert {tuple(r) for r in suffix_dedup.repeats(docs).collect()} == want and len(want) == 6


def test_runs_of_equal_ranks_are_streams(spark):
    """One rank in very many documents, in batches of any size: the same positions come back with one number a run."""
    rng = np.random.default_rng(5)
    rank, doc = np.sort(np.concatenate([np.full(5000, 7), rng.integers(0, 40, 300)])), None
    doc = rng.integers(0, 900, len(rank))
    order = np.lexsort((doc, rank))
    rank, doc, pos = rank[order], doc[order], np.arange(len(rank))
    want = {int(p) for k in np.unique(rank) if len(set(doc[rank == k])) > 1 for p in pos[rank == k]}
    for size in (1, 3, 64, 10**6):
        batches = spark.createDataFrame([(0,)], "i int").coalesce(1)  # a task context is there within a task only
        cuts = [(doc[i : i + size], rank[i : i + size], pos[i : i + size]) for i in range(0, len(rank), size)]

        def run(it, cuts=cuts):
            import pyarrow as pa

            list(it)
            yield from suffix_dedup._rerank(suffix_dedup._columns, False)(pa.RecordBatch.from_arrays([pa.array(x) for x in c], ["doc_id", "rank", "pos"]) for c in cuts)

        got = batches.mapInArrow(run, "doc_id bigint, pos bigint, rank bigint").collect()
        assert {r.pos for r in got} == want and len(got) == len(want)
        assert len({(r.rank, int(rank[r.pos])) for r in got}) == len({r.rank for r in got})


def test_a_text_with_too_many_words_for_the_packed_keys():
    """Over two million different words in one text, and in a shard of several: the same matches."""
    rng = np.random.default_rng(1)
    h = rng.permutation(np.arange(1, 2_200_001, dtype=np.uint64) * np.uint64(977))
    item = h[1_500_000:1_500_030].copy()
    t = decontam.TestSet([(5, item), (6, item[:20]), (7, h[:3])], 13)
    one = decontam.shard_matches(h, np.array([0, len(h)]), [t, t], 13, 30)
    assert sorted(zip(*(x.tolist() for x in one), strict=True)) == [(0, 1_500_000, 5, 0, 30)] * 2 + [(0, 1_500_000, 6, 0, 20)] * 2
    two = decontam.shard_matches(h, np.array([0, 1_000_000, len(h)]), [t], 13, 30)
    assert sorted(zip(*(x.tolist() for x in two), strict=True)) == [(1, 500_000, 5, 0, 30), (1, 500_000, 6, 0, 20)]
