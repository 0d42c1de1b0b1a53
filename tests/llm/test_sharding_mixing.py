from __future__ import annotations

from collections import Counter

import pytest
from checks import DATA, same_rows
from pyspark.sql import functions as F

from corpusloom.llm import mixing, sharding


def jump(key: int, n: int) -> int:
    b, j = -1, 0
    key &= (1 << 64) - 1
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 100_000])
def test_jump_hash_equals_the_published_loop(spark, n):
    keys = [0, 1, 2, 3, 17, 256, 10**9, 2**63 - 1, -1, -(2**63), *range(1000, 1100)]
    got = {r.k: r.s for r in spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", sharding.jump_hash(F.col("k"), n).alias("s")).collect()}
    assert got == {k: jump(k, n) for k in keys}


def test_growing_moves_only_the_necessary_share(spark):
    r = spark.range(20_000).select(sharding.jump_hash(F.col("id"), 10).alias("a"), sharding.jump_hash(F.col("id"), 11).alias("b")).collect()
    moved = [x for x in r if x.a != x.b]
    assert all(x.b == 10 for x in moved)
    assert 0.07 < len(moved) / 20_000 < 0.11
    assert max(Counter(x.a for x in r).values()) < 2200


def test_shard_edge_cases(spark, messy, none):
    out = sharding.shard(messy, 8)
    assert out.columns == messy.columns and dict(out.dtypes)["shard"] == "int"
    rows = out.collect()
    assert len(rows) == messy.count()
    assert all((r.shard is None) == (r.doc_id is None) for r in rows)
    assert all(r.shard == jump(r.doc_id, 8) for r in rows if r.doc_id is not None)
    assert sharding.shard(none).count() == 0
    with pytest.raises(ValueError):
        sharding.jump_hash(F.lit(1), 0)


def test_shard_plan_has_no_exchange(spark, messy):
    assert "Exchange" not in sharding.shard(messy)._jdf.queryExecution().toString()


def test_sql(spark, duck):
    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    same_rows(sharding.shard(docs), duck("sf0.001").sql(sharding.oracle()))
    same_rows(mixing.mix_sources(docs), duck("sf0.001").sql(mixing.oracle()))


def test_mixing_reaches_target_weights(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "big" if i < 9000 else "small") for i in range(10_000)], "doc_id bigint, text string, source string")
    out = mixing.mix_sources(docs, {"big": 1.0, "small": 3.0})
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 2500) <= 1 and abs(n["small"] - 7500) <= 1
    per = out.filter("source = 'small'").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy_no").alias("m"), F.min("copy_no").alias("l")).collect()
    assert {r.n for r in per} <= {7, 8} and all(r.n == r.m and r.l == 1 for r in per)
    again = mixing.mix_sources(docs.repartition(7), {"big": 1.0, "small": 3.0})
    assert again.exceptAll(out).count() == 0
    assert mixing.mix_sources(docs, {"big": 1.0}).select("source").distinct().collect()[0].source == "big"
    assert mixing.mix_sources(docs, {}).count() == 0


def test_mixing_edge_cases(spark, messy, none):
    out = mixing.mix_sources(messy)
    assert set(out.columns) == set(messy.columns) and dict(out.dtypes)["copy_no"] == "int"
    assert abs(out.count() - messy.count()) <= 3
    assert mixing.mix_sources(messy, copy_col=None).columns == messy.columns
    assert mixing.mix_sources(messy, {"s1": 2.0}).filter("source is null or source <> 's1'").count() == 0
    assert mixing.mix_sources(none).count() == 0


def test_tiny_weights_and_large_sources_are_exact(spark):
    docs = spark.range(60_000).selectExpr("id as doc_id", "'t' as text", "case when id < 3 then 'tiny' when id < 30000 then 'a' else 'b' end as source")
    n = {r.source: r["count"] for r in mixing.mix_sources(docs, {"a": 1e-9, "b": 3e-9, "tiny": 1e-13}).groupBy("source").count().collect()}
    assert abs(n["a"] - 15_000) <= 1 and abs(n["b"] - 45_000) <= 1 and n.get("tiny", 0) in (1, 2)
    n = {r.source: r["count"] for r in mixing.mix_sources(docs, {"a": 1e-9, "b": 1.0}).groupBy("source").count().collect()}
    assert n["b"] in (60_000, 59_999) and n.get("a", 0) <= 1
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            mixing.mix_sources(docs, {"a": bad})


def test_places_equal_exact_fractions(spark):
    from fractions import Fraction
    from hashlib import md5

    docs = [(i, "t", "x" if i % 7 else "y") for i in range(700)]
    got = Counter((r.source, r.doc_id) for r in mixing.mix_sources(spark.createDataFrame(docs, "doc_id bigint, text string, source string"), {"x": 1.0, "y": 2.5}).collect())
    for s, w in (("x", Fraction(2, 7)), ("y", Fraction(5, 7))):
        ids = sorted((d for d, _, c in docs if c == s), key=lambda d: (d % mixing.BUCKETS, d))
        e, u = Fraction(int(700 * 10**6 * w), 10**6) / len(ids), Fraction(int(md5(f"42:s{s}".encode()).hexdigest()[:8], 16) % 10**6, 10**6)
        for k, d in enumerate(ids, 1):
            assert got[s, d] == int(u + k * e) - int(u + (k - 1) * e)


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([(f"id-{i}", "t", "s") for i in range(100)] + [(None, None, None), ("id-3", "t", "s")], "doc_id string, text string, source string")
    out = sharding.shard(docs, 16).collect()
    assert all((r.shard is None) == (r.doc_id is None) for r in out) and len({r.shard for r in out}) > 10
    assert len({r.shard for r in out if r.doc_id == "id-3"}) == 1
    assert abs(mixing.mix_sources(docs).count() - 102) <= 2
