"""Jump consistent hashing: a stable shard for a stable key, without a ring table.

The published algorithm (Lamping and Veach, 2014) as one Catalyst expression: a fold over at most STEPS jumps whose
64-bit multiplication is done in 32-bit halves, since Spark's ANSI arithmetic rejects overflow. No shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

MASK = 0xFFFFFFFF
M_HI, M_LO1, M_LO0 = 2862933555777941757 >> 32, (2862933555777941757 >> 16) & 0xFFFF, 2862933555777941757 & 0xFFFF
#: The number of jumps is about ln(shards) on average; more than this many has a chance below 1e-20 for a million
#: shards and ends the query with an error instead of a wrong shard.
STEPS = 64
N_SHARDS = 1024


def _step(s: Column, shards: int) -> Column:
    and_ = lambda c, m: c.bitwiseAND(F.lit(m).cast("bigint"))
    hi, lo = s["hi"], s["lo"]
    p1 = lo * F.lit(M_LO1)
    low = lo * F.lit(M_LO0) + F.shiftleft(and_(p1, 0xFFFF), 16) + F.lit(1)
    high = F.shiftright(low, 32) + F.shiftright(p1, 16) + and_(lo * F.lit(M_HI), MASK) + hi * F.lit(M_LO0) + F.shiftleft(and_(hi * F.lit(M_LO1), 0xFFFF), 16)
    hi2 = and_(high, MASK)
    jump = F.floor((s["j"] + F.lit(1)).cast("double") * (F.lit(2147483648.0) / (F.shiftright(hi2, 1) + F.lit(1)).cast("double"))).cast("bigint")
    new = F.struct(hi2.alias("hi"), and_(low, MASK).alias("lo"), s["j"].alias("b"), jump.alias("j"))
    return F.when(s["j"] >= F.lit(shards), s).otherwise(new)


def jump_hash(key: Column, shards: int = N_SHARDS) -> Column:
    """Shard (int, 0 <= shard < shards) of an integer key, any 64-bit value; null for a null key."""
    if shards < 1:
        raise ValueError("shards must be positive")
    k = key.cast("bigint")
    zero = F.struct(F.shiftright(k, 32).bitwiseAND(F.lit(MASK).cast("bigint")).alias("hi"), k.bitwiseAND(F.lit(MASK).cast("bigint")).alias("lo"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), zero, lambda s, _: _step(s, shards))
    found = F.aggregate(F.array(end), F.lit(0).cast("bigint"), lambda _, e: F.when(e["j"] >= F.lit(shards), e["b"]).otherwise(F.raise_error(F.lit("jump hash did not end")).cast("bigint")))
    return F.when(k.isNotNull(), found.cast("int"))


def shard(docs: DataFrame, shards: int = N_SHARDS, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """Every row with its shard, in one narrow pass.

    Integer keys are hashed as they are; keys of any other type by their 64-bit xxHash. A null key has the null shard; equal
    keys and repeated rows share a shard; an empty table stays empty; texts aren't looked at. A column that is already named as ``out`` is replaced, all others are kept."""
    k = F.col(f"`{key}`")
    if not isinstance(docs.schema[key].dataType, IntegralType):
        k = F.when(k.isNotNull(), F.xxhash64(k))
    return docs.withColumn(out, jump_hash(k, shards))


def oracle(shards: int = N_SHARDS, source: str = "documents") -> str:
    return f"""
WITH RECURSIVE keys AS (SELECT DISTINCT doc_id FROM {source} WHERE doc_id IS NOT NULL),
j AS (
  SELECT doc_id, CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616::HUGEINT ELSE doc_id::HUGEINT END AS k, (-1)::BIGINT AS b, 0::BIGINT AS j FROM keys
  UNION ALL
  SELECT doc_id, k2, j, CAST(floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k2 // 8589934592::HUGEINT) + 1)::DOUBLE)) AS BIGINT)
  FROM (SELECT doc_id, j, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM j WHERE j < {shards})
)
SELECT d.*, CAST(s.b AS INTEGER) AS shard FROM {source} d LEFT JOIN (SELECT doc_id, b FROM j WHERE j >= {shards}) s USING (doc_id)"""
