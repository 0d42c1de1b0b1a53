"""Mixing sources to target weights by systematic sampling.

A source's expected number of copies is the total times its share of the weights (in millionths of a copy, from integers, so that sums don't
depend on their order); each of its documents expects an equal part of that, kept as a fraction and never rounded. Within a
source these are added up in a fixed order, one random offset is added, and a document is emitted once for each whole
number that its stretch of the running sum crosses; a source's number of copies is thus exact to within one, whatever its size and weight. The
running sum has two levels, (source, bucket) and then rows within a bucket, so no task ever holds a whole source, and
rows with their texts are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

UNIT = 1_000_000
BUCKETS = 4096
SEED = 42


def _keys(docs: DataFrame) -> DataFrame:
    number = F.col("doc_id") if isinstance(docs.schema["doc_id"].dataType, IntegralType) else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    return docs.withColumns({
        "__loom_s": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")),
        "__loom_b": F.coalesce(F.pmod(number, F.lit(BUCKETS)), F.lit(BUCKETS)).cast("bigint"),
    })


def _whole(weights: dict[str, float]) -> dict[str, int]:
    """Weights as whole numbers, the greatest 10^15; one over 0 never becomes 0."""
    if any(not v >= 0 or v == float("inf") for v in weights.values()):
        raise ValueError("weights must be finite and not negative")
    top = max(weights.values(), default=0) or 1
    return {k: max(1, round(v / top * 10**15)) if v else 0 for k, v in weights.items()}


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, copy_col: str | None = "copy_no") -> DataFrame:
    """Documents repeated or left out so that sources have their target weights; the total stays about the number of
    documents. ``weights`` maps sources to weights (those not named get 0, so none is emitted); by default a source
    weighs the square root of its number of documents, which tempers large sources and raises small ones. Weights may be
    of any size; a negative, infinite or NaN one is an error.

    Ids may be of any type. A null source is a source of its own (weight 0 if ``weights`` is given); documents with a null id come last in their
    source; ties and repeated rows are separate documents; texts may be null, empty or long. An empty table gives an
    empty result. copy_no counts a document's copies from 1 and replaces a column of that name; with copy_col=None there is no such column."""
    rows = _keys(docs)
    buckets = rows.groupBy("__loom_s", "__loom_b").agg(F.count("*").alias("__loom_n"))
    per = buckets.groupBy("__loom_s").agg(F.sum("__loom_n").alias("__loom_ns"))
    if weights is None:
        w = F.round(F.sqrt("__loom_ns") * F.lit(UNIT)).cast("bigint")
    else:
        w = F.coalesce(F.create_map(*[x for k, v in _whole(weights).items() for x in (F.lit(f"s{k}"), F.lit(v).cast("bigint"))])[F.col("__loom_s")] if weights else F.lit(None), F.lit(0).cast("bigint"))
    big = "decimal(38,0)"
    per = per.withColumn("__loom_w", w)
    total = per.agg(F.sum("__loom_ns").alias("__loom_total_n"), F.sum(F.col("__loom_w").cast(big)).alias("__loom_total_w"))
    # at most one row per source, and one row of totals; the source's copies in millionths
    share = F.expr(f"(cast({UNIT} as {big}) * __loom_total_n * __loom_w) div __loom_total_w")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("__loom_s"))), 1, 8), 16, 10).cast("bigint") % F.lit(UNIT)
    per = per.crossJoin(total).filter("__loom_total_w > 0").select("__loom_s", "__loom_ns", share.alias("__loom_e"), offset.alias("__loom_u")).filter("__loom_e > 0")
    before = F.sum("__loom_n").over(Window.partitionBy("__loom_s").orderBy("__loom_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = buckets.join(per, "__loom_s").select("__loom_s", "__loom_b", "__loom_e", "__loom_u", "__loom_ns", F.coalesce(before, F.lit(0)).alias("__loom_0"))
    order = Window.partitionBy("__loom_s", "__loom_b").orderBy(F.col("doc_id"), F.col("text"))
    copies = rows.join(starts, ["__loom_s", "__loom_b"]).withColumn("__loom_1", F.col("__loom_0") + F.row_number().over(order))
    # the whole numbers up to a document's place: (offset + place * copies / documents), as one fraction
    upto = lambda place: f"(cast(__loom_u as {big}) * __loom_ns + cast({place} as {big}) * __loom_e) div (cast({UNIT} as {big}) * __loom_ns)"
    crossed = F.expr(f"cast({upto('__loom_1')} - {upto('__loom_1 - 1')} as int)")
    out = copies.withColumn("__loom_c", crossed).filter("__loom_c > 0")
    number = F.explode(F.sequence(F.lit(1), F.col("__loom_c")))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != copy_col]
    out = out.select(*kept, number.alias(copy_col or "__loom_k"))
    return out if copy_col else out.drop("__loom_k")


def oracle(seed: int = SEED, source: str = "documents") -> str:
    return f"""
WITH r AS (SELECT *, coalesce('s' || source, 'null') AS ls, coalesce(((doc_id % {BUCKETS}) + {BUCKETS}) % {BUCKETS}, {BUCKETS}) AS lb FROM {source}),
per AS (SELECT ls, count(*) AS ns, CAST(round(sqrt(count(*)) * {UNIT}) AS BIGINT) AS w FROM r GROUP BY ls),
tot AS (SELECT sum(ns)::HUGEINT AS n, sum(w)::HUGEINT AS w FROM per),
e AS (SELECT ls, ns, {UNIT}::HUGEINT * tot.n * sw // tot.w AS e, CAST('0x' || substr(md5('{seed}:' || ls), 1, 8) AS BIGINT) % {UNIT} AS u FROM (SELECT ls, ns, w AS sw FROM per), tot),
p AS (SELECT r.*, e.e, e.u, e.ns, row_number() OVER (PARTITION BY r.ls ORDER BY lb, doc_id, text) AS k FROM r JOIN e USING (ls)),
c AS (SELECT *, CAST((u::HUGEINT * ns + k * e) // ({UNIT}::HUGEINT * ns) - (u::HUGEINT * ns + (k - 1) * e) // ({UNIT}::HUGEINT * ns) AS INTEGER) AS n FROM p)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(generate_series(1, n)) AS INTEGER) AS copy_no FROM c WHERE n > 0"""
