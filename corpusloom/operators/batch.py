"""Batches as tables with a row id: union of columns, repetition, chunks, padding, iteration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import hash_number
from corpusloom.runtime import bucket_of


def pop(df: DataFrame, columns: Sequence[str], row: str) -> tuple[DataFrame, DataFrame]:
    """The columns with the row id, and the table without them."""
    return df.select(row, *columns), df.drop(*columns)


def union_columns(a: DataFrame, b: DataFrame, row: str) -> DataFrame:
    """Columns of both by row id; a column that both have must have equal values, else the query ends with an error."""
    common = [c for c in b.columns if c in a.columns and c != row]
    j = a.join(b.withColumnsRenamed({c: f"__b_{c}" for c in common}), row)
    for c in common:
        j = j.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"__b_{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")).cast(a.schema[c].dataType)))
    return j.drop(*[f"__b_{c}" for c in common])


def gather(df: DataFrame, positions: DataFrame, row: str) -> DataFrame:
    """Rows in the order of (place, row id), repeated where asked for twice."""
    return positions.join(df, row)


def repeat(df: DataFrame, n: int, row: str, interleave: bool = True) -> DataFrame:
    """Each row n times; `place` orders copies next to each other (interleave) or the table after the table."""
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))
    w = (F.col(row), F.col("copy")) if interleave else (F.col("copy"), F.col(row))
    return out.withColumn("place", F.struct(*w))


def numbered(df: DataFrame, key: str, bucket: int = 100_000, out: str = "place") -> DataFrame:
    """Place of each row by an integer key, from 0, in two levels: rows within buckets of the key (of about `bucket` rows, however ids are spread), and buckets' sizes."""
    rows = df.withColumn("__b", bucket_of(df, key, bucket))
    at = rows.groupBy("__b").agg(F.count("*").alias("__n")).select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__0"))  # one row per bucket
    return rows.join(at, "__b").withColumn(out, F.col("__0") + F.row_number().over(Window.partitionBy("__b").orderBy(key)) - 1).drop("__b", "__0")


def batches(df: DataFrame, key: str, size: int, drop_last: bool = False) -> DataFrame:
    """batch number of each row in key order; drop_last leaves an incomplete last batch out."""
    out = numbered(df, key).withColumn("batch", F.floor(F.col("place") / size))
    if drop_last:
        n = df.agg(F.count("*").alias("__all"))
        out = out.crossJoin(F.broadcast(n)).filter(F.col("place") < F.floor(F.col("__all") / size) * size).drop("__all")  # one row
    return out


def equal_chunks(df: DataFrame, key: str, n: int) -> DataFrame:
    """chunk number of each row when the table, in key order, is cut into n parts that differ by one row at most."""
    total = df.agg(F.count("*").alias("__all"))
    p, small, extra = F.col("place"), F.floor(F.col("__all") / n), F.col("__all") % n
    big = extra * (small + 1)
    chunk = F.when(p < big, F.floor(p / (small + 1))).otherwise(extra + F.floor((p - big) / F.greatest(small, F.lit(1))))
    return numbered(df, key).crossJoin(F.broadcast(total)).withColumn("chunk", chunk.cast("bigint")).drop("__all")  # one row


def pad_to_multiple(df: DataFrame, key: str, divisor: int) -> DataFrame:
    """The table with its first rows (again from the start if need be) repeated up to a multiple of the divisor; is_pad marks them."""
    rows = numbered(df, key)
    total = df.agg(F.count("*").alias("__all"))
    missing = (F.lit(divisor) - F.col("__all") % divisor) % divisor
    times = F.when(F.col("place") < missing, F.floor((missing - F.col("place") - 1) / F.col("__all")) + 1).otherwise(0)
    pads = rows.crossJoin(F.broadcast(total)).withColumn("__t", times.cast("int")).filter("__t > 0").withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__t"))))  # one row
    pads = pads.withColumn("place", F.col("__all") * F.col("__k") + F.col("place")).drop("__all", "__t", "__k").withColumn("is_pad", F.lit(True))
    return rows.withColumn("is_pad", F.lit(False)).unionByName(pads)


def unpad(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_pad")).drop("is_pad")


def epochs(df: DataFrame, key: str, size: int, n: int, seed: int = 42) -> DataFrame:
    """Rows of n epochs, each in its own seeded order, with epoch, place and mini-batch. A place is found in two levels by the order's hash."""
    e = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    h = hash_number(F.concat(F.lit(f"{seed}:"), F.col("epoch").cast("string"), F.lit(":"), F.col(key).cast("string")), digits=12)
    e = e.withColumns({"__h": h, "__b": F.shiftright(h, 36)})
    at = e.groupBy("epoch", "__b").agg(F.count("*").alias("__n")).select("epoch", "__b", F.coalesce(F.sum("__n").over(Window.partitionBy("epoch").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__0"))
    out = e.join(at, ["epoch", "__b"]).withColumn("place", F.col("__0") + F.row_number().over(Window.partitionBy("epoch", "__b").orderBy("__h", key)) - 1)
    return out.withColumn("batch", F.floor(F.col("place") / size)).drop("__h", "__b", "__0")


def align(*frames: DataFrame) -> DataFrame:
    """Rows of all tables over the union of their columns, in the order in which these are first seen; missing values are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
