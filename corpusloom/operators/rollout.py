"""Batches of rollouts: cuts to the effective length, rows that take part, masks of what the policy wrote, samples per prompt."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda s, x: s + x.cast("int"))


def effective_cut(df: DataFrame, mask: str, columns: Sequence[str], left: bool = True) -> DataFrame:
    """Array columns (and the mask) cut to the longest row's number of tokens that count; padding is on the left or right."""
    n = df.agg(F.max(total(F.col(mask))).alias("__n"))
    cut = lambda c: F.when(F.col("__n") > 0, F.slice(c, (F.size(c) - F.least(F.size(c), F.col("__n")) + 1) if left else F.lit(1), F.col("__n"))).otherwise(F.slice(c, 1, 0))
    wide = df.crossJoin(F.broadcast(n))  # one row
    return wide.withColumns({c: cut(F.col(c)) for c in [*columns, mask]}).drop("__n")


def scattered(rows: DataFrame, part: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """All rows with the values of those that took part; the others get the defaults."""
    return rows.select(key).join(part.select(key, *defaults), key, "left").select(key, *[F.coalesce(F.col(c), d).alias(c) for c, d in defaults.items()])


def joined_segments(segments: Column) -> tuple[Column, Column]:
    """Ids and loss mask of an array<struct<ids, is_info>>: what was retrieved counts for nothing."""
    ids = F.flatten(F.transform(segments, lambda s: s["ids"]))
    return ids, F.flatten(F.transform(segments, lambda s: F.transform(s["ids"], lambda _: F.when(s["is_info"], 0).otherwise(1))))


def coverage(df: DataFrame, mask: str) -> DataFrame:
    """Share of tokens that count, over all rows."""
    return df.agg(F.round(F.sum(total(F.col(mask))) / F.sum(F.size(mask)), 6).alias("coverage"))


def response_info(mask: Column, size: int) -> tuple[Column, Column]:
    """Lengths of prompt and response, of a mask whose last `size` places are the response's."""
    return total(F.slice(mask, F.lit(1), F.greatest(F.lit(0), F.size(mask) - size))), total(F.slice(mask, F.greatest(F.lit(1), F.size(mask) - size + 1), F.lit(size)))


def sampled(rows: DataFrame, key: str, n: int, generate: Callable[[DataFrame], DataFrame], pad: str = "") -> DataFrame:
    """(key, responses): n responses of each row in their order; generate adds `response` to rows with `sample`. The padding text is taken out."""
    many = generate(rows.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))))
    text = F.replace(F.col("response"), F.lit(pad), F.lit("")) if pad else F.col("response")
    return many.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", text.alias("r")))), lambda x: x["r"]).alias("responses"))


def rank_share(df: DataFrame, place: str, world: int, drop_last: bool = True) -> DataFrame:
    """The rank of each row by its place, in turn; an incomplete last round is left out or kept."""
    out = df.withColumn("rank", F.pmod(F.col(place), F.lit(world)))
    if drop_last:
        n = df.agg(F.count("*").alias("__n"))
        out = out.crossJoin(F.broadcast(n)).filter(F.col(place) < F.floor(F.col("__n") / world) * world).drop("__n")  # one row
    return out


def inverse(df: DataFrame, place: str, origin: str) -> DataFrame:
    """Of a permutation (place, origin) its inverse: where each original place went."""
    return df.select(F.col(origin).alias(place), F.col(place).alias(origin))


def rolling_history(turns: DataFrame, key: str, order: str, text: str, n: int) -> DataFrame:
    """Each turn with the texts of the n turns before it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-n, -1)
    return turns.withColumn("history", F.collect_list(text).over(w))
