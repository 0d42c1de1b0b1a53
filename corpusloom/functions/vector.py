"""Vectors as array columns; sums are taken in double."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def normalized(a: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    return F.get(F.transform(F.array(F.sqrt(dot(a, a))), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(F.transform(a, lambda x: x.cast("double")))), F.lit(0))


def mean_pool(states: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is 1, from an array of vectors."""
    on = F.filter(F.arrays_zip(states.alias("v"), mask.alias("m")), lambda z: z["m"] == 1)
    total = F.aggregate(on, F.transform(F.element_at(states, 1), lambda x: F.lit(0.0)), lambda s, z: F.zip_with(s, z["v"], lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: F.try_divide(x, F.size(on)))


def min_max(score: Column, *keys: str, constant: float = 0.0) -> Column:
    """(x - min) / (max - min) within the keys; `constant` where all scores are the same."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi > lo, (score - lo) / (hi - lo)).otherwise(F.lit(constant))


def clip(x: Column, lo: float | Column, hi: float | Column) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(F.least(x, as_col(hi)), as_col(lo))


def entropy(logits: Column) -> Column:
    """Entropy of the softmax of an array of logits."""
    m = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - m))
    z = _sum(e)
    return F.log(z) + m - _sum(F.zip_with(logits, e, lambda x, p: x * p / z))


def log_prob(logits: Column, token: Column) -> Column:
    """Log-probability of the token with this number (from 0)."""
    m = F.array_max(logits)
    return F.element_at(logits, token + 1) - m - F.log(_sum(F.transform(logits, lambda x: F.exp(x - m))))


def pooled(states: Column, mask: Column, kind: str = "mean", pooler: Column | None = None) -> Column:
    """One vector of an array of vectors: mean over the mask, the first ('cls'), or the model's own ('pooler')."""
    if kind == "mean":
        return mean_pool(states, mask)
    if kind == "cls":
        return F.transform(F.element_at(states, 1), lambda x: x.cast("double"))
    if kind == "pooler" and pooler is not None:
        return F.transform(pooler, lambda x: x.cast("double"))
    raise ValueError(kind)


def tempered(logits: Column, temperature: float) -> Column:
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    return F.transform(logits, lambda x: x / F.lit(temperature))


def cosine_rate(step: Column, warm: int, total: int, least: float = 0.0, cycles: float = 0.5) -> Column:
    """Factor of a learning rate: a linear rise over `warm` steps, then a cosine from 1 to `least`."""
    share = (step - F.lit(warm)) / F.lit(float(max(1, total - warm)))
    wave = (F.cos(F.lit(3.141592653589793 * cycles * 2) * share) + 1) / 2
    return F.when(step < warm, least + (1 - least) * step / F.lit(float(max(1, warm)))).otherwise(F.greatest(F.lit(0.0), F.lit(least) + (1 - least) * wave))


def constant_rate(step: Column, warm: int) -> Column:
    return F.least(F.lit(1.0), step / F.lit(float(max(1, warm)))) if warm else F.lit(1.0)
