"""Token sequences as array columns: padding, masks, labels, windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = -100


def pad(ids: Column, size: int, value: int = 0, left: bool = False, truncation: str = "right") -> Column:
    """An array of exactly `size` ids. truncation: which side of a longer one goes ('left', 'right'), or 'error'."""
    if truncation not in ("left", "right", "error"):
        raise ValueError(truncation)
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(0), F.lit(size) - F.size(ids)))
    full = F.concat(fill, ids) if left else F.concat(ids, fill)
    cut = F.slice(full, -size, size) if truncation == "left" else F.slice(full, 1, size)
    return F.when(F.size(ids) > size, F.raise_error(F.lit("sequence is longer than the limit")).cast("array<int>")).otherwise(cut) if truncation == "error" else cut


def unpad(ids: Column, value: int = 0) -> Column:
    return F.filter(ids, lambda x: x != value)


def pads_last(ids: Column, value: int = 0) -> Column:
    """Padding moved behind the rest, whose order stays."""
    return F.concat(F.filter(ids, lambda x: x != value), F.filter(ids, lambda x: x == value))


def eos_mask(ids: Column, eos: int) -> Column:
    """1 up to the first end mark and on it, 0 behind it."""
    at = F.array_position(ids, eos)
    return F.transform(ids, lambda _, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def position_ids(mask: Column) -> Column:
    """Position of each token among those that count; 0 for padding."""
    return F.transform(mask, lambda m, i: (F.aggregate(F.slice(mask, 1, i + 1), F.lit(0), lambda s, x: s + x.cast("int")) - 1) * m.cast("int"))


def last_token_reward(size: Column, score: Column) -> Column:
    """Zeros with the score at the last of `size` places."""
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), size), lambda i: F.when(i == size, score.cast("double")).otherwise(0.0))).otherwise(F.array().cast("array<double>"))


def masked_labels(source: Column, target: Column, eos: int) -> Column:
    """Labels of one turn: the prompt is ignored, the answer and an end mark count."""
    return F.concat(F.array_repeat(F.lit(IGNORE), F.size(source)), target, F.array(F.lit(eos)))


def has_label(labels: Column) -> Column:
    return F.exists(labels, lambda x: x != IGNORE)


def windows(tokens: Column, size: int, overlap: int) -> Column:
    """Array of windows of at most `size` tokens, each beginning size - overlap after the one before; the last is the first to reach the end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than the size")
    stride = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.size(tokens) - size) / F.lit(float(stride)))).cast("int")
    return F.when(F.size(tokens) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(tokens, i * stride + 1, F.lit(size))))


def fit_turn(source: Column, target: Column, limit: int) -> tuple[Column, Column]:
    """Prompt and answer shortened in proportion to their lengths so that both fit, with room for an end mark."""
    n, m = F.size(source), F.size(target)
    share = lambda k: F.floor(F.lit(limit) * F.try_divide(k.cast("double"), n + m)).cast("int")
    return F.slice(source, 1, F.least(n, F.coalesce(share(n), F.lit(0)))), F.slice(target, 1, F.greatest(F.lit(0), F.least(m, F.coalesce(share(m), F.lit(0)) - 1)))
