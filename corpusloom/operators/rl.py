"""Reinforcement-learning math over rows and token arrays: advantages, returns, penalties, losses, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.vector import clip


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def group_advantage(df: DataFrame, group: str, score: str, eps: float = 1e-6, out: str = "advantage") -> DataFrame:
    """(score - mean) / (sample deviation + eps) within the group; a group of one has mean 0 and deviation 1."""
    w = Window.partitionBy(group)
    n, mean, std = F.count(score).over(w), F.avg(score).over(w), F.stddev_samp(score).over(w)
    return df.withColumn(out, F.when(n > 1, (F.col(score) - mean) / (std + eps)).otherwise(F.col(score) / (1 + eps)))


def gae(rewards: Column, values: Column, gamma: float = 1.0, lam: float = 0.95) -> Column:
    """Generalised advantages of one sequence, by a fold from its end; the value behind the end is 0."""
    zero = F.struct(F.lit(0.0).alias("next"), F.lit(0.0).alias("adv"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, rv: Column) -> Column:
        adv = rv["r"] + gamma * s["next"] - rv["v"] + gamma * lam * s["adv"]
        return F.struct(rv["v"].alias("next"), adv.alias("adv"), F.concat(s["out"], F.array(adv)).alias("out"))

    pairs = F.reverse(F.zip_with(rewards, values, lambda r, v: F.struct(r.cast("double").alias("r"), v.cast("double").alias("v"))))
    return F.aggregate(pairs, zero, step, lambda s: F.reverse(s["out"]))


def masked_sum(x: Column, m: Column) -> Column:
    return _sum(F.zip_with(x, m, lambda a, b: a.cast("double") * b.cast("double")))


def masked_mean(x: Column, m: Column) -> Column:
    """Mean where the mask is 1; an error without any."""
    n = _sum(F.transform(m, lambda b: b.cast("double")))
    return F.when(n > 0, masked_sum(x, m) / n).otherwise(F.raise_error(F.lit("empty mask")).cast("double"))


def masked_var(x: Column, m: Column) -> Column:
    """Sample variance where the mask is 1; an error with fewer than two."""
    n, mean = _sum(F.transform(m, lambda b: b.cast("double"))), masked_mean(x, m)
    sq = _sum(F.zip_with(x, m, lambda a, b: (a.cast("double") - mean) * (a.cast("double") - mean) * b.cast("double")))
    return F.when(n > 1, sq / (n - 1)).otherwise(F.raise_error(F.lit("mask with fewer than two")).cast("double"))


def whiten(df: DataFrame, value: str, mask: str | None = None, out: str = "whitened", shift: bool = True) -> DataFrame:
    """(x - mean) / sqrt(variance + 1e-8) over all rows with mask 1; shift=False adds the mean again."""
    on = F.col(mask) == 1 if mask else F.lit(True)
    stats = df.agg(F.avg(F.when(on, F.col(value))).alias("__m"), F.var_samp(F.when(on, F.col(value))).alias("__v"))
    z = (F.col(value) - F.col("__m")) / F.sqrt(F.col("__v") + 1e-8)
    return df.crossJoin(F.broadcast(stats)).withColumn(out, z if shift else z + F.col("__m")).drop("__m", "__v")  # one row


def kl_penalty(logp: Column, ref: Column, kind: str) -> Column:
    d = logp - ref
    if kind == "kl":
        return d
    if kind == "abs":
        return F.abs(d)
    if kind == "mse":
        return d * d / 2
    if kind == "low_var_kl":
        return clip(F.exp(-d) + d - 1, -10.0, 10.0)
    raise ValueError(kind)


def penalised(score: Column, logp: Column, ref: Column, ratio: float) -> Column:
    return score - F.lit(ratio) * (logp - ref)


class AdaptiveKL:
    """Coefficient that follows a target over steps; state on the driver."""

    def __init__(self, value: float, target: float, horizon: int) -> None:
        self.value, self.target, self.horizon = value, target, horizon

    def update(self, current: float, n: int) -> float:
        self.value *= 1 + min(max(current / self.target - 1, -0.2), 0.2) * n / self.horizon
        return self.value


def policy_loss(df: DataFrame, old: str, new: str, adv: str, mask: str, clip_ratio: float = 0.2) -> DataFrame:
    """One row (loss, clip_fraction, approx_kl) over token rows."""
    d = F.col(new) - F.col(old)
    r, a, m = F.exp(d), F.col(adv), F.col(mask).cast("double")
    plain, clipped = -a * r, -a * clip(r, 1 - clip_ratio, 1 + clip_ratio)
    mean = lambda x: F.sum(x * m) / F.sum(m)
    return df.agg(F.round(mean(F.greatest(plain, clipped)), 6).alias("loss"), F.round(mean((clipped > plain).cast("double")), 6).alias("clip_fraction"), F.round(mean(-d), 6).alias("approx_kl"))


def value_loss(df: DataFrame, pred: str, old: str, ret: str, mask: str, clip_range: float = 0.5) -> DataFrame:
    """One row (loss, clip_fraction) of the clipped value loss."""
    p, m = F.col(pred), F.col(mask).cast("double")
    bound = clip(p, F.col(old) - clip_range, F.col(old) + clip_range)
    a, b = (p - F.col(ret)) ** 2, (bound - F.col(ret)) ** 2
    mean = lambda x: F.sum(x * m) / F.sum(m)
    return df.agg(F.round(0.5 * mean(F.greatest(a, b)), 6).alias("loss"), F.round(mean((b > a).cast("double")), 6).alias("clip_fraction"))


def pair_loss(chosen: Column, rejected: Column) -> Column:
    """Mean of -log sigmoid(chosen - rejected)."""
    return F.avg(F.log1p(F.exp(-(chosen - rejected))))


def pass_at_n(df: DataFrame, prompt: str, score: str) -> DataFrame:
    best = df.groupBy(prompt).agg(F.max(score).alias("best"))
    return best.agg(F.count("*").alias("n_prompts"), F.round(F.avg((F.col("best") == 1).cast("double")), 6).alias("pass_at_n"))


def source_means(df: DataFrame, source: str, score: str) -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean_score"))


def training_metrics(df: DataFrame, score: str, ret: str, value: str, length: str, max_length: int) -> DataFrame:
    """One row: mean, greatest and least score, explained variance, length statistics and how many reach the limit."""
    var = 1 - F.var_samp(F.col(ret) - F.col(value)) / (F.var_samp(ret) + 1e-5)
    return df.agg(F.count("*").alias("n"), *[F.round(f(score), 6).alias(f"score_{n}") for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))], F.round(var, 6).alias("explained_variance"), F.round(F.avg(length), 6).alias("length_mean"), F.max(length).alias("length_max"), F.min(length).alias("length_min"), F.round(F.avg((F.col(length) >= max_length).cast("double")), 6).alias("clip_ratio"))


def perplexity(df: DataFrame, nll: str, n: str) -> DataFrame:
    return df.agg(F.round(F.exp(F.sum(nll) / F.sum(n)), 6).alias("perplexity"))


def token_accuracy(preds: Column, labels: Column, ignore: int = -100) -> Column:
    """Share of labels that the prediction one place before has; ignored labels don't count."""
    pairs = F.filter(F.arrays_zip(F.slice(preds, F.lit(1), F.size(preds) - 1).alias("p"), F.slice(labels, F.lit(2), F.greatest(F.lit(0), F.size(labels) - 1)).alias("l")), lambda z: z["l"] != ignore)
    return F.try_divide(F.size(F.filter(pairs, lambda z: z["p"] == z["l"])).cast("double"), F.size(pairs))


def prediction_errors(df: DataFrame, pred: str, label: str) -> DataFrame:
    """One row (mse, mae)."""
    d = F.col(pred) - F.col(label)
    return df.agg(F.round(F.avg(d * d), 6).alias("mse"), F.round(F.avg(F.abs(d)), 6).alias("mae"))


def token_metrics(df: DataFrame, columns: dict[str, str], mask: str) -> DataFrame:
    """One row: mean, greatest and least of each token column where the mask is 1, under its name."""
    on = {n: F.when(F.col(mask) == 1, F.col(c)) for n, c in columns.items()}
    return df.agg(*[F.round(f(x), 6).alias(f"{n}_{k}") for n, x in on.items() for k, f in (("mean", F.avg), ("max", F.max), ("min", F.min))])


def timing_metrics(df: DataFrame, section: str, seconds: str, n_tokens: str) -> DataFrame:
    """(section, seconds, ms_per_token): of each section the sums' ratio."""
    return df.groupBy(section).agg(F.round(F.sum(seconds), 6).alias("seconds"), F.round(F.try_divide(F.sum(seconds) * 1000, F.sum(n_tokens)), 6).alias("ms_per_token"))


def reduced(df: DataFrame, name: str, value: str) -> DataFrame:
    """Mean of each metric's values."""
    return df.groupBy(name).agg(F.round(F.avg(value), 6).alias("mean"))


class FixedKL:
    """A coefficient that stays."""

    def __init__(self, value: float) -> None:
        self.value = value

    def update(self, current: float, n: int) -> float:
        return self.value


def kl_controller(kind: str, value: float, target: float | None = None, horizon: int | None = None) -> FixedKL | AdaptiveKL:
    if kind == "fixed":
        return FixedKL(value)
    if kind == "adaptive" and target and horizon:
        return AdaptiveKL(value, target, horizon)
    raise ValueError(f"{kind}: fixed, or adaptive with a target and a horizon")
