"""Reinforcement-learning math and batch queries; events stand for token or response rows (user_id: prompt, value: score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import tokens, vector
from corpusloom.operators import batch, chunking, rl
from corpusloom.plans.registry import query
from corpusloom.runtime import table
from corpusloom.streaming import streams


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """Per user the values in order of events, as rewards, with half of them as value estimates."""
    item = F.struct("event_id", "value")
    seq = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["value"])
    return events(spark, d).groupBy("user_id").agg(seq.alias("r")).withColumn("v", F.transform("r", lambda x: x / 2))


@query("SELECT event_id, round(CASE WHEN count(*) OVER w > 1 THEN (value - avg(value) OVER w) / (stddev_samp(value) OVER w + 1e-6) ELSE value / (1 + 1e-6) END, 6) AS advantage FROM events WINDOW w AS (PARTITION BY user_id)")
def grpo_advantage(spark: SparkSession, d: str) -> DataFrame:
    return rl.group_advantage(events(spark, d), "user_id", "value").select("event_id", F.round("advantage", 6).alias("advantage"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_score FROM events GROUP BY 1")
def source_mean_reward(spark: SparkSession, d: str) -> DataFrame:
    return rl.source_means(events(spark, d), "event_type", "value")


@query("SELECT count(*) AS n_prompts, round(avg(CASE WHEN b = 1 THEN 1.0 ELSE 0 END), 6) AS pass_at_n FROM (SELECT user_id, max(CASE WHEN value > 90 THEN 1 ELSE 0 END) AS b FROM events GROUP BY 1)")
def pass_at_n(spark: SparkSession, d: str) -> DataFrame:
    return rl.pass_at_n(events(spark, d).withColumn("s", (F.col("value") > 90).cast("int")), "user_id", "s")


@query("""WITH s AS (SELECT user_id, event_id, value AS r, value / 2 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
t AS (SELECT *, r + 0.99 * coalesce(lead(v) OVER (PARTITION BY user_id ORDER BY i), 0) - v AS dl FROM s)
SELECT a.user_id, CAST(a.i - 1 AS INTEGER) AS i, round(sum(power(0.99 * 0.95, b.i - a.i) * b.dl), 4) AS advantage FROM t a JOIN t b ON a.user_id = b.user_id AND b.i >= a.i GROUP BY 1, 2""")
def gae_returns(spark: SparkSession, d: str) -> DataFrame:
    return sequences(spark, d).select("user_id", F.posexplode(rl.gae(F.col("r"), F.col("v"), 0.99, 0.95)).alias("i", "a")).select("user_id", "i", F.round("a", 4).alias("advantage"))


@query("WITH m AS (SELECT user_id, value FROM events WHERE value > 20) SELECT user_id, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS var FROM m GROUP BY 1 HAVING count(*) > 1")
def masked_stats(spark: SparkSession, d: str) -> DataFrame:
    s = sequences(spark, d).withColumn("m", F.transform("r", lambda x: (x > 20).cast("int"))).filter(F.aggregate("m", F.lit(0), lambda a, b: a + b) > 1)
    return s.select("user_id", F.round(rl.masked_sum(F.col("r"), F.col("m")), 4).alias("total"), F.round(rl.masked_mean(F.col("r"), F.col("m")), 6).alias("mean"), F.round(rl.masked_var(F.col("r"), F.col("m")), 4).alias("var"))


@query("WITH s AS (SELECT avg(value) AS m, var_samp(value) AS v FROM events) SELECT event_id, round((value - m) / sqrt(v + 1e-8), 6) AS whitened FROM events, s")
def whitened_values(spark: SparkSession, d: str) -> DataFrame:
    return rl.whiten(events(spark, d), "value").select("event_id", F.round("whitened", 6).alias("whitened"))


@query("WITH x AS (SELECT event_id, -value / 100 AS a, -(event_id % 100) / 100.0::DOUBLE AS b FROM events), y AS (SELECT event_id, a - b AS d FROM x) SELECT event_id, round(d, 4) AS kl, round(abs(d), 4) AS abs, round(d * d / 2 + 1e-7, 5) AS mse, round(least(greatest(exp(-d) + d - 1, -10), 10) + 1e-7, 5) AS low_var FROM y")
def kl_penalties(spark: SparkSession, d: str) -> DataFrame:
    a, b = -F.col("value") / 100, -(F.col("event_id") % 100) / F.lit(100.0)
    k = lambda name, n, shift=0.0: F.round(rl.kl_penalty(a, b, name) + shift, n)  # noqa: E731  # the shift moves ties of the rounding apart
    return events(spark, d).select("event_id", k("kl", 4).alias("kl"), k("abs", 4).alias("abs"), k("mse", 5, 1e-7).alias("mse"), k("low_var_kl", 5, 1e-7).alias("low_var"))


TOK = "x AS (SELECT -value / 100 AS n, -(event_id % 100) / 100.0::DOUBLE AS o, (event_id % 7 - 3)::DOUBLE AS a, (event_id % 5 <> 0)::INTEGER::DOUBLE AS m FROM events)"


def token_rows(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return events(spark, d).select((-F.col("value") / 100).alias("n"), (-(e % 100) / F.lit(100.0)).alias("o"), (e % 7 - 3).cast("double").alias("a"), (e % 5 != 0).cast("int").alias("m"))


@query(f"WITH {TOK}, y AS (SELECT m, n - o AS d, -a * exp(n - o) AS p, -a * least(greatest(exp(n - o), 0.8), 1.2) AS c FROM x) SELECT round(sum(greatest(p, c) * m) / sum(m), 6) AS loss, round(sum((c > p)::INTEGER * m) / sum(m), 6) AS clip_fraction, round(sum(-d * m) / sum(m), 6) AS approx_kl FROM y")
def clipped_policy_loss(spark: SparkSession, d: str) -> DataFrame:
    return rl.policy_loss(token_rows(spark, d), "o", "n", "a", "m")


@query(f"WITH {TOK}, y AS (SELECT m, power(n - a, 2) AS p, power(least(greatest(n, o - 0.5), o + 0.5) - a, 2) AS c FROM x) SELECT round(0.5 * sum(greatest(p, c) * m) / sum(m), 6) AS loss, round(sum((c > p)::INTEGER * m) / sum(m), 6) AS clip_fraction FROM y")
def clipped_value_loss(spark: SparkSession, d: str) -> DataFrame:
    return rl.value_loss(token_rows(spark, d), "n", "o", "a", "m")


@query("SELECT count(*) AS n, round(avg(value), 6) AS score_mean, round(max(value), 6) AS score_max, round(min(value), 6) AS score_min, round(1 - var_samp(value - value / 2) / (var_samp(value) + 1e-5), 6) AS explained_variance, round(avg(user_id), 6) AS length_mean, max(user_id) AS length_max, min(user_id) AS length_min, round(avg(CASE WHEN user_id >= 90 THEN 1.0 ELSE 0 END), 6) AS clip_ratio FROM events")
def training_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rl.training_metrics(events(spark, d).withColumn("half", F.col("value") / 2), "value", "value", "half", "user_id", 90)


@query("SELECT round(avg(ln(1 + exp(-(value - event_id % 100) / 100))), 6) AS loss FROM events")
def pair_loss(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).agg(F.round(rl.pair_loss(F.col("value") / 100, (F.col("event_id") % 100) / F.lit(100.0)), 6).alias("loss"))


@query("SELECT round(exp(sum(value / 100) / sum(user_id % 5 + 1)), 6) AS perplexity FROM events")
def perplexity(spark: SparkSession, d: str) -> DataFrame:
    return rl.perplexity(events(spark, d).withColumns({"nll": F.col("value") / 100, "n": F.col("user_id") % 5 + 1}), "nll", "n")


ORD = "o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders)"


@query(f"WITH {ORD} SELECT o_orderkey, place, place // 64 AS batch FROM o WHERE place < n // 64 * 64")
def batch_chunks(spark: SparkSession, d: str) -> DataFrame:
    out = batch.batches(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 64, drop_last=True)
    return out.select("o_orderkey", F.col("place").cast("bigint").alias("place"), F.col("batch").cast("bigint").alias("batch"))


@query("SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS chunk FROM orders")
def batch_equal(spark: SparkSession, d: str) -> DataFrame:
    return batch.equal_chunks(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7).select("o_orderkey", "chunk")


@query("SELECT s_suppkey, CAST(c AS INTEGER) AS copy, row_number() OVER (ORDER BY s_suppkey, c) AS place FROM supplier, (SELECT unnest([1, 2, 3]) AS c)")
def batch_repeat(spark: SparkSession, d: str) -> DataFrame:
    out = batch.repeat(table(spark, d, "supplier").select("s_suppkey"), 3, "s_suppkey")
    return out.select("s_suppkey", "copy", ((F.dense_rank().over(Window.orderBy("place"))).cast("bigint")).alias("place"))


@query(f"WITH {ORD} SELECT o_orderkey, place, false AS is_pad FROM o UNION ALL SELECT o_orderkey, n + place, true FROM o WHERE place < (64 - n % 64) % 64")
def pad_to_divisor(spark: SparkSession, d: str) -> DataFrame:
    return batch.pad_to_multiple(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 64).select("o_orderkey", F.col("place").cast("bigint").alias("place"), "is_pad")


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def batch_union(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return batch.union_columns(o.select("o_orderkey", "o_custkey", "o_totalprice"), o.select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_orderkey")


@query("""WITH e AS (SELECT unnest([0, 1]) AS epoch), h AS (SELECT s_suppkey, CAST(epoch AS INTEGER) AS epoch, CAST('0x' || substr(sha256('42:' || epoch || ':' || s_suppkey), 1, 12) AS BIGINT) AS h FROM supplier, e), p AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY h, s_suppkey) - 1 AS place FROM h)
SELECT s_suppkey, epoch, place, place // 16 AS batch FROM p""")
def batch_epochs(spark: SparkSession, d: str) -> DataFrame:
    out = batch.epochs(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", 16, 2)
    return out.select("s_suppkey", "epoch", F.col("place").cast("bigint").alias("place"), F.col("batch").cast("bigint").alias("batch"))


@query()
def balanced_partitions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return chunking.part_sums(chunking.balanced(docs, "source", "doc_id", "n_chars", 4), "source", "n_chars")


@query("""WITH s AS (SELECT user_id, list(CAST(event_id % 4 AS INTEGER) ORDER BY event_id) AS ids FROM events GROUP BY 1), m AS (SELECT user_id, ids, list_position(ids, 3) AS e3 FROM s)
SELECT user_id, array_to_string(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN coalesce(e3, 0) = 0 OR i <= e3 THEN 1 ELSE 0 END), '') AS mask, CAST(len(list_filter(ids, lambda x: x <> 0)) AS INTEGER) AS n_kept, array_to_string((ids || [9,9,9,9,9,9,9,9,9,9,9,9,9,9,9,9])[1:16], '') AS padded FROM m""")
def token_masks(spark: SparkSession, d: str) -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list(F.struct("event_id", (F.col("event_id") % 4).cast("int").alias("t")))), lambda x: x["t"])
    s = events(spark, d).groupBy("user_id").agg(ids.alias("ids"))
    text_ = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "")
    return s.select("user_id", text_(tokens.eos_mask(F.col("ids"), 3)).alias("mask"), F.size(tokens.unpad(F.col("ids"))).alias("n_kept"), text_(tokens.pad(F.col("ids"), 16, 9)).alias("padded"))


@query("SELECT vec_id, round(log(2.718281828459045, 1) + ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE)))) - list_sum(list_transform(embedding, lambda x: x::DOUBLE * exp(x::DOUBLE))) / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE))), 6) AS entropy, round(embedding[4]::DOUBLE - ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE)))), 6) AS log_prob FROM embeddings")
def logit_stats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("l", F.transform("embedding", lambda x: x.cast("double")))
    return e.select("vec_id", F.round(vector.entropy(F.col("l")), 6).alias("entropy"), F.round(vector.log_prob(F.col("l"), F.lit(3)), 6).alias("log_prob"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return streams.windowed(events(spark, d), "ts", "1 hour", ["event_type"], "value")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return streams.sessions(events(spark, d), "ts", "30 minutes", "user_id")
