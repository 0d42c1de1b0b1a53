"""URL filtering by association rules.

URLs are baskets of tokens (host labels, path segments, query parts, fragment). Of a bounded sample of labelled URLs
Spark's FP-growth mines the token combinations that are frequent among the bad ones, and these are counted over all of the sample; a combination
whose URLs are bad with at least MIN_CONFIDENCE and MIN_SUPPORT is a rule, unless a part of it is one that is as sure. Tokens that are in the same URLs
of the sample are mined as one (a rule with two of them is never needed beside that with one), so a template of many parts doesn't
make 2^parts sets. Rules match URLs by an inverted index: a rule is under the one of its tokens that the fewest rules have, and holds where the URL has
all of them.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut

#: Labelled URLs for mining; the bound of the sample.
MAX_LABELLED = 200_000
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.0005, 20, 0.6
#: Rules up to which the index is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL; empty for null. Numbers in paths and queries are one token."""
    u = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(u, r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1)
    rest = F.regexp_replace(u, r"^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*", "")
    path, query, frag = (F.regexp_extract(rest, p, 1) for p in (r"^([^?#]*)", r"^[^?#]*\?([^#]*)", r"#(.*)$"))
    part = lambda c, by, p: F.transform(F.filter(F.split(c, by), lambda x: x != ""), lambda x: F.concat(F.lit(p), F.regexp_replace(x, r"\d+", "0")))
    return F.array_distinct(F.concat(F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x)), part(path, r"[/.]", "p:"), part(query, r"[&;]", "q:"), part(frag, r"\W", "f:")))


def mine(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, limit: int = MAX_LABELLED) -> DataFrame:
    """Rules (rule_id, items, support, confidence): token combinations whose labelled URLs are bad (of low quality or
    toxic). Labels belong to the page with their doc_id; several labels of a page count as bad if one is. Pages without a URL or label
    take no part, repeated rows are each counted, long URLs are read whole, empty tables have no rules; ties are kept, all of them."""
    bad = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    known = pages.filter("url is not null").select("page_id", "url").join(bad, F.col("page_id") == F.col("doc_id"))
    sample = known.orderBy(F.xxhash64("page_id", F.lit(3)), "page_id", "url").limit(limit)
    cores = pages.sparkSession.sparkContext.defaultParallelism
    # limit leaves one partition; baskets are numbered before they are spread
    spread = sample.select(F.monotonically_increasing_id().alias("basket"), "bad", "url").repartition(cores, "basket")
    baskets = cut(spread.select("basket", "bad", tokens(F.col("url")).alias("items")).filter("size(items) > 0"))
    n, n_bad = baskets.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    least = max(min_count, math.ceil(min_support * n))
    if n_bad < least:
        return pages.sparkSession.createDataFrame([], "rule_id bigint, items array<string>, support bigint, confidence double")
    # tokens in the same baskets: equal count and equal sums of two hashes of the baskets (128 bits); the first in order stands for all
    mark = lambda seed: F.sum(F.xxhash64("basket", F.lit(seed)).cast("decimal(38,0)"))
    per = baskets.select("basket", "bad", F.explode("items").alias("token")).groupBy("token").agg(F.sum("bad").alias("bad"), F.struct(F.count("*").alias("n"), mark(1), mark(2)).alias("same"))
    frequent = per.filter(F.col("bad") >= least)
    alike = cut(frequent.groupBy("same").agg(F.min("token").alias("first"), F.sort_array(F.collect_list("token")).alias("tokens")).select("first", "tokens"))
    rows = baskets.select("basket", "bad", F.explode("items").alias("first")).join(alike.select("first"), "first")
    short = cut(rows.groupBy("basket", "bad").agg(F.collect_list("first").alias("items")))
    n_mined = short.filter("bad = 1").count()
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, least / max(1, n_mined) * (1 - 1e-9)), minConfidence=1.0, numPartitions=cores).fit(short.filter("bad = 1").repartition(cores)).freqItemsets
    sets = cut(sets.select(F.sort_array("items").alias("items"), F.col("freq").alias("support")).filter(F.col("support") >= least).withColumn("set_id", F.monotonically_increasing_id()))
    # how often each set is in any basket: looked for where its rarest token is
    rarest = sets.select("set_id", "items", F.explode("items").alias("first")).join(per.select(F.col("token").alias("first"), F.col("same.n").alias("n")), "first").groupBy("set_id", "items").agg(F.min_by("first", F.struct("n", "first")).alias("token"))
    held = short.select("items", F.explode("items").alias("token")).withColumnRenamed("items", "all").join(rarest, "token").filter("size(array_except(items, all)) = 0")
    freq = held.groupBy("set_id").agg(F.count("*").alias("freq"))
    sure = sets.join(freq, "set_id").select("items", "support", (F.col("support") / F.col("freq")).alias("confidence")).filter(F.col("confidence") >= min_confidence)
    # every token of a group can stand for it
    for_all = sure.select(F.monotonically_increasing_id().alias("rule"), "*").select("rule", "support", "confidence", F.posexplode("items").alias("place", "first")).join(alike, "first")
    chosen = for_all.groupBy("rule", "support", "confidence").agg(F.collect_list("tokens").alias("choices"))
    many = F.aggregate("choices", F.array(F.array().cast("array<string>")), lambda acc, c: F.flatten(F.transform(acc, lambda x: F.transform(c, lambda t: F.concat(x, F.array(t))))))
    rules = chosen.select(F.explode(many).alias("items"), "support", "confidence").withColumn("items", F.sort_array("items"))
    rules = cut(rules.withColumn("rule_id", F.xxhash64("items")))
    # a rule goes if a smaller one of its tokens is as sure; found by the inverted index, as a match is
    index = rules.select(F.explode("items").alias("token"), F.col("rule_id").alias("small"), F.size("items").alias("n"), F.col("confidence").alias("c"))
    over = rules.select(F.explode("items").alias("token"), "rule_id", F.size("items").alias("size"), "confidence").join(index, "token").filter("n < size and c >= confidence").groupBy("rule_id", "small", "n").count().filter("count = n").select("rule_id").distinct()
    return cut(rules.join(over, "rule_id", "left_anti").select("rule_id", "items", "support", "confidence"))


def match(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (page_id, url, blocked, rule, confidence) for every page: the surest rule that holds (of equally sure ones the
    first in alphabetical order), null where none does.

    A null or empty URL is never blocked; repeated rows and pages of one URL are each judged; further columns are
    ignored; an empty table, or no rules, blocks nothing."""
    each = rules.select("rule_id", "items", "confidence", F.explode("items").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("n"))
    # a rule is under the one of its tokens that the fewest rules have
    index = each.join(often, "token").groupBy("rule_id", "items", "confidence").agg(F.min_by("token", F.struct("n", "token")).alias("token")).withColumn("rule", F.array_join("items", " "))
    if rules.count() <= BROADCAST_ROWS:
        index = F.broadcast(index)
    urls = pages.select("url").filter("url is not null").distinct().withColumn("all", tokens(F.col("url")))
    hits = urls.select("url", "all", F.explode("all").alias("token")).join(index, "token").filter("size(array_except(items, all)) = 0")
    best = hits.groupBy("url").agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.col("rule").alias("rule"))).alias("b"))
    return pages.select("page_id", "url").join(best, "url", "left").select("page_id", "url", F.col("b").isNotNull().alias("blocked"), F.col("b.rule").alias("rule"), F.round(-F.col("b.c"), 6).alias("confidence"))


def filter_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """match() with the rules that mine() finds in the pages' labels, with production parameters."""
    return match(pages, mine(pages, labels))
