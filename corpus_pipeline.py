"""Corpus preparation: toxicity, near-duplicates, benchmark decontamination, source mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns it got; the last adds the
shard. run() writes every stage's result as Parquet into the shared folder and reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontam, mixing, sharding, simhash, toxicity
from corpusloom.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a sentence that the string-kernel machine rejects go.

    Rows without a text, or with an empty one, stay; long texts are read whole; repeated rows are judged alike; a score that equals the threshold isn't over it;
    columns of any name and an empty table pass through."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays, the one with the least id.

    Rows without an id or a word stay; long texts are read whole; rows that repeat an id stay or go together; of equal texts the least id
    is kept; columns of any name and an empty table pass through."""
    return simhash.without_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share 13 consecutive words with a benchmark item go.

    Rows without a text match nothing and stay, as do those without an id, which can't be named; long texts are read whole; rows that repeat an id go if
    one of them is affected; items under 13 words match nothing; columns of any name and an empty table pass through."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh the square root of their size; a document comes as often as it was drawn.

    Rows without a source are a source of their own, those without an id come last in theirs; texts aren't looked at but to order ties;
    repeated rows are drawn one by one; columns of any name pass through; an empty table stays empty."""
    return mixing.mix_sources(docs, copy_col=None)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard of the document's id; copies of one document share a shard.

    A row without an id has no shard (null); a column that is already named shard is replaced, all others pass through; texts aren't looked at; an empty
    table stays empty."""
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing", mix),
    ("sharding", assign_shards),
]

#: A string-kernel machine and SimHash groups have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
