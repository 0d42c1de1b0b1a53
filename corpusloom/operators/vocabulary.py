"""Vocabularies as tables (term, n): lines of vocabulary files, frequent terms, and what one vocabulary adds to another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text


def from_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(term): the first blank-separated field of each line that has one, each once."""
    return lines.select(F.get(F.split(F.trim(column), r"\s+"), F.lit(0)).alias("term")).filter("term <> ''").distinct()


def most_frequent(terms: DataFrame, n: int) -> DataFrame:
    """The n most frequent of (term, n), ties by the term."""
    return terms.orderBy(F.desc("n"), F.asc("term")).limit(n)


def merged(base: DataFrame, added: DataFrame, whole_chinese: bool = False) -> DataFrame:
    """(term, is_new) of both; a term of the base stays its own. whole_chinese: of the added only terms all of whose characters are Chinese."""
    extra = added.filter(text.is_chinese("term", True)) if whole_chinese else added
    new = extra.select("term").distinct().join(base.select("term"), "term", "left_anti")
    return base.select("term").distinct().withColumn("is_new", F.lit(False)).unionByName(new.withColumn("is_new", F.lit(True)))
