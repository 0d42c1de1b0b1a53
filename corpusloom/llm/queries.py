"""The queries of this subpackage, each an operator with its production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import audio, decontam, dom, mixing, sharding, simhash, suffix_dedup, toxicity, urlrules, warc
from corpusloom.llm.common import cut, new_folder, table


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.extract(table(spark, sf_dir, "pages"))


def op6_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.decode(audio.vector_clips(table(spark, sf_dir, "embeddings"), 4))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages are written to the shared folder as whole-file gzip; their paths are the normaliser's input."""
    old, new = (new_folder(spark, name) for name in ("archives", "normalised"))
    return warc.normalise_files(cut(warc.stored(warc.monolithic(table(spark, sf_dir, "pages")), old)), new)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jump_sharding": op1_jump_sharding,
    "op2_decontaminate": op2_decontaminate,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_simhash": op4_simhash,
    "op5_html_extract": op5_html_extract,
    "op6_telephony_audio": op6_telephony_audio,
    "op7_mix_sources": op7_mix_sources,
    "op8_url_rules": op8_url_rules,
    "op9_toxicity": op9_toxicity,
    "op10_warc_normalise": op10_warc_normalise,
}

ORACLES = {
    "op1_jump_sharding": sharding.oracle(),
    "op2_decontaminate": decontam.oracle(),
    "op3_suffix_dedup": suffix_dedup.oracle(),
    "op7_mix_sources": mixing.oracle(),
}
