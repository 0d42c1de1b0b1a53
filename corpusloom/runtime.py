"""Session helpers: tables, and where intermediate results are kept."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, for a local master only (tests), a folder of our own where none is set."""
    jsc = spark.sparkContext._jsc.sc()
    if (d := spark.conf.get("spark.checkpoint.dir", None)) is None:
        if jsc.getCheckpointDir().isDefined():
            d = jsc.getCheckpointDir().get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            d = tempfile.mkdtemp(prefix="loom-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut(df: DataFrame) -> DataFrame:
    """Materialise into the shared folder and forget the lineage; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like cut, but as a compressed Parquet table in the shared folder, for wide rows."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Let Arrow batches hold at most `size` bytes (or one row): by default they are counted in rows, and thousands of
    long texts don't fit a Python worker. A session that sets the limit itself is left alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(size))


def spread(df: DataFrame) -> DataFrame:
    """A scan of few, small files over all cores; a scan with at least as many splits as cores, and any plan with an
    exchange, is left as it is."""
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():
        return df
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if plan.toRdd().getNumPartitions() < n else df


def bucket_of(df: DataFrame, key: str, rows: int = 100_000) -> Column:
    """A whole number that never falls as the key rises, with about so many rows each if keys are spread evenly (dense ids, or hashed ones of
    64 bits): for numbering in two levels. Runs a job for the key's bounds."""
    low, high, n = df.agg(F.min(key).cast("double"), F.max(key).cast("double"), F.count(key)).first()
    width = max(1.0, ((high or 0.0) - (low or 0.0)) / max(1, n // rows))
    return F.floor((F.col(key).cast("double") - F.lit(low or 0.0)) / F.lit(width))
