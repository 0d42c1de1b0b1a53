"""Sinks: JSON lines and relevance files in a fixed order and form, collections, digests, metrics, graph tables."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.quality import digest


def sorted_struct(df: DataFrame) -> Column:
    """All columns as a struct in alphabetical order, so that equal rows are equal texts."""
    return F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])


def json_lines(df: DataFrame, path: str, order: Sequence[str], files: int | None = None) -> None:
    """JSON lines with sorted keys, rows in the given order over the files (range-partitioned, so large tables are written by many tasks)."""
    by = [F.col(c) for c in order]
    parts = df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)
    parts.sortWithinPartitions(*by).select(F.to_json(sorted_struct(df), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def qrels(df: DataFrame, path: str) -> None:
    df.select("query_id", "doc_id", F.lit(1).alias("relevance")).repartitionByRange("query_id", "doc_id").sortWithinPartitions("query_id", "doc_id").write.mode("overwrite").csv(path, sep="\t", header=True)


def collection(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """({id, contents}, {chunk_id, doc_id, order}): the text table of an index and its side table."""
    return chunks.select(F.col("chunk_id").alias("id"), F.col("content").alias("contents")), chunks.select("chunk_id", "doc_id", "order")


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n_rows, digest) of tables: what a frozen data set is checked against."""
    out = None
    for name, df in sorted(tables.items()):
        row = digest(df).select(F.lit(name).alias("name"), "n_rows", "digest")
        out = row if out is None else out.unionByName(row)
    return out


def manifest_violations(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """Names whose rows or digest changed, or that only one of two manifests has."""
    a, b = recorded.select("name", F.struct("n_rows", "digest").alias("a")), now.select("name", F.struct("n_rows", "digest").alias("b"))
    return a.join(b, "name", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("name")


def _digest(fs: pafs.FileSystem, path: str) -> str:
    h = hashlib.sha256()
    with fs.open_input_stream(path, compression=None) as f:
        while piece := f.read(1 << 20):
            h.update(piece)
    return h.hexdigest()


def file_digest(path: str) -> str:
    """Digest of a file on any storage that a path or URI can name."""
    return _digest(*pafs.FileSystem.from_uri(str(path)))


def folder_digest(path: str) -> str:
    """Digest of the relative names (with their lengths) and digests of all files of a folder, in name order."""
    h = hashlib.sha256()
    fs, root = pafs.FileSystem.from_uri(str(path))
    root = root.rstrip("/")
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file]
    for p in sorted(files, key=lambda x: x[len(root) + 1 :].split("/")):
        name = p[len(root) + 1 :].encode()
        h.update(len(name).to_bytes(8, "big") + name + bytes.fromhex(_digest(fs, p)))
    return h.hexdigest()


def metrics_rows(df: DataFrame, step: int) -> DataFrame:
    """(step, name, value) rows of a one-row metrics table, to be appended."""
    num = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float")]
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in num])).alias("m")).select(F.lit(step).alias("step"), "m.*")


def graph(vertices: DataFrame, edges: DataFrame, bridge: DataFrame, path: str) -> None:
    for name, df in (("vertices", vertices), ("edges", edges), ("bridge", bridge)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
