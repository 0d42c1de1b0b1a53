"""Comparison of Spark and DuckDB rows."""

from __future__ import annotations

DATA = "/root/testdata"


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def same_rows(df, rel) -> None:
    """Spark and DuckDB rows are equal, in any order."""
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    at = [rel.columns.index(c) for c in cols]
    b = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert a == b
