"""Words of texts as hashes, vectorised over Arrow buffers.

Words are what is left of a text after lower-casing and replacing every run of characters that are neither letters
nor digits by one blank. The JVM does that (``norm``); Python then only sees Arrow buffers, which numpy hashes without
creating one Python object per word.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 1 << 19  # bytes of text that are hashed at once


def process_cache(name: str) -> dict:
    """A dictionary that lives as long as the worker process (functions are shipped by value, so module globals don't)."""
    store = sys.__dict__.setdefault("_corpusloom", {})
    return store.setdefault(name, {})


def norm(text: str | Column) -> Column:
    """Words of a text, lower-cased and separated by one blank; null counts as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cache = process_cache("powers")
    if cache.get("n", 0) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        p = 0x9E3779B97F4A7C15
        inv = pow(p, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up, down = np.full(size, p, np.uint64), np.full(size, inv, np.uint64)
            up[0] = down[0] = 1
            cache.update(n=size, up=np.cumprod(up, dtype=np.uint64), down=np.cumprod(down, dtype=np.uint64), byte=mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return cache["up"], cache["down"], cache["byte"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes of a string array without copying the bytes."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def hashed_words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For chunks of rows of normalised texts: first row, row behind the last, hash of every word, and for each row
    where its words begin (one more entry than rows). A text is never split, however long."""
    offsets, data = buffers(texts)
    row, n = 0, len(texts)
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        stop = min(stop, n)
        base, off = offsets[row], offsets[row : stop + 1] - offsets[row]
        b = data[base : offsets[stop]]
        full = off[1:] > off[:-1]
        blanks = np.flatnonzero(b == 32)
        starts = np.sort(np.concatenate([blanks + 1, off[:-1][full]]))
        ends = np.sort(np.concatenate([blanks, off[1:][full]]))
        up, down, byte = _powers(len(b) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(byte[b] * up[: len(b)], out=total[1:])
            h = mix((total[ends] - total[starts]) * down[starts])
        yield row, stop, h, np.searchsorted(starts, off)
        row = stop


def hash_list(words: list[str]) -> np.ndarray:
    """Hashes of already normalised single words, equal to those of hashed_words."""
    out = [h for *_, h, _ in hashed_words(pa.array(words, pa.string()))]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def pair_rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of the concatenation of two named strings."""
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F))


def run_names(words: np.ndarray, width: int) -> np.ndarray:
    """Name of the `width` words from each position on; the last width - 1 positions have none."""
    r, w = words, 1
    while w < width:
        step = min(w, width - w)
        r = pair_rank(r[: len(r) - step], r[step:]) if len(r) > step else r[:0]
        w += step
    return r
