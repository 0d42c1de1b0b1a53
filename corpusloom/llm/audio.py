"""Telephony audio columns: mu-law and A-law by lookup tables, IMA and MS ADPCM by numpy across blocks, resampled 16-bit PCM.

A clip is a row (codec, rate, payload): payloads of 'mulaw' and 'alaw' hold a byte per sample, those of 'ima_adpcm' hold
mono blocks of `block` bytes (a header of predictor and step index, then two samples a byte, low half first), those of 'ms_adpcm'
blocks with a header of coefficient set, step and two samples, then two samples a byte, high half first. The
ADPCM state runs from sample to sample but not from block to block, so the decoder steps through sample positions once and handles the blocks
of all clips of an Arrow batch in each step. Resampling is by a windowed-sinc polyphase filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import small_batches

BLOCK = 256
#: Samples of an IMA block.
SAMPLES = 2 * (BLOCK - 4) + 1
OUT_RATE = 16000
STEP = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
MOVE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def mulaw_table() -> np.ndarray:
    """Sample of each mu-law byte (ITU-T G.711)."""
    u = ~np.arange(256) & 0xFF
    size = (((u & 0x0F) << 3) + 0x84 << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Sample of each A-law byte (ITU-T G.711)."""
    a = np.arange(256) ^ 0x55
    seg, low = (a & 0x70) >> 4, (a & 0x0F) << 4
    size = np.where(seg == 0, low + 8, (low + 0x108) << np.maximum(seg - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def companded(pcm: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Bytes whose samples are nearest to the given ones (the encoder, by the decoder's table)."""
    order = np.argsort(table, kind="stable")
    values = table[order].astype(np.int32)
    at = np.clip(np.searchsorted(values, pcm.astype(np.int32)), 1, 255)
    left = pcm.astype(np.int32) - values[at - 1] <= values[at] - pcm.astype(np.int32)
    return order[at - left].astype(np.uint8)


def _ima_step(pred: np.ndarray, index: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = STEP[index]
    diff = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
    return np.clip(pred + np.where(code & 8, -diff, diff), -32768, 32767), np.clip(index + MOVE[code], 0, 88)


def ima_decode(blocks: np.ndarray) -> np.ndarray:
    """Samples (int16) of mono IMA ADPCM blocks, one row each: 1 + 2 * (block - 4) samples a row."""
    head = blocks[:, :4].astype(np.int32)
    pred = ((head[:, 0] | head[:, 1] << 8) ^ 0x8000) - 0x8000
    index = np.minimum(head[:, 2], 88)
    out = np.empty((len(blocks), 1 + 2 * (blocks.shape[1] - 4)), np.int16)
    out[:, 0] = pred
    for k in range(4, blocks.shape[1]):
        for half in (0, 1):
            pred, index = _ima_step(pred, index, (blocks[:, k] >> (4 * half) & 15).astype(np.int32))
            out[:, 2 * (k - 4) + 1 + half] = pred
    return out


MS_MOVE = np.array([230, 230, 230, 230, 307, 409, 512, 614, 768, 614, 512, 409, 307, 230, 230, 230], np.int64)
#: Steps beyond this occur in damaged blocks only.
MS_MOST = 1 << 21
MS_COEF = np.array([(256, 0), (512, -256), (0, 0), (192, 64), (240, 0), (460, -208), (392, -232)], np.int64)


def ms_decode(blocks: np.ndarray) -> np.ndarray:
    """Samples (int16) of mono MS ADPCM blocks, one row each: 2 + 2 * (block - 7) samples a row. An unknown coefficient set is read as the last."""
    head = blocks[:, :7].astype(np.int64)
    signed = lambda a, b: ((head[:, a] | head[:, b] << 8) ^ 0x8000) - 0x8000
    c1, c2 = MS_COEF[np.minimum(head[:, 0], 6)].T
    delta, new, old = signed(1, 2), signed(3, 4), signed(5, 6)
    out = np.empty((len(blocks), 2 + 2 * (blocks.shape[1] - 7)), np.int16)
    out[:, 0], out[:, 1] = old, new
    for k in range(7, blocks.shape[1]):
        for half in (1, 0):
            code = blocks[:, k].astype(np.int64) >> (4 * half) & 15
            guess = (new * c1 + old * c2) >> 8
            old, new = new, np.clip(guess + ((code ^ 8) - 8) * delta, -32768, 32767)
            delta = np.clip(MS_MOVE[code] * delta >> 8, 16, MS_MOST)
            out[:, 2 * (k - 7) + 3 - half] = new
    return out


#: Decoder and bytes of the header of each codec that comes in blocks.
BLOCKED = {"ima_adpcm": (ima_decode, 4), "ms_adpcm": (ms_decode, 7)}


def ima_encode(pcm: np.ndarray) -> np.ndarray:
    """Blocks of rows of samples, an odd number each; every block starts anew."""
    x = pcm.astype(np.int32)
    n, m = x.shape
    out = np.zeros((n, 4 + (m - 1) // 2), np.uint8)
    pred, index = x[:, 0].copy(), np.zeros(n, np.int32)
    out[:, 0], out[:, 1] = pred & 0xFF, pred >> 8 & 0xFF
    for k in range(1, m):
        step, diff = STEP[index], x[:, k] - pred
        code = np.where(diff < 0, 8, 0)
        size = np.abs(diff)
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            on = size >= part
            code, size = code | np.where(on, bit, 0), size - np.where(on, part, 0)
        pred, index = _ima_step(pred, index, code.astype(np.int32))
        out[:, 4 + (k - 1) // 2] |= (code << (4 * ((k - 1) % 2))).astype(np.uint8)
    return out


def sinc_filter(up: int, down: int, taps: int = 16) -> np.ndarray:
    """Low-pass filter of a polyphase resampler (Kaiser window), gain `up`."""
    cut = 1.0 / max(up, down)
    half = taps * max(up, down)
    n = np.arange(-half, half + 1)
    h = cut * np.sinc(cut * n) * np.kaiser(len(n), 8.0)
    return h * (up / h.sum())


def resample(x: np.ndarray, rate: int, out_rate: int) -> np.ndarray:
    """Rows of samples of one length at another rate; len * out_rate / rate samples, rounded up."""
    g = gcd(rate, out_rate)
    up, down = out_rate // g, rate // g
    if up == down or x.shape[1] == 0:
        return x.astype(np.int16)
    h = sinc_filter(up, down)
    half, n = len(h) // 2, -(-x.shape[1] * up // down)
    out = np.empty((len(x), n))
    pad = half // up + 1
    wide = np.pad(x.astype(np.float64), ((0, 0), (pad, pad + 1)))
    stride = down // gcd(up, down)
    for phase in range(up):  # outputs whose place between input samples is the same share their coefficients
        m = np.arange(n)[(np.arange(n) * down) % up == phase]
        if not len(m):
            continue
        c = h[(phase + half) % up :: up]  # taps at distance phase + k * up from the centre
        first = m[0] * down // up + (phase + half) // up + pad  # newest input sample that the filter reaches, and from there on every `stride`-th
        acc = np.zeros((len(x), len(m)))
        for k, coef in enumerate(c):
            at = first - k
            skip = max(0, -(-(-at) // stride)) if at < 0 else 0
            part = wide[:, at + skip * stride :: stride][:, : len(m) - skip]
            acc[:, skip : skip + part.shape[1]] += coef * part
        out[:, m] = acc
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def decode_clips(codecs: list[str | None], rates: list[int | None], payloads: list[bytes | None], block: int, out_rate: int) -> list[np.ndarray | None]:
    """PCM of each clip, None for one that can't be decoded."""
    out: list[np.ndarray | None] = [None] * len(codecs)
    pcm: dict[int, np.ndarray] = {}
    found: dict[tuple[str, int], list[tuple[int, np.ndarray]]] = {}
    order: dict[int, list[np.ndarray]] = {}
    for i, (c, r, p) in enumerate(zip(codecs, rates, payloads, strict=True)):
        if p is None or r is None or r <= 0:
            continue
        if c in ("mulaw", "alaw"):
            pcm[i] = (MULAW if c == "mulaw" else ALAW)[np.frombuffer(p, np.uint8)]
        elif c in BLOCKED:
            order[i] = []
            if n := len(p) // block:
                found.setdefault((c, block), []).append((i, np.frombuffer(p, np.uint8, n * block).reshape(n, block)))
            if len(p) % block >= BLOCKED[c][1]:  # a short last block
                found.setdefault((c, len(p) % block), []).append((i, np.frombuffer(p, np.uint8, offset=n * block)[None, :]))
    for (c, size), parts in sorted(found.items(), key=lambda x: -x[0][1]):  # whole blocks before short ones; all clips' blocks of one size at once
        rows = BLOCKED[c][0](np.concatenate([b for _, b in parts]))
        at = 0
        for i, b in parts:
            order[i].append(rows[at : at + len(b)].reshape(-1))
            at += len(b)
    for i, parts in order.items():
        pcm[i] = np.concatenate([np.zeros(0, np.int16), *parts])
    same: dict[tuple[int, int], list[int]] = {}
    for i, x in pcm.items():
        same.setdefault((rates[i], len(x)), []).append(i)
    for (rate, _), ids in same.items():
        for i, y in zip(ids, resample(np.stack([pcm[i] for i in ids]), rate, out_rate), strict=True):
            out[i] = y
    return out


def decode(clips: DataFrame, block: int = BLOCK, out_rate: int = OUT_RATE) -> DataFrame:
    """Each row of clips (columns codec, rate, payload and others) with payload replaced by sample_rate, n_samples and
    pcm (16-bit little-endian, mono).

    A null codec, rate or payload, an unknown codec or a rate that isn't positive gives a null pcm and n_samples; an
    empty payload an empty pcm and 0; ADPCM bytes after the last whole block are a shorter block, shorter than a block's header they are
    dropped. Long clips are decoded whole. Repeated rows are each decoded; columns named as the results are replaced; an empty table stays empty."""
    small_batches(clips.sparkSession)
    kept = [c for c in clips.columns if c not in ("payload", "sample_rate", "n_samples", "pcm")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                codec, rate, payload = (part.column(part.num_columns - 3 + j).to_pylist() for j in range(3))
                pcm = decode_clips(codec, rate, payload, block, out_rate)
                yield pa.RecordBatch.from_arrays([*part.columns[:-3], pa.array([out_rate] * len(pcm), pa.int32()), pa.array([None if x is None else len(x) for x in pcm], pa.int64()), pa.array([None if x is None else x.astype("<i2").tobytes() for x in pcm], pa.binary())], [*kept, "sample_rate", "n_samples", "pcm"])

    schema = ", ".join(f"`{c}` {clips.schema[c].dataType.simpleString()}" for c in kept)
    return clips.select(*[F.col(f"`{c}`") for c in kept], F.col("codec").alias("__loom_c"), F.col("rate").cast("int").alias("__loom_r"), F.col("payload").cast("binary").alias("__loom_p")).mapInArrow(run, f"{schema}, sample_rate int, n_samples bigint, pcm binary")


def vector_clips(vectors: DataFrame, blocks: int = 1) -> DataFrame:
    """Clips (vec_id, codec, rate, payload) made from embeddings, as the test tables hold no audio: a vector's values,
    scaled and drawn out, are the wave; the id picks the codec and the length: one ADPCM block, or up to `blocks` of which the last is short."""
    tail = SAMPLES if blocks == 1 else SAMPLES // 3 | 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            codecs, payloads = [], []
            for i, v in zip(ids.to_pylist(), batch.column(1).to_pylist(), strict=True):
                kind, whole = ("mulaw", "alaw", "ima_adpcm")[(i or 0) % 3], (i or 0) // 3 % blocks
                codecs.append(kind)
                if not v:
                    payloads.append(None if v is None else b"")
                    continue
                x = np.nan_to_num(np.array(v, np.float64))
                wave = np.interp(np.linspace(0, len(x) - 1, whole * SAMPLES + tail), np.arange(len(x)), x)
                payloads.append(np.clip(wave * 32000 / max(1e-9, np.abs(wave).max()), -32768, 32767).astype(np.int16))
            same: dict[int, list[int]] = {}
            for k, c in enumerate(codecs):
                if isinstance(payloads[k], np.ndarray):
                    same.setdefault(len(payloads[k]) if c == "ima_adpcm" else 0, []).append(k)
            for k in same.pop(0, ()):
                payloads[k] = companded(payloads[k], MULAW if codecs[k] == "mulaw" else ALAW).tobytes()
            for n, ks in same.items():
                rows = np.stack([payloads[k] for k in ks])
                full, last = ima_encode(rows[:, : n - tail].reshape(-1, SAMPLES)) if n > tail else np.zeros((0, BLOCK), np.uint8), ima_encode(rows[:, n - tail :])
                for k, a, b in zip(ks, full.reshape(len(ks), -1), last, strict=True):
                    payloads[k] = a.tobytes() + b.tobytes()
            yield pa.RecordBatch.from_arrays([ids, pa.array(codecs), pa.array([8000] * len(codecs), pa.int32()), pa.array(payloads, pa.binary())], ["vec_id", "codec", "rate", "payload"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, codec string, rate int, payload binary")
