from __future__ import annotations

import gzip
import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import audio, warc


def mulaw_sample(byte):
    u = ~byte & 0xFF
    t = ((u & 0x0F) << 3) + 0x84
    t <<= (u & 0x70) >> 4
    return 0x84 - t if u & 0x80 else t - 0x84


def alaw_sample(byte):
    a = byte ^ 0x55
    t, seg = (a & 0x0F) << 4, (a & 0x70) >> 4
    t = t + 8 if seg == 0 else t + 0x108 if seg == 1 else (t + 0x108) << (seg - 1)
    return t if a & 0x80 else -t


def test_tables_equal_the_standard():
    assert audio.MULAW.tolist() == [mulaw_sample(b) for b in range(256)]
    assert audio.ALAW.tolist() == [alaw_sample(b) for b in range(256)]
    assert (audio.MULAW[0xFF], audio.MULAW[0x80], audio.MULAW[0x00], audio.ALAW[0xD5], audio.ALAW[0x2A]) == (0, 32124, -32124, 8, -32256)


@pytest.mark.parametrize("table", [audio.MULAW, audio.ALAW])
def test_companding_round_trip(table):
    assert (table[audio.companded(table, table)] == table).all()
    x = np.arange(-32000, 32000, 37)
    best = np.abs(table[None, :].astype(int) - x[:, None]).min(1)
    assert (np.abs(table[audio.companded(x, table)].astype(int) - x) == best).all()


def ima_slow(block):
    """One sample after the other, as the format is written down."""
    pred = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [pred]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEP[index])
            diff = step >> 3
            diff += step >> 2 if code & 1 else 0
            diff += step >> 1 if code & 2 else 0
            diff += step if code & 4 else 0
            pred = max(-32768, min(32767, pred - diff if code & 8 else pred + diff))
            index = max(0, min(88, index + int(audio.MOVE[code])))
            out.append(pred)
    return out


def test_adpcm_across_blocks_equals_sample_by_sample():
    blocks = np.random.default_rng(0).integers(0, 256, (20, 64), dtype=np.uint8)
    assert audio.ima_decode(blocks).tolist() == [ima_slow(bytes(b)) for b in blocks]
    t = np.arange(505)
    x = np.stack([8000 * np.sin(t * f / 8000 * 2 * np.pi) for f in (200, 440, 900)]).astype(np.int16)
    y = audio.ima_decode(audio.ima_encode(x))
    assert np.abs(x[:, 100:].astype(int) - y[:, 100:]).max() < 1500


@pytest.mark.parametrize("rates", [(8000, 16000), (8000, 44100), (16000, 8000), (11025, 16000), (8000, 8000)])
def test_resampled_tone(rates):
    a, b = rates
    n = 2000
    x = (10000 * np.sin(2 * np.pi * 300 * np.arange(n) / a)).astype(np.int16)
    y = audio.resample(x[None, :], a, b)[0]
    assert len(y) == -(-n * b // a)
    want = 10000 * np.sin(2 * np.pi * 300 * np.arange(len(y)) / b)
    assert np.abs(y - want)[200:-200].max() < 30


def test_audio_edge_cases(spark):
    block = audio.ima_encode(np.zeros((1, 505), np.int16)).tobytes()
    rows = [(1, "mulaw", 8000, b"\xff" * 10, "a"), (1, "mulaw", 8000, b"\xff" * 10, "a"), (2, "alaw", 8000, b"", "a"), (3, None, 8000, b"a", "a"), (4, "mulaw", None, b"a", "a"), (5, "opus", 8000, b"a", "a"), (6, "ima_adpcm", 8000, block + block[:20] + b"", "a"), (7, "mulaw", 0, b"a", "a"), (8, "mulaw", 8000, None, None), (9, "ima_adpcm", 16000, block + b"abc", "a"), (None, "alaw", 16000, b"\xd5" * 70_000, "a")]
    clips = spark.createDataFrame(rows, "vec_id bigint, codec string, rate int, payload binary, pcm string")
    got = [(r.vec_id, r.n_samples, None if r.pcm is None else len(r.pcm)) for r in audio.decode(clips).collect()]
    assert sorted(got, key=str) == sorted([(1, 20, 40), (1, 20, 40), (2, 0, 0), (3, None, None), (4, None, None), (5, None, None), (6, 2 * (505 + 33), 4 * (505 + 33)), (7, None, None), (8, None, None), (9, 505, 1010), (None, 70_000, 140_000)], key=str)
    assert audio.decode(clips.limit(0)).count() == 0
    v = spark.createDataFrame([(0, [0.5, -0.5]), (1, []), (2, None), (None, [1.0, float("nan")])], "vec_id bigint, embedding array<float>")
    assert sorted((r.n_samples for r in audio.decode(audio.vector_clips(v)).collect()), key=str) == [0, 1010, 1010, None]


def build(pages):
    return b"".join(warc.record_bytes("response", f"r{i}", f"http://x/{i}", p) for i, p in enumerate(pages))


def read_back(whole, index):
    return [gzip.decompress(whole[o : o + n]) for o, n in index]


PAGES = [b"", b"\r\n\r\nWARC/1.0\r\n", b"x" * 1_000_000, "ü\n".encode() * 50, b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"]


@pytest.mark.parametrize("pack", [lambda b: gzip.compress(b), lambda b: b, lambda b: gzip.compress(b[:100]) + gzip.compress(b[100:]), lambda b: b.replace(b"\r\n\r\nWARC", b"\r\n\r\nWARC")])
@pytest.mark.parametrize("piece", [1, 7, 1 << 18])
def test_stream_round_trip(pack, piece, monkeypatch):
    pages = [p if len(p) < 10_000 else p[:3000] for p in PAGES] if piece < 100 else PAGES
    raw = build(pages)
    monkeypatch.setattr(warc, "PIECE", piece)
    out = io.BytesIO()
    rows = list(warc.normalise_stream(io.BytesIO(pack(raw)), out))
    assert gzip.decompress(out.getvalue()) == raw
    assert read_back(out.getvalue(), [(r[2], r[3]) for r in rows]) == [build([p]).replace(b"<urn:uuid:r0>", f"<urn:uuid:r{i}>".encode()).replace(b"http://x/0", f"http://x/{i}".encode()) for i, p in enumerate(pages)]


def test_normaliser_edge_cases(spark):
    raw = build(PAGES)
    files = [("a", gzip.compress(raw), 1), ("a", gzip.compress(raw), 1), ("b", None, 1), ("c", b"", 1), ("d", gzip.compress(raw)[:-400], 1), ("e", b"nonsense without an end", 1), (None, gzip.compress(build([b"1"])), 1), ("f", gzip.compress(build([b"1"])[:-2]), 1), ("g", gzip.compress(raw[:-1000]), 1)]
    got = warc.normalise(spark.createDataFrame(files, "file string, content binary, member int")).collect()
    n = lambda f, ok=True: len([r for r in got if r.file == f and (r.error is None) == ok])
    assert (n("a"), n("b"), n("c"), n(None), n("f")) == (10, 0, 0, 1, 1)
    assert n("d", False) == 1 and n("d") >= 2 and n("e", False) == 1 and n("g", False) == 1
    one = sorted({(r.offset, r.member) for r in got if r.file == "a"})
    assert gzip.decompress(b"".join(m for _, m in one)) == raw
    assert [o for o, _ in one] == np.cumsum([0] + [len(m) for _, m in one[:-1]]).tolist()
    assert warc.normalise(spark.createDataFrame([], "file string, content binary")).count() == 0


def test_archive_of_pages(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>") for i in range(20)] + [(None, None, None), (3, "http://x/3", "<p>3</p>")], "page_id bigint, url string, html string")
    rows = warc.normalise(warc.monolithic(pages, 8)).filter(F.col("type") == "response").collect()
    assert len(rows) == 22 and all(r.error is None for r in rows)
    assert sum(gzip.decompress(r.member).endswith(b"<p>3</p>\r\n\r\n") for r in rows) == 2


def test_files_are_rewritten_and_read_by_their_index(spark, tmp_path):
    """Through Spark: files of one stream, larger than a piece and with many records, become files that are read at any record."""
    rng = np.random.default_rng(3)
    pages = [bytes(rng.integers(32, 127, int(n), dtype=np.uint8)) for n in rng.integers(0, 3000, 900)] + [b"z" * 2_000_000]
    raw = build(pages)
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    cases = {"whole.warc.gz": gzip.compress(raw), "plain.warc": raw, "cut.warc.gz": gzip.compress(raw)[:-500], "empty.warc.gz": b"", "bad.warc": b"WARC/1.0\r\nContent-Length: \xc2\xb2\r\n\r\nab\r\n\r\n", "noise.warc": b"WARC/1.0 " * 300_000}
    for name, content in cases.items():
        (tmp_path / "in" / name).write_bytes(content)
    paths = spark.createDataFrame([(str(tmp_path / "in" / n), "x") for n in [*cases, "missing.warc"]] + [(None, "x"), (str(tmp_path / "in" / "whole.warc.gz"), "x")], "path string, record string")
    assert len(cases["whole.warc.gz"]) > 4 * warc.PIECE
    index = warc.normalise_files(paths, str(tmp_path / "out")).persist()
    rows = index.collect()
    count = lambda f, ok=True: sum(r.file == f and (r.error is None) == ok for r in rows)
    assert (count("whole.warc.gz"), count("plain.warc"), count("empty.warc.gz")) == (2 * len(pages), len(pages), 0)
    assert count("cut.warc.gz") >= 800 and [count(f, False) for f in ("cut.warc.gz", "bad.warc", "noise.warc", "missing.warc")] == [1, 1, 1, 1]
    for name in ("whole.warc.gz", "plain.warc"):
        one = index.filter((F.col("file") == name) & (F.col("record") % 7 == 0)).distinct()
        got = {r.record: r.content for r in warc.fetch(one).collect()}
        starts = np.cumsum([0] + [len(warc.record_bytes("response", f"r{i}", f"http://x/{i}", p)) for i, p in enumerate(pages)])
        assert got == {i: raw[starts[i] : starts[i + 1]] for i in range(0, len(pages), 7)}
        whole = next(p for p in (tmp_path / "out").iterdir() if p.name.endswith(name))
        assert gzip.decompress(whole.read_bytes()) == raw
        lines = [json.loads(x) for x in (tmp_path / "out" / f"{whole.name}.index.jsonl").read_text().splitlines()]
        assert sorted((x["record"], x["offset"], x["length"]) for x in lines) == sorted({(r.record, r.offset, r.length) for r in rows if r.file == name})
    assert not [p for p in (tmp_path / "out").iterdir() if not p.name.endswith((".gz", ".warc", ".jsonl"))]


def test_query_of_archives_equals_the_pages(spark):
    from checks import DATA

    from corpusloom.llm import queries

    sf = f"{DATA}/sf0.001"
    index = queries.op10_warc_normalise(spark, sf).persist()
    assert index.filter("error is not null").count() == 0
    got = {r.content for r in warc.fetch(index.filter("type = 'response'")).collect()}
    assert got == {warc.record_bytes("response", f"page-{r.page_id}", r.url, r.html.encode()) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}


def ms_slow(block):
    c1, c2 = [(256, 0), (512, -256), (0, 0), (192, 64), (240, 0), (460, -208), (392, -232)][min(block[0], 6)]
    delta, new, old = (int.from_bytes(block[i : i + 2], "little", signed=True) for i in (1, 3, 5))
    out = [old, new]
    for byte in block[7:]:
        for code in (byte >> 4, byte & 15):
            guess = (new * c1 + old * c2) >> 8
            old, new = new, max(-32768, min(32767, guess + (code - 16 if code > 7 else code) * delta))
            delta = min(audio.MS_MOST, max(16, int(audio.MS_MOVE[code]) * delta >> 8))
            out.append(new)
    return out


def test_ms_adpcm_across_blocks_equals_sample_by_sample():
    blocks = np.random.default_rng(1).integers(0, 256, (20, 64), dtype=np.uint8)
    assert audio.ms_decode(blocks).tolist() == [ms_slow(bytes(b)) for b in blocks]


def test_clips_of_many_blocks_equal_brute_force(spark):
    """The query's clips, each decoded sample by sample and resampled by the sum over all taps."""
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(60)
    clips = audio.vector_clips(vectors, 4)
    taps = audio.sinc_filter(2, 1)
    half = len(taps) // 2
    want = {}
    for r in clips.collect():
        if r.codec == "ima_adpcm":
            pcm = [x for k in range(0, len(r.payload), audio.BLOCK) for x in ima_slow(r.payload[k : k + audio.BLOCK])]
        else:
            pcm = [(mulaw_sample if r.codec == "mulaw" else alaw_sample)(b) for b in r.payload]
        wide = np.zeros(2 * len(pcm))
        wide[::2] = pcm
        want[r.vec_id] = np.clip(np.rint(np.convolve(wide, taps)[half : half + 2 * len(pcm)]), -32768, 32767).astype(int)
    assert max(map(len, want.values())) > 3 * 2 * audio.SAMPLES
    got = {r.vec_id: np.frombuffer(r.pcm, "<i2").astype(int) for r in audio.decode(clips).collect()}
    assert got.keys() == want.keys() and all(len(got[k]) == len(want[k]) and np.abs(got[k] - want[k]).max() <= 1 for k in want)
