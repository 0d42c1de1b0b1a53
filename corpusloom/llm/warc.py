"""Monolithic gzip WARC files normalised: one gzip member per record and a sidecar offset index.

A file that was compressed as one stream can't be read at a record. The normaliser inflates the stream once, in pieces,
cuts it at record boundaries (header block, blank line, Content-Length bytes, two line ends), compresses every record as a gzip member of its own
and notes offset and length of each member. normalise_files() reads files by their paths and writes the new file and its index beside each other, in an executor each and to any
storage that a path can name, so its memory is bounded by the largest record (or, where a record states more bytes than the file has, by the
rest of the file). normalise() is the same for files that are cells of a table.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import small_batches

PIECE = 1 << 18
#: A header block without an end within so many bytes is damage.
MAX_HEADER = 1 << 20
#: Pages per file of the test archive.
PAGES_PER_FILE = 256
#: Tasks that files are divided among, at most.
MAX_TASKS = 10_000
FILE_INDEX = "path string, file string, record int, record_id string, type string, uri string, offset bigint, length bigint, raw_length bigint, digest string, error string"
INDEX = "file string, record int, record_id string, type string, uri string, offset bigint, length bigint, raw_length bigint, digest string, member binary, error string"


class WarcError(ValueError):
    """The stream isn't a sequence of whole WARC records."""


def inflate(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Bytes of a gzip stream of one or several members, or of plain bytes."""
    z, head, start, within = None, b"", True, False
    for piece in pieces:
        if start:
            head += piece
            if len(head) < 2:
                continue
            piece, start = head, False
            z = zlib.decompressobj(31) if piece[:2] == b"\x1f\x8b" else None
        if z is None:
            yield piece
            continue
        while piece:
            try:
                yield z.decompress(piece)
            except zlib.error as e:
                raise WarcError(f"gzip stream: {e}") from e
            within = not z.eof
            piece = z.unused_data
            if z.eof:
                piece = piece.lstrip(b"\0")  # padding between members
                z = zlib.decompressobj(31)
    if start and head:
        yield head
    if within:
        raise WarcError("gzip stream ends early")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and all bytes of each record."""
    buf, source = bytearray(), iter(pieces)

    def more() -> bool:
        for p in source:
            if p:
                buf.extend(p)
                return True
        return False

    while True:
        while len(buf) < 4 and more():
            pass
        while buf[:1] in (b"\r", b"\n"):  # stray line ends between records
            del buf[:1]
            if not buf:
                more()
        if not buf:
            return
        seen = 0
        while (end := buf.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(buf)
            if seen > MAX_HEADER or not more():
                raise WarcError("header without end")
        lines = bytes(buf[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError(f"no record begins with {lines[0][:20]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = head.get("content-length", "")
        if not (size.isascii() and size.isdecimal() and len(size) < 19):
            raise WarcError("record without a length")
        total = end + 4 + int(size) + 4
        while len(buf) < total and more():
            pass
        if len(buf) < total - 4:
            raise WarcError("record ends early")
        raw = bytes(buf[:total])
        if raw[end + 4 + int(size) :] != b"\r\n\r\n":  # the two line ends belong to every record
            tail = raw[end + 4 + int(size) :]
            keep = len(tail) - len(tail.lstrip(b"\r\n"))
            total = end + 4 + int(size) + keep
            raw = raw[: end + 4 + int(size)] + b"\r\n\r\n"
        del buf[:total]
        yield head, raw


def member(raw: bytes, level: int = 6) -> bytes:
    """One record as a gzip member, the same bytes on every run."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _index_row(n: int, head: dict[str, str], raw: bytes, at: int, size: int) -> dict[str, object]:
    return {"record": n, "record_id": head.get("warc-record-id"), "type": head.get("warc-type"), "uri": head.get("warc-target-uri"), "offset": at, "length": size, "raw_length": len(raw), "digest": hashlib.sha1(raw).hexdigest()}


def _rewritten(source: BinaryIO, out: BinaryIO, level: int) -> Iterator[tuple[int, dict[str, str], bytes, int, int]]:
    at = 0
    for n, (head, raw) in enumerate(records(inflate(iter(lambda: source.read(PIECE), b"")))):
        m = member(raw, level)
        out.write(m)
        yield n, head, raw, at, len(m)
        at += len(m)


def normalise_stream(source: BinaryIO, out: BinaryIO, level: int = 6) -> Iterator[tuple[int, dict[str, str], int, int, int]]:
    """Rewrite a stream; yields (record, header, offset, length, raw length), the sidecar index."""
    for n, head, raw, at, size in _rewritten(source, out, level):
        yield n, head, at, size, len(raw)


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _placed(fs: pafs.FileSystem, temporary: str, path: str) -> None:
    """A whole file takes its name at once; a task that runs again replaces it by the same bytes."""
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_file(path)
    fs.move(temporary, path)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def normalise_files(files: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Of files (path) on shared storage a row per record, the index; the new file and its index as JSON lines
    (the name and .index.jsonl) are written to the folder, under the name of the file after a digest of its path.

    A null path has no row; plain (uncompressed), empty and already divided files are accepted. A damaged file gives the
    records before the damage, in the file and the index, and one row with record = -1 and the error; a file that can't be read gives that row alone.
    Repeated paths are each normalised, to one file; long records are held one at a time; of equal records each has its row; further columns are ignored; an empty table gives no rows."""
    schema = _schema(FILE_INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                if path is None:
                    continue
                base = f"{hashlib.sha1(path.encode()).hexdigest()[:12]}-{path.rstrip('/').rpartition('/')[2]}"
                fs, to = _opened(f"{folder}/{base}")
                temporary, rows, error = f"{to}.{uuid.uuid4().hex}", [], None
                named = {"path": f"{folder}/{base}", "file": path.rpartition("/")[2]}
                try:
                    source_fs, source_path = _opened(path)
                    with source_fs.open_input_stream(source_path, compression=None) as source, fs.open_output_stream(temporary, compression=None) as out, fs.open_output_stream(f"{temporary}.index", compression=None) as index:
                        try:
                            for found in _rewritten(source, out, level):
                                row = _index_row(*found)
                                index.write(json.dumps(row).encode() + b"\n")
                                rows.append(named | row | {"error": None})
                                if len(rows) >= 4096:
                                    yield pa.RecordBatch.from_pylist(rows, schema)
                                    rows = []
                        except WarcError as e:
                            error = str(e)
                    _placed(fs, temporary, to)
                    _placed(fs, f"{temporary}.index", f"{to}.index.jsonl")
                except OSError as e:
                    error = f"file: {e}"
                if error:
                    rows.append(named | {"record": -1, "error": error})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    # a path is a small row for much work: as many tasks as files, so the optimiser mustn't join them
    return files.select("path").repartition(max(1, min(files.count(), MAX_TASKS))).mapInArrow(run, FILE_INDEX)


def fetch(index: DataFrame) -> DataFrame:
    """(path, record, content) of rows of an index: each record is read at its offset, without what is before it. Error rows have no content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, pa.NativeFile] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] not in opened:
                    opened.clear()
                    fs, p = _opened(row["path"])
                    opened[row["path"]] = fs.open_input_file(p)
                raw = gzip.decompress(opened[row["path"]].read_at(row["length"], row["offset"]))
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]]), pa.array([row["record"]], pa.int32()), pa.array([raw], pa.binary())], ["path", "record", "content"])

    return index.filter("path is not null and record >= 0").select("path", "record", "offset", "length").mapInArrow(run, "path string, record int, content binary")


def normalise(files: DataFrame, level: int = 6) -> DataFrame:
    """Of files (file, content) a row per record: its number, WARC-Record-ID, type and target, offset and length of its
    member in the rewritten file, uncompressed length, SHA-1 of the record, the member's bytes and an error.
    The members of a file in the order of their offsets are the new file; all other columns are the index. A file is
    a cell here, so it is held whole and can't exceed 2 GB; normalise_files() has neither limit.

    A null or empty content has no row; plain (uncompressed) and already divided files are accepted. A damaged file
    gives the records before the damage and one row with record = -1 and the error. Repeated files are each
    normalised; further columns are ignored; an empty table gives no rows."""

    schema = _schema(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if not content:
                    continue
                rows, at, held = [], 0, 0
                try:
                    for n, (head, raw) in enumerate(records(inflate(content[k : k + PIECE] for k in range(0, len(content), PIECE)))):
                        m = member(raw, level)
                        rows.append({"file": name, **_index_row(n, head, raw, at, len(m)), "member": m, "error": None})
                        at, held = at + len(m), held + len(m)
                        if held > 1 << 24:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                except WarcError as e:
                    rows.append({"file": name, "record": -1, "offset": at, "error": str(e)})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    small_batches(files.sparkSession)
    return files.select("file", "content").mapInArrow(run, INDEX)


def record_bytes(kind: str, record_id: str, uri: str | None, payload: bytes) -> bytes:
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{record_id}>\r\n" + (f"WARC-Target-URI: {uri}\r\n" if uri else "") + f"WARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def monolithic(pages: DataFrame, per_file: int = PAGES_PER_FILE) -> DataFrame:
    """Whole-file gzip archives (file, content) of pages, `per_file` ids each: the input that the normaliser is for. A
    page without html is an empty record; pages without an id are in a file of their own."""

    def build(key: tuple, t: pa.Table) -> pa.Table:
        z = zlib.compressobj(4, zlib.DEFLATED, 31)
        out = [z.compress(record_bytes("warcinfo", f"file-{key[0].as_py()}", None, b"software: corpusloom\r\n"))]
        t = t.sort_by([("page_id", "ascending"), ("url", "ascending")])
        for chunk in t.to_batches():
            for p, u, h in zip(*(chunk.column(c) for c in ("page_id", "url", "html")), strict=True):
                out.append(z.compress(record_bytes("response", f"page-{p.as_py()}", u.as_py(), (h.as_py() or "").encode())))
        out.append(z.flush())
        return pa.table({"file": pa.array([f"pages-{key[0].as_py():08d}.warc.gz"]), "content": pa.array([b"".join(out)], pa.binary())})

    return pages.select(F.coalesce(F.floor(F.col("page_id") / per_file), F.lit(-1)).cast("bigint").alias("__loom_f"), "page_id", "url", "html").groupBy("__loom_f").applyInArrow(build, "file string, content binary")


def stored(files: DataFrame, folder: str) -> DataFrame:
    """(path) of files (file, content) after they were written to the folder; a null content has no file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name is None or not content.is_valid:
                    continue
                fs, to = _opened(f"{folder}/{name}")
                temporary = f"{to}.{uuid.uuid4().hex}"
                with fs.open_output_stream(temporary, compression=None) as out:
                    out.write(content.as_buffer())
                _placed(fs, temporary, to)
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], ["path"])

    small_batches(files.sparkSession)
    return files.select("file", "content").mapInArrow(run, "path string")
