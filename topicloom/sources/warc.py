"""WARC files as a DataFrame of records.

``read_warc`` streams files through a Python data source and never holds more than a
batch of records.  A task reads a file, or of a gzipped file with one member a record a range
of ``SPLIT_BYTES``: it starts at the first member head from there on that holds a record, and
ends where the next range starts, so that no record is read twice or lost.  ``hdfs://`` paths
go through Spark's binary file reader instead, which holds one file per row.  Plain and
gzipped files (one or many members) are told apart by their first bytes, not by their name.
Plain files are not cut: what looks like a record in them may be a payload.
"""

from __future__ import annotations

import glob
import gzip
import io
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from topicloom.session import ship_package

SCHEMA = (
    "path string, record_no long, warc_type string, record_id string, trec_id string, "
    "target_uri string, headers map<string,string>, payload binary, error string"
)
_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("record_no", pa.int64()),
        ("warc_type", pa.string()),
        ("record_id", pa.string()),
        ("trec_id", pa.string()),
        ("target_uri", pa.string()),
        ("headers", pa.map_(pa.string(), pa.string())),
        ("payload", pa.binary()),
        ("error", pa.string()),
    ]
)
#: Gzipped files are read in ranges of so many bytes.
SPLIT_BYTES = 128 * 2**20
#: ``record_no`` counts from here on in the next range of a file.
RANGE_RECORDS = 2**40
#: Members that must follow each other where a range starts.
CHAIN = 16
_HEAD, _PEEK, _READ = b"\x1f\x8b\x08", 64 * 1024, 2**20
_BATCH_BYTES = 16 * 2**20
_BATCH_RECORDS = 10_000


def _headers(stream) -> dict[str, str]:
    headers, name = {}, None
    while line := stream.readline():
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            break
        if text[0] in " \t" and name:
            headers[name] += " " + text.strip()
        elif ":" in text:
            name, value = text.split(":", 1)
            name = name.strip()
            headers[name] = value.strip()
    return headers


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes | None, str | None]]:
    """(headers, payload, error) per record; text between records is skipped.

    A record that breaks off, or a damaged gzip member, ends the file with one row
    that has the error and no payload.
    """
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            headers = _headers(stream)
            lengths = [v for k, v in headers.items() if k.lower() == "content-length"]
            if not lengths or not lengths[0].isdigit():
                yield headers, None, "no content length"
                continue
            payload = stream.read(int(lengths[0]))
            if len(payload) < int(lengths[0]):
                yield {}, None, "record is cut short"
                return
            yield headers, payload, None
    except (EOFError, OSError, zlib.error) as e:
        yield {}, None, f"{type(e).__name__}: {e}"


def _open(raw):
    raw = io.BufferedReader(raw) if not hasattr(raw, "peek") else raw
    packed = raw.peek(2)[:2] == b"\x1f\x8b"
    return gzip.GzipFile(fileobj=raw) if packed else raw


def _holds_record(data: bytes) -> bool:
    """Whether a gzip member that starts here holds a record."""
    try:
        return zlib.decompressobj(31).decompress(data, 5) == b"WARC/"
    except zlib.error:
        return False


def _chained(raw, at: int) -> bool:
    """Whether members follow each other from here: ``CHAIN`` of them, or up to the end of the
    file or a damage.  An archive inside of a payload ends in other bytes."""
    raw.seek(at)
    data = b""
    for _ in range(CHAIN):
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            data = data or raw.read(_READ)
            if not data:
                return True
            try:
                unpack.decompress(data)
            except zlib.error:
                return True
            data = unpack.unused_data
        while not (data := data.lstrip(b"\0")) or len(data) < len(_HEAD):
            more = raw.read(_READ)
            if not more:
                return not data
            data += more
        if not data.startswith(_HEAD):
            return False
    return True


def _first_member(raw, start: int, end: int) -> int | None:
    """The place of the first member head from ``start`` to ``end`` that holds a record."""
    raw.seek(start)
    data, at = b"", start
    while at < end:
        more = raw.read(_READ)
        data += more
        last = len(data) if not more else len(data) - _PEEK  # heads further on are seen whole later
        found = data.find(_HEAD)
        while 0 <= found < last and at + found < end:
            if _holds_record(data[found : found + _PEEK]):
                here = raw.tell()
                if _chained(raw, at + found):
                    return at + found
                raw.seek(here)
            found = data.find(_HEAD, found + 1)
        if not more:
            return None
        keep = max(0, last)
        data, at = data[keep:], at + keep
    return None


class _Members(io.RawIOBase):
    """The content of the gzip members from ``start``, up to the first one at or behind ``end``
    that holds a record."""

    def __init__(self, raw, start: int, end: int):
        self.raw, self.at, self.end = raw, start, end  # the place of what is not yet unpacked
        self.packed, self.ready, self.unpack = b"", b"", zlib.decompressobj(31)
        raw.seek(start)

    def readable(self):
        return True

    def readinto(self, buffer):
        while not self.ready:
            if self.unpack is None:
                return 0
            if self.unpack.eof:
                self._next()
                continue
            data = self.packed or self.raw.read(_READ)
            if not data:
                self.unpack, broken = None, self.unpack
                if broken is not None and self.at_member:
                    return 0
                raise EOFError("compressed file ended before the end-of-stream marker was reached")
            self.at_member = False
            self.packed = b""
            self.ready = self.unpack.decompress(data)
            self.at += len(data) - len(self.unpack.unused_data)
        size = min(len(buffer), len(self.ready))
        buffer[:size], self.ready = self.ready[:size], self.ready[size:]
        return size

    at_member = False  # nothing of the current member has been read

    def _next(self):
        """Go on to the next member, unless the next range has it."""
        self.packed = self.unpack.unused_data
        while len(self.packed) < _PEEK and (more := self.raw.read(_READ)):
            self.packed += more
        padding = len(self.packed) - len(self.packed.lstrip(b"\0"))
        self.packed, self.at = self.packed[padding:], self.at + padding
        if not self.packed or self.at >= self.end and _holds_record(self.packed[:_PEEK]):
            self.unpack = None
            return
        self.unpack, self.at_member = zlib.decompressobj(31), True


def _range_stream(raw, start: int, end: int):
    """A stream of the records that the range owns; None if it owns none."""
    if raw.peek(3)[:3] != _HEAD:
        return raw if start == 0 else None
    at = 0 if start == 0 else _first_member(raw, start, end)
    return None if at is None else io.BufferedReader(_Members(raw, at, end), _READ)


def record_batches(
    path: str, raw, record_type: str | None = None, first: int = 0, payloads: bool = True,
    wanted: dict[str, str] | None = None,
) -> Iterator[pa.RecordBatch]:
    """Records of one open file as Arrow batches of bounded size, numbered from ``first``.

    ``wanted`` holds values that ``warc_type`` and ``target_uri`` must have; other rows, those
    with an error too, are skipped.  Without ``payloads`` that column is null.
    """
    rows, size = [], 0
    for number, (headers, payload, error) in enumerate(parse_records(raw), first):
        known = {k.lower(): v for k, v in headers.items()}
        kind = known.get("warc-type")
        if record_type is not None and kind != record_type and error is None:
            continue  # damage is kept: nobody knows what it would have been
        if wanted and any(known.get(_PUSHED[c]) != v for c, v in wanted.items()):
            continue
        payload = payload if payloads else None
        rows.append(
            {
                "path": path, "record_no": number, "warc_type": kind,
                "record_id": known.get("warc-record-id"),
                "trec_id": known.get("warc-trec-id"),
                "target_uri": known.get("warc-target-uri"),
                "headers": list(headers.items()), "payload": payload, "error": error,
            }
        )
        size += len(payload or b"")
        if size >= _BATCH_BYTES or len(rows) >= _BATCH_RECORDS:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


#: Columns whose equality with a value is settled by the reader, and their headers.
_PUSHED = {"warc_type": "warc-type", "target_uri": "warc-target-uri"}


def _hidden(path: str) -> bool:
    return os.path.basename(path).startswith(("_", "."))


def _segment(part: str) -> str:
    """A regular expression for one segment of a glob."""
    wild = {"*": "[^/]*", "?": "[^/]"}
    pieces = re.split(r"(\*|\?|\[[^\]]+\])", part)
    return "".join(
        wild.get(p) or (p.replace("[!", "[^", 1) if p.startswith("[") else re.escape(p))
        for p in pieces
    )


def list_files(path: str) -> list[str]:
    """Visible files of a file, directory or glob; a URI is listed on its file system."""
    if "://" in path or path.startswith("file:/"):
        from pyarrow import fs

        # Without wildcards the pattern is the path itself; what lies below a match counts.
        parts = path.rstrip("/").split("/")
        fixed = next((i for i, part in enumerate(parts) if glob.has_magic(part)), len(parts))
        base = "/".join(parts[:fixed])
        system, inner = fs.FileSystem.from_uri(base)
        if fixed == len(parts) and system.get_file_info(inner).type == fs.FileType.File:
            return [path]
        scheme = base[: len(base) - len(inner)] if base.endswith(inner) else path.split("://")[0] + "://"
        segments = [re.escape(inner.rstrip("/")), *map(_segment, parts[fixed:])]
        pattern = re.compile("/".join(segments) + "(/.*)?")
        found = system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
        return sorted(
            scheme + f.path
            for f in found
            if f.is_file and not _hidden(f.path) and pattern.fullmatch(f.path)
        )
    files = []
    for match in sorted(glob.glob(path)):
        if os.path.isdir(match):
            for folder, _, names in os.walk(match):
                files += [os.path.join(folder, n) for n in names]
        else:
            files.append(match)
    return sorted(f for f in files if not _hidden(f))


def _open_raw(path: str):
    if "://" in path or path.startswith("file:/"):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return io.BufferedReader(system.open_input_file(inner))
    return open(path, "rb", buffering=_READ)


def _size(path: str) -> int:
    if "://" in path or path.startswith("file:/"):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.get_file_info(inner).size
    return os.path.getsize(path)


@dataclass
class WarcRanges(InputPartition):
    """Ranges (path, number of the range, start, end)."""

    ranges: list[tuple[str, int, int, int]]


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.record_type = options.get("recordtype")
        self.most = int(options.get("partitions") or 0)
        self.split = int(options.get("splitbytes") or SPLIT_BYTES)
        self.payloads = options.get("payload", "true").lower() != "false"
        self.wanted: dict[str, str] = {}

    def partitions(self):
        files = list_files(self.path)
        if not files:
            raise FileNotFoundError(f"no WARC files at {self.path}")
        ranges = []
        for path in files:
            size = _size(path)
            starts = range(0, max(size, 1), self.split)
            ranges += [(path, n, a, min(a + self.split, size)) for n, a in enumerate(starts)]
        tasks = min(len(ranges), self.most or len(ranges))
        return [WarcRanges(ranges[i::tasks]) for i in range(tasks)]

    def read(self, partition):
        for path, number, start, end in partition.ranges:
            with _open_raw(path) as raw:
                stream = _range_stream(raw, start, end)
                if stream is not None:
                    first = number * RANGE_RECORDS
                    yield from record_batches(path, stream, self.record_type, first, self.payloads, self.wanted)


class PushedWarcReader(WarcReader):
    """For sessions with ``spark.sql.python.filterPushdown.enabled``: Spark takes a reader with
    this method nowhere else."""

    def pushFilters(self, filters):
        """Equalities of the record's type and URI are settled here, before Spark sees a row."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo) and len(f.attribute) == 1 else None
            if name in _PUSHED and isinstance(f.value, str) and self.wanted.get(name, f.value) == f.value:
                self.wanted[name] = f.value
            else:
                yield f


class WarcSource(DataSource):
    """``spark.read.format("warc").option("recordType", "response").load(path)``"""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        options = {k.lower(): v for k, v in self.options.items()}
        pushed = options.get("pushdown", "false").lower() == "true"
        return (PushedWarcReader if pushed else WarcReader)(options)


def warc_from_files(
    spark: SparkSession, path: str, record_type: str | None = None, partitions: int | None = None,
    split_bytes: int | None = None, payloads: bool = True,
) -> DataFrame:
    """Stream records from a mounted path or a URI (globs too), one task a range of
    ``split_bytes`` of a file, or in at most ``partitions`` tasks.

    ``record_no`` counts the records of a file; each further range goes on at the next
    multiple of ``RANGE_RECORDS``.  Without ``payloads`` only headers reach Spark.
    """
    ship_package(spark)
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc")
    if partitions:
        reader = reader.option("partitions", partitions)
    if record_type is not None:
        reader = reader.option("recordType", record_type)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower() == "true":
        reader = reader.option("pushdown", "true")
    if split_bytes:
        reader = reader.option("splitBytes", split_bytes)
    if not payloads:
        reader = reader.option("payload", "false")
    return reader.load(path)


def warc_from_hadoop(
    spark: SparkSession, path: str, record_type: str | None = None, partitions: int | None = None
) -> DataFrame:
    """Records from any Hadoop file system; each file (up to about 1 GB) is one row on the way."""
    ship_package(spark)

    def split(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                content = io.BytesIO(batch.column("content")[at].as_buffer())
                yield from record_batches(batch.column("path")[at].as_py(), _open(content), record_type)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.coalesce(partitions) if partitions else files
    return files.select("path", "content").mapInArrow(split, SCHEMA)


def read_warc(
    spark: SparkSession, path: str, record_type: str | None = None, partitions: int | None = None
) -> DataFrame:
    """All records below ``path``, by the reader that fits its scheme.

    ``record_type`` skips other records at the source, before they reach Spark, but not
    rows with an ``error``.  ``partitions`` deals out files, not records.
    """
    reader = warc_from_hadoop if path.startswith("hdfs://") else warc_from_files
    return reader(spark, path, record_type, partitions)
