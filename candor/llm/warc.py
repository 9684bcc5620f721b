"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each a group of whole WARC/1.1
records, and a last skippable frame with the seek table: compressed and decompressed
size of each frame, number of frames, descriptor, magic number. Any Zstandard reader
unpacks the whole file; a reader of the table unpacks one frame for one record. The
index maps each record to bundle, frame and its offset within the unpacked frame.

Payloads are compared by SHA-1. Digests that occur once need no look-up; of the others
the largest page_id is found by an aggregation and joined to the pages, by broadcast only
if the written table is below Spark's broadcast limit. Equal payloads in any number
meet as one row per task in that aggregation.

write() writes bundles with pyarrow's file systems below the shared folder, one or more
for each task; a task that runs again writes new names, and only files of the attempt
that Spark committed stand in the index.

Nulls: a null html is an empty payload; a null url gives no target; a null page_id sorts
below every other. Rows that repeat page_id and payload are all of that id's type.
Payloads of any length are one record. An empty table gives no files and no rows.
Ids are cast to long: an id that is no number is an error under ANSI.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lean, shared_dir, small_batches, stored

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20  # compressed
LEVEL = 3
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_TABLE = struct.Struct("<II")
_FOOTER = struct.Struct("<IBI")

INDEX = "record_id string, page_id long, bundle string, frame int, frame_start long, frame_size long, offset long, size long"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to, revisit: bool) -> tuple[str, bytes]:
    """Record id and bytes of a response, or of a revisit without its payload."""
    digest = digest_of(payload)
    name = lambda i: f"<urn:page:{'-' if i is None else i}:{digest}>"
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,-./:;<=>?@[]_~")))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to))]
    else:
        block += payload
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return name(page_id), b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of a record, its `payload` and the payload's stated length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"Content-Length: (\d+)", http)
    return fields | {"payload": payload, "payload_bytes": int(length[1])}


class Bundle:
    """A file under construction."""

    def __init__(self, root: str):
        self.uri = f"{root}/{uuid.uuid4().hex}.warc.zst"
        fs, path = pafs.FileSystem.from_uri(self.uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(path, compression=None)
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.table, self.written = [], 0

    def frame(self, raw: bytes) -> tuple[int, int, int]:
        """Number, start and compressed size of a new frame."""
        packed = self.zstd.compress(raw)
        at = self.written
        self.out.write(packed)
        self.table.append((len(packed), len(raw)))
        self.written += len(packed)
        return len(self.table) - 1, at, len(packed)

    def close(self) -> None:
        body = b"".join(_TABLE.pack(*t) for t in self.table) + _FOOTER.pack(len(self.table), 0, _SEEKABLE)
        self.out.write(_TABLE.pack(_SKIPPABLE, len(body)) + body)
        self.out.close()


class Reader:
    """Random access to the records of one bundle."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, _, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != _SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        table = self.file.read_at(n * _TABLE.size, size - _FOOTER.size - n * _TABLE.size)
        self.sizes = list(_TABLE.iter_unpack(table))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.at, self.raw = -1, b""

    def close(self) -> None:
        self.file.close()

    def frame(self, k: int) -> bytes:
        if k != self.at:
            packed = self.file.read_at(self.sizes[k][0], self.starts[k])
            self.raw, self.at = zstandard.ZstdDecompressor().decompress(packed, max_output_size=self.sizes[k][1]), k
        return self.raw

    def record(self, frame: int, offset: int, size: int) -> dict:
        return parse(self.frame(frame)[offset : offset + size])


@lean
def _write(batches, root: str) -> Iterator[pa.RecordBatch]:
    bundle, group, held = None, [], 0
    names = ["record_id", "page_id", "bundle", "frame", "frame_start", "frame_size", "offset", "size"]

    def flush() -> pa.RecordBatch:
        nonlocal held
        frame, start, packed = bundle.frame(b"".join(g[2] for g in group))
        at, cols = 0, [[] for _ in names]
        for key, page, raw in group:
            for c, v in zip(cols, (key, page, bundle.uri, frame, start, packed, at, len(raw)), strict=True):
                c.append(v)
            at += len(raw)
        group.clear()
        held = 0
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    for batch in batches:
        for page, url, html, latest in zip(*[batch.column(c) for c in ("page_id", "url", "html", "latest")], strict=True):
            page, url, latest = page.as_py(), url.as_py(), latest.as_py()
            revisit = latest is not None and page != latest
            key, raw = record(page, url, html.as_buffer().to_pybytes() if html.is_valid else b"", latest, revisit)
            bundle = bundle or Bundle(root)
            group.append((key, page, raw))
            held += len(raw)
            if held >= FRAME_BYTES:
                yield flush()
                if bundle.written >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
    if group:
        yield flush()
    if bundle:
        bundle.close()


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark would read it by: one without is on the default file system, not on each executor's disk."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return f"file://{full.removeprefix('file:')}" if full.startswith("file:/") and not full.startswith("file://") else full


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", root: str | None = None) -> DataFrame:
    """Writes one record for each row into bundles below root (default: the shared folder); returns the stored index."""
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    small_batches(pages.sparkSession)
    sha = F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    counts = pages.select("page_id", sha.alias("sha")).groupBy("sha").agg(F.max("page_id").alias("latest"), F.count("*").alias("n"))
    again = stored(counts.where("n > 1").select("sha", "latest"), "again")
    typed = pages.withColumn("sha", sha).join(again, "sha", "left").select("page_id", "url", "html", "latest")
    where = root or f"{shared_dir(pages.sparkSession)}/bundles"
    where = qualified(pages.sparkSession, where)
    return stored(typed.mapInArrow(lambda b: _write(b, where), INDEX), "index")


@lean
def _read(batches, payload: bool) -> Iterator[pa.RecordBatch]:
    reader, uri = None, None
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if r["bundle"] != uri:
                if reader:
                    reader.close()
                reader, uri = Reader(r["bundle"]), r["bundle"]
            rows.append((r["record_id"], r["page_id"], reader.record(r["frame"], r["offset"], r["size"])))
        cols = [[], [], [], [], [], [], [], []]
        for key, page, f in rows:
            kind = f["WARC-Type"]
            digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
            if f["WARC-Record-ID"] != key or (kind == "response" and digest_of(f["payload"]) != digest):
                raise ValueError(f"record {key} is damaged")
            to = re.match(r"<urn:page:(-?\d+):", f.get("WARC-Refers-To", ""))
            values = (page, f["payload_bytes"], digest, kind, int(to[1]) if to else None, key, f.get("WARC-Target-URI"), f["payload"] if payload and kind == "response" else None)
            for c, v in zip(cols, values, strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri", "payload"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
    if reader:
        reader.close()


def read(index: DataFrame, payload: bool = True) -> DataFrame:
    """Every record of the index, read from its bundle; payload of responses only (a revisit's is that of refers_to)."""
    return index.select("record_id", "page_id", "bundle", "frame", "offset", "size").mapInArrow(lambda b: _read(b, payload), RESULT)
