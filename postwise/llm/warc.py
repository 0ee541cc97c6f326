"""Operator 10: WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``frame_bytes``;
a bundle ends with an index frame (skippable) that maps each record id to its
frame and the offset inside it, and with the seek table of the Zstandard
seekable format (also a skippable frame), so any reader of plain ``.zst`` files
reads the records, and this one reads a single record by decompressing a single
frame.

Equal payloads of at least ``dedup_bytes`` are stored once: the smallest page id
is the ``response``, the others are ``revisit`` records that name it and carry
the digest and length of the full payload.

Scale. Payload groups are reduced to one row per digest (map-side combined)
before the join; groups of one never enter it. A task holds one frame and its
bundle's index; a bundle is closed at ``bundle_bytes``.

Defined results: a null html is an empty payload; rows without an id are
responses, unless an equal payload has an id; rows that share the smallest id of
a group are all responses; line breaks in urls are escaped; empty tables give
empty results and no bundle. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark import TaskContext

from .common import DataFrame, F, pa, scratch_path, written
from .sharedio import reading, writing

# Fixed values of the Zstandard seekable format
_SKIPPABLE = struct.Struct("<II")  # magic, size
_SEEK_MAGIC = 0x184D2A5E
_INDEX_MAGIC = 0x184D2A50
_SEEKABLE = 0x8F92EAB1
_ENTRY = struct.Struct("<II")  # compressed and decompressed size of a frame
_FOOT = struct.Struct("<IBI")  # frames, descriptor, magic
_INDEX_HEAD = struct.Struct("<8sQ")
_INDEX_TAG = b"RECINDEX"
_INDEX_TYPE = np.dtype([("id", "<i8"), ("has_id", "u1"), ("frame", "<u4"), ("offset", "<u8"), ("length", "<u8")])

_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_name(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:page:unnamed:{digest}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, size: int, refers_to: int | None,
           date: str) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP head of the full payload only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: {record_name(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}",
             f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if refers_to is None:
        body = http + payload
    else:
        body = http
        lines += [f"WARC-Profile: {_REVISIT_PROFILE}", f"WARC-Refers-To: {record_name(refers_to, digest)}"]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record; lengths and digests of responses are those of the
    payload found, checked against the header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    body = rest[:int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).split(": ")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    refers = fields.get("WARC-Refers-To")
    return {"record_id": fields["WARC-Record-ID"], "url": fields.get("WARC-Target-URI", ""), "record_type": kind,
            "payload_bytes": size, "payload_digest": digest, "payload": payload,
            "refers_to": int(refers[len("<urn:page:"):-1]) if refers else None}


class BundleWriter:
    """Append records, then ``close``; frames are compressed independently."""

    def __init__(self, out, frame_bytes: int = 1 << 20, level: int = 3):
        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held, self.size, self.frames, self.index, self.total = [], 0, [], [], 0

    def append(self, page_id: int | None, data: bytes) -> None:
        if self.size and self.size + len(data) > self.frame_bytes:
            self.flush()
        self.index.append((page_id or 0, page_id is not None, len(self.frames), self.size, len(data)))
        self.held.append(data)
        self.size += len(data)
        self.total += len(data)

    def flush(self) -> None:
        if self.held:
            frame = self.zstd.compress(b"".join(self.held))
            self.out.write(frame)
            self.frames.append((len(frame), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = _INDEX_HEAD.pack(_INDEX_TAG, len(self.index)) + np.array(self.index, _INDEX_TYPE).tobytes()
        self.out.write(_SKIPPABLE.pack(_INDEX_MAGIC, len(index)) + index)
        self.frames.append((len(index) + _SKIPPABLE.size, 0))
        table = b"".join(_ENTRY.pack(*f) for f in self.frames) + _FOOT.pack(len(self.frames), 0, _SEEKABLE)
        self.out.write(_SKIPPABLE.pack(_SEEK_MAGIC, len(table)) + table)


class BundleReader:
    """Random access to the records of a bundle through its seek table."""

    def __init__(self, path: str):
        self.file = reading(path)
        size = self.file.size()
        n, _, magic = _FOOT.unpack(self.file.read_at(_FOOT.size, size - _FOOT.size))
        if magic != _SEEKABLE:
            raise ValueError(f"not a seekable bundle: {path}")
        table = np.frombuffer(self.file.read_at(n * _ENTRY.size, size - _FOOT.size - n * _ENTRY.size), "<u4")
        self.sizes = table.reshape(n, 2).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes[:, 0])))
        at = int(self.starts[n - 1]) + _SKIPPABLE.size
        index = self.file.read_at(int(self.sizes[n - 1, 0]) - _SKIPPABLE.size, at)
        tag, count = _INDEX_HEAD.unpack_from(index)
        if tag != _INDEX_TAG:
            raise ValueError(f"no record index: {path}")
        self.index = np.frombuffer(index, _INDEX_TYPE, count, _INDEX_HEAD.size)
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        return self.zstd.decompress(self.file.read_at(int(self.sizes[k, 0]), int(self.starts[k])),
                                    max_output_size=int(self.sizes[k, 1]))

    def find(self, page_id: int) -> list[bytes]:
        """The records of one id, through their frames only."""
        hits = self.index[(self.index["id"] == page_id) & (self.index["has_id"] == 1)]
        return [self.frame(int(h["frame"]))[int(h["offset"]):int(h["offset"] + h["length"])] for h in hits]

    def records(self) -> Iterator[tuple[int | None, bytes]]:
        at, data = -1, b""
        for h in self.index:
            if h["frame"] != at:
                at = int(h["frame"])
                data = self.frame(at)
            start = int(h["offset"])
            yield int(h["id"]) if h["has_id"] else None, data[start:start + int(h["length"])]


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html", dedup_bytes: int = 100, frame_bytes: int = 1 << 20,
                  bundle_bytes: int = 1 << 28, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write bundles under ``folder``; returns the manifest (path, n_records)."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"),
                        F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"),
                        F.coalesce(F.col(f"`{html_col}`").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    digest, size = F.sha2("payload", 256), F.octet_length("payload").cast("long")
    rows = rows.withColumn("digest", digest).withColumn("size", size)
    groups = (rows.filter(F.col("size") >= dedup_bytes).groupBy("digest")
              .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
              .filter((F.col("n") > 1) & F.col("first_id").isNotNull()).select("digest", "first_id"))
    joined = rows.join(groups, "digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    joined = joined.select("page_id", "url", F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
                           "digest", "size", F.when(again, F.col("first_id")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), []

        def rows_of() -> Iterator[tuple]:
            for batch in batches:
                cols = [batch.column(i) for i in range(batch.num_columns)]
                for i in range(batch.num_rows):
                    yield tuple(c[i].as_py() for c in cols)

        stream = rows_of()
        row = next(stream, None)
        while row is not None:
            path = f"{folder}/part-{part:05d}-{len(done):03d}.warc.zst"
            with writing(path) as out:
                bundle = BundleWriter(out, frame_bytes)
                while row is not None and bundle.total < bundle_bytes:
                    bundle.append(row[0], record(*row, date))
                    row = next(stream, None)
                bundle.close()
            done.append((path, len(bundle.index)))
        cols = list(zip(*done)) if done else [(), ()]
        yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64())],
                              names=["path", "n_records"])

    return written(joined.mapInArrow(write, "path string, n_records long"), "warc-manifest")


_SCHEMA = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long")


def read_bundles(manifest: DataFrame) -> DataFrame:
    """One row per record, read back from the bundles."""
    paths = manifest.select("path").repartitionByRange(max(1, min(manifest.count(), 20_000)), "path")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [()] * len(names)
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=list(names))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                out: list[tuple] = []
                for page_id, data in BundleReader(path).records():
                    r = parse(data)
                    out.append((page_id, *[r[n] for n in names[1:]]))
                    if len(out) == 2_000:
                        yield batch_of(out)
                        out = []
                yield batch_of(out)

    return paths.mapInArrow(read, _SCHEMA)


def archive_pages(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write all pages to bundles and read them back."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return read_bundles(write_bundles(pages, folder, **options))
