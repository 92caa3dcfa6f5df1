"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle is such frames followed by a seek table in a skippable frame (the
public seekable format: sizes of every frame, then their number, a descriptor and a magic number). Readers find a frame by the seek table in
the footer, decompress that frame alone, and take the record at its offset there.

Of pages with equal payloads the one with the smallest id is written as a response; others become revisits that refer to it, without
payload. Only ids and digests are grouped to find that out, and a payload that most pages share is broadcast or dealt over salts; a page's html is shuffled once, to where its bundle is written.

Bundles are written straight to the shared folder through its file system, one record at a time, under a name of their own
for every attempt of a task, then renamed; the index names the file that the surviving attempt wrote, and is itself
written to the shared folder, so lost executors leave at worst files that no index names.

Defined cases: a null html is an empty payload; a null url leaves its header out, line ends in it become spaces; a null page id is
never smaller than another; repeated rows are records of their own, and those with the smallest id are all responses; no pages give no bundles;
other columns are ignored. A record longer than a frame has a frame to itself.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import checkpointed, join_small, shared_dir, table

#: Fixed values of the seekable format: magic numbers of the skippable frame and of the seek table.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, FRAME_RECORDS, BUNDLE_BYTES = 1 << 18, 256, 1 << 29
DATE = "2020-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.splitlines()))
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "replace") + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict, dict, bytes]:
    """A record's WARC headers, HTTP headers and payload, from its first byte on."""
    if not data.startswith(b"WARC/1."):
        raise ValueError("no record begins here")
    end = data.index(b"\r\n\r\n")
    headers = lambda lines: {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    warc = headers(data[:end].decode("utf-8", "replace").split("\r\n")[1:])
    block = data[end + 4 : end + 4 + int(warc["content-length"])]
    if len(block) != int(warc["content-length"]) or data[end + 4 + len(block) : end + 8 + len(block)] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    cut = block.index(b"\r\n\r\n")
    return warc, headers(block[:cut].decode().split("\r\n")[1:]), block[cut + 4 :]


class BundleWriter:
    """One bundle of frames with its seek table."""

    def __init__(self, out):
        self.out, self.compressor = out, zstandard.ZstdCompressor(level=3)
        self.sizes, self.held, self.n, self.at, self.written = [], [], 0, 0, 0

    def add(self, data: bytes) -> tuple[int, int]:
        """The record's frame and its offset in that frame."""
        if self.held and (self.at + len(data) > FRAME_BYTES or self.n >= FRAME_RECORDS):
            self.flush()
        place = len(self.sizes), self.at
        self.held.append(data)
        self.at, self.n = self.at + len(data), self.n + 1
        return place

    def flush(self) -> None:
        if self.held:
            frame = self.compressor.compress(b"".join(self.held))
            self.out.write(frame)
            self.sizes.append((len(frame), self.at))
            self.held, self.at, self.n, self.written = [], 0, 0, self.written + len(frame)

    def close(self) -> None:
        self.flush()
        table_ = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table_)) + table_)
        self.out.close()


class BundleReader:
    """Frames of a bundle, by the seek table at its end."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end")
        width = 12 if flags & 0x80 else 8
        source.seek(size - 9 - width * n)
        entries = source.read(width * n)
        self.sizes = [struct.unpack_from("<II", entries, width * i) for i in range(n)]
        self.starts = [0]
        for c, _ in self.sizes:
            self.starts.append(self.starts[-1] + c)

    def frame(self, k: int) -> bytes:
        self.source.seek(self.starts[k])
        return zstandard.ZstdDecompressor().decompress(self.source.read(self.sizes[k][0]), max_output_size=self.sizes[k][1])


INDEX = "page_id long, bundle string, frame int, offset long, length long"


def first_of_payload(pages: DataFrame) -> DataFrame:
    """__id, __sum, __first: for each page that isn't the smallest of its payload's, that smallest one."""
    ids = pages.select("__id", F.sha1(F.col("__html").cast("binary")).alias("__sum"))
    groups = ids.groupBy("__sum").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1 AND __first IS NOT NULL").drop("__n")
    return join_small(ids, groups, "__sum", F.col("__id"), "inner").where("__id IS NULL OR __id <> __first").distinct()


def write_bundles(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for every row of pages; gives the index, page_id -> (bundle, frame, offset in the frame, length)."""
    rows = pages.select(F.col(id_col).cast("long").alias("__id"), F.col(url_col).alias("__url"), F.coalesce(F.col(html_col), F.lit("")).alias("__html"))
    repeats = first_of_payload(rows.where(F.octet_length("__html") >= min_bytes))
    whole = rows.withColumn("__sum", F.sha1(F.col("__html").cast("binary")))
    same = F.col("a.__id").eqNullSafe(F.col("b.__id")) & (F.col("a.__sum") == F.col("b.__sum"))
    marked = whole.alias("a").join(repeats.alias("b"), same, "left").select("a.__id", "a.__url", "a.__html", "b.__first").sortWithinPartitions("__id")

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        writer, name, places = None, None, []

        def close():
            writer.close()
            store.move(f"{root}/.{name}.part", f"{root}/{name}")
            cols = list(zip(*places))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array([name] * len(places)), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["page_id", "bundle", "frame", "offset", "length"])

        for batch in batches:
            for page_id, url, html, first in zip(*(iter(c) for c in batch.columns)):
                if writer is None:
                    name, places = f"{uuid.uuid4().hex}.warc.zst", []
                    writer = BundleWriter(store.open_output_stream(f"{root}/.{name}.part"))
                data = record(page_id.as_py(), url.as_py(), html.as_py().encode("utf-8", "replace"), first.as_py(), first.is_valid)
                places.append((page_id.as_py(), *writer.add(data), len(data)))
                if writer.written >= BUNDLE_BYTES:
                    yield close()
                    writer = None
        if writer is not None:
            yield close()

    return checkpointed(marked.mapInArrow(run, INDEX))


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"


def read_records(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The record that each row of the index points to. A response's payload is checked against its digest and length; a revisit has none."""

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        bundle, reader, k, frame = None, None, None, b""
        for batch in batches:
            out = []
            for page_id, name, number, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if name != bundle:
                    bundle, reader, k = name, BundleReader(store.open_input_file(f"{root}/{name}")), None
                if number != k:
                    k, frame = number, reader.frame(number)
                warc, http, payload = parse(frame[offset : offset + length])
                kind, size, digest = warc["warc-type"], int(http["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (size, digest):
                    raise ValueError(f"the payload of page {page_id} is damaged")
                own = warc["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
                first = warc["warc-refers-to"].removeprefix("<urn:page:").removesuffix(">") if kind == "revisit" else None
                out.append((int(own) if own else None, size, digest, kind, int(first) if first else None, warc.get("warc-target-uri"), payload if with_payload else None))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[f.split()[0] for f in READ.split(", ")])

    return index.mapInArrow(run, READ)


def op6_warc(spark, sf_dir):
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    index = write_bundles(table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32: five bits each of the 160 of SHA-1, so four characters of each 20 bits, which are five hex digits.
SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, n, h, array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST((CAST(concat('0x', substr(h, CAST(i // 4 AS INTEGER) * 5 + 1, 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1]), '') AS digest,
         min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
