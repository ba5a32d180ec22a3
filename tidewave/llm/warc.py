"""WARC archives in the seekable Zstandard format: write with revisit records, index, read back.

An archive is a run of independent Zstandard frames, each holding whole WARC records, and at its end a skippable frame
with the table of frame sizes. The index maps each record to its file, frame and offset within the decompressed frame, so
one record costs the decompression of one frame.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm._common import fresh_dir, lean, open_input, open_output, table, written

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
RECORD_DATE = "1970-01-01T00:00:00Z"

INDEX = "page_id long, file string, frame int, offset long, length long"


class SeekableWriter:
    """Groups records into frames of about `frame_bytes` before compression and ends the file with the seek table."""

    def __init__(self, out, frame_bytes: int = 1 << 20, level: int = 3):
        import zstandard

        self.out, self.limit, self.zstd = out, frame_bytes, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.pending, self.size, self.sizes = [], 0, []

    def add(self, record: bytes) -> tuple[int, int]:
        """Take a record; returns its frame number and its offset in that frame."""
        if self.size and self.size + len(record) > self.limit:
            self.flush()
        at = len(self.sizes), self.size
        self.pending.append(record)
        self.size += len(record)
        return at

    def flush(self) -> None:
        if self.pending:
            packed = self.zstd.compress(b"".join(self.pending))
            self.out.write(packed)
            self.sizes.append((len(packed), self.size))
            self.pending, self.size = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.out.close()


class SeekableReader:
    """Random access to the frames of such a file."""

    def __init__(self, path: str):
        import zstandard

        self.file, self.zstd = open_input(path), zstandard.ZstdDecompressor()
        self.file.seek(self.file.size() - 9)
        frames, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{path} has no seek table")
        self.file.seek(self.file.size() - 9 - 8 * frames)
        sizes = [struct.unpack("<II", self.file.read(8)) for _ in range(frames)]
        self.frames, at = [], 0
        for packed, _ in sizes:
            self.frames.append((at, packed))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed = self.frames[number]
        self.file.seek(at)
        return self.zstd.decompress(self.file.read(packed))

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """A response record, or a revisit record that refers to page `first` and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if first is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {RECORD_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if first is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], memoryview]]:
    """WARC headers, HTTP headers and payload of each record in a frame."""
    def headers(at: int) -> tuple[dict[str, str], int]:
        end = data.index(b"\r\n\r\n", at)
        pairs = (line.partition(": ") for line in data[at:end].decode().split("\r\n")[1:])
        return {k: v for k, _, v in pairs}, end + 4

    at = 0
    while at < len(data):
        warc, start = headers(at)
        end = start + int(warc["Content-Length"])
        http, body = headers(start)
        yield warc, http, memoryview(data)[body:end]
        at = end + 4


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 100) -> DataFrame:
    """Write a record per row of `pages` (page_id, url, html) and return the index (page_id, file, frame, offset, length).

    Of rows with equal payloads of at least `least_bytes` bytes, the one with the smallest page_id is a response and the
    others revisit it. Null html is an empty payload, a null url is left out of the record. Rows that share both the
    payload and the smallest page_id are all responses; a null page_id never is the smallest, unless all are null (then
    all are responses). One row of the index stands for one row of the input; an empty table writes no file.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    marked = rows.join(groups.where("n > 1").drop("n"), "digest", "left")
    marked = marked.withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))

    @lean
    def write(batches: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        name, out = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst", None
        for batch in batches:
            index = []
            for row in batch.to_pylist():
                out = out or SeekableWriter(open_output(name))
                record = make_record(row["page_id"], row["url"], row["payload"], row["digest"], row["first"])
                index.append((row["page_id"], name, *out.add(record), len(record)))
            cols = list(zip(*index, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["page_id", "file", "frame", "offset", "length"])
        if out:
            out.close()

    return written(marked.select("page_id", "url", "payload", "digest", "first").mapInArrow(write, INDEX), "warc-index")


def read_archives(spark: SparkSession, files: list[str]) -> DataFrame:
    """Every record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The digest of a response is computed from the payload that was read; a revisit carries those of its headers.
    """
    source = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files)))

    @lean
    def read(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        page = re.compile(r"<urn:page:(-?\d*)>")
        number = lambda s: int(x) if (x := page.fullmatch(s)[1]) else None
        for batch in batches:
            for path in batch.column("file").to_pylist():
                archive = SeekableReader(path)
                for k in range(len(archive.frames)):
                    out = []
                    for warc, http, body in parse_records(archive.frame(k)):
                        kind, digest = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response":
                            digest = hashlib.sha256(body).hexdigest()
                        size = len(body) if kind == "response" else int(http["Content-Length"])
                        out.append((number(warc["WARC-Record-ID"]), size, digest, kind, number(warc["WARC-Refers-To"]) if kind == "revisit" else None))
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return source.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_files(index: DataFrame) -> list[str]:
    """The files of an index: at most one per partition that wrote them."""
    return sorted(r["file"] for r in index.select("file").distinct().collect())


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    index = write_archives(table(spark, sf_dir, "pages"), fresh_dir(spark, "warc"))
    return read_archives(spark, archive_files(index))


QUERIES = {"op2_warc": op2_warc}
SQL = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha256(h) AS s FROM p),
        g AS (SELECT s, min(page_id) AS f, count(*) AS c FROM d WHERE n >= 100 GROUP BY s)
        SELECT d.page_id, d.n AS payload_bytes, d.s AS payload_digest,
               CASE WHEN g.c > 1 AND d.page_id <> g.f THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN g.c > 1 AND d.page_id <> g.f THEN g.f END AS refers_to
        FROM d LEFT JOIN g ON d.s = g.s""",
}
