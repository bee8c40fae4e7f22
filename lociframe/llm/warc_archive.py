"""WARC archives, index first.

Each task writes its pages as records, every record a gzip member of its own, and returns a row per record for the index:
file, offset, length, URL and digest.  Reading selects rows of the index, sorts their byte ranges, joins neighbours into few
large reads, and parses the records found there.

Files are written and read through pyarrow's file systems, below spark.checkpoint.dir (a shared folder: file://, s3:// or,
where libhdfs is installed, hdfs://).  A file's name holds the task's attempt, and only rows of attempts that succeeded
reach the index, so a lost executor leaves at most a file that nothing refers to.

Of pages with equal payloads (of at least min_bytes) that with the smallest page_id is a response and the others revisit
it.  Null html is an empty payload, a null URL becomes urn:page:<id>, pages without an id are responses unless a page with an
id has their payload; repeated rows of one id and payload are each a response; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared

#: Digests that occur more than once are broadcast up to this many (about 60 bytes each); beyond it, a join by digest.
BROADCAST_DIGESTS = 200_000
FILE_BYTES = 1 << 30
#: Reads join ranges that lie this close, up to so many bytes.
GAP_BYTES, READ_BYTES = 1 << 16, 8 << 20
#: Byte ranges of one file that go to one task.
BLOCK_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, page_id long"


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None) -> str:
    h = hashlib.md5(f"page:{page_id}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _safe(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """A response, or if first is given a revisit of that page's response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_safe(url) if url is not None else f'urn:page:{page_id}'}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}", *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
    ]
    if first is not None:
        head += [f"WARC-Refers-To: {record_id(first)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {first}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, dict[str, str]]:
    """(WARC headers, payload, HTTP headers) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record at this place")
    warc = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, payload, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        task = TaskContext.get()
        out, name, offset, number = None, "", 0, 0
        try:
            for batch in batches:
                rows = []
                for i in range(batch.num_rows):
                    page_id, url, html, sha1, first = (batch.column(k)[i].as_py() for k in range(5))
                    if out is None or offset >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"pages-{task.partitionId():06d}-{number:03d}-{task.taskAttemptId()}.warc.gz"
                        out, offset, number = fs.open_output_stream(f"{root}/{name}", compression=None), 0, number + 1
                    pack = zlib.compressobj(3, wbits=31)
                    digest = base32(sha1)
                    data = pack.compress(record(page_id, url, html or b"", digest, first)) + pack.flush()
                    out.write(data)
                    rows.append((name, offset, len(data), url, digest, page_id))
                    offset += len(data)
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=["file", "offset", "length", "url", "digest", "page_id"])
        finally:
            if out is not None:
                out.close()

    return run


def write_pages(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes the archives into folder and returns their index."""
    spark = pages.sparkSession
    _shared.prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"), F.unhex(F.sha1(body)).alias("sha1"))
    firsts = rows.filter(F.octet_length("html") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n")
    firsts = _shared.written(firsts, "warc-firsts")
    right = F.broadcast(firsts) if firsts.count() <= BROADCAST_DIGESTS else firsts
    joined = rows.join(right, "sha1", "left").select("page_id", "url", "html", "sha1", F.when(~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("html") >= min_bytes), F.col("first")).alias("first"))
    return _shared.written(joined.mapInArrow(_write(folder), INDEX), "warc-index")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        name, source = None, None
        try:
            for batch in batches:
                files = batch.column(0).to_pylist()
                at, size = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                rows, i = [], 0
                while i < len(files):
                    j, end = i + 1, at[i] + size[i]
                    while j < len(files) and files[j] == files[i] and at[j] - end <= GAP_BYTES and at[j] + size[j] - at[i] <= READ_BYTES:
                        end, j = at[j] + size[j], j + 1
                    if files[i] != name:
                        if source is not None:
                            source.close()
                        name, source = files[i], fs.open_input_file(f"{root}/{files[i]}")
                    source.seek(int(at[i]))
                    data = source.read(int(end - at[i]))
                    for k in range(i, j):
                        a = int(at[k] - at[i])
                        warc, payload, http = parse(zlib.decompress(data[a : a + int(size[k])], wbits=31))
                        digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = warc["WARC-Type"]
                        if kind == "response" and base32(hashlib.sha1(payload).digest()) != digest:
                            raise ValueError(f"payload of {warc['WARC-Record-ID']} does not match its digest")
                        number = lambda key: int(warc[key]) if key in warc else None
                        rows.append((number("X-Page-Id"), int(http["Content-Length"]), digest, kind, number("X-Refers-To-Page-Id"), warc["WARC-Target-URI"], payload if kind == "response" else None))
                    i = j
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                for a in range(0, len(rows), 50):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[a : a + 50], strict=True), types, strict=True)], names=_RECORD)
        finally:
            if source is not None:
                source.close()

    return run


_RECORD = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the index's rows, with payloads (null for a revisit)."""
    _shared.prepare(index.sparkSession)
    block = F.expr(f"offset div {BLOCK_BYTES}")
    total = index.agg(F.sum("length")).first()[0] or 0  # tasks by what they read, not by the few bytes of their index rows
    ranges = index.select("file", "offset", "length").repartition(max(1, -(-total // BLOCK_BYTES)), "file", block).sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(_read(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    folder = _shared.work_dir(pages.sparkSession, "warc")
    return read_records(write_pages(pages, folder, min_bytes), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
