"""BAM files.  Each file is one task: its blocks are unpacked in turn, so memory holds a few records, not the file's text."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "qname string, flag long, rname string, pos long, mapq long, cigar string, rnext string, pnext long, tlen long, seq string, qual string"
# fixed values: letters of packed bases and of alignment operations
_BASES, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"


def _unpacked(raw: bytes) -> Iterator[bytes]:
    """The members of a blocked gzip file."""
    while raw:
        d = zlib.decompressobj(wbits=31)
        yield d.decompress(raw)
        raw = d.unused_data


def records(raw: bytes) -> Iterator[tuple]:
    buffer, blocks = bytearray(), _unpacked(raw)

    def need(n: int) -> bool:
        while len(buffer) < n:
            more = next(blocks, None)
            if more is None:
                return False
            buffer.extend(more)
        return True

    def take(n: int) -> bytes:
        if not need(n):
            raise ValueError("the file ends within a record")
        out = bytes(buffer[:n])
        del buffer[:n]
        return out

    if take(4) != b"BAM\1":
        raise ValueError("no BAM file")
    take(struct.unpack("<i", take(4))[0])
    names = []
    for _ in range(struct.unpack("<i", take(4))[0]):
        names.append(take(struct.unpack("<i", take(4))[0])[:-1].decode())
        take(4)
    name = lambda i: names[i] if i >= 0 else "*"
    while need(4):
        rec = take(struct.unpack("<i", take(4))[0])
        ref, pos, l_name, mapq, _, n_ops, flag, l_seq, mate, mate_pos, tlen = struct.unpack("<iiBBHHHiiii", rec[:32])
        at = 32 + l_name
        qname = rec[32 : at - 1].decode()
        ops = struct.unpack(f"<{n_ops}I", rec[at : at + 4 * n_ops])
        at += 4 * n_ops
        packed = rec[at : at + (l_seq + 1) // 2]
        at += len(packed)
        seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:l_seq] or "*"
        qual = rec[at : at + l_seq]
        shown = "*" if not qual or qual[0] == 255 else bytes(q + 33 for q in qual).decode()
        cigar = "".join(f"{x >> 4}{_OPS[x & 15]}" for x in ops) or "*"
        rnext = "*" if mate < 0 else "=" if mate == ref else name(mate)
        yield qname, flag, name(ref), pos + 1, mapq, cigar, rnext, mate_pos + 1, tlen, seq, shown


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.string() for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                rows = []
                for r in records(raw.as_py()):
                    rows.append(r)
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


bam = read_bam
