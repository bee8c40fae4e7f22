"""Lempel-Ziv phrase fingerprints.

A text is read as symbols (up to four bytes of a word) and parsed into phrases: each phrase is the shortest run of symbols
that the dictionary does not hold yet (LZ78).  The fingerprint holds the K smallest hashes of the phrase set; of two
fingerprints, the share of the K smallest hashes of both sets together that both hold estimates the Jaccard similarity of
the sets, exactly where they have no more than K phrases.

Null and empty texts have an empty fingerprint; two empty ones are alike (1.0).  Repeated ids follow each other in the
order of their texts; rows without an id come last; very long texts are parsed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared

#: Hashes in a fingerprint.
K = 128
_PRIME = (1 << 61) - 1
_BASE = 0x9E3779B1
_EMPTY = np.zeros(0, dtype=np.uint64)


def symbols(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, their end bytes): words in pieces of four bytes; the first piece of a word is marked."""
    b = np.frombuffer(raw, dtype=np.uint8)
    if not len(b):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = np.r_[False, ~_shared.IS_SPACE[b], False]
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    pieces = (ends - starts + 3) // 4
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = np.repeat(starts, pieces) + 4 * nth
    end = np.minimum(at + 4, np.repeat(ends, pieces))
    wide = np.r_[b, np.zeros(4, np.uint8)].astype(np.int64)
    value = wide[at]
    for k in (1, 2, 3):
        value |= np.where(at + k < end, wide[at + k], 0) << (8 * k)
    return value | (nth == 0).astype(np.int64) << 32 | (end - at) << 33, end


def parse(tokens: list[int], phrases: set[int], h: int = 0) -> int:
    """Adds the phrases of tokens; h is the hash of an open phrase, before and after."""
    add = phrases.add
    for t in tokens:
        h = (h * _BASE + t) % _PRIME
        if h not in phrases:
            add(h)
            h = 0
    return h


def smallest(phrases: set[int], k: int = K) -> np.ndarray:
    """The k smallest 32-bit hashes of a phrase set, sorted."""
    if not phrases:
        return _EMPTY
    h = _shared.mix64(np.fromiter(phrases, np.uint64, len(phrases))) >> np.uint64(32)
    if len(h) > 4 * k:
        h = h[h <= np.partition(h, 3 * k)[3 * k]]
    return np.unique(h)[:k]


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    fresh = np.r_[True, ~twice]
    limit = np.flatnonzero(fresh)[:k]
    shared = np.r_[twice, False][limit]
    return float(shared.sum() / len(limit))


def shown(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    """The hashes of a fingerprint string."""
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u4").astype(np.uint64)


def fingerprint(text: str | None, k: int = K) -> str:
    phrases: set[int] = set()
    tokens = symbols((text or "").encode("utf-8", "surrogatepass"))[0].tolist()
    h = parse(tokens, phrases)
    if h:
        phrases.add(h)
    return shown(smallest(phrases, k))


@dataclass
class _Open:
    """A document whose next one has not come yet."""

    doc_id: int | None
    text: str
    sketch: np.ndarray
    kept: int  # symbols before the cut
    phrases: set[int]  # of those
    h: int


def _begin(doc_id: int | None, text: str) -> _Open:
    tokens, ends = symbols(text.encode("utf-8", "surrogatepass"))
    cut = len(text[: len(text) - len(text) // 2].encode("utf-8", "surrogatepass"))
    kept = int(np.searchsorted(ends, cut))  # symbols that end before the cut are the edited text's too
    values = tokens.tolist()
    phrases: set[int] = set()
    h = parse(values[:kept], phrases)
    whole = set(phrases)
    last = parse(values[kept:], whole, h)
    if last:
        whole.add(last)
    return _Open(doc_id, text, smallest(whole), kept, phrases, h)


def _finish(doc: _Open, next_text: str, next_sketch: np.ndarray) -> list:
    n = len(doc.text)
    edited = doc.text[: n - n // 2] + next_text[: n // 2]
    raw = edited.encode("utf-8", "surrogatepass")
    tokens, _ = symbols(raw)
    phrases = doc.phrases
    h = parse(tokens[doc.kept :].tolist(), phrases, doc.h)
    if h:
        phrases.add(h)
    sketch = smallest(phrases)
    return [doc.doc_id, n, hashlib.sha256(raw).hexdigest(), shown(doc.sketch), shown(sketch), likeness(doc.sketch, sketch), likeness(doc.sketch, next_sketch)]


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, sent, doc_id, text), sorted; the sent row behind a bucket only serves as the next of its last row."""
    open_doc, bucket = None, None
    for batch in batches:
        rows = []
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            for b, sent, doc_id, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket != b:
                    open_doc, bucket = None, b
                if sent and open_doc is None:
                    continue
                doc = _begin(doc_id, text or "")
                if open_doc is not None:
                    rows.append(_finish(open_doc, doc.text, doc.sketch))
                open_doc = None if sent else doc
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_COLUMNS)


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text (the second half replaced by the beginning of the next document in
    descending order of ids; after the last comes the first), and how alike the text is to both.

    Ids are cut into ranges of like counts; each range is a group of its own, and the first document of the range below
    joins it as the next of its last one.  So texts move once, and no task needs more than its ranges in order."""
    spark = docs.sparkSession
    _shared.prepare(spark)
    low = -(1 << 63)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("at", F.coalesce("doc_id", F.lit(low)))
    ranges = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("at", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    splits = [float("-inf"), *sorted({float(c) for c in cuts}), float("inf")]
    if len(splits) < 3:
        splits.insert(1, 0.0)
    deal = Bucketizer(splits=splits, inputCol="place", outputCol="bucket")
    placed = deal.transform(rows.withColumn("place", F.col("at").cast("double"))).drop("place").withColumn("bucket", F.col("bucket").cast("int"))
    tops = sorted(tuple(r) for r in placed.groupBy("bucket").agg(F.max("at").alias("top")).collect())
    heads = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    heads_df = spark.createDataFrame(heads, "at long, goes_to int")
    both = placed.join(F.broadcast(heads_df), "at", "left")
    sent = F.explode(F.when(F.col("goes_to").isNull(), F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("sent")))).otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("sent")), F.struct(F.col("goes_to").alias("bucket"), F.lit(True).alias("sent")))))
    dealt = both.select(sent.alias("to"), "at", "doc_id", "text").select("to.bucket", "to.sent", "at", "doc_id", "text")
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "sent", F.desc("at"), "text").select("bucket", "sent", "doc_id", "text")
    return ordered.mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
