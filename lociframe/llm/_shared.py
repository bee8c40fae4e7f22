"""Helpers that several training-data operators share: shared work folders, written tables, flat text batches, hashing and
connected components."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
#: Rows in an Arrow batch handed to Python.  Texts average a few KB, so a batch stays at a few MB.
BATCH_ROWS = 1000
#: Bytes of text that one numpy pass works on; a longer document is a pass of its own.
CHUNK_BYTES = 1 << 19


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lociframe-")  # one machine only: tests and trials
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lociframe/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, files_per_core: int | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: the lineage ends there, lost executors or not.  With
    files_per_core a task takes several partitions in turn, so that a by-product is no heap of tiny files, whatever the
    shuffle's partitions."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    if files_per_core:
        df = df.coalesce(files_per_core * max(1, spark.sparkContext.defaultParallelism))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what written() wrote for df, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows, and lets Python workers that share this machine's files import this library; on a
    cluster it is installed or sent with --py-files."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def release() -> None:
    """Gives memory that a finished task has freed back to the machine: the Python worker lives on, idle, beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only the C library of Linux has it
        ctypes.CDLL(None).malloc_trim(0)


def quoted(name: str) -> str:
    """A column name as Spark's parser takes it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def unused(name: str, taken: list[str]) -> str:
    """name, with underscores before it until no other column has it, whatever the case."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name = "_" + name
    return name


def with_results(docs: DataFrame, kept: list[str], results: str) -> T.StructType:
    """Schema of the kept columns and the results (a DDL string), whose names must differ."""
    made = T.StructType.fromDDL(results)
    clash = {c.lower() for c in kept} & {f.name.lower() for f in made}
    if clash:
        raise ValueError(f"kept columns have the names of results: {sorted(clash)}; give other names")
    return T.StructType([docs.schema[c] for c in kept] + made.fields)


def fold_of(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def hash_share(id_col: str, seed: str) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    mixed = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"))
    return (F.shiftrightunsigned(mixed, 11)).cast("double") / F.lit(float(1 << 53))


#: Rows of a sample of labelled documents, over all labels.
SAMPLE_ROWS = 20_000


def labelled_sample(df: DataFrame, label: str, cap: int, seed: str) -> DataFrame:
    """About cap rows for each value of label (all, where there are fewer), picked by a hash of doc_id.  Counts the labels
    first, without reading texts; then only the picked rows reach the driver."""
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    cap = min(cap, SAMPLE_ROWS / max(1, len(sizes)))
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, cap / n))).otherwise(share)
    return df.filter(hash_share("doc_id", seed) < share)


# ---------------------------------------------------------------- flat text batches


def utf8_parts(col: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a string column, in parts of about size bytes; nulls are empty."""
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    n = len(col)
    if n == 0:
        return
    off = np.frombuffer(col.buffers()[1], dtype=np.int64, count=n + 1 + col.offset)[col.offset :]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(off, off[at] + size, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end, raw[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values (wraps around)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 1)
        for key, base in (("up", _ODD), ("down", _ODD_INVERSE)):
            steps = np.full(size, U64(base), dtype=U64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def _byte_codes() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))


_CODES = _byte_codes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The white space that ends a word: x20 and x09 to x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each raw[start:end], by prefix sums of a polynomial in an odd base (mod 2**64), then mixed."""
    n = len(raw)
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, dtype=U64)
        np.cumsum(_CODES[raw] * up[:n], out=prefix[1:])
        value = (prefix[ends] - prefix[starts]) * down[starts]
        return mix64(value + mix64((ends - starts).astype(U64)))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and owning row of the words `[^\\x20\\x09-\\x0D]+` of each raw[offsets[i]:offsets[i+1]]."""
    inside = ~IS_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(raw)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    back = edges[edges > 0] - 1
    last[back] = inside[back]
    ends = np.flatnonzero(last) + 1
    owner = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, owner


# ---------------------------------------------------------------- connected components


#: Up to so many edges (16 bytes each) a step of components() is one plan; beyond, minima are written before they are joined.
PLAIN_EDGES = 1_000_000


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.  edges: (a, b) longs.  Returns (node,
    component_id), component_id the smallest node that links reach; nodes without an edge do not appear.  Each round is
    written to the shared folder and superseded tables are deleted; the number of rounds grows with the logarithm of the
    longest path.  Beyond PLAIN_EDGES minima are written before they are joined back, so both sides of each join are plain
    scans, and adaptive execution may split the rows of a node of many edges among tasks."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}-e", 1)
    before = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, old = now, [e]

        def kept(df: DataFrame, part: str, edges: int = now[0], old: list = old) -> DataFrame:
            if edges <= PLAIN_EDGES:
                return df
            old.append(written(df, f"{name}-{part}", 1))
            return old[-1]

        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        large = kept(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        # small star: u and its smaller neighbours go to the smallest of them
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-e", 1)
        for df in old:
            discard(df)
    return e.groupBy("u").agg(F.min("v").alias("component_id")).withColumnRenamed("u", "node").union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
    )
