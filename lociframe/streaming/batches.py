"""Bounded streams are lazy DataFrames; unbounded ones Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import ordinal


def to_stream(df: DataFrame) -> DataFrame:
    return df


def stream_chunks(df: DataFrame, order, n: int) -> DataFrame:
    """(chunk, rows): arrays of n rows, in order."""
    numbered = ordinal(df, order, "__n")
    chunk = F.floor((F.col("__n") - 1) / n).cast("long").alias("chunk")
    rows = F.array_sort(F.collect_list(F.struct("__n", F.struct(*df.columns).alias("row"))))
    return numbered.groupBy(chunk).agg(F.transform(rows, lambda r: r["row"]).alias("rows"))


def stream_take(df: DataFrame, order, n: int) -> DataFrame:
    return df.orderBy(*([order] if isinstance(order, str) else order)).limit(n)


def stream_skip(df: DataFrame, order, n: int) -> DataFrame:
    return ordinal(df, order, "__n").filter(F.col("__n") > n).drop("__n")


def stream_batch(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """fn over Arrow-fed pandas batches."""
    return df.mapInPandas(fn, schema)


def stream_concat(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionAll(b)


def tee(df: DataFrame, path: str) -> DataFrame:
    """Writes df and goes on with what was written."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tap(df: DataFrame, fn: Callable) -> DataFrame:
    fn(df)
    return df


inspect = tap


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], late: str | None = None, **aggs) -> DataFrame:
    """Aggregates of fixed windows; late: how long late rows are waited for (streams only)."""
    df = df.withWatermark(time, late) if late else df
    out = df.groupBy(F.window(time, width), *keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggs)


def sliding(df: DataFrame, time: str, width: str, step: str, keys: list[str], late: str | None = None, **aggs) -> DataFrame:
    df = df.withWatermark(time, late) if late else df
    out = df.groupBy(F.window(time, width, step), *keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggs)


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], late: str | None = None, **aggs) -> DataFrame:
    df = df.withWatermark(time, late) if late else df
    out = df.groupBy(F.session_window(time, gap), *keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, *aggs)


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream until its present input is used up."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()
