"""Tables written to the folder that all executors share (spark.checkpoint.dir), to cut the lineage of loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, from the session; only on one machine, where it is unset, a temporary folder stands in for it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lociframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df as written to the shared folder, in at most four files for each core; what reads it survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lociframe/settled-{uuid.uuid4().hex}"
    df.coalesce(4 * max(1, spark.sparkContext.defaultParallelism)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
