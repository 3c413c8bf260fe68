"""Tables that a query writes once and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(1)
def _local() -> str:
    return tempfile.mkdtemp(prefix="skein-core-")


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where it is unset, a temporary folder of our own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{_local()}"


def staged(df: DataFrame, label: str) -> DataFrame:
    path = f"{folder(df.sparkSession)}/skein-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
