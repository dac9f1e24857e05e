"""Lineage cuts: tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one of our own, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="funweave-"))


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """df, written as parquet to the shared folder and read back; a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/funweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
