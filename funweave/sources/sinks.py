"""Sinks: text and parquet tables, and stages that are resumed if they exist."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from funweave.operators.strict_load import GAF_COLUMNS


def write_tsv(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=header)


def write_evalues(hits: DataFrame, path: str) -> None:
    """query, target, evalue and the sorted terms of each hit, parted by tabs."""
    rows = hits.groupBy("protein_id", "target", "evalue").agg(F.array_join(F.array_sort(F.collect_set("term_id")), "\t").alias("terms"))
    rows.select(F.concat_ws("\t", "protein_id", "target", F.col("evalue").cast("string"), "terms")).write.mode("overwrite").text(path)


def write_clamp(annotations: DataFrame, path: str) -> None:
    write_tsv(annotations.select("protein_id", "term_id").distinct(), path)


def write_by(df: DataFrame, column: str, path: str, kind: str = "csv") -> None:
    """One folder for each value: sequences by taxon, hits by query, annotations by evidence code."""
    df.write.mode("overwrite").partitionBy(column).format(kind).save(path)


def write_fasta(records: DataFrame, path: str, width: int = 60) -> None:
    """Records header, seq with sequences broken into lines."""
    lines = F.rtrim(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"))
    records.select(F.concat(F.lit(">"), "header", F.lit("\n"), lines)).write.mode("overwrite").text(path)


def write_gaf(annotations: DataFrame, path: str) -> None:
    """Annotation rows with all their columns, parted by tabs, nulls empty."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in GAF_COLUMNS]
    annotations.select(F.concat_ws("\t", *cols)).write.mode("overwrite").text(path)


def write_pairs(kernel: DataFrame, path: str) -> None:
    """The pairs p1 < p2 of a kernel or graph with their weight."""
    write_tsv(kernel.filter("p1 < p2"), path)


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def stage(spark: SparkSession, folder: str, name: str, config: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The stage's table, made only if none was written for the same configuration."""
    key = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]
    path = f"{folder}/{name}-{key}.parquet"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
