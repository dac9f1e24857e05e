"""Incremental annotation updates. Up-propagation keeps the highest score, so late and repeated rows change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def best_scores(annotations: DataFrame, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """window, protein_id, term_id, score: the highest score of each pair in each window of loaded_at; later rows than the delay are dropped."""
    rows = annotations.withWatermark("loaded_at", delay).groupBy(F.window("loaded_at", window), "protein_id", "term_id").agg(F.max("score").alias("score"))
    return rows.select(F.col("window.start").alias("since"), "protein_id", "term_id", "score")
