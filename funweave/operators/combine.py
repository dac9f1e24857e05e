"""Combining and comparing score tables protein_id, term_id, score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

KEYS = ["protein_id", "term_id"]


def weighted_sum(seeds: list[DataFrame], coefficients: list[float] | None = None) -> DataFrame:
    """The linear combination of seeds; coefficients default to equal shares, duplicates sum."""
    coef = coefficients or [1 / len(seeds)] * len(seeds)
    if len(coef) != len(seeds):
        raise ValueError("one coefficient for each seed")
    rows = reduce(DataFrame.unionByName, [s.select(*KEYS, (F.lit(c) * F.col("score")).alias("score")) for s, c in zip(seeds, coef)])
    return rows.groupBy(*KEYS).agg(F.sum("score").alias("score"))


def clamp(seed: DataFrame, truth: DataFrame) -> DataFrame:
    """The greater score of both tables."""
    return seed.select(*KEYS, "score").unionByName(truth.select(*KEYS, "score")).groupBy(*KEYS).agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))


def top_n(predictions: DataFrame, n: int) -> DataFrame:
    """The n best terms of each protein with their rank; equal scores go by the term. Partial limits come before the shuffle."""
    at = F.row_number().over(W.partitionBy("protein_id").orderBy(F.desc("score"), "term_id"))
    return predictions.withColumn("rank_no", at).filter(F.col("rank_no") <= n)


def pairwise_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """score_a, score_b, delta over the pairs of either table, missing scores 0."""
    rows = a.toDF(*KEYS, "score_a").join(b.toDF(*KEYS, "score_b"), KEYS, "full").na.fill(0.0, ["score_a", "score_b"])
    return rows.withColumn("delta", F.col("score_b") - F.col("score_a"))


def extremes(deltas: DataFrame, n: int = 10) -> DataFrame:
    """The n greatest gains and the n greatest losses of pairwise_delta, with rank_no and side; ties go by protein and term."""
    up = deltas.orderBy(F.desc("delta"), *KEYS).limit(n).withColumn("side", F.lit("gain"))
    down = deltas.orderBy("delta", *KEYS).limit(n).withColumn("side", F.lit("loss"))
    at = F.row_number().over(W.partitionBy("side").orderBy(F.desc(F.abs("delta")), *KEYS))  # 2 n rows
    return up.unionByName(down).withColumn("rank_no", at)


def method_table(seeds: dict[str, DataFrame]) -> DataFrame:
    """protein_id, term_id, method, score of several runs over their common universe, in long form, zeros left out."""
    return reduce(DataFrame.unionByName, [s.select(*KEYS, F.lit(m).alias("method"), "score") for m, s in seeds.items()]).filter("score <> 0")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """protein_id, n_common, n_union, jaccard of the term sets of two runs."""
    marked = a.select(*KEYS, F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select(*KEYS, F.lit(0), F.lit(1)))
    pairs = marked.groupBy(*KEYS).agg((F.max("x") + F.max("y")).alias("n"))
    per = pairs.groupBy("protein_id").agg(F.count_if(F.col("n") == 2).alias("n_common"), F.count("*").alias("n_union"))
    return per.withColumn("jaccard", F.col("n_common") / F.col("n_union"))


def rescore(predictions: DataFrame, links: DataFrame, th: float) -> DataFrame:
    """Terms all of whose predicted children score more than the term's score + th."""
    kids = predictions.toDF("protein_id", "child", "child_score").join(links, "child").withColumnRenamed("parent", "term_id")
    bad = predictions.join(kids, KEYS).filter(F.col("child_score") <= F.col("score") + th).select(*KEYS).distinct()
    return predictions.join(bad, KEYS, "left_anti")


def run_summary(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        F.countDistinct("protein_id").alias("n_proteins"), F.countDistinct("term_id").alias("n_terms"), F.count("*").alias("n_rows"),
        F.min("score").alias("min_score"), F.median("score").alias("median_score"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"),
    )


def score_pivot(rows: DataFrame, terms: list[str]) -> DataFrame:
    """protein_id and a column for each listed term, missing scores 0."""
    return rows.groupBy("protein_id").pivot("term_id", terms).agg(F.sum("score")).na.fill(0.0)
