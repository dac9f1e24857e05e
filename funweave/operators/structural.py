"""Selection and function transfer of structure-search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def covered(a: str, b: str, n: str) -> Column:
    """(b - a + 1) / n, not below 0; 0 if the length is 0."""
    return F.when(F.col(n) == 0, 0.0).otherwise(F.greatest(F.col(b) - F.col(a) + 1, F.lit(0)) / F.col(n))


def select_hits(hits: DataFrame, evalue: float = 1e-5, coverage: float = 0.7, tm: float = 0.5, top_k: int = 50) -> DataFrame:
    """The first top_k targets of each query in the order of row_no, each once, that pass the gates; the structure score
    counts only for queries that have any."""
    rows = hits.withColumn("avg_tm", (F.col("qtmscore") + F.col("ttmscore")) / 2)
    any_tm = rows.groupBy("query").agg(F.bool_or(F.col("avg_tm").isNotNull()).alias("has_tm"))
    good = rows.join(any_tm, "query").filter(
        (F.col("evalue") <= evalue) & (covered("qstart", "qend", "qlen") >= coverage) & (covered("tstart", "tend", "tlen") >= coverage)
        & (~F.col("has_tm") | (F.coalesce("avg_tm", F.lit(0.0)) >= tm))
    )
    first = good.groupBy("query", "target").agg(F.min("row_no").alias("row_no"), F.min_by("evalue", "row_no").alias("evalue"))
    at = F.row_number().over(W.partitionBy("query").orderBy("row_no", "target"))
    return first.withColumn("at", at).filter(F.col("at") <= top_k)


def support(accepted: DataFrame, target_ipr: DataFrame) -> DataFrame:
    """query, interpro, n: accepted hits that carry the domain."""
    return accepted.join(target_ipr, "target").groupBy("query", "interpro").agg(F.count("*").alias("n"))


def assignments(supported: DataFrame, ipr2go: DataFrame) -> DataFrame:
    """protein_id, term_id, interpro, score 1, distinct."""
    return supported.join(ipr2go, "interpro").select(F.col("query").alias("protein_id"), "term_id", "interpro").distinct().withColumn("score", F.lit(1.0))


def with_fallback(structural: DataFrame, sequence: DataFrame) -> DataFrame:
    """The hits of the structure search, and those of the sequence search for queries that have none there; source says which."""
    rest = sequence.join(structural.select("query").distinct(), "query", "left_anti")
    return structural.withColumn("source", F.lit("structure")).unionByName(rest.withColumn("source", F.lit("sequence")))


def propagated(assigned: DataFrame, closure: DataFrame) -> DataFrame:
    """protein_id, term_id, interpro, score: the assigned terms and all above them; a term keeps the domains it was
    assigned by, one row for each, and has an empty one if it was only reached from below."""
    own = assigned.select("protein_id", "term_id", "score")
    up = own.join(closure, "term_id").select("protein_id", F.col("ancestor").alias("term_id"), "score")
    terms = own.union(up).groupBy("protein_id", "term_id").agg(F.max("score").alias("score"))
    by = assigned.select("protein_id", "term_id", "interpro").distinct()
    return terms.join(by, ["protein_id", "term_id"], "left").withColumn("interpro", F.coalesce("interpro", F.lit(""))).select("protein_id", "term_id", "interpro", "score")


def transfer(hits: DataFrame, target_ipr: DataFrame, ipr2go: DataFrame, closure: DataFrame, least: int = 1, **gates: float) -> DataFrame:
    """From hits to assignments: gates, domains of the accepted targets with enough support, their terms, and the terms above.

    target_ipr: target, interpro; ipr2go: interpro, term_id; closure: term_id, ancestor."""
    accepted = select_hits(hits, **gates).select("query", "target")
    supported = support(accepted, target_ipr.distinct()).filter(F.col("n") >= least)
    return propagated(assignments(supported, ipr2go), closure)
