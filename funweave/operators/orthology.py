"""Best hits, orthologs and edge transfer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def best_hits(hits: DataFrame, as_text: bool = False) -> DataFrame:
    """The row with the least e-value of each query, by aggregation; of ties the last row_no, then the least target. as_text compares e-values as strings."""
    e = F.col("evalue").cast("string") if as_text else F.col("evalue")
    best = hits.groupBy("query").agg(F.min_by(F.struct(*hits.columns), F.struct(e, -F.col("row_no"), "target")).alias("b"))
    return best.select("b.*")


def reciprocal(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """query, target, and the e-values and scores of both directions, where each is the other's best hit."""
    b = backward.select(F.col("query").alias("target"), F.col("target").alias("query"), F.col("evalue").alias("target_evalue"), F.col("pident").alias("target_pi"))
    f = forward.select("query", "target", F.col("evalue").alias("query_evalue"), F.col("pident").alias("query_pi"))
    return f.join(b, ["query", "target"]).withColumn("pos", F.sqrt(F.col("query_pi") * F.col("target_pi")))


def coverage(hits: DataFrame, as_coded: bool = True) -> DataFrame:
    """hits with perc; as_coded keeps the known slip of precedence, which leaves nearly every hit valid."""
    q = (100 * F.col("qend") - F.col("qstart") / F.col("qlen")) if as_coded else (100 * (F.col("qend") - F.col("qstart") + 1) / F.col("qlen"))
    return hits.withColumn("perc", q)


def valid_orthologs(orthologs: DataFrame, max_evalue: float = 1e-6, perc: float = 80.0, positives: float = 60.0) -> DataFrame:
    """The orthologs with an e-value of the query below the bound, enough of both sequences covered and enough positives; a null fails."""
    ok = (F.col("query_evalue") < max_evalue) & (F.col("target_perc") >= perc) & (F.col("query_perc") >= perc) & (F.col("pos") >= positives)
    return orthologs.filter(ok)


def transfer_edges(
    links: DataFrame, orthologs: DataFrame, channels: list[str], least: int = 3, blacklist: DataFrame | None = None, validity: dict[str, float] | None = None
) -> DataFrame:
    """p1 < p2, the summed channels and, with validity, max_evalue: links of every organism with at least so many
    orthologs, mapped to the queries.

    links: organism_id, a, b, channels; orthologs: organism_id, query, target, and query_evalue, query_perc, target_perc,
    pos if validity (the bounds of valid_orthologs) is given; blacklist: tax_id. Edges without a positive channel and
    self-edges are dropped; weights sum over organisms and both directions. Invalid orthologs count for `least`, but map nothing.
    """
    many = orthologs.groupBy("organism_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    usable = orthologs.join(many, "organism_id")
    if blacklist is not None:
        usable = usable.join(blacklist.select(F.col("tax_id").cast("string").alias("tax_id")), F.col("organism_id").cast("string") == F.col("tax_id"), "left_anti")
    extra = []
    if validity is not None:
        usable, extra = valid_orthologs(usable, **validity), ["query_evalue"]
    side = lambda t, q, e: usable.select("organism_id", F.col("target").alias(t), F.col("query").alias(q), *(F.col(c).alias(e) for c in extra))
    rows = links.filter(reduce(lambda s, t: s | t, [F.col(c) > 0 for c in channels]))
    rows = rows.join(side("a", "qa", "ea"), ["organism_id", "a"]).join(side("b", "qb", "eb"), ["organism_id", "b"]).filter("qa <> qb")
    worst = [F.max(F.greatest("ea", "eb")).alias("max_evalue")] if extra else []
    return rows.groupBy(F.least("qa", "qb").alias("p1"), F.greatest("qa", "qb").alias("p2")).agg(*(F.sum(c).alias(c) for c in channels), *worst)


def ortholog_table(forward: DataFrame, backward: DataFrame, as_coded: bool = True) -> DataFrame:
    """query, target, both e-values and coverages, and pos of the reciprocal best hits of two searches in BLAST columns
    (query, subject, pident, qstart, qend, evalue, qlen) with row_no."""
    best = lambda h: best_hits(coverage(h.withColumnRenamed("subject", "target"), as_coded))
    f, b = best(forward), best(backward)
    back = b.select(F.col("query").alias("target"), F.col("target").alias("query"), F.col("evalue").alias("target_evalue"), F.col("perc").alias("target_perc"), F.col("pident").alias("target_pi"))
    rows = f.select("query", "target", F.col("evalue").alias("query_evalue"), F.col("perc").alias("query_perc"), F.col("pident").alias("query_pi")).join(back, ["query", "target"])
    return rows.withColumn("pos", F.sqrt(F.col("query_pi") * F.col("target_pi")))
