"""Ontology operators over terms(go_id, go_namespace, alt_id, is_obsolete) and links(child, parent)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from funweave.functions.text import norm_id
from funweave.operators import hierarchy as hi


def resolve(rows: DataFrame, terms: DataFrame, column: str = "term_id") -> DataFrame:
    """Rows with alternate ids replaced by the terms that list them; unknown ids are dropped."""
    alts = terms.select(F.explode("alt_id").alias("name"), "go_id")
    names = terms.select(F.col("go_id").alias("name"), "go_id", F.lit(0).alias("alt")).union(alts.select("name", "go_id", F.lit(1)))
    names = names.groupBy("name").agg(F.min_by("go_id", F.struct("alt", "go_id")).alias("resolved"))
    key = norm_id(F.col(column)).alias("name")
    return rows.withColumn("name", key).join(names, "name").withColumn(column, F.col("resolved")).drop("name", "resolved")


def same_domain(links: DataFrame, terms: DataFrame) -> DataFrame:
    """The links whose ends lie in one namespace."""
    c, p = terms.select(F.col("go_id").alias("child"), F.col("go_namespace").alias("a")), terms.select(F.col("go_id").alias("parent"), F.col("go_namespace").alias("b"))
    return links.join(c, "child").join(p, "parent").filter("a = b").select("child", "parent")


def ancestors(terms: DataFrame, links: DataFrame) -> DataFrame:
    """term_id, ancestor (without the term itself) over links that lie on no loop."""
    nodes = terms.filter("go_id is not null").select(F.col("go_id").alias("term"))
    return hi.closure(hi.acyclic(nodes, links)).toDF("term_id", "ancestor")


def up_propagate(annotations: DataFrame, closure: DataFrame) -> DataFrame:
    """Each protein's score on a term and on all its ancestors; the highest wins. Monotone and idempotent."""
    up = annotations.join(closure, "term_id").select("protein_id", F.col("ancestor").alias("term_id"), "score")
    return annotations.select("protein_id", "term_id", "score").union(up).groupBy("protein_id", "term_id").agg(F.max("score").alias("score"))


def information_content(annotations: DataFrame) -> DataFrame:
    """term_id, ic = -log2(pairs of the term / all pairs)."""
    counts = annotations.groupBy("term_id").agg(F.count("*").alias("n"))
    total = annotations.agg(F.count("*").alias("n_all"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("term_id", (-F.log2(F.col("n") / F.col("n_all"))).alias("ic"))


def popularity(annotations: DataFrame, terms: DataFrame, least: int = 3) -> DataFrame:
    """By namespace: proteins, terms and popular terms (with at least so many proteins)."""
    rows = annotations.join(terms.select(F.col("go_id").alias("term_id"), F.col("go_namespace").alias("domain")), "term_id")
    per = rows.groupBy("domain", "term_id").agg(F.countDistinct("protein_id").alias("n"))
    by_term = per.groupBy("domain").agg(F.count("*").alias("n_terms"), F.count_if(F.col("n") >= least).alias("n_popular"))
    return rows.groupBy("domain").agg(F.countDistinct("protein_id").alias("n_proteins")).join(by_term, "domain")
