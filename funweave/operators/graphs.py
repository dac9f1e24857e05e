"""Graphs as edge tables p1 < p2; a missing edge is 0."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from funweave.scratch import cut

BLOCK = 8192  # classes of equal term sets that one side of a task holds


def canonical(edges: DataFrame, weight: str = "score") -> DataFrame:
    """p1 < p2, weight: ends in order, self-edges dropped, duplicates summed."""
    return edges.filter("p1 <> p2").groupBy(F.least("p1", "p2").alias("p1"), F.greatest("p1", "p2").alias("p2")).agg(F.sum(weight).alias(weight))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, as i, j, w."""
    e = edges.select(F.col("p1").alias("i"), F.col("p2").alias("j"), F.col(edges.columns[2]).alias("w"))
    return e.union(e.select("j", "i", "w"))


def within(edges: DataFrame, proteins: DataFrame) -> DataFrame:
    """The edges with both ends in the index."""
    ends = proteins.select("protein_id")
    return edges.join(ends.toDF("p1"), "p1", "left_semi").join(ends.toDF("p2"), "p2", "left_semi").select(edges.columns)


def homology(hits: DataFrame, default: bool = False) -> tuple[DataFrame, float]:
    """Edges of the homology graph and the weight of pairs without a hit.

    e is the greater of the least e-values of both directions, a missing one 10; w = 1 if e = 0, -ln(e / 11) below
    11, else 0; all weights but 1 are divided by their greatest. hits: query, subject, evalue.
    """
    least = hits.groupBy("query", "subject").agg(F.min("evalue").alias("e")).filter("query <> subject")
    both = least.select(F.least("query", "subject").alias("p1"), F.greatest("query", "subject").alias("p2"), "e")
    pairs = both.groupBy("p1", "p2").agg(F.when(F.count("*") == 2, F.max("e")).otherwise(F.greatest(F.max("e"), F.lit(10.0))).alias("e"))
    raw = pairs.withColumn("w", F.when(F.col("e") == 0, 1.0).when(F.col("e") < 11, -F.ln(F.col("e") / 11)).otherwise(0.0))
    top = raw.agg(F.max(F.when(F.col("w") != 1, F.col("w"))).alias("top"))  # one row
    none = -math.log(10 / 11)
    edges = raw.crossJoin(F.broadcast(top)).select("p1", "p2", F.when(F.col("w") == 1, 1.0).otherwise(F.col("w") / F.greatest(F.coalesce("top", F.lit(none)), F.lit(none))).alias("score"))
    most = (top.collect()[0][0] or none) if default else none
    return edges, none / max(most, none) if default else 0.0


def binarised(seed: DataFrame, tau: float = 0.2) -> DataFrame:
    """protein_id, term_id of the pairs above tau of the greatest score."""
    top = seed.agg(F.max("score").alias("top"))  # one row
    return seed.crossJoin(F.broadcast(top)).filter(F.col("score") / F.col("top") > tau).select("protein_id", "term_id").distinct()


def seed_jaccard(pairs: DataFrame, binary: DataFrame) -> DataFrame:
    """p1, p2, y = common / (size1 + size2 - common + 1), for the given pairs (p1, p2) only."""
    size = binary.groupBy("protein_id").agg(F.count("*").alias("n"))
    a, b = binary.toDF("p1", "t"), binary.toDF("p2", "t")
    co = pairs.select("p1", "p2").join(a, "p1").join(b, ["p2", "t"]).groupBy("p1", "p2").agg(F.count("*").alias("co"))
    rows = co.join(size.toDF("p1", "n1"), "p1").join(size.toDF("p2", "n2"), "p2")
    return rows.select("p1", "p2", (F.col("co") / (F.col("n1") + F.col("n2") - F.col("co") + 1)).alias("y"))


def shared_pairs(binary: DataFrame) -> DataFrame:
    """p1 < p2, co: pairs with a term in common. Terms are met in blocks of a pair's smaller hash, so that a term held by
    most proteins is spread over many tasks; the output is the number of such pairs."""
    salted = binary.withColumn("salt", F.pmod(F.xxhash64("protein_id"), F.lit(16)))
    other = binary.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    x = salted.select(F.col("protein_id").alias("p1"), "term_id", "salt")
    y = other.select(F.col("protein_id").alias("p2"), "term_id", "salt")
    return x.join(y, ["term_id", "salt"]).filter("p1 < p2").groupBy("p1", "p2").agg(F.count("*").alias("co"))


def _block_sum(block: pa.Table) -> pa.Table:
    """The Jaccard sum of the pairs between both sides of a block, or within it if the sides are one."""
    code = block["terms"].combine_chunks().flatten().dictionary_encode()
    n_terms, code = len(code.dictionary), code.indices.to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(np.asarray(block["size"]))])
    right, left = np.asarray(block["right"]), np.asarray(block["left"])
    size, weight = np.asarray(block["size"]).astype(float), np.asarray(block["weight"]).astype(float)
    row = np.full(len(right), -1)
    row[right] = np.arange(right.sum())
    owner = np.repeat(row, np.diff(at))
    held, owner = code[owner >= 0], owner[owner >= 0]
    order = np.argsort(held, kind="stable")
    owner, ends = owner[order], np.concatenate([[0], np.cumsum(np.bincount(held, minlength=n_terms))])
    other_size, other_weight, total = size[right], weight[right], 0.0
    if len(other_size):
        for k in np.flatnonzero(left):
            co = np.bincount(np.concatenate([owner[ends[t] : ends[t + 1]] for t in code[at[k] : at[k + 1]]]), minlength=len(other_size))
            total += weight[k] * float((co / (size[k] + other_size - co + 1)) @ other_weight)
    if (left & right).any():
        total = (total - float((weight * size / (size + 1)).sum())) / 2
    return pa.table({"y": [total]})


def jaccard_total(binary: DataFrame) -> float:
    """The sum of seed_jaccard's y over all pairs of proteins, exactly, without listing them.

    Proteins with equal terms form a class, which counts by its number of proteins. Classes are dealt into blocks by the
    hash of their terms, and a task counts the common terms between two blocks; only its sum leaves it.
    """
    sets = binary.filter("protein_id is not null and term_id is not null").groupBy("protein_id").agg(F.sort_array(F.collect_set("term_id")).alias("terms"))
    classes = cut(sets.groupBy("terms").agg(F.count("*").alias("weight")).withColumn("size", F.size("terms").cast("long")), "classes")
    n = max(4, -(-classes.count() // BLOCK))
    own = classes.withColumn("own", F.pmod(F.xxhash64("terms"), F.lit(n)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    one, two = F.least("own", "other"), F.greatest("own", "other")
    rows = own.select(one.alias("one"), two.alias("two"), "terms", "size", "weight", (F.col("own") == one).alias("left"), (F.col("own") == two).alias("right"))
    return rows.groupBy("one", "two").applyInArrow(_block_sum, "y double").agg(F.sum("y")).collect()[0][0] or 0.0


def channel_norm(edges: DataFrame, channels: list[str]) -> DataFrame:
    """Each channel divided by its greatest value, then multiplied by the greatest quotient."""
    eps = 2.220446049250313e-16
    top = edges.agg(*(F.max(c).alias(f"top_{c}") for c in channels))  # one row
    scaled = edges.crossJoin(F.broadcast(top)).select("p1", "p2", *((F.col(c) / (F.col(f"top_{c}") + eps)).alias(c) for c in channels))
    return scaled


def coefficients(edges: DataFrame, target: DataFrame, channels: list[str], n_proteins: int, total: float | None = None) -> np.ndarray:
    """Least-squares coefficients of the channels and, last, the intercept, over all n(n-1)/2 pairs.

    The target lists every pair that is not 0; if it lists only those with an edge, total is its sum over all pairs.

    Only sums over pairs that have a channel or a target are gathered; the rest of the pairs are zeros and enter
    through their number alone. The system has one row per channel and is solved on the driver, by minimum norm.
    """
    goal = target.select("p1", "p2", F.col("y").alias("_target"))  # a channel may be called y
    rows = edges.join(goal, ["p1", "p2"], "full").select(*(F.coalesce(c, F.lit(0.0)).cast("double").alias(c) for c in [*channels, "_target"]))
    k = len(channels)
    sums = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(channels) for b in channels[i:]] + [F.sum(F.col(a) * F.col("_target")) for a in channels]
    got = [x or 0.0 for x in rows.agg(*sums, *(F.sum(a) for a in channels), F.sum("_target")).collect()[0]]  # one row
    gram, right, at = np.zeros((k + 1, k + 1)), np.zeros(k + 1), 0
    for i in range(k):
        for j in range(i, k):
            gram[i, j] = gram[j, i] = got[at]
            at += 1
    right[:k], gram[k, :k] = got[at : at + k], got[at + k : at + 2 * k]
    gram[:k, k], gram[k, k], right[k] = gram[k, :k], n_proteins * (n_proteins - 1) / 2, got[-1] if total is None else total
    return np.linalg.lstsq(gram, right, rcond=None)[0]


def seed_coefficients(edges: DataFrame, seed: DataFrame, channels: list[str], proteins: DataFrame, tau: float = 0.2) -> np.ndarray:
    """The coefficients with the seed's Jaccard similarity of all pairs as target; single values are needed on edges only.

    proteins: the index, protein_id; all of them count, with or without an edge or a seed, and no others.
    """
    index = proteins.select("protein_id").filter("protein_id is not null").distinct()
    binary = cut(binarised(seed.join(index, "protein_id", "left_semi"), tau), "binary")
    return coefficients(edges, seed_jaccard(edges, binary), channels, index.count(), jaccard_total(binary))


def combined(edges: DataFrame, channels: list[str], coef: np.ndarray) -> DataFrame:
    """p1, p2, score: the weighted sum of the channels; the intercept is dropped."""
    total = sum((F.lit(float(c)) * F.coalesce(F.col(n), F.lit(0.0)) for n, c in zip(channels, coef)), F.lit(0.0))
    return edges.select("p1", "p2", total.alias("score"))
