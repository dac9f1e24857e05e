"""Threshold metrics over the whole grid, zeros included, without building it.

cells: entity, score, n, pos, ic_pos, ic_neg - one row per distinct score of an entity (a protein, a term, or all).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from funweave.scratch import cut

TINY = 2.2250738585072014e-308
MOST_SCORES = 10_000  # beyond so many distinct scores they are rounded to four digits


def reduced(predictions: DataFrame, most: int = MOST_SCORES, digits: int = 4) -> DataFrame:
    """predictions with scores rounded half-even to `digits`, only if there are more than `most` distinct ones; either way
    an entity, even the whole grid, has a bounded number of thresholds."""
    n = predictions.select("score").distinct().agg(F.count("*").alias("n_scores"))  # one row
    short = F.rint(F.col("score") * 10**digits) / 10**digits
    return predictions.crossJoin(F.broadcast(n)).withColumn("score", F.when(F.col("n_scores") > most, short).otherwise(F.col("score"))).drop("n_scores")


def cells(predictions: DataFrame, truth: DataFrame, ic: DataFrame, entity: str | None = None, most: int = MOST_SCORES) -> DataFrame:
    """The distinct scores of each entity with their counts; the cells of the grid without a row join the score 0.

    n0 is the divisor of S_min: the proteins of the grid, but its terms where an entity is a protein.
    """
    key = ["protein_id", "term_id"]
    pairs = reduced(predictions.select(*key, "score"), most).join(truth.select(*key, F.lit(1).alias("y")), key, "full")
    pairs = cut(pairs.na.fill(0.0, ["score"]).na.fill(0, ["y"]).join(ic, "term_id", "left").na.fill(0.0, ["ic"]), "pairs")
    who = F.col(entity) if entity else F.lit("all")
    own = pairs.groupBy(who.alias("entity"), "score").agg(
        F.count("*").alias("n"), F.sum("y").alias("pos"), F.sum(F.col("ic") * F.col("y")).alias("ic_pos"), F.sum(F.col("ic") * (1 - F.col("y"))).alias("ic_neg")
    )
    universe = pairs.select("protein_id").distinct().agg(F.count("*").alias("np"))
    terms = pairs.select("term_id", "ic").distinct().agg(F.count("*").alias("nt"), F.sum("ic").alias("ic_all"))
    grid = universe.crossJoin(terms)  # one row
    stored = own.groupBy("entity").agg(F.sum("n").alias("n"), F.sum(F.col("ic_pos") + F.col("ic_neg")).alias("ics"))
    if entity == "term_id":
        stored = stored.join(ic.select(F.col("term_id").alias("entity"), "ic"), "entity", "left").na.fill(0.0, ["ic"])
    full_n = {"protein_id": F.col("nt"), "term_id": F.col("np")}.get(entity, F.col("np") * F.col("nt"))
    full_ic = {"protein_id": F.col("ic_all"), "term_id": (F.col("np") * F.col("ic") if entity == "term_id" else None)}.get(entity, F.col("np") * F.col("ic_all"))
    zero = stored.crossJoin(F.broadcast(grid)).select("entity", F.lit(0.0).alias("score"), (full_n - F.col("n")).alias("n"), F.lit(0).cast("long").alias("pos"), F.lit(0.0).alias("ic_pos"), (full_ic - F.col("ics")).alias("ic_neg"))
    rows = own.unionByName(zero.filter("n > 0")).groupBy("entity", "score").agg(*(F.sum(c).alias(c) for c in ("n", "pos", "ic_pos", "ic_neg")))
    return rows.crossJoin(F.broadcast(grid.select(F.col("nt" if entity == "protein_id" else "np").alias("n0"))))


def curve(rows: DataFrame) -> DataFrame:
    """entity, score, tp, fp, fn, tn, precision, recall, fpr, ru, mi at each threshold (predicted: score >= threshold)."""
    down = W.partitionBy("entity").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy("entity")
    got = rows.select(
        "entity", "score", "n0", F.sum("pos").over(down).alias("tp"), F.sum(F.col("n") - F.col("pos")).over(down).alias("fp"), F.sum("pos").over(every).alias("p"), F.sum("n").over(every).alias("t"),
        (F.sum("ic_pos").over(every) - F.sum("ic_pos").over(down)).alias("ru"), F.sum("ic_neg").over(down).alias("mi"), F.count("*").over(every).alias("scores"),
    )
    return got.select(
        "entity", "score", "n0", "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("t") - F.col("p") - F.col("fp")).alias("tn"), "p", "t", "scores", "ru", "mi",
        F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", "p").alias("recall"), F.try_divide("fp", F.col("t") - F.col("p")).alias("fpr"),
    )


def metrics(points: DataFrame) -> DataFrame:
    """entity, auc, aupr, f_max, jaccard, p_at_20, s_min. Areas are trapezoids without an anchor at the origin.

    Without positives, negatives or a second score: AUC 0.5, AUPR and Jaccard the base rate, others 0.
    """
    w = W.partitionBy("entity").orderBy(F.desc("score"))
    area = lambda x, y: (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    rows = points.withColumn("a", area("fpr", "recall")).withColumn("b", area("recall", "precision"))
    got = rows.groupBy("entity").agg(
        F.sum("a").alias("auc"), F.sum("b").alias("aupr"),
        F.max(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + TINY)).alias("f_max"),
        F.max(F.col("tp") / (F.col("tp") + F.col("fn") + F.col("fp"))).alias("jaccard"),
        F.max_by("precision", F.when(F.col("recall") >= 0.2, F.col("score"))).alias("p_at_20"),
        F.min(F.sqrt(F.pow(F.col("ru") / F.col("n0"), 2) + F.pow(F.col("mi") / F.col("n0"), 2))).alias("s_min"),
        F.max("p").alias("p"), F.max("t").alias("t"), F.max("scores").alias("scores"),
    )
    flat = (F.col("p") == 0) | (F.col("p") == F.col("t")) | (F.col("scores") == 1)
    base = F.col("p") / F.col("t")
    pick = lambda c, v: F.when(flat, v).otherwise(F.col(c)).alias(c)
    return got.select("entity", pick("auc", F.lit(0.5)), pick("aupr", base), pick("f_max", F.lit(0.0)), pick("jaccard", base), pick("p_at_20", F.lit(0.0)), "s_min")


def grid_ranks(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """entity (a protein), item (a term), score, y, rn, best: the stored cells and the truths, ranked within the whole grid.

    Cells without a row have the score 0 and no relevance; equal scores go by the greater item. The grid is not built:
    below the stored cells of a protein an unpredicted term's rank follows from its rank among all terms, less the
    stored terms that come before it. best is the rank in the ideal order; cells that are never hit are not listed.
    """
    key = ["protein_id", "term_id"]
    pairs = predictions.filter("score > 0").select(*key, "score").join(truth.select(*key, F.lit(1).alias("y")), key, "full")
    pairs = cut(pairs.na.fill(0.0, ["score"]).na.fill(0, ["y"]), "ranked")
    terms = pairs.select("term_id").distinct()
    place = terms.withColumn("place", F.row_number().over(W.orderBy(F.desc("term_id"))))  # one row per term, a dimension
    w = W.partitionBy("protein_id")
    stored = (F.col("score") > 0).cast("int")
    before = F.sum(stored).over(w.orderBy(F.desc("term_id")).rowsBetween(W.unboundedPreceding, -1))
    rows = pairs.join(place, "term_id").withColumns(
        {"own": F.row_number().over(w.orderBy(F.desc("score"), F.desc("term_id"))), "stored": F.sum(stored).over(w), "before": F.coalesce(before, F.lit(0))}
    )
    rank = F.when(F.col("score") > 0, F.col("own")).otherwise(F.col("stored") + F.col("place") - F.col("before"))
    best = F.row_number().over(w.orderBy(F.desc("y"), F.desc("term_id")))
    return rows.select(F.col("protein_id").alias("entity"), F.col("term_id").alias("item"), "score", "y", rank.alias("rn"), best.alias("best"))


def listed_ranks(rows: DataFrame) -> DataFrame:
    """rows (entity, item, score, y) with rn and best within the rows alone; ties go by the greater item."""
    w = W.partitionBy("entity")
    return rows.withColumns({"rn": F.row_number().over(w.orderBy(F.desc("score"), F.desc("item"))), "best": F.row_number().over(w.orderBy(F.desc("y"), F.desc("item")))})


def ranked_gain(ranks: DataFrame, k: int | None = None, linear: bool = False) -> DataFrame:
    """entity, dcg, ndcg, p_at_k, ap_at_k of ranks (entity, y, rn, best), over all of the list or its first k places.

    Precision divides by k, or by the listed rows without k; average precision by the number of relevant items, at most k.
    """
    hits = F.sum((F.col("y") > 0).cast("int")).over(W.partitionBy("entity").orderBy("rn").rowsBetween(W.unboundedPreceding, 0))
    gain = F.col("y").cast("double") if linear else F.pow(F.lit(2.0), F.col("y")) - 1
    x = ranks.select("entity", "y", "rn", "best", hits.alias("hits"), gain.alias("g"))
    cap = lambda c: (F.col(c) <= k) if k else F.lit(True)
    got = x.groupBy("entity").agg(
        F.coalesce(F.sum(F.when(cap("rn"), F.col("g") / F.log2(F.col("rn") + 1))), F.lit(0.0)).alias("dcg"),
        F.sum(F.when(cap("best"), F.col("g") / F.log2(F.col("best") + 1))).alias("idcg"),
        F.count_if(cap("rn") & (F.col("y") > 0)).alias("found"), F.count("*").alias("shown"),
        F.sum(F.when(cap("rn") & (F.col("y") > 0), F.col("hits") / F.col("rn"))).alias("ap"), F.count_if(F.col("y") > 0).alias("all"),
    )
    most = F.least("all", F.lit(k)) if k else F.col("all")
    return got.select(
        "entity", "dcg", F.coalesce(F.try_divide("dcg", "idcg"), F.lit(0.0)).alias("ndcg"), (F.col("found") / (F.lit(k) if k else F.col("shown"))).alias("p_at_k"),
        F.coalesce(F.try_divide("ap", most), F.lit(0.0)).alias("ap_at_k"),
    )


def mean_metrics(per_entity: DataFrame) -> DataFrame:
    """metric, mean, n over the entities, in long form; NaN and null values do not count."""
    long = per_entity.unpivot("entity", [c for c in per_entity.columns if c != "entity"], "metric", "value").filter("value is not null and not isnan(value)")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def flattened(runs: dict[str, DataFrame], keep: tuple[str, ...] = ("auc", "aupr", "f_max", "s_min")) -> DataFrame:
    """method, metric, value of the mean metrics of each method."""
    rows = [mean_metrics(m).select(F.lit(n).alias("method"), "metric", F.col("mean").alias("value")) for n, m in runs.items()]
    return reduce(DataFrame.unionByName, rows).filter(F.col("metric").isin(*keep))


def labelled(rows: DataFrame, labels: dict[str, str], column: str = "method") -> DataFrame:
    """The codes of a column replaced by their labels; codes without a label stay."""
    table = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    return rows.withColumn(column, F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)))


def masks(truth: DataFrame, min_truths: int = 4, low: int = 3, high: int = 300) -> DataFrame:
    """The truths of proteins with enough of them, on terms with a count in the range."""
    p = truth.groupBy("protein_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_truths)
    t = truth.groupBy("term_id").agg(F.count("*").alias("n")).filter(F.col("n").between(low, high))
    return truth.join(p, "protein_id", "left_semi").join(t, "term_id", "left_semi")
