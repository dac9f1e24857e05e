"""Top N items within every group (problem 4): hot-cold split.

Rows are first reduced to the distinct items of each group with their highest score, in one pass over the input, spread
by group and item. Exact group counts over these send heavy groups to a range sort on (group, falling score, item), whose
quantile boundaries salt a heavy group over several partitions, and light groups to an ordinary window; the results are
united. Rows with a null group, item or score or a NaN score are left out; equal scores go by the smaller item;
-Infinity and negative scores rank like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from funweave.scratch import cut

HEAVY_ROWS = 20_000  # distinct items of a group that one window takes, whatever the input
SHIPPED_GROUPS = 20_000  # heavy groups that are broadcast, about one megabyte; more are joined by shuffle
SALTS = 64


def scored(df: DataFrame, list_name: str, group: str, item: str, score: str) -> DataFrame:
    """The usable rows in the form list_name, group_id, item_id, score."""
    rows = df.select(F.lit(list_name).alias("list_name"), F.col(group).alias("group_id"), F.col(item).alias("item_id"), F.col(score).cast("double").alias("score"))
    return rows.filter("group_id is not null and item_id is not null and score is not null and not isnan(score)")


def _ranked(by: list[Column | str]) -> Column:
    return F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "item_id"))


def marked_rows(best: DataFrame, heavy: DataFrame, key: list[str], shipped: int) -> DataFrame:
    """best with the column heavy, null for light groups. A long list of heavy groups is joined by shuffle, each group
    in SALTS parts, so that no group meets its mark in one task."""
    if heavy.count() <= shipped:
        return best.join(F.broadcast(heavy), key, "left")
    parts = heavy.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return best.withColumn("salt", F.pmod(F.xxhash64("item_id"), F.lit(SALTS)).cast("int")).join(parts, [*key, "salt"], "left").drop("salt")


def top_items(rows: DataFrame, n: int = 5, heavy_rows: int = HEAVY_ROWS, shipped: int = SHIPPED_GROUPS) -> DataFrame:
    """list_name, group_id, item_id, rank_no of the n best distinct items of each group."""
    key = ["list_name", "group_id"]
    best = cut(rows.groupBy(*key, "item_id").agg(F.max("score").alias("score")), "items")
    heavy = cut(best.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > heavy_rows).select(*key, F.lit(True).alias("heavy")), "heavy")
    marked = marked_rows(best, heavy, key, shipped)
    light = marked.filter("heavy is null").select(*key, "item_id", "score")
    light = light.withColumn("rank_no", _ranked(key)).filter(F.col("rank_no") <= n)
    hot = marked.filter("heavy").select(*key, "item_id", "score")
    hot = hot.repartitionByRange(*key, F.desc("score"), "item_id").withColumn("salt", F.spark_partition_id())
    hot = hot.withColumn("at", _ranked([*key, "salt"])).filter(F.col("at") <= n).drop("at", "salt")
    hot = hot.withColumn("rank_no", _ranked(key)).filter(F.col("rank_no") <= n)
    return light.unionByName(hot).select(*key, "item_id", "rank_no")
