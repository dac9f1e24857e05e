"""Per-key results over skewed keys (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from funweave.functions.text import norm_id
from funweave.operators.multivalue import split_cell
from funweave.runs import sorted_runs


def key_rows(goa: DataFrame) -> DataFrame:
    """One row (field_name, key_text, member, tie) for each go_id and each distinct taxon of an annotation.

    Null and blank go_ids carry no key; a taxon value without digits carries none.
    """

    def numbers(c: Column) -> Column:
        found = F.transform(split_cell(c, "taxon"), lambda x: F.regexp_extract(x, r"(\d+)\s*$", 1))
        return F.filter(F.array_distinct(found), lambda x: x != "")

    # the tie column keeps equal rows apart; it is hashed, so that it needs no order of its own
    tie = F.col("goa_id")
    go = F.struct(F.lit("go_id").alias("field_name"), norm_id(F.col("go_id")).alias("key_text"))
    taxa = F.transform(numbers(F.col("taxon")), lambda x: F.struct(F.lit("taxon").alias("field_name"), x.alias("key_text")))
    rows = goa.select(
        F.col("db_object_id").alias("member"),
        tie.alias("tie"),
        F.explode(F.concat(F.array(go), F.coalesce(taxa, F.array().cast("array<struct<field_name:string,key_text:string>>")))).alias("k"),
    )
    return rows.select("k.field_name", "k.key_text", "member", "tie").filter("key_text <> ''")


def key_stats(goa: DataFrame) -> DataFrame:
    """field_name, key_text, n_rows, n_members of each go_id and taxon, by range-sorted runs."""
    return sorted_runs(key_rows(goa))


def heavy_keys(goa: DataFrame, share: float = 0.02) -> DataFrame:
    """The keys carried by at least the given share of all rows of goa."""
    total = goa.agg(F.count("*").alias("n_all"))  # one row
    return key_stats(goa).crossJoin(F.broadcast(total)).filter(F.col("n_rows") >= share * F.col("n_all")).select("field_name", "key_text")
