"""Rows that fail to parse (problem 7): strict load, anti join, diagnosis of the remainder.

A null or blank line and a comment line are neither cases nor rows. A line of an unknown kind fails as `kind`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from funweave.functions.text import blank_trim

# The evidence codes of the GAF format.
EVIDENCE_CODES = (
    "EXP IDA IPI IMP IGI IEP HTP HDA HMP HGI HEP IBA IBD IKR IRD ISS ISO ISA ISM IGC RCA TAS NAS IC ND IEA"
).split()
GAF_COLUMNS = (
    "db db_object_id db_object_symbol qualifier go_id db_reference evidence_code with_from aspect db_object_name "
    "synonyms db_object_type taxon annot_date assigned_by annotation_extension gene_product_form_id"
).split()
TBLOUT_COLUMNS = (
    "target_name target_acc query_name query_acc e_value score bias e_value_dom score_dom bias_dom "
    "exp reg clu ov env dom rep inc description"
).split()
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
QUOTED = r'^"([^"]|"")*"$'


def _body() -> Column:
    return F.regexp_replace(F.col("line_text"), r"\r$", "")


def content_lines(lines: DataFrame) -> DataFrame:
    """line_id, file_kind, body, fields of the lines that are neither blank nor comments."""
    body = _body()
    gaf, tbl = F.col("file_kind") == "gaf", F.col("file_kind") == "tblout"
    comment = (gaf & body.startswith("!")) | (tbl & body.startswith("#"))
    fields = F.when(gaf, F.split(body, "\t", -1)).when(tbl, F.split(blank_trim(body), r"[ \t]+", 19))
    return lines.filter((blank_trim(body) != "") & ~F.coalesce(comment, F.lit(False))).select(
        "line_id", F.coalesce("file_kind", F.lit("")).alias("file_kind"), fields.alias("fields")
    )


def _day_ok(c: Column) -> Column:
    y, m, d = (F.try_to_number(F.substr(c, F.lit(i), F.lit(n)), F.lit("9" * n)) for i, n in ((1, 4), (5, 2), (7, 2)))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return F.when(c.rlike("^[0-9]{8}$"), (y >= 1) & m.between(1, 12) & d.between(1, last)).otherwise(F.lit(False))


def reason() -> Column:
    """The first reason for which the line fails; null if it conforms. Reads file_kind and fields."""
    f = lambda i: F.get(F.col("fields"), F.lit(i - 1))
    gaf_invalid = ~(
        f(5).rlike("^GO:[0-9]{7}$") & f(7).isin(EVIDENCE_CODES) & f(9).isin("P", "F", "C") & _day_ok(f(14))
    )
    quoting = F.exists("fields", lambda x: x.startswith('"') & ~x.rlike(QUOTED))
    numbers = F.forall(F.slice("fields", 5, 14), lambda x: x.rlike(NUMBER))
    gaf = F.when(F.size("fields") != 17, "columns").when(quoting, "quoting").when(gaf_invalid, "invalid")
    tbl = F.when(F.size("fields") < 19, "columns").when(~numbers | f(5).startswith("-"), "invalid")
    return F.when(F.col("file_kind") == "gaf", gaf).when(F.col("file_kind") == "tblout", tbl).otherwise(F.lit("kind"))


def _unquote(x: Column) -> Column:
    return F.when(x.startswith('"'), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)


def load_gaf(lines: DataFrame) -> DataFrame:
    """Typed rows of the conforming gaf lines, with line_id."""
    ok = content_lines(lines.filter("file_kind = 'gaf'")).filter(reason().isNull())
    cols = [_unquote(F.get("fields", F.lit(i))).alias(n) for i, n in enumerate(GAF_COLUMNS)]
    return ok.select("line_id", *cols).withColumn("annot_date", F.to_date("annot_date", "yyyyMMdd"))


def load_tblout(lines: DataFrame) -> DataFrame:
    """Typed rows of the conforming tblout lines, with line_id."""
    ok = content_lines(lines.filter("file_kind = 'tblout'")).filter(reason().isNull())
    x = lambda i: F.get("fields", F.lit(i))
    return ok.select("line_id", *((x(i).cast("double") if 4 <= i <= 17 else x(i)).alias(n) for i, n in enumerate(TBLOUT_COLUMNS)))


def rejected(lines: DataFrame) -> DataFrame:
    """line_id, reason of each line that is not loaded: the offsets of the content lines less those of the strict load."""
    loaded = load_gaf(lines).select("line_id").union(load_tblout(lines).select("line_id"))
    rest = content_lines(lines).join(loaded, "line_id", "left_anti")
    return rest.select("line_id", reason().alias("reason"))
