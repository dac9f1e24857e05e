"""Several values packed in one cell (problem 2).

Protected spans (quoted text, a backslash with the character after it, in synonyms a comma between two digits, and
the marker characters themselves, should the text hold any) are replaced by indexed placeholders. What is left of
the separators is then split on, and each piece gets its spans back by array lookup.

A quote opens a span anywhere in the cell; a quote that is never closed is a plain character. A null cell has no
value and gives null; an empty or blank cell gives an empty array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE = "\ue000", "\ue001"
QUOTED = r'"(?:[^"]|"")*"'
ESCAPED = r"\\[\s\S]"
MARKERS = f"[{OPEN}{CLOSE}]"
DIGIT_COMMA = r"(?<=[0-9]),(?=[0-9])"
FIELDS = ("taxon", "with_from", "synonyms")


def patterns(field: str) -> tuple[str, str]:
    """The patterns of protected spans and of separators of a field."""
    spans = [QUOTED, ESCAPED, MARKERS] + [DIGIT_COMMA] * (field == "synonyms")
    return "|".join(spans), r"[|;,]" if field == "synonyms" else r"[|;,\s]"


def _restore(piece: Column, spans: Column) -> Column:
    """The piece with each placeholder replaced by its span, cleaned of quotes, backslashes and outer blanks."""
    mark = f"{OPEN}([0-9]+){CLOSE}"
    plain = F.split(piece, mark, -1)
    found = F.transform(F.regexp_extract_all(piece, F.lit(mark), 1), lambda i: F.get(spans, i.cast("int")))
    whole = F.array_join(F.zip_with(plain, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return whole


def _clean(item: Column) -> Column:
    item = F.btrim(item, F.lit(" \t\r\n"))
    quoted = item.rlike(f"^{QUOTED}$")
    inner = F.btrim(F.replace(F.substr(item, F.lit(2), F.length(item) - 2), F.lit('""'), F.lit('"')), F.lit(" \t\r\n"))
    return F.when(quoted, inner).otherwise(F.regexp_replace(item, r"\\([\s\S])", "$1"))


def split_cell(cell: Column, field: str) -> Column:
    """The values of a cell, as an array in their order; empty pieces are left out."""
    span, sep = patterns(field)
    spans = F.regexp_extract_all(cell, F.lit(span), 0)
    plain = F.split(cell, span, -1)
    masked = F.array_join(
        F.transform(plain, lambda p, i: F.when(i < F.size(spans), F.concat(p, F.lit(OPEN), i.cast("string"), F.lit(CLOSE))).otherwise(p)), ""
    )
    pieces = F.filter(F.split(masked, sep, -1), lambda p: F.btrim(p, F.lit(" \t\r\n")) != "")
    full = F.filter(F.transform(pieces, lambda p: _clean(_restore(p, spans))), lambda x: x != "")
    # cells without any mark take the short way, with the same result
    return F.when(cell.rlike(r'["\\,;|\s' + OPEN + CLOSE + "]"), full).otherwise(F.filter(F.array(cell), lambda x: x != ""))


def split_fields(goa: DataFrame, fields: tuple[str, ...] = FIELDS, least: int = 2) -> DataFrame:
    """goa_id, field_name, pos, item: one row per value of the cells that hold at least so many."""
    cells = F.array(*(F.struct(F.lit(f).alias("field_name"), split_cell(F.col(f), f).alias("items")) for f in fields))
    kept = F.filter(cells, lambda c: F.size(c["items"]) >= least)
    return (
        goa.select("goa_id", F.explode(kept).alias("c"))
        .select("goa_id", "c.field_name", F.posexplode("c.items").alias("pos", "item"))
        .select("goa_id", "field_name", (F.col("pos") + 1).alias("pos"), "item")
    )
