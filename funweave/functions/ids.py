"""Id and name expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the six-character accession of protein sequence databases.
ACCESSION6 = "[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9][A-Z][A-Z0-9]{2}[0-9]"


def first_word(header: Column) -> Column:
    """The first token of a FASTA header, without the leading mark."""
    return F.regexp_extract(header, r"^>?\s*(\S+)", 1)


def piped_accession(name: Column) -> Column:
    """The second field of a name with pipes, else the whole name."""
    parts = F.split(name, r"\|")
    return F.when(F.size(parts) > 1, parts[1]).otherwise(name)


# The forms in which model names and headers carry an accession.
ACCESSION_FORMS = (r"AF-([A-Z0-9]+)-F[0-9]+", r"(?:sp|tr)\|([A-Z0-9]+)\|", r"(?:sp|tr)_([A-Z0-9]+)", rf"(?:^|[^A-Za-z0-9])({ACCESSION6})(?:[^A-Za-z0-9]|$)")


def any_accession(text: Column) -> Column:
    """An accession in a header or file name: model name, sp|..|, sp_.., else the first token that looks like one; null without."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, t, 1), F.lit("")) for t in ACCESSION_FORMS))


def before_marks(name: Column, marks: tuple[str, ...]) -> Column:
    """The name up to the first of the marks, trimmed."""
    for m in marks:
        name = F.substring_index(name, m, 1)
    return F.trim(name)


def looked_up(table: Column, key: Column, default: str = "") -> Column:
    """The value of a map, or the default."""
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def number_text(value: Column, form: str) -> Column:
    """A number in a printf form, such as %.2e, %.1f or %.3f; null stays null."""
    return F.when(value.isNotNull(), F.format_string(form, value))
