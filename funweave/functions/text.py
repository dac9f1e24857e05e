"""Column expressions over text cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BLANKS = " \t\r\n"


def blank_trim(c: Column) -> Column:
    """c without blanks (space, tab, carriage return, line feed) at either end."""
    return F.btrim(c, F.lit(BLANKS))


def norm_id(c: Column) -> Column:
    """Upper case without outer blanks."""
    return F.upper(blank_trim(c))
