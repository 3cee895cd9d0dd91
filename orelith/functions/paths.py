"""Paths of project files as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_path(c: str | Column) -> Column:
    """Clean form: outer blanks off, backslashes as `/`, `/` single, no leading `./`; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(c, r"^\s+|\s+$", "")
    c = F.regexp_replace(c, r"[\\/]+", "/")
    return F.regexp_replace(c, r"^(\./)+", "")


def extension(c: str | Column) -> Column:
    """Lower-case extension with its dot, '' where there is none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_extract(c, r"(\.[^./\\]+)$", 1))
