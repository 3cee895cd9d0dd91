"""Instants as microseconds since the epoch in UTC, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000


def wall_micros(c: str | Column) -> Column:
    """Microseconds of a timestamp without zone, its wall clock read as UTC; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    day = F.unix_date(c.cast("timestamp_ntz").cast("date")).cast("long") * F.lit(DAY)
    clock = c.cast("timestamp_ntz")
    seconds = F.hour(clock).cast("long") * 3600 + F.minute(clock).cast("long") * 60
    return day + seconds * 1_000_000 + (F.extract(F.lit("SECOND"), clock) * 1_000_000).cast("long")


def text_micros(c: str | Column) -> Column:
    """Microseconds of an ISO-8601 text with or without offset (none: UTC); what is no instant gives null."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    zoned = F.when(c.rlike(r"(Z|z|[+-]\d{2}:?\d{2})$") & c.rlike(r"\d:\d"), c).otherwise(F.concat(c, F.lit("Z")))
    zoned = F.regexp_replace(zoned, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.unix_micros(zoned.try_cast("timestamp"))


def shown(micros: Column) -> Column:
    """`YYYY-MM-DD HH:MM:SS` in UTC."""
    day, second = F.floor(micros / F.lit(DAY)), F.floor(F.pmod(micros, F.lit(DAY)) / 1_000_000)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.date_from_unix_date(day.cast("int")).cast("string"), F.lit(" "), F.concat_ws(":", two(F.floor(second / 3600)), two(F.floor(second / 60) % 60), two(second % 60)))


def month_of(micros: Column) -> Column:
    """`YYYY-MM` in UTC."""
    return F.date_format(F.date_from_unix_date(F.floor(micros / F.lit(DAY)).cast("int")), "yyyy-MM")
