"""Stable identities: content checksums and symbol ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = "␟"


def checksum(text: str | Column) -> Column:
    """First 8 hex characters of SHA-256 over the UTF-8 text."""
    return F.substring(F.sha2(F.col(text) if isinstance(text, str) else text, 256), 1, 8)


def _hash(kind: str, parts: list[Column]) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha1(F.concat_ws(UNIT, *[F.coalesce(p, F.lit("")) for p in parts])), 1, 16))


def class_id(file: Column, name: Column, loc: Column) -> Column:
    return _hash("class", [file, name, loc])


def method_ids(methods: DataFrame, key: str = "id") -> DataFrame:
    """methods (file, class, name, sig, loc, ...) with their id; ids that repeat inside a file are all made anew with the location.

    A window per file and id: overloads of one signature, never a hot group of the whole table.
    """
    plain = _hash("method", [F.col("file"), F.col("class"), F.col("name"), F.col("sig")])
    precise = _hash("method", [F.col("file"), F.col("class"), F.col("name"), F.col("sig"), F.col("loc")])
    n = F.count("*").over(Window.partitionBy("file", "_id"))
    return methods.withColumn("_id", plain).withColumn(key, F.when(n > 1, precise).otherwise(F.col("_id"))).drop("_id")
