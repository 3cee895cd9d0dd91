"""Reads and writes of program state in source lines, by pattern, without Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: roots that hold state, operators that write
ROOTS = ["this", "props", "state", "store", "config", "settings", "options"]
WRITES = ["++", "--", "??=", "||=", "&&=", "+=", "-=", "*=", "/=", "%="]
PATTERN = r"\b(?:" + "|".join(ROOTS) + r"|[A-Z]\w*Config)(?:\??\.\w+)+\s*(?:\(|\+\+|--|\?\?=|\|\|=|&&=|\+=|-=|\*=|/=|%=|=[^=>]|=$)?"


def state_references(files: DataFrame) -> DataFrame:
    """files (file, text): (file, line, path, kind, context), kind read or write, distinct per path, line and kind.

    A dotted path from a state root; calls are left out; `?.` reads as `.`; context is the trimmed line.
    """
    lines = files.where(F.col("text").isNotNull()).select("file", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("i", "l"))
    hit = lines.where(F.col("l").rlike(PATTERN)).select("file", (F.col("i") + 1).alias("line"), F.trim("l").alias("context"), F.explode(F.regexp_extract_all("l", F.lit(PATTERN), F.lit(0))).alias("m"))
    path = F.regexp_extract("m", r"^[\w.?]+", 0)
    tail = F.trim(F.substring("m", F.length(path) + 1, 1 << 30))
    return (
        hit.select("file", "line", F.replace(path, F.lit("?."), F.lit(".")).alias("path"), tail.alias("tail"), "context").where(~F.col("tail").startswith("("))
        .select("file", "line", "path", F.when(F.col("tail") == "", "read").otherwise("write").alias("kind"), "context").distinct()
    )


def list_references(refs: DataFrame, query: str | None = None, kind: str | None = None, limit: int = 50) -> DataFrame:
    """References whose path or file holds the query literally, of a kind; by file, line, path."""
    if query is not None:
        refs = refs.where(F.lower("path").contains(query.lower()) | F.lower("file").contains(query.lower()))
    if kind is not None:
        refs = refs.where(F.col("kind") == kind)
    return refs.orderBy("file", "line", "path", "kind").limit(limit)
