"""Prose files as sections: Markdown headings and plain-text chunks, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_LINES = 80
SIG_LENGTH = 120


def signature(text: Column) -> Column:
    """The first line, cut to 120 characters and marked by dots."""
    line = F.trim(F.substring_index(text, "\n", 1))
    return F.when(F.length(line) > SIG_LENGTH, F.concat(F.substring(line, 1, SIG_LENGTH), F.lit("..."))).otherwise(line)


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")


def text_chunks(files: DataFrame) -> DataFrame:
    """files (file, text): (file, name, start_line, end_line, sig, text) per chunk `paragraph k`.

    A chunk ends at a blank line once it has text, or after 80 lines; blank lines before its text belong to its range.
    Null and blank texts give no chunk. One fold over a file's lines; a file is one row, as it was delivered.
    """
    chunk = "struct<a:int,b:int>"
    start = F.struct(F.lit(0).alias("i"), F.lit(1).alias("a"), F.lit(False).alias("t"), F.array().cast(f"array<{chunk}>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        i = acc["i"] + 1
        blank = F.trim(line) == ""
        t = acc["t"] | ~blank
        flush = (blank & acc["t"]) | ((i - acc["a"] + 1 >= MAX_LINES) & t)
        end = F.when(blank & acc["t"], i - 1).otherwise(i)
        out = F.when(flush, F.array_append(acc["out"], F.struct(acc["a"].alias("a"), end.alias("b")))).otherwise(acc["out"])
        return F.struct(i.alias("i"), F.when(flush, i + 1).otherwise(acc["a"]).alias("a"), F.when(flush, F.lit(False)).otherwise(t).alias("t"), out.alias("out"))

    def finish(acc: Column) -> Column:
        return F.when(acc["t"], F.array_append(acc["out"], F.struct(acc["a"].alias("a"), acc["i"].alias("b")))).otherwise(acc["out"])

    rows = files.where(F.col("text").isNotNull()).select("file", _lines(F.col("text")).alias("_l"))
    rows = rows.select("file", "_l", F.posexplode(F.aggregate("_l", start, step, finish)).alias("_k", "_c"))
    body = F.trim(F.array_join(F.slice("_l", F.col("_c.a"), F.col("_c.b") - F.col("_c.a") + 1), "\n"), F.lit(" \n\t\r"))
    return rows.select("file", F.concat(F.lit("paragraph "), (F.col("_k") + 1).cast("string")).alias("name"), F.col("_c.a").alias("start_line"), F.col("_c.b").alias("end_line"), body.alias("text")).withColumn("sig", signature(F.col("text")))


def markdown_sections(files: DataFrame) -> DataFrame:
    """files (file, text): (file, name, start_line, end_line, text) per section under a heading of one to four signs.

    Text before the first heading is `intro`, a text without headings `content`. Headings inside code fences count;
    headings without body are dropped. A running count of headings per file numbers the sections.
    """
    lines = files.where(F.col("text").isNotNull()).select("file", F.posexplode(_lines(F.col("text"))).alias("i", "line"))
    head = F.regexp_extract("line", r"^#{1,4}\s+(.+)$", 1)
    w = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("head", F.nullif(F.trim(head), F.lit(""))).withColumn("k", F.count("head").over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("head").isNull(), F.struct("i", "line")))), lambda x: x["line"]), "\n")
    out = marked.groupBy("file", "k").agg(F.max("head").alias("head"), F.min("i").alias("a"), F.max("i").alias("b"), F.trim(body, F.lit(" \n\t\r")).alias("text"))
    any_head = F.max("k").over(Window.partitionBy("file"))
    name = F.when(F.col("head").isNotNull(), F.col("head")).when(any_head > 0, "intro").otherwise("content")
    return out.withColumn("name", name).where(F.col("text") != "").select("file", "name", (F.col("a") + 1).alias("start_line"), (F.col("b") + 1).alias("end_line"), "text")
