"""Project files as a table: globs, ignore lists, languages, path guards."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orelith.functions.paths import clean_path, extension

# ---- fixed values: parsers by extension, extensions of prose
PARSER_OF = {".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".cs": "csharp", ".md": "markdown", ".mdx": "markdown", ".txt": "text"}
PROSE = ["md", "mdx", "txt"]


def glob_to_regex(glob: str) -> str:
    """A whole-path pattern for a glob with **, *, ? and {a,b}; names that start with a dot match too."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out += "(?:" + "|".join(re.escape(x) for x in glob[i + 1 : end].split(",")) + ")"
            i = end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    """Whether any glob matches the whole path; false without globs. One alternation, evaluated in the JVM."""
    return path.rlike("|".join(map(glob_to_regex, globs))) if globs else F.lit(False)


def prose_globs(include: list[str]) -> list[str]:
    """Globs of prose files beside every include that holds a star."""
    return list(dict.fromkeys(f"{g[: g.index('*')]}**/*.{e}" for g in include if "*" in g for e in PROSE))


def ignore_globs(lines: list[str]) -> list[str]:
    """Entries of an ignore file: blanks, comments and negations dropped; a folder covers what is in it."""
    kept = [x.strip() for x in lines]
    kept = [x.lstrip("/") for x in kept if x and not x.startswith(("#", "!"))]
    return list(dict.fromkeys(g for x in kept for g in ([x] if any(c in x for c in "*?{") else [x.rstrip("/"), x.rstrip("/") + "/**", "**/" + x.rstrip("/") + "/**", "**/" + x.rstrip("/")])))


def ignore_entry(path: str, is_folder: bool) -> str:
    """What is written to the ignore list for a path: a glob as it is, a folder with all in it, else the path."""
    if any(c in path for c in "*?{"):
        return path
    return path.strip("/") + "/**" if is_folder else path.lstrip("/")


def parser_of(file: str | Column) -> Column:
    """Parser by lower-case extension, null if there is none."""
    pairs = F.create_map(*[F.lit(x) for kv in PARSER_OF.items() for x in kv])
    return pairs[extension(file)]


def guarded(path: Column) -> Column:
    """The clean project-relative path, null if it is empty, holds NUL or leaves the project."""
    p = F.regexp_replace(clean_path(path), r"^file://", "")
    parts = F.split(p, "/")
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, x: F.struct((a["d"] + F.when(x == "..", -1).when((x == ".") | (x == ""), 0).otherwise(1)).alias("d"), F.least(a["low"], a["d"] + F.when(x == "..", -1).otherwise(0)).alias("low")))
    bad = (p == "") | (p == ".") | p.startswith("/") | p.rlike(r"^[A-Za-z]:") | p.contains("\u0000") | (depth["low"] < 0)
    return F.when(~F.coalesce(bad, F.lit(True)), p)


def scan(spark: SparkSession, root: str, include: list[str], exclude: list[str] | None = None, ignored: list[str] | None = None) -> DataFrame:
    """(file, text, length, modified): parseable files under root that an include or its prose twin matches, without excluded and ignored ones.

    Reads with the binaryFile source, so folders are listed by Spark and contents stay with the executors; invalid UTF-8 is replaced.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + re.escape("/" + base.split("://")[-1].strip("/")) + "/", "")
    rows = raw.withColumn("file", rel).where(matches_any(F.col("file"), [*include, *prose_globs(include)]))
    rows = rows.where(~matches_any(F.col("file"), [*(exclude or []), *(ignored or [])])).where(parser_of("file").isNotNull())
    return rows.select("file", F.decode("content", "UTF-8").alias("text"), "length", F.col("modificationTime").alias("modified")).dropDuplicates(["file"])


def folder_histogram(files: DataFrame) -> DataFrame:
    """(top_dir, n_files) of files below a folder, most files first."""
    rows = files.where(F.col("file").contains("/")).groupBy(F.substring_index("file", "/", 1).alias("top_dir")).agg(F.count("*").alias("n_files"))
    return rows.orderBy(F.desc("n_files"), "top_dir")


def languages(files: DataFrame) -> DataFrame:
    """(lang, n_files) by parser."""
    return files.groupBy(parser_of("file").alias("lang")).agg(F.count("*").alias("n_files")).where("lang IS NOT NULL").orderBy(F.desc("n_files"), "lang")
