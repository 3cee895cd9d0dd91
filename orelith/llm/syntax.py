"""Source files that do not parse, by language of their extension."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orelith.functions.paths import extension
from orelith.llm.grammar import ELEMENT_EXTENSIONS, LANGUAGE_OF, lex, pairs
from orelith.session import materialise, spread


def permissible(spark: SparkSession) -> DataFrame:
    """(lang, cls, nxt, brk): every adjacency a grammar permits; a fixed table of some ten thousand rows."""
    rows = []
    for lang in ("js", "ts", "cs"):
        anywhere, across = pairs(lang)
        rows += [(lang, a, b, brk) for a, b in anywhere for brk in (False, True)] + [(lang, a, b, True) for a, b in across - anywhere]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["lang", "cls", "nxt", "brk"]))


def token_rows(files: DataFrame) -> DataFrame:
    """(repo, file, lang, toks, brks, lexical) of files (repo, file, text): token classes between BOF and EOF, line breaks, lexical error or ''.

    Only files with a known extension; a file that comes twice counts once, with its greatest text; a null text is blank.
    """
    known = files.where(F.col("repo").isNotNull() & F.col("file").isNotNull()).withColumn("ext", extension("file")).where(F.col("ext").isin(list(LANGUAGE_OF)))
    one = known.groupBy("repo", "file", "ext").agg(F.max("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for repo, file, ext, text in zip(pdf["repo"], pdf["file"], pdf["ext"], pdf["text"], strict=True):
                toks, brks, lexical = lex(text or "", LANGUAGE_OF[ext], ext in ELEMENT_EXTENSIONS)
                rows.append((repo, file, LANGUAGE_OF[ext], ["BOF", *toks, "EOF"], [True, *brks, True], lexical))
            yield pd.DataFrame(rows, columns=["repo", "file", "lang", "toks", "brks", "lexical"])

    return one.mapInPandas(run, "repo string, file string, lang string, toks array<string>, brks array<boolean>, lexical string")


def syntax_errors(files: DataFrame) -> DataFrame:
    """(repo, file, lang, errors) for every file that is not valid: errors is the sorted set of what fails.

    lexical: a text that has no tokens of the language, a literal or comment without end. adjacent: two neighbouring
    tokens that no production puts next to each other. nesting: brackets that do not close in order. production: a
    statement without a part it needs. Blank and comment-only files are valid.

    The token arrays are shuffled once, by file; rows of a file are then made and reduced inside its partition.
    """
    lexed = materialise(token_rows(files), "tokens")
    spark = files.sparkSession
    key = ["repo", "file", "lang"]
    bad = lexed.where("lexical <> ''").select(*key, F.lit("lexical").alias("error"))
    rows = spread(lexed.where("lexical = ''"), "repo", "file").select(*key, F.posexplode(F.arrays_zip("toks", "brks")).alias("pos", "t")).select(*key, "pos", F.col("t.toks").alias("cls"), F.col("t.brks").alias("before"))
    line = Window.partitionBy("repo", "file").orderBy("pos")
    opens, closes = F.col("cls").isin("(", "[", "{"), F.col("cls").isin(")", "]", "}")
    seen = rows.select(
        "*",
        F.lead("cls").over(line).alias("nxt"), F.lead("before").over(line).alias("brk"),
        F.lag("cls", 1).over(line).alias("p1"), F.lag("cls", 2).over(line).alias("p2"), F.lag("cls", 3).over(line).alias("p3"),
        F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(line).alias("after"),
    )
    apart = seen.where("nxt IS NOT NULL").select(*key, "cls", "nxt", "brk").distinct().join(F.broadcast(permissible(spark)), ["lang", "cls", "nxt", "brk"], "left_anti").select(*key, F.lit("adjacent").alias("error"))
    # the level of a bracket is that of what stands around it
    level = seen.withColumn("level", F.when(opens, F.col("after") - 1).otherwise(F.col("after")))
    same = Window.partitionBy("repo", "file", "level").orderBy("pos")
    # what comes next on a level is a running value of the reversed order, so that a level of any length takes linear time
    ahead = Window.partitionBy("repo", "file", "level").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    bracket = F.last(F.when(opens | closes, F.col("cls")), ignorenulls=True).over(same.rowsBetween(Window.unboundedPreceding, -1))
    must = F.col("cls").isin("class", "interface", "enum", "struct", "switch", "try") | ((F.col("cls") == "function") & (F.col("lang") == "js"))
    stop = F.last(F.when(F.col("cls").isin("{", ";", "EOF", "}"), F.col("cls")), ignorenulls=True).over(ahead)
    source = F.last(F.when(F.col("cls").isin("str", "(", ".", "=", ";", "EOF"), F.col("cls")), ignorenulls=True).over(ahead)
    mark = F.last(F.when(F.col("cls").isin(";", "if", "else", "while", "do"), F.col("cls")), ignorenulls=True).over(same.rowsBetween(Window.unboundedPreceding, -2))
    looked = level.select(*key, "cls", "p1", "p2", "p3", "nxt", "after", "pos", bracket.alias("open"), stop.alias("stop"), source.alias("source"), mark.alias("mark"), F.lead("cls", 3).over(same).alias("third"), *[F.lag("cls", k).over(same).alias(f"b{k}") for k in (1, 2, 3, 4, 5)])
    opener = F.when(F.col("cls") == ")", "(").when(F.col("cls") == "]", "[").otherwise("{")
    tangled = (closes & ~F.col("open").eqNullSafe(opener)) | (F.col("after") < 0) | ((F.col("cls") == "EOF") & (F.col("after") != 0))
    dotted = F.col("p1").isin(".", "?.")
    headless = must & ~dotted & ~F.col("stop").eqNullSafe("{") & ~((F.col("lang") == "cs") & (F.col("nxt").isin(":", ",", ">", "(", ")") | F.col("p1").isin("record", ":", ",")))
    unnamed = (F.col("cls") == "import") & (F.col("lang") != "cs") & ~dotted & (F.coalesce("source", F.lit("EOF")).isin(";", "EOF"))
    untried = (F.col("cls") == "try") & ~dotted & ~F.coalesce("third", F.lit("")).isin("catch", "finally")
    three = (F.col("lang") == "cs") & (F.col("cls") == "id") & (F.col("p1") == "id") & (F.col("p2") == "id")
    typed = (F.col("lang") == "js") & (F.col("cls") == ":") & (F.col("p1") == "id") & (F.col("p2") == "(") & (F.col("p3").isin("id", "function"))
    untyped = (F.col("lang") == "cs") & (F.col("cls") == "id") & F.col("p1").isin("function")
    # else follows the statement of an if: no block of a function or type, no statement that another one precedes
    body = (F.col("b1") == "}") & (F.col("b2") == "{") & (F.col("b3").isin("id", "any", "void", "type", ">", "]") | ((F.col("b3") == ")") & (F.col("b4") == "(") & (F.col("b5") == "id")))
    stray = (F.col("cls") == "else") & ~dotted & (body | ((F.col("b1") == ";") & (F.col("mark") == ";")))
    broken = headless | unnamed | untried | three | typed | untyped | F.coalesce(stray, F.lit(False))
    shape = looked.select(*key, F.when(tangled, "nesting").when(broken, "production").alias("error")).where("error IS NOT NULL")
    found = bad.unionByName(apart).unionByName(shape)
    return found.groupBy(*key).agg(F.array_sort(F.collect_set("error")).alias("errors"))
