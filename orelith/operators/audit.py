"""Freshness audit, status, and impact facts: tests, public interface, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelith.functions.moments import wall_micros
from orelith.functions.paths import extension
from orelith.functions.rules import is_route_decorator, is_test_path, strip_test_words, symbol_parts

# ---- fixed values: issue kinds with their category and severity
ISSUE_KINDS = {
    "missing-file": ("files", "high"),
    "changed-file": ("files", "high"),
    "missing-header": ("headers", "medium"),
    "parse-failed": ("parser", "medium"),
    "unsupported-extension": ("parser", "low"),
    "checksum-mismatch": ("generation", "medium"),
    "scan-generation-mismatch": ("generation", "low"),
    "stale-insight": ("insights", "low"),
    "pending-insight": ("insights", "low"),
    "missing-vector": ("vectors", "medium"),
    "orphan-vector": ("vectors", "medium"),
    "vector-mismatch": ("vectors", "medium"),
}
GRAMS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64)  # first letters, as many as a name has, by which tests and looked-for names meet
SCORES = (100, 70, 50, 20)  # of a test: base name and word, base name, word, neither

# ---- fixed values: extensions by language; text files always count
EXTENSIONS = {"typescript": [".ts", ".tsx"], "javascript": [".js", ".jsx", ".mjs", ".cjs"], "csharp": [".cs"], "text": [".md", ".mdx", ".txt"]}


def supported(file: str | Column, languages: list[str]) -> Column:
    exts = [e for x in (*languages, "text") for e in EXTENSIONS.get(x, [])]
    return extension(file).isin(exts)


def stale_issues(tracked: DataFrame, disk: DataFrame, headers: DataFrame, methods: DataFrame, n_vectors: int, n_symbols: int, languages: list[str], insights: bool = True, pending: int = 0, last_scan: str | None = "") -> DataFrame:
    """(kind, category, severity, file, symbol): what the index no longer knows.

    tracked and disk: (file, checksum); headers: (file); methods: (file, name, class, insight); n_vectors leaves notes
    out. A file that is gone raises nothing else; a file without header raises missing-header and parse-failed, and its
    methods are not looked at. n_vectors < 0: no vectors are kept, and none is missed.
    """
    d = disk.select("file", F.col("checksum").alias("_d")).dropDuplicates(["file"])
    h = headers.select("file").distinct().withColumn("_h", F.lit(True))
    seen = tracked.select("file", "checksum").dropDuplicates(["file"]).join(d.withColumn("_on", F.lit(True)), "file", "left").join(h, "file", "left")
    here, differs = F.col("_on").isNotNull(), F.col("checksum") != F.col("_d")
    kinds = F.array_compact(F.array(
        F.when(~here, "missing-file"), F.when(here & ~supported("file", languages), "unsupported-extension"), F.when(here & differs, "changed-file"),
        F.when(here & differs, "checksum-mismatch"), F.when(here & F.col("_h").isNull(), "missing-header"), F.when(here & F.col("_h").isNull(), "parse-failed"),
    ))
    none = F.lit(None).cast("string")
    issues = seen.select(F.explode(kinds).alias("kind"), "file", none.alias("symbol"))
    if insights:
        known = seen.where(here & F.col("_h").isNotNull()).select("file")
        bare = methods.where(F.coalesce("insight", F.lit("")) == "").join(known, "file", "left_semi")
        issues = issues.unionByName(bare.select(F.lit("stale-insight").alias("kind"), "file", F.concat_ws("#", "class", "name").alias("symbol")))
    whole = ["pending-insight"] if pending > 0 else []
    if n_vectors >= 0:
        whole += (["missing-vector"] if n_vectors < n_symbols else []) + (["orphan-vector"] if n_vectors > n_symbols else []) + (["vector-mismatch"] if n_vectors != n_symbols else [])
    whole += ["scan-generation-mismatch"] if last_scan is None else []
    if whole:
        issues = issues.unionByName(issues.sparkSession.createDataFrame([(k, None, None) for k in whole], "kind string, file string, symbol string"))
    info = F.create_map(*[x for k, (c, s) in ISSUE_KINDS.items() for x in (F.lit(k), F.struct(F.lit(c).alias("c"), F.lit(s).alias("s")))])
    return issues.select("kind", info[F.col("kind")]["c"].alias("category"), info[F.col("kind")]["s"].alias("severity"), "file", "symbol")


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("category", "kind", "severity").agg(F.count("*").alias("n_issues"))


def is_fresh(issues: DataFrame) -> bool:
    """Whether nothing but low issues was found."""
    return issues.where("severity <> 'low'").isEmpty()


def _pairs(bases: Column, words: Column) -> Column:
    """All (base, word) of two lists, either or both of them left blank included."""
    blank = F.array(F.lit(""))
    each = F.transform(F.array_union(blank, bases), lambda b: F.transform(F.array_union(blank, words), lambda w: F.struct(b.alias("_b"), w.alias("_w"))))
    return F.explode(F.flatten(each))


def test_candidates(files: DataFrame, targets: DataFrame, most: int = 8) -> DataFrame:
    """(target, file, score, confidence): test files of the same project that may cover a target.

    files: (project, file); targets: (target, project, file, symbols array<string>). 20 for a test path, 50 more if it
    holds the target's base name, 30 more if it holds a word of three or more letters of a symbol; the best eight, ties by file.

    A project's names (base names and words) are looked up once each in the distinct parts of its tests' paths, by an equi
    join on their first letters (GRAMS) with the letter runs of the parts. A test is listed under each name, and each pair of base name
    and word, that it holds; only the first eight of such a list can be among the best of a target, so no target is paired
    with all tests that it matches. A list of letter runs is many times what it is made from, by which Spark guesses
    its size; so the joins with such lists are told not to broadcast them.
    """
    base = F.regexp_replace(F.regexp_replace("file", r"^.*/", ""), r"\.[^.]*$", "")
    words = F.flatten(F.transform(F.filter("symbols", lambda s: s.isNotNull()), symbol_parts))
    words = F.coalesce(F.filter(F.array_distinct(words), lambda t: F.length(t) >= 3), F.array().cast("array<string>"))
    t = targets.select("target", "project", F.coalesce(F.lower(strip_test_words(base)), F.lit("")).alias("base"), words.alias("words"))
    names = t.select("project", F.explode(F.concat(F.array(F.struct(F.col("base").alias("key"), F.lit(True).alias("is_base"))), F.transform("words", lambda w: F.struct(w.alias("key"), F.lit(False).alias("is_base"))))).alias("k"))
    names = names.where("k.key <> ''").groupBy("project", "k.key").agg(F.max("k.is_base").alias("is_base"), F.min("k.is_base").alias("_m")).select("project", "key", "is_base", (~F.col("_m")).alias("is_word"))
    sizes = F.array(*[F.lit(n) for n in GRAMS])
    names = names.withColumn("_g", F.substring("key", F.lit(1), F.array_max(F.filter(sizes, lambda n: n <= F.length("key")))))

    tests = files.where(is_test_path("file")).select("project", "file", F.lower(strip_test_words(F.col("file"))).alias("_hay")).distinct()
    parts = F.split("_hay", "/")  # no name has a slash, unless a line break before it hides it from the pattern of the base name
    parts = F.array_distinct(F.when(F.col("_hay").rlike(r"[\n\r\x{85}\x{2028}\x{2029}]"), F.array_append(parts, F.col("_hay"))).otherwise(parts))
    parts = tests.select("project", "file", F.explode(parts).alias("part"))
    fitting = F.filter(sizes, lambda n: n <= F.length("part"))
    runs = F.array_distinct(F.flatten(F.transform(fitting, lambda n: F.transform(F.sequence(F.lit(1), F.length("part") - n + 1), lambda i: F.substring(F.col("part"), i, n)))))
    runs = parts.select("project", "part").distinct().select("project", "part", F.explode(runs).alias("_g"))
    found = runs.hint("merge").join(names, ["project", "_g"]).where(F.col("part").contains(F.col("key"))).select("project", "part", "key", "is_base", "is_word")
    held = parts.hint("merge").join(found, ["project", "part"], "left").groupBy("project", "file")
    held = held.agg(F.collect_set(F.when(F.col("is_base"), F.col("key"))).alias("bases"), F.collect_set(F.when(F.col("is_word"), F.col("key"))).alias("words"))

    listed = held.select("project", "file", _pairs(F.col("bases"), F.col("words")).alias("k")).select("project", "k.*", "file")
    by_name = Window.partitionBy("project", "_b", "_w").orderBy("file")
    lists = listed.withColumn("r", F.row_number().over(by_name)).where(F.col("r") <= most).groupBy("project", "_b", "_w").agg(F.collect_list("file").alias("fs"))
    asked = t.select("target", "project", _pairs(F.array("base"), F.col("words")).alias("k")).select("target", "project", "k.*")
    score = F.lit(20) + F.when(F.col("_b") != "", 50).otherwise(0) + F.when(F.col("_w") != "", 30).otherwise(0)
    scored = asked.hint("merge").join(lists.hint("merge"), ["project", "_b", "_w"]).select("target", score.alias("score"), "fs")
    best = scored.groupBy("target").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("score") == s, F.col("fs")))))).alias(f"_{s}") for s in SCORES])
    rows, seen = [], F.array().cast("array<string>")
    for s in SCORES:
        new = F.array_except(f"_{s}", seen)
        rows.append(F.arrays_zip(new.alias("file"), F.array_repeat(F.lit(s), F.size(new)).alias("score")))
        seen = F.array_union(seen, F.col(f"_{s}"))
    top = best.select("target", F.explode(F.slice(F.concat(*rows), 1, most)).alias("k")).select("target", "k.*")
    return top.withColumn("confidence", F.when(F.col("score") >= 70, "high").when(F.col("score") >= 45, "medium").otherwise("low"))


def public_symbols(headers: DataFrame) -> DataFrame:
    """(file, symbol, kind): exports, route methods and public methods of headers (file, exports, methods)."""
    out = headers.select("file", F.explode("exports").alias("symbol")).select("file", "symbol", F.lit("export").alias("kind"))
    m = headers.select("file", F.explode("methods").alias("m"))
    symbol = F.concat_ws("#", "m.class_name", "m.method_name")
    dec = F.col("m.decorators") if "decorators" in headers.schema["methods"].dataType.elementType.names else F.lit(None).cast("array<string>")
    kind = F.when(is_route_decorator(dec), "route").when(F.col("m.visibility").isin("public", "export"), "public-method")
    return out.unionByName(m.select("file", symbol.alias("symbol"), kind.alias("kind")).where("kind IS NOT NULL")).distinct()


def of_symbol(public: DataFrame, symbol: str) -> DataFrame:
    """Public symbols that hold the given one or are held by it, in any case; a blank one leaves all."""
    low = F.lower("symbol")
    return public.where(low.contains(symbol.lower()) | F.lit(symbol.lower()).contains(low)) if symbol.strip() else public


def same_file_symbols(symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, id): the other symbols of a target's file, those of the target's own range left out. targets: rows of symbols."""
    t = targets.select(F.col("id").alias("target_id"), F.col("file"), F.col("loc").alias("_l"))
    return t.join(symbols.select("id", "file", "loc"), "file").where((F.col("id") != F.col("target_id")) & ~F.col("loc").eqNullSafe(F.col("_l"))).select("target_id", "id")


def index_age(manifests: DataFrame, now) -> DataFrame:
    """Adds age_hours, whole hours from the end of each run to `now` (a column), and whether it is older than a day."""
    hours = F.floor((wall_micros(now) - wall_micros("finished_at")) / 3_600_000_000)
    return manifests.withColumn("age_hours", hours).withColumn("is_old", F.coalesce(F.col("age_hours") > 24, F.lit(False)))


def unread(asked: DataFrame, history: DataFrame) -> DataFrame:
    """Asked ranges (file, start_line, end_line) that no range of the history (file, start_line, end_line) contains.

    The history's ranges of a file are reduced to one per first line before they meet what is asked.
    """
    h = history.groupBy("file", F.col("start_line").alias("_a")).agg(F.max("end_line").alias("_b"))
    return asked.join(h, (asked["file"] == h["file"]) & (h["_a"] <= asked["start_line"]) & (h["_b"] >= asked["end_line"]), "left_anti")


def risk(facts: DataFrame) -> DataFrame:
    """Adds risk_score and risk_level to facts (n_callers, n_routes, n_exports, stale)."""
    score = (
        F.when(F.col("n_callers") >= 5, 3).when(F.col("n_callers") >= 2, 1).otherwise(0) + F.when(F.col("n_routes") > 0, 3).otherwise(0)
        + F.when(F.col("n_exports") > 0, 2).otherwise(0) + F.when(F.col("stale"), 1).otherwise(0)
    )
    return facts.withColumn("risk_score", score).withColumn("risk_level", F.when(score >= 4, "high").when(score >= 2, "medium").otherwise("low"))
