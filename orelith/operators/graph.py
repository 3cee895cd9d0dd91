"""Call graph: edges, callers, callees, references with depth, traces, symbol resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelith.functions.rules import import_candidates, imported_names, reference_keys, selectors
from orelith.session import materialise


def reference_rows(symbols: DataFrame) -> DataFrame:
    """(src_id, project, src_file, src_name, ref, key): every reference of a method under every name it may mean.

    Repeated references of a method are dropped inside its row, before the explode.
    """
    refs = F.array_distinct(F.filter("refs", lambda r: r.isNotNull()))
    each = symbols.where(F.col("type") == "method").select(F.col("id").alias("src_id"), "project", F.col("file").alias("src_file"), F.col("name").alias("src_name"), F.explode(refs).alias("ref"))
    return each.select("*", F.explode(reference_keys("ref")).alias("key"))


def callers(symbols: DataFrame, target: DataFrame) -> DataFrame:
    """Methods of the same project whose references match any name of the target methods: (target_id, id, file, name, class, loc, confidence).

    target: rows of symbols. high: a reference is literally one of the target's names; medium: only one of its parts.
    An equi join on project and candidate name; a scan of all headers per query is not needed.
    """
    names = F.array_distinct(F.flatten(F.transform(selectors(F.col("id"), F.col("name"), F.col("class")), reference_keys)))
    keys = target.select("project", F.col("id").alias("target_id"), F.explode(names).alias("key")).distinct()
    hits = reference_rows(symbols).join(keys, ["project", "key"]).groupBy("target_id", "src_id").agg(F.max((F.replace(F.trim("ref"), F.lit("?."), F.lit(".")) == F.col("key")).cast("int")).alias("direct"))
    out = hits.join(symbols.select(F.col("id").alias("src_id"), "file", "name", "class", "loc"), "src_id")
    return out.select("target_id", F.col("src_id").alias("id"), "file", "name", "class", "loc", F.when(F.col("direct") == 1, "high").otherwise("medium").alias("confidence"))


def relative_imports(files: DataFrame) -> DataFrame:
    """(file, import_text, target): the first known file that a relative import of files (file, imports) may mean."""
    each = files.select("file", F.explode("imports").alias("import_text")).distinct()
    found = each.select("file", "import_text", F.explode(import_candidates(F.col("file"), F.col("import_text"))).alias("target"))
    return found.join(files.select(F.col("file").alias("target")).distinct(), "target", "left_semi").groupBy("file", "import_text").agg(F.min("target").alias("target"))


def exporting_files(names: DataFrame, files: DataFrame) -> DataFrame:
    """(project, file, name, target): for names (project, file, name) that a file brings in, the first other file of the project that exports it.

    files: (project, file, exports). A name that very many files export is cut to its first two before it meets the names.
    """
    out = files.select("project", F.col("file").alias("_t"), F.explode("exports").alias("name")).distinct()
    w = Window.partitionBy("project", "name").orderBy("_t")
    first = out.withColumn("_r", F.row_number().over(w)).where("_r <= 2").drop("_r")
    return names.join(first, ["project", "name"]).where(F.col("_t") != F.col("file")).groupBy("project", "file", "name").agg(F.min("_t").alias("target"))


def preferred_files(symbols: DataFrame) -> DataFrame:
    """(file, target): the files that a file's imports lead to, by relative path or by an exported name."""
    files = symbols.groupBy("project", "file").agg(F.max("imports").alias("imports"), F.max("exports").alias("exports"))
    names = files.select("project", "file", F.explode("imports").alias("i")).select("project", "file", F.explode(imported_names(F.col("i"))).alias("name")).distinct()
    return relative_imports(files).select("file", "target").unionByName(exporting_files(names, files).select("file", "target")).distinct()


def edges(symbols: DataFrame) -> DataFrame:
    """(src_id, ref, dst_id, confidence): each reference with the method it resolves to, null if none.

    Candidates share the reference's last name. The best is the named owner's method, else one in the same file, else one
    in a file that the referring file imports (by path or by an exported name), else anywhere in the project (its
    repository); by file, location and id. A name declared by a hot number of methods is ranked by a window with a group
    limit, so the group is cut before it is shuffled.
    """
    refs = F.array_distinct(F.filter("refs", lambda r: r.isNotNull()))
    clean = F.replace(F.trim("ref"), F.lit("?."), F.lit("."))
    each = symbols.where(F.col("type") == "method").select(F.col("id").alias("src_id"), F.col("file").alias("src_file"), F.col("project").alias("project"), F.explode(refs).alias("ref"))
    each = each.withColumn("key", F.regexp_extract(clean, r"([^.#]*)$", 1)).withColumn("owner", F.nullif(F.regexp_extract(clean, r"([^.#]*)[.#][^.#]*$", 1), F.lit("")))
    decl = symbols.where(F.col("type") == "method").select(F.col("id").alias("dst_id"), F.col("file").alias("dst_file"), "project", F.col("name").alias("key"), F.col("class").alias("dst_class"), F.col("loc").alias("dst_loc"))
    # the best declaration anywhere in the project needs no pairing with the references
    w = Window.partitionBy("project", "key").orderBy("dst_file", "dst_loc", "dst_id")
    anywhere = decl.withColumn("r", F.row_number().over(w)).where("r = 1").select("project", "key", F.struct("dst_id").alias("any"))
    by_file = decl.groupBy("dst_file", "key").agg(F.min(F.struct("dst_loc", "dst_id")).alias("here"))
    by_class = decl.where("dst_class IS NOT NULL").groupBy("project", F.col("dst_class").alias("owner"), "key").agg(F.min(F.struct("dst_file", "dst_loc", "dst_id")).alias("owned"))
    brought = preferred_files(symbols).select(F.col("file").alias("src_file"), F.col("target").alias("dst_file")).join(by_file, "dst_file")
    brought = brought.groupBy("src_file", "key").agg(F.min(F.struct("dst_file", "here.dst_loc", "here.dst_id")).alias("brought"))
    out = each.join(anywhere, ["project", "key"], "left").join(by_file.withColumnRenamed("dst_file", "src_file"), ["src_file", "key"], "left").join(brought, ["src_file", "key"], "left").join(by_class, ["project", "owner", "key"], "left")
    near = F.col("owned").isNotNull() | F.col("here").isNotNull() | F.col("brought").isNotNull()
    return out.select(
        "src_id", "ref", F.coalesce("owned.dst_id", "here.dst_id", "brought.dst_id", "any.dst_id").alias("dst_id"),
        F.when(near, "high").when(F.col("any").isNotNull(), "medium").otherwise("missing-index").alias("confidence"),
    )


def reachable(links: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(start, node, steps): nodes within `depth` steps of links (src, dst), each with its fewest steps; breadth first.

    Every round joins the frontier only and drops what was seen; rounds are written out so the plan does not grow.
    """
    seen = start.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("steps")).distinct()
    frontier = seen
    for i in range(depth):
        nxt = frontier.join(links, frontier["node"] == links["src"]).select("start", F.col("dst").alias("node")).where("node IS NOT NULL").distinct()
        frontier = materialise(nxt.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("steps", F.lit(i + 1)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def refs_depth(symbols: DataFrame, start: DataFrame, depth: int = 1) -> DataFrame:
    """(start, ref): distinct references of the start methods and of methods of the same file they lead to, depth 1 to 3."""
    depth = max(1, min(3, depth))
    rows = reference_rows(symbols)
    local = symbols.where(F.col("type") == "method").select(F.col("file").alias("src_file"), F.explode(selectors(F.col("id"), F.col("name"), F.col("class"))).alias("key"), F.col("id").alias("dst"))
    links = materialise(rows.join(local, ["src_file", "key"]).select(F.col("src_id").alias("src"), "dst").distinct(), "local")
    seen = reachable(links, start, depth - 1)
    return seen.join(rows.select(F.col("src_id").alias("node"), "ref").distinct(), "node").select("start", "ref").distinct()


def trace(symbols: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """(start, node, steps): methods reached across files within 1 to 5 steps."""
    links = materialise(edges(symbols).where("dst_id IS NOT NULL").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")).distinct(), "edges")
    return reachable(links, start, max(1, min(5, depth)))


# ---- fixed values: what a candidate is worth by how it is named
MATCH_WORTH = {"id": 120, "hash": 110, "dot": 108, "name": 100, "direct": 90, "other": 60}
PREFERRED_WORTH, IMPORTED_WORTH = 50, 25


def match_score(selector: str, direct: Column, preferred: Column, imported: Column) -> Column:
    """What a method (id, name, class) is worth for a selector; direct: the selector names it, preferred: it stands in the
    asking file or one that file imports, imported: its name or owner is imported."""
    q, name, owner = selector.lower(), F.lower("name"), F.lower(F.coalesce("class", F.lit("")))
    own = (
        F.when(F.lower("id") == q, MATCH_WORTH["id"]).when((owner != "") & (F.concat(owner, F.lit("#"), name) == q), MATCH_WORTH["hash"]).when((owner != "") & (F.concat(owner, F.lit("."), name) == q), MATCH_WORTH["dot"])
        .when(name == q, MATCH_WORTH["name"]).when(direct, MATCH_WORTH["direct"]).otherwise(MATCH_WORTH["other"])
    )
    return own + F.when(preferred, PREFERRED_WORTH).when(imported, IMPORTED_WORTH).otherwise(0)


def match_candidates(exact: DataFrame, pattern: DataFrame, selector: str) -> DataFrame:
    """(id, file, score) of the methods among exact and pattern hits, each once."""
    named = F.array_contains(selectors(F.col("id"), F.col("name"), F.col("class")), selector)
    cols = ["id", "type", "file", "loc", "name", "class"]
    both = exact.select(*cols).unionByName(pattern.select(*cols)).dropDuplicates(["type", "file", "id", "loc"]).where("type = 'method'")
    return both.select("id", "file", match_score(selector, named, F.lit(False), F.lit(False)).alias("score"))


def indexed_files(files: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, file): the one file that each path of queries (query) names: whole or as a tail, with or without extension, in any case; none where several fit.

    files: (file). Both sides meet on the last part of the path.
    """
    def last(c: Column) -> Column:
        return F.substring_index(c, "/", -1)

    low = F.lower(F.translate("file", "\\", "/"))
    known = files.select("file", low.alias("_f")).distinct().select("file", F.explode(F.array_distinct(F.array("_f", F.regexp_replace("_f", r"\.[^/.]+$", "")))).alias("_f"))
    asked = queries.select("query", F.lower(F.translate(F.trim("query"), "\\", "/")).alias("_q")).where("_q <> ''").distinct()
    hits = known.withColumn("_l", last(F.col("_f"))).join(asked.withColumn("_l", last(F.col("_q"))), "_l").where((F.col("_f") == F.col("_q")) | F.col("_f").endswith(F.concat(F.lit("/"), F.col("_q"))))
    return hits.groupBy("query").agg(F.min("file").alias("file"), F.countDistinct("file").alias("n")).where("n = 1").select("query", "file")


def resolve(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id, file, name, class, loc, match, score, ambiguous): the best symbol of each query, or none.

    queries: (query). score 120 class.name or class#name, 100 name, 90 id, in any case. A query `path#symbol` whose path
    names one indexed file is looked up in that file alone. Ties by file, location, id; ambiguous if the runner-up has
    the same score.
    """
    asked = queries.where(F.col("query").isNotNull()).select("query").distinct()
    path = F.regexp_extract("query", r"^([^#]*[/.][^#]*)#.", 1)
    scoped = asked.withColumn("_p", F.nullif(path, F.lit(""))).where("_p IS NOT NULL")
    places = indexed_files(symbols.select("file"), scoped.select(F.col("_p").alias("query"))).withColumnRenamed("query", "_p").withColumnRenamed("file", "_file")
    scoped = scoped.join(places, "_p").select("query", "_file", F.lower(F.expr("substring(query, length(_p) + 2)")).alias("_k"))
    asked = asked.join(scoped.select("query"), "query", "left_anti").select("query", F.lit(None).cast("string").alias("_file"), F.lower("query").alias("_k")).unionByName(scoped)

    def keyed(key: Column, match: str, score: int) -> DataFrame:
        return symbols.select(F.lower(key).alias("_k"), "id", "file", "name", "class", "loc", F.lit(match).alias("match"), F.lit(score).alias("score")).where("_k IS NOT NULL")

    cand = keyed(F.concat_ws(".", F.col("class"), F.col("name")), "qualified", 120).where("class IS NOT NULL")
    cand = cand.unionByName(keyed(F.concat_ws("#", F.col("class"), F.col("name")), "qualified", 120).where("class IS NOT NULL")).unionByName(keyed(F.col("name"), "exact", 100)).unionByName(keyed(F.col("id"), "id", 90))
    hits = cand.join(asked, "_k").where(F.col("_file").isNull() | (F.col("_file") == F.col("file")))
    hits = hits.groupBy("query", "id").agg(F.max(F.struct("score", "match", "file", "loc", "name", "class")).alias("m")).select("query", "id", "m.*")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "file", "loc", "id")
    best = hits.withColumn("r", F.row_number().over(w)).where("r <= 2")
    nxt = F.lead("score").over(w)
    return best.withColumn("ambiguous", F.coalesce(nxt == F.col("score"), F.lit(False))).where("r = 1").drop("r")
