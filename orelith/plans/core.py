"""Queries of the index and retrieval operators over the delivered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orelith.functions import rules, text
from orelith.functions.identity import checksum, class_id, method_ids
from orelith.functions.moments import shown, text_micros
from orelith.functions.paths import clean_path, extension
from orelith.operators import audit, graph, incremental, notes, search, sections, state_refs
from orelith.operators.snapshots import completed_ranks, latest_by
from orelith.plans import relations
from orelith.session import new_path, table
from orelith.sources import extract
from orelith.sources.providers import HashingEmbedder, embed_frame

QUERY, PATTERN, NOTE, WORDS, WORD = "kettle", "^(get|find)[A-Z]\\w+(be|bi)", "timeout", ["token", "timeout"], "count"


def _symbols(spark: SparkSession, sf: str) -> DataFrame:
    return relations.symbols(relations.headers(spark, sf))


def _join(c):
    return F.array_join(c, "|")


# -- prose and code text

def text_chunks(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    return sections.text_chunks(d).select(F.col("file").alias("doc_id"), "name", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), checksum("text").alias("text_sum"))


def markdown_sections(spark, sf):
    f = relations.files(spark, sf).where(extension("file").isin(".md", ".mdx"))
    return sections.markdown_sections(f).select("file", "name", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), checksum("text").alias("text_sum"))


def file_checksum(spark, sf):
    return relations.files(spark, sf).select("file", checksum("text").alias("checksum"))


def symbol_identity(spark, sf):
    s = _symbols(spark, sf)
    m = method_ids(s.where("type = 'method'").select("file", "class", "name", "sig", "loc", F.col("id").alias("given")), "new_id").select("given", "new_id")
    return m.unionByName(s.where("type = 'class'").select(F.col("id").alias("given"), class_id(F.col("file"), F.col("name"), F.col("loc")).alias("new_id")))


def duplicate_identity(spark, sf):
    h = relations.headers(spark, sf)
    m = h.select("file", F.explode("methods").alias("m")).groupBy("file", F.col("m.class_name").alias("class"), F.col("m.method_name").alias("name"), F.col("m.sig").alias("sig")).agg(F.count("*").alias("n_methods"))
    return m.where("n_methods > 1")


def identifier_split(spark, sf):
    return _symbols(spark, sf).select("id", text.split_identifier("name").alias("words"))


def search_terms(spark, sf):
    return _symbols(spark, sf).select("id", _join(F.array_sort(text.search_terms(F.concat_ws(" ", "file", "name", "sig", "insight")))).alias("terms"))


def compact_token(spark, sf):
    return _symbols(spark, sf).select("id", text.compact(F.concat_ws("#", "class", "name")).alias("token"))


def normalize_query(spark, sf):
    return _symbols(spark, sf).where("sig IS NOT NULL").select("id", text.normalize_query("sig").alias("query"))


def intent_class(spark, sf):
    d = table(spark, sf, "documents").where("source = 'search-log' AND text IS NOT NULL").select("doc_id", "text")
    return d.select("doc_id", rules.intent("text").alias("intent"), rules.prepare_intent("text").alias("prepare_intent"))


def symbol_intent(spark, sf):
    n = relations.notes(spark, sf).where("symbol IS NOT NULL").select("symbol").distinct()
    return n.select("symbol", rules.intent("symbol").alias("intent"), rules.prepare_intent("symbol").alias("prepare_intent"))


def path_keywords(spark, sf):
    return relations.headers(spark, sf).select("file", text.path_keywords("file").alias("keywords"))


def vector_text(spark, sf):
    s = _symbols(spark, sf)
    return s.select("id", text.join_present([F.col("namespace"), F.col("class"), F.col("name"), F.col("sig"), F.col("return_type"), F.col("insight"), text.path_keywords("file")]).alias("vector_text"))


def class_vector_text(spark, sf):
    """Classes with the names of their methods."""
    s = _symbols(spark, sf)
    m = s.where("type = 'method' AND class IS NOT NULL").groupBy("file", "class").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("methods"))
    return s.where("type = 'class'").join(m, ["file", "class"], "left").select("id", text.join_present([F.col("namespace"), F.col("class"), F.col("extends_name"), F.col("methods"), text.path_keywords("file")]).alias("vector_text"))


def search_content(spark, sf):
    return _symbols(spark, sf).select("id", text.search_content([F.col("file"), F.col("name"), F.col("class"), F.col("sig"), F.col("insight")]).alias("content"))


def meta_infer(spark, sf):
    m = _symbols(spark, sf).where("type = 'method' AND sig IS NOT NULL")
    s = F.col("sig")
    return m.select("id", rules.visibility(s).alias("visibility"), rules.is_async(s).alias("is_async"), rules.is_static(s).alias("is_static"), _join(rules.parameters(s)).alias("parameters"), rules.return_type(s, F.col("name")).alias("return_type"), text.infer_namespace("exports").alias("export_namespace"))


def reference_keys(spark, sf):
    r = _symbols(spark, sf).where("type = 'method'").select(F.explode("refs").alias("ref")).where("ref IS NOT NULL").distinct()
    return r.select("ref", _join(F.array_sort(rules.reference_keys("ref"))).alias("ref_keys"))


def selector_set(spark, sf):
    return _symbols(spark, sf).where("type = 'method'").select("id", _join(F.array_sort(rules.selectors(F.col("id"), F.col("name"), F.col("class")))).alias("selectors"))


def expand_loc(spark, sf):
    return _symbols(spark, sf).select("id", rules.expand_range("loc").alias("wide"), rules.range_start("loc").alias("start_line"), rules.range_end("loc").alias("end_line"))


def symbol_parts(spark, sf):
    return _symbols(spark, sf).select("id", _join(rules.symbol_parts(F.concat_ws("#", "class", "name"))).alias("parts"))


# -- search

def exact_search(spark, sf):
    return search.exact_search(_symbols(spark, sf), QUERY, 20).select("id", F.col("tier").cast("int").alias("tier"), "score")


def exact_tiers(spark, sf):
    """How many symbols fall into each tier, over all that match."""
    s = search.exact_matches(_symbols(spark, sf), "er")
    return s.groupBy(F.col("tier").cast("int").alias("tier")).agg(F.count("*").alias("n_symbols"))


def regex_search(spark, sf):
    return search.regex_search(_symbols(spark, sf), PATTERN, 30).select("id")


def _stored_index(spark, sf, kind: str, build) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of a text index, written to the shared folder by the first query of a session that needs it."""
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _INDEXES:
        _INDEXES[key] = new_path(spark, f"index-{kind}")
        search.stored(build(), lambda name, df: df.write.parquet(f"{_INDEXES[key]}/{name}"), lambda name: spark.read.parquet(f"{_INDEXES[key]}/{name}"))
    return spark.read.parquet(f"{_INDEXES[key]}/postings"), spark.read.parquet(f"{_INDEXES[key]}/doc_lengths")


_INDEXES: dict[tuple[str, str, str], str] = {}


def _symbol_bm25(spark, sf, terms: list[str]) -> DataFrame:
    index, lengths = _stored_index(spark, sf, "symbols", lambda: search.symbol_postings(_symbols(spark, sf)))
    return search.bm25(index, terms, search.COLUMN_WEIGHTS, lengths=lengths)


def postings(spark, sf):
    return search.symbol_postings(_symbols(spark, sf)).select("doc_id", F.col("col").alias("field"), "term", "tf")


def lexical_bm25(spark, sf):
    return _symbol_bm25(spark, sf, ["kettle", "recipe"]).select("doc_id", F.round("score", 6).alias("score"))


def document_bm25(spark, sf):
    index, lengths = _stored_index(spark, sf, "documents", lambda: search.postings(table(spark, sf, "documents").select("doc_id", "text"), {"text": F.col("text")}))
    return search.bm25(index, ["kettle", "recipe"], {"text": 1.0}, lengths=lengths).select("doc_id", F.round("score", 6).alias("score"))


def memory_lexical(spark, sf):
    return notes.lexical(relations.notes(spark, sf), WORDS, 20)


def _query_vector(spark, sf, kind: str) -> list[float]:
    v = relations.vectors(spark, sf).where((F.col("kind") == kind) & (F.size("vector") == 64) & ~F.exists("vector", F.isnan)).orderBy("id").select("vector").first()
    return [float(x) for x in v[0]] if v else [0.0] * 64


def vector_knn(spark, sf):
    v = relations.vectors(spark, sf).where(~F.exists("vector", F.isnan))
    return search.knn(v, _query_vector(spark, sf, "method"), 20)


def vector_knn_typed(spark, sf):
    v = relations.vectors(spark, sf).where(~F.exists("vector", F.isnan))
    return search.knn(v, _query_vector(spark, sf, "method"), 20, "class")


def embedding_knn(spark, sf):
    """Nearest of the plain embeddings to the first one."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.lit("e").alias("kind"), F.col("embedding").alias("vector"))
    q = e.orderBy("id").select("vector").first()
    return search.knn(e, [float(x) for x in q[0]], 20)


def _signals(spark, sf) -> DataFrame:
    s = _symbols(spark, sf)
    attrs = ["id", "type", "file", "name", "class", "sig", "insight", "refs"]
    by = lambda *o: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*o))  # noqa: E731  over at most the limit's rows
    exact = search.exact_search(s, QUERY, 24).select(*attrs, "score").withColumn("rank", by(F.desc("score"), "file", "name", "id")).select(F.lit("exact").alias("signal"), "rank", F.col("score").alias("native"), *attrs)
    b = _symbol_bm25(spark, sf, [QUERY]).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(24)
    lexical = b.withColumn("rank", by(F.desc("score"), "doc_id")).join(s.select(*attrs), F.col("doc_id") == F.col("id")).select(F.lit("lexical").alias("signal"), "rank", (F.col("score") / (1 + F.col("score"))).alias("native"), *attrs)
    rx = search.regex_search(s, QUERY, 24).select(*attrs, "ordinal").withColumn("rank", by("ordinal")).select(F.lit("regex").alias("signal"), "rank", F.lit(0.5).alias("native"), *attrs)
    near = vector_knn(spark, sf).withColumn("rank", by("distance", "id")).withColumnRenamed("id", "vid").join(s.select(*attrs), F.col("vid") == F.col("id")).select(F.lit("vector").alias("signal"), "rank", F.col("distance").alias("native"), *attrs)
    code = exact.unionByName(lexical).unionByName(rx).unionByName(near).withColumn("text", F.lit(None).cast("string"))
    m = notes.matching(relations.notes(spark, sf), QUERY).limit(24)
    none = F.lit(None).cast("string")
    mem = m.select(F.lit("memory").alias("signal"), F.lit(1).alias("rank"), F.lit(0.0).alias("native"), "id", F.lit("memory").alias("type"), "file", none.alias("name"), none.alias("class"), none.alias("sig"), none.alias("insight"), F.lit(None).cast("array<string>").alias("refs"), "text")
    return code.unionByName(mem).withColumnRenamed("id", "key")


def hybrid_search(spark, sf):
    return search.fuse(_signals(spark, sf), QUERY).orderBy(F.desc("score"), "key").limit(20).select("key", "type", "signals", "score")


def hybrid_typed(spark, sf):
    return search.fuse(_signals(spark, sf), QUERY).where("type = 'class'").orderBy(F.desc("score"), "key").limit(20).select("key", "signals", "score")


def result_clusters(spark, sf):
    return search.clusters(search.exact_search(_symbols(spark, sf), QUERY, 50))


def batch_search(spark, sf):
    """The best three of every query of a pipe-separated batch."""
    s, out = _symbols(spark, sf), None
    for q in dict.fromkeys(x.strip() for x in "kettle| ledger |kettle|tribunal".split("|")):
        one = search.exact_search(s, q, 2).select(F.lit(q).alias("query"), "id", "score")
        out = one if out is None else out.unionByName(one)
    return out


def file_scoped_search(spark, sf):
    """Per file: symbols that hold the word in their name, and lines with it outside those symbols' ranges."""
    hits = _symbols(spark, sf).where(F.lower("name").contains(WORD)).select("file", rules.range_start("loc").alias("a"), rules.range_end("loc").alias("b"), "type")
    lines = relations.files(spark, sf).select("file", F.posexplode(F.split("text", "\n")).alias("i", "l")).where(F.lower("l").contains(WORD)).select("file", (F.col("i") + 1).alias("n"))
    ranges = hits.select("file", "a", "b")
    outside = lines.join(ranges, (lines["file"] == ranges["file"]) & (lines["n"] >= ranges["a"]) & (lines["n"] <= ranges["b"]), "left_anti")
    counts = hits.groupBy("file").agg(F.count(F.when(F.col("type") == "class", 1)).alias("n_classes"), F.count(F.when(F.col("type") == "method", 1)).alias("n_methods")).join(outside.groupBy("file").agg(F.count("*").alias("n_lines")), "file", "full_outer")
    c, m, n = (F.coalesce(x, F.lit(0)) for x in ("n_classes", "n_methods", "n_lines"))
    return counts.select("file", c.alias("n_classes"), m.alias("n_methods"), n.alias("n_lines"), ((c + m + n) > 5).alias("truncated"))


def files_list(spark, sf):
    return relations.headers(spark, sf).where(F.lower("file").contains("oven")).select("file", "lang").orderBy("file")


# -- notes

def memory_list(spark, sf):
    return notes.matching(relations.notes(spark, sf), NOTE).select("id", "created_at")


def memory_before(spark, sf):
    return notes.before(relations.notes(spark, sf), "2025-03-01").select("id")


def memory_hint(spark, sf):
    s = search.exact_search(_symbols(spark, sf), QUERY, 50)
    return notes.hints(s, relations.notes(spark, sf)).select("id", "hint")


def memory_scope(spark, sf):
    n = relations.notes(spark, sf)
    return n.select("id", notes.scope(F.col("symbol_id"), F.col("symbol"), F.col("file")).alias("scope"), rules.warns(F.col("text")).alias("warns"), F.coalesce(text_micros("created_at"), F.lit(0)).alias("micros"))


# -- graph

def callers(spark, sf):
    s = _symbols(spark, sf)
    return graph.callers(s, s.where("type = 'method'")).select("target_id", F.col("id").alias("caller_id"), "confidence")


def callees(spark, sf):
    return graph.edges(_symbols(spark, sf)).select("src_id", "ref", "dst_id", "confidence")


def refs_depth(spark, sf):
    s = _symbols(spark, sf)
    return graph.refs_depth(s, s.where("type = 'method'"), 3).groupBy("start").agg(F.count("*").alias("n_refs"))


def trace(spark, sf):
    s = _symbols(spark, sf)
    return graph.trace(s, s.where("type = 'method'"), 3).groupBy(F.col("start").alias("start_id"), "steps").agg(F.count("*").alias("n_nodes"))


def symbol_resolve(spark, sf):
    q = relations.notes(spark, sf).where("symbol IS NOT NULL").select(F.col("symbol").alias("query"))
    return graph.resolve(_symbols(spark, sf), q).select("query", "id", "match", "score", "ambiguous")


def import_resolution(spark, sf):
    return graph.relative_imports(relations.headers(spark, sf).select("file", "imports"))


def export_resolution(spark, sf):
    """Names that a file brings in, by its imports or as parents of its classes, with the other file of the project that exports them."""
    h = relations.headers(spark, sf)
    imported = h.select("project", "file", F.explode("imports").alias("i")).select("project", "file", F.explode(rules.imported_names(F.col("i"))).alias("name"))
    parents = h.select("project", "file", F.explode(F.transform("classes", lambda c: F.regexp_extract(c["extends_name"], r"([\w$]+)\s*(?:<.*)?$", 1))).alias("name")).where("name <> ''")
    return graph.exporting_files(imported.unionByName(parents).distinct(), h.select("project", "file", "exports")).select("file", "name", "target")


def file_resolve(spark, sf):
    """The indexed file that the file name of every note means, if there is just one."""
    n = relations.notes(spark, sf).where("file IS NOT NULL").select(F.substring_index("file", "/", -1).alias("query"))
    return graph.indexed_files(relations.headers(spark, sf).select("file"), n)


def file_scoped_resolve(spark, sf):
    """Every method looked up as `path#name`, the path without its extension."""
    s = _symbols(spark, sf)
    q = s.where("type = 'method' AND name NOT LIKE '%#%'").select(F.concat(F.regexp_replace("file", r"\.[^/.]+$", ""), F.lit("#"), F.col("name")).alias("query"))
    return graph.resolve(s, q).select("query", "id", "match", "score", "ambiguous")


def state_writes_by_path(spark, sf):
    """How often and in how many files each state path is written and read."""
    r = state_refs.state_references(relations.files(spark, sf))
    return r.groupBy("path").agg(F.count(F.when(F.col("kind") == "write", 1)).alias("n_writes"), F.count(F.when(F.col("kind") == "read", 1)).alias("n_reads"), F.countDistinct("file").alias("n_files"))


def project_overloads(spark, sf):
    """Names that a project declares more than once, with how many files and owners declare them."""
    s = _symbols(spark, sf).where("type = 'method'")
    return s.groupBy("project", "name").agg(F.count("*").alias("n_methods"), F.countDistinct("file").alias("n_files"), F.countDistinct("class").alias("n_owners")).where("n_methods > 1")


def state_references(spark, sf):
    return state_refs.state_references(relations.files(spark, sf)).select("file", "line", "path", F.col("kind").alias("ref_kind"))


def state_writers(spark, sf):
    return state_refs.list_references(state_refs.state_references(relations.files(spark, sf)), "value", "write", 50).select("file", "line", "path")


def state_readers(spark, sf):
    return state_refs.list_references(state_refs.state_references(relations.files(spark, sf)), None, "read", 50).select("file", "line", "path")


# -- incremental

def _generation(spark, sf, back: int) -> DataFrame:
    """(file, checksum, methods) of the last full snapshot but `back`."""
    ranks = completed_ranks(table(spark, sf, "manifests")).orderBy(F.desc("rank")).select("generation_id").take(back + 1)
    gen = ranks[back][0] if len(ranks) > back else ""
    h = table(spark, sf, "headers")
    body = F.struct(F.concat_ws("/", "repo", clean_path("file")).alias("file"), F.lower(F.trim("checksum")).alias("checksum"), "methods")
    h = latest_by(h.select("header_id", "delivered_at", "generation_id", F.when(F.col("generation_id") == gen, body).alias("b")), "header_id", "delivered_at", ["generation_id", "b"])
    return h.where(F.col("generation_id") == gen).select("b.file", "b.checksum", "b.methods")


def _methods(g: DataFrame) -> DataFrame:
    return g.select("file", F.explode("methods").alias("m")).select(F.col("m.id").alias("id"), "file", F.col("m.loc").alias("loc"), F.concat_ws("|", "m.sig", "m.insight", F.array_join("m.refs", ",")).alias("body")).groupBy("id").agg(F.min(F.struct("file", "loc", "body")).alias("x")).select("id", "x.*")


def changed_files(spark, sf):
    now, then = _generation(spark, sf, 0), _generation(spark, sf, 1)
    return incremental.file_states(now.select("file", "checksum"), then.select("file", "checksum"), now.where("methods IS NOT NULL").select("file"))


def method_diff(spark, sf):
    return incremental.method_diff(_methods(_generation(spark, sf, 1)), _methods(_generation(spark, sf, 0)))


def upsert(spark, sf):
    old = _generation(spark, sf, 1).select("file", "checksum")
    return incremental.upsert(old, _generation(spark, sf, 0).select("file", "checksum"), "file")


def delete_by_file(spark, sf):
    """Symbols that stay after the files that vanished since the last full snapshot are removed."""
    gone = incremental.file_states(_generation(spark, sf, 0).select("file", "checksum"), _generation(spark, sf, 1).select("file", "checksum"), _generation(spark, sf, 0).select("file")).where("state = 'vanished'")
    return incremental.without_files(_methods(_generation(spark, sf, 1)), gone).select("id")


def debounce_changes(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("file"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", "unlink").when(F.col("event_type") == "signup", "add").otherwise("change").alias("kind"))
    return incremental.debounced(e, 3600).select(F.col("file").alias("file_key"), "at", F.col("kind").alias("change_kind"))


def manifest_history(spark, sf):
    return incremental.manifest_history(table(spark, sf, "manifests"), 5).select("generation_id", F.col("age").cast("int").alias("age"), "is_latest", "status")


def insight_backlog(spark, sf):
    return _symbols(spark, sf).where("type = 'method' AND coalesce(insight, '') = ''").select("id", "file")


def embedding_cache_misses(spark, sf):
    return _symbols(spark, sf).join(relations.vectors(spark, sf).where(F.size("vector") == 64).select("id"), "id", "left_anti").select("id", "type")


# -- reports

def stale_report(spark, sf):
    h, files = relations.headers(spark, sf), relations.files(spark, sf)
    s = relations.symbols(h)
    n_vectors = relations.vectors(spark, sf).where("kind <> 'memory'").count()
    issues = audit.stale_issues(h.select("file", F.lower(F.trim("checksum")).alias("checksum")), files.select("file", checksum("text").alias("checksum")), h.where("methods IS NOT NULL"), s.where("type = 'method'"), n_vectors, s.count(), ["typescript", "javascript"])
    return audit.issue_counts(issues).select("category", F.col("kind").alias("issue_kind"), "severity", "n_issues")


def issue_summary(spark, sf):
    i = table(spark, sf, "stale_issues").select("issue_id", F.translate(F.lower(F.trim("kind")), "_", "-").alias("issue_kind"), "repo").distinct()
    return i.groupBy("repo", "issue_kind").agg(F.count("*").alias("n_issues"))


def status(spark, sf):
    h = relations.headers(spark, sf)
    s = relations.symbols(h)
    files = h.agg(F.count("*").alias("n_files"), F.countDistinct("generation_id").alias("n_generations"))
    return files.join(s.agg(F.count("*").alias("n_symbols"), F.count(F.when(F.col("type") == "method", 1)).alias("n_methods"), F.count(F.when((F.col("type") == "method") & (F.coalesce("insight", F.lit("")) == ""), 1)).alias("n_pending")))


def test_candidates(spark, sf):
    h = relations.headers(spark, sf)
    t = h.select(F.col("file").alias("target"), "project", "file", F.coalesce("exports", F.array().cast("array<string>")).alias("symbols"))
    return audit.test_candidates(h.select("project", "file"), t).select("target", "file", F.col("score").cast("int").alias("score"), "confidence")


def public_api(spark, sf):
    return audit.public_symbols(relations.headers(spark, sf)).select("file", "symbol", F.col("kind").alias("api_kind"))


def public_api_of(spark, sf):
    return audit.of_symbol(audit.public_symbols(relations.headers(spark, sf)), WORD).select("file", "symbol", F.col("kind").alias("api_kind"))


def same_file_symbols(spark, sf):
    s = _symbols(spark, sf)
    return audit.same_file_symbols(s, search.exact_search(s, QUERY, 20))


def match_candidates(spark, sf):
    s = _symbols(spark, sf)
    return graph.match_candidates(search.exact_search(s, QUERY, 10), search.regex_search(s, search.quoted(QUERY), 10), QUERY)


def index_age(spark, sf):
    """Age of every finished run when the last one started."""
    m = table(spark, sf, "manifests").select("generation_id", "started_at", "finished_at")
    last = m.agg(F.max("started_at").alias("now"))
    return audit.index_age(m.where("finished_at IS NOT NULL").join(last), F.col("now")).select("generation_id", "age_hours", "is_old")  # one row of now


def unread_ranges(spark, sf):
    """Methods that no class range of their file contains, classes standing for what was read before."""
    s = _symbols(spark, sf).select("id", "file", "type", rules.range_start("loc").alias("start_line"), rules.range_end("loc").alias("end_line"))
    return audit.unread(s.where("type = 'method' AND start_line IS NOT NULL"), s.where("type = 'class'")).select("id")


def bounded_files(spark, sf):
    """Every source file as it is shown: at most 80 lines."""
    f = relations.files(spark, sf).select("file", text.bounded_lines(F.split("text", "\n")).alias("ls"))
    return f.select("file", F.size("ls").alias("n_lines"), checksum(F.array_join("ls", "\n")).alias("shown_sum"))


def note_times(spark, sf):
    """When a note was made, as it is shown."""
    n = relations.notes(spark, sf)
    return n.select("id", shown(text_micros("created_at")).alias("shown_at"))


def parsed_lists(spark, sf):
    """References written as JSON and read back."""
    s = _symbols(spark, sf).where("type = 'method'")
    return s.select("id", F.coalesce(F.size(F.filter(text.parse_list(text.list_json("refs")), lambda x: x.isNotNull())), F.lit(0)).alias("n_refs"))


def risk_level(spark, sf):
    """Risk of a change to each file: callers from other files, exports, routes, whether it changed since the snapshot before."""
    h = relations.headers(spark, sf)
    s = relations.symbols(h)
    e = graph.edges(s).where("dst_id IS NOT NULL")
    at = s.select("id", "file")
    crossing = e.join(at.select(F.col("id").alias("src_id"), F.col("file").alias("src_file")), "src_id").join(at.select(F.col("id").alias("dst_id"), "file"), "dst_id").where("src_file <> file")
    n_callers = crossing.groupBy("file").agg(F.countDistinct("src_id").alias("n_callers"))
    changed = changed_files(spark, sf).where("state = 'changed'").select("file", F.lit(True).alias("stale"))
    facts = h.select("file", F.greatest(F.size("exports"), F.lit(0)).alias("n_exports"), rules.is_route_path(F.col("file")).cast("int").alias("n_routes")).join(n_callers, "file", "left").join(changed, "file", "left")
    facts = facts.withColumn("n_callers", F.coalesce("n_callers", F.lit(0))).withColumn("stale", F.coalesce("stale", F.lit(False)))
    return audit.risk(facts).select("file", F.col("risk_score").cast("int").alias("risk_score"), "risk_level")


def enrich_deep(spark, sf):
    """Results with what their header knows: by id, else by name in the file."""
    hits = search.exact_search(_symbols(spark, sf), QUERY, 50).select("id", "file", "name")
    h = relations.headers(spark, sf)
    m = h.select("file", "namespace", F.size("imports").alias("n_imports"), F.explode("methods").alias("m"))
    by_id = m.select("file", F.col("m.id").alias("id"), F.col("m.sig").alias("sig"), "namespace").groupBy("file", "id").agg(F.min(F.struct("sig", "namespace")).alias("i"))
    by_name = m.select("file", F.col("m.method_name").alias("name"), F.col("m.sig").alias("sig"), "namespace").groupBy("file", "name").agg(F.min(F.struct("sig", "namespace")).alias("n"))
    out = hits.join(by_id, ["file", "id"], "left").join(by_name, ["file", "name"], "left")
    return out.select("id", F.coalesce("i.sig", "n.sig").alias("sig"), F.coalesce("i.namespace", "n.namespace").alias("namespace"))


def snippets(spark, sf):
    """The lines of every method, cut out of its file inside the file's row."""
    h = relations.headers(spark, sf).select("file", F.transform("methods", lambda m: F.struct(m["id"].alias("id"), m["loc"].alias("loc"))).alias("ms"))
    lines = relations.files(spark, sf).select("file", F.split("text", "\n").alias("ls"))
    each = h.join(lines, "file").select("ls", F.explode("ms").alias("m")).select("ls", "m.id", rules.range_start("m.loc").alias("a"), rules.range_end("m.loc").alias("b"))
    each = each.where((F.col("a") >= 1) & (F.col("a") <= F.col("b")) & (F.col("a") <= F.size("ls")))
    cut = F.slice("ls", F.col("a"), F.least(F.col("b"), F.size("ls")) - F.col("a") + 1)
    return each.select("id", F.size(cut).alias("n_lines"), checksum(F.array_join(cut, "\n")).alias("snippet_sum"))


def overload_groups(spark, sf):
    s = _symbols(spark, sf).where("type = 'method'")
    return s.groupBy("file", "class", "name").agg(F.count("*").alias("n_overloads"), F.array_join(F.array_sort(F.collect_set("loc")), ",").alias("locs")).where("n_overloads > 1")


def enclosing_class(spark, sf):
    """For every method the narrowest class of its file whose range holds it."""
    s = _symbols(spark, sf).select("id", "file", "type", rules.range_start("loc").alias("a"), rules.range_end("loc").alias("b")).where("a IS NOT NULL")
    m = s.where("type = 'method'")
    c = s.where("type = 'class'").select(F.col("file").alias("cf"), F.col("id").alias("class_id"), F.col("a").alias("ca"), F.col("b").alias("cb"))
    inside = m.join(c, (m["file"] == c["cf"]) & (c["ca"] <= m["a"]) & (c["cb"] >= m["b"]))
    return inside.groupBy("id").agg(F.min(F.struct((F.col("cb") - F.col("ca")).alias("w"), F.col("class_id").alias("c"))).alias("x")).select("id", F.col("x.c").alias("class_id"))


def language_histogram(spark, sf):
    h = relations.headers(spark, sf)
    return h.groupBy("project", F.element_at(F.split("file", "/"), 2).alias("top_dir"), extension("file").alias("ext")).agg(F.count("*").alias("n_files"))


# -- what only Python can do: rows without SQL, tested on fixtures

def code_extract(spark, sf):
    h = extract.headers(relations.files(spark, sf))
    return h.select("file", "lang", F.size("classes").alias("n_classes"), F.size("methods").alias("n_methods"), F.size("imports").alias("n_imports"), F.size("exports").alias("n_exports"))


def extracted_calls(spark, sf):
    """Distinct call references of every extracted method."""
    h = extract.headers(relations.files(spark, sf)).select("file", F.explode("methods").alias("m"))
    return h.select("file", F.col("m.name").alias("name"), F.col("m.loc").alias("loc"), F.explode("m.refs").alias("ref"))


def hashing_embed(spark, sf):
    said = vector_text(spark, sf).select(F.col("id").alias("key"), F.col("vector_text").alias("text"))
    return embed_frame(said, HashingEmbedder()).select(F.col("key").alias("id"), F.size("vector").alias("n_dims"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 3).alias("squared_length"))


_NAMES = """code_extract extracted_calls hashing_embed text_chunks markdown_sections file_checksum symbol_identity duplicate_identity identifier_split search_terms compact_token normalize_query intent_class
symbol_intent path_keywords vector_text class_vector_text search_content meta_infer reference_keys selector_set expand_loc symbol_parts exact_search exact_tiers regex_search
postings lexical_bm25 document_bm25 memory_lexical vector_knn vector_knn_typed embedding_knn hybrid_search hybrid_typed result_clusters batch_search file_scoped_search files_list
memory_list memory_before memory_hint memory_scope callers callees refs_depth trace symbol_resolve import_resolution export_resolution file_resolve file_scoped_resolve state_writes_by_path project_overloads state_references state_writers state_readers changed_files
method_diff upsert delete_by_file debounce_changes manifest_history insight_backlog embedding_cache_misses stale_report issue_summary status test_candidates public_api risk_level
public_api_of same_file_symbols match_candidates index_age unread_ranges bounded_files note_times parsed_lists enrich_deep snippets overload_groups enclosing_class language_histogram""".split()
QUERIES = {n: globals()[n] for n in _NAMES}
