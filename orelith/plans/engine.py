"""The engine: build and keep an index, and ask it questions from Python."""

from __future__ import annotations

import re
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orelith.functions import rules, text
from orelith.functions.identity import checksum, class_id, method_ids
from orelith.operators import audit, graph, incremental, notes, queue, search, state_refs
from orelith.operators.sections import markdown_sections, text_chunks
from orelith.session import ship
from orelith.sources import extract, files
from orelith.sources.providers import Embedder, HashingEmbedder, Reranker, embed_frame
from orelith.sources.store import IndexStore, embed_missing


@dataclass(frozen=True)
class Config:
    include: tuple[str, ...] = ("src/**/*",)
    exclude: tuple[str, ...] = ()
    languages: tuple[str, ...] = ("typescript", "javascript", "csharp")
    insights: bool = False
    default_limit: int = 3
    max_limit: int = 20
    debounce_ms: int = 1000
    multiplier: int = 3
    cached_results: int = 64


def resolve_limit(asked: float | None, default: int, most: int) -> int:
    """Whole number from 1 to most; nothing, zero and NaN mean the default."""
    if not asked or asked != asked:
        asked = default
    return max(1, min(int(asked // 1), max(1, most)))


def batch_limit(asked: int | None, n_queries: int) -> int:
    """An explicit limit up to 100, else 3 for one query and 8 shared out over several, at least one each."""
    if asked:
        return min(asked, 100)
    return 3 if n_queries <= 1 else max(1, 8 // n_queries)


def candidate_limit(limit: int, intent: str, multiplier: int = 3) -> int:
    return limit * (2 if intent in ("exact-symbol", "dependency") else 4 if intent == "trace" else max(1, multiplier))


@dataclass
class Answer:
    """A result: rows as a DataFrame, how they were found, and warnings."""

    rows: DataFrame
    mode: str = "exact"
    fallback: str | None = None
    confidence: float | None = None
    warnings: list[str] = field(default_factory=list)
    telemetry: dict = field(default_factory=dict)


class Engine:
    def __init__(self, spark: SparkSession, state: str, config: Config | None = None, embedder: Embedder | None = None, reranker: Reranker | None = None):
        ship(spark)
        self.spark, self.config, self.store = spark, config or Config(), IndexStore(spark, state)
        self.embedder, self.reranker = embedder or HashingEmbedder(), reranker
        self._results: OrderedDict[tuple, Answer] = OrderedDict()
        self._query = None

    # -- building

    def scan(self, root: str, ignored: list[str] | None = None) -> dict[str, int]:
        """Full incremental scan of a folder: unchanged files with a header are skipped, vanished ones deleted."""
        found = files.scan(self.spark, root, list(self.config.include), list(self.config.exclude), files.ignore_globs(ignored or []))
        return self.ingest(found.select("file", "text"), complete=True)

    def sync(self, changed: DataFrame, deleted: DataFrame | None = None) -> dict[str, int]:
        """Single files: changed (file, text), deleted (file)."""
        return self.ingest(changed, complete=False, deleted=deleted)

    def ingest(self, current: DataFrame, complete: bool, deleted: DataFrame | None = None) -> dict[str, int]:
        """Files vanish first, then changed ones are parsed; edges are made last, from what is left. A manifest tells the run."""
        generation, started = f"gen-{uuid.uuid4().hex[:10]}", datetime.now(UTC).isoformat()
        self._manifest(generation, started, "running", {})
        if deleted is not None:
            self.store.remove_files(deleted)
        now = current.select("file", "text", checksum("text").alias("checksum"))
        empty = self.spark.createDataFrame([], "file string, checksum string")
        tracked = self.store.read("tracked_files") if self.store.exists("tracked_files") else empty
        known = self.store.read("headers").select("file") if self.store.exists("headers") else empty.select("file")
        states = incremental.file_states(now.select("file", "checksum"), tracked, known).persist()
        try:
            counts = {r["state"]: r["n"] for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}
            if complete and counts.get("vanished"):
                self.store.remove_files(states.where("state = 'vanished'").select("file"))
            fresh = now.join(states.where(F.col("state").isin("added", "changed", "missing-header")).select("file"), "file", "left_semi")
            heads = self._headers(fresh, generation)
            self.store.upsert("headers", heads, "file") if not self.store.exists("headers") else self._replace("headers", heads, fresh)
            heads = self.store.read("headers")
            self._replace("symbols", self._symbols(heads.join(fresh.select("file"), "file", "left_semi")), fresh)
            self._replace("state_refs", state_refs.state_references(fresh), fresh)
            self._replace("vectors", self._vectors(self.store.read("symbols").join(fresh.select("file"), "file", "left_semi")), fresh)
            if self.config.insights:
                self._enqueue(fresh)
            self.store.upsert("tracked_files", now.select("file", "checksum"), "file")
            self.store.write("edges", graph.edges(self.store.read("symbols")))
            search.stored(search.symbol_postings(self.store.read("symbols")), self.store.write, self.store.read)
            self._manifest(generation, started, "completed", counts)
            return counts
        finally:
            states.unpersist()

    def _manifest(self, generation: str, started: str, status: str, counts: dict[str, int]) -> None:
        done = status == "completed"
        indexed = self.store.count("headers") if done else 0
        methods = self.store.read("symbols").where("type = 'method'").count() if done else 0
        changed = counts.get("changed", 0) + counts.get("added", 0) + counts.get("missing-header", 0)
        failed = max(0, self.store.count("tracked_files") - indexed) if done else 0
        row = self.spark.createDataFrame([(generation, started, datetime.now(UTC).isoformat() if done else None, status, indexed, changed, counts.get("unchanged", 0), failed, methods)], "generation_id string, started_at string, finished_at string, status string, indexed_files long, changed_files long, skipped_files long, failed_files long, total_methods long")
        old = self.store.read("manifests").drop("age", "is_latest", "compaction") if self.store.exists("manifests") else row.limit(0)
        self.store.write("manifests", incremental.manifest_history(incremental.upsert(old, row, "generation_id")))

    def manifests(self) -> DataFrame:
        """The latest run and up to 20 before it, latest first."""
        return self.store.read("manifests").orderBy("age")

    def _enqueue(self, fresh: DataFrame) -> None:
        """Methods of fresh files that have no insight wait in the queue."""
        old = self.store.read("insight_queue") if self.store.exists("insight_queue") else self.spark.createDataFrame([], queue.SCHEMA)
        bare = self.store.read("symbols").where("type = 'method' AND coalesce(insight, '') = ''").join(fresh.select("file"), "file", "left_semi")
        self.store.write("insight_queue", queue.enqueue(old, bare.select("file", F.col("id").alias("method_id"), F.col("sig").alias("code")), datetime.now(UTC).isoformat()))

    def pending_insights(self) -> DataFrame:
        """(file, n_pending) of methods that wait for an insight."""
        return queue.pending_by_file(self.store.read("insight_queue") if self.store.exists("insight_queue") else self.spark.createDataFrame([], queue.SCHEMA))

    def _replace(self, table: str, rows: DataFrame, of: DataFrame) -> None:
        old = incremental.without_files(self.store.read(table), of) if self.store.exists(table) else None
        self.store.write(table, rows if old is None else old.unionByName(rows, allowMissingColumns=True))

    def _headers(self, fresh: DataFrame, generation: str) -> DataFrame:
        """Code by the extractors, prose as methods that are sections; metadata is inferred before the header is kept."""
        code = extract.headers(fresh)
        prose = fresh.where(files.parser_of("file").isin("markdown", "text"))
        md = markdown_sections(prose.where(files.parser_of("file") == "markdown")).select("file", "name", "start_line", "end_line", "text")
        tx = text_chunks(prose.where(files.parser_of("file") == "text")).select("file", "name", "start_line", "end_line", "text")
        loc = F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string"))
        none, lists = F.lit(None).cast("string"), F.array().cast("array<string>")
        section = F.struct(F.col("name"), none.alias("class"), loc.alias("loc"), F.substring(F.substring_index("text", "\n", 1), 1, 120).alias("sig"), lists.alias("refs"), lists.alias("decorators"), none.alias("visibility"), F.lit(False).alias("is_async"), F.lit(False).alias("is_static"))
        sections = md.unionByName(tx).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start_line", section.alias("m")))).alias("ms"))
        written = sections.select("file", F.lit("text").alias("lang"), none.alias("ns"), F.array().cast(f"array<{extract.CLASS}>").alias("classes"), F.transform("ms", lambda x: x["m"]).alias("methods"), lists.alias("imports"), lists.alias("exports"))
        return code.unionByName(written).withColumn("namespace", F.coalesce("ns", text.infer_namespace("exports"))).withColumn("generation_id", F.lit(generation))

    def _symbols(self, heads: DataFrame) -> DataFrame:
        shared = ["file", "lang", "namespace", "imports", "exports", "generation_id"]
        none, lists = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
        m = heads.select(*shared, F.explode("methods").alias("m")).select(*shared, "m.*")
        m = method_ids(m).select(*shared, "id", F.lit("method").alias("type"), "name", "class", "sig", "loc", none.alias("insight"), "refs", "decorators", rules.parameters(F.col("sig")).alias("parameters"), rules.return_type(F.col("sig"), F.col("name")).alias("return_type"), none.alias("extends_name"), lists.alias("implements"), F.coalesce("visibility", rules.visibility(F.col("sig"))).alias("visibility"), F.coalesce("is_async", rules.is_async(F.col("sig"))).alias("is_async"))
        c = heads.select(*shared, F.explode("classes").alias("c")).select(*shared, class_id(F.col("file"), F.col("c.name"), F.col("c.loc")).alias("id"), F.lit("class").alias("type"), F.col("c.name").alias("name"), F.col("c.name").alias("class"), none.alias("sig"), F.col("c.loc").alias("loc"), none.alias("insight"), lists.alias("refs"), F.col("c.decorators").alias("decorators"), lists.alias("parameters"), none.alias("return_type"), F.col("c.extends_name").alias("extends_name"), F.col("c.implements").alias("implements"), F.col("c.visibility").alias("visibility"), F.lit(None).cast("boolean").alias("is_async"))
        return m.unionByName(c).withColumn("ordinal", F.concat_ws("|", "file", "id")).withColumn("project", F.lit(""))

    def _vectors(self, symbols: DataFrame) -> DataFrame:
        """Methods by what they say and where, classes by their parents and method names; what was embedded before comes from the cache."""
        inside = symbols.where("type = 'method' AND class IS NOT NULL").groupBy("file", "class").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("_m"))
        place = text.path_keywords("file")
        method = text.join_present([F.col("namespace"), F.col("class"), F.col("name"), F.col("sig"), F.col("return_type"), F.col("insight"), place])
        owner = text.join_present([F.col("namespace"), F.col("class"), F.col("extends_name"), F.col("_m"), place])
        kept = symbols.join(inside, ["file", "class"], "left").select("id", "file", F.col("type").alias("kind"), F.when(F.col("type") == "class", owner).otherwise(method).alias("text"))
        return self._embedded(kept).select("id", "file", "kind", "vector")

    def _embedded(self, texts: DataFrame) -> DataFrame:
        cache = self.store.read("embedding_cache") if self.store.exists("embedding_cache") else self.spark.createDataFrame([], "key string, vector array<float>")
        embed = lambda d: embed_frame(d, self.embedder)
        _, fresh = embed_missing(texts, cache, embed, self.embedder.name, self.embedder.dims)
        self.store.upsert("embedding_cache", fresh, "key")
        return embed_missing(texts, self.store.read("embedding_cache"), embed, self.embedder.name, self.embedder.dims)[0].where("vector IS NOT NULL")

    # -- search

    def symbols(self) -> DataFrame:
        return self.store.read("symbols")

    def notes(self) -> DataFrame:
        return self.store.read("memories") if self.store.exists("memories") else self.spark.createDataFrame([], "id string, text string, file string, symbol string, symbol_id string, scope string, created_at string")

    def search(self, query: str, mode: str = "auto", limit: int | None = None, kind: str = "all", deep: bool = False) -> Answer:
        """auto: exact, then exact with the normalised query, then hybrid; or exact, regex, vector, hybrid as asked."""
        n = resolve_limit(limit, self.config.default_limit, self.config.max_limit)
        key = (query.lower().strip(), mode, n, kind, deep, tuple(sorted(self.store.versions().items())))
        if key in self._results:
            self._results.move_to_end(key)
            return self._results[key]
        answer = self._route(query, mode, n, kind)
        if deep:
            answer.rows = notes.hints(answer.rows, self.notes())
        if not answer.rows.isEmpty():
            self._results[key] = answer
            while len(self._results) > self.config.cached_results:
                self._results.popitem(last=False)
        return answer

    def _typed(self, kind: str) -> DataFrame:
        s = self.symbols()
        return s if kind == "all" else s.where(F.col("type") == kind)

    def _route(self, query: str, mode: str, n: int, kind: str) -> Answer:
        s = self._typed(kind)
        if mode == "regex":
            rows = search.regex_search(s, query, n)
            return Answer(rows, "regex", confidence=0.85, warnings=[] if search.valid_pattern(self.spark, query) else ["invalid pattern"])
        if mode in ("vector", "hybrid") or (mode == "auto" and self.intent(query) == "semantic"):
            return self.hybrid(query, n, kind)
        rows = search.exact_search(s, query, n)
        if mode == "exact" or not rows.isEmpty():
            return Answer(rows, "exact", confidence=0.95)
        plain = self.spark.range(1).select(text.normalize_query(F.lit(query))).first()[0]
        if plain and plain != query:
            rows = search.exact_search(s, plain, n)
            if not rows.isEmpty():
                return Answer(rows, "exact", "normalized-exact", 0.87)
        answer = self.hybrid(query, n, kind)
        answer.fallback, answer.confidence = "semantic", 0.75 - 0.2
        return answer

    def intent(self, query: str) -> str:
        return self.spark.range(1).select(rules.intent(F.lit(query))).first()[0]

    def hybrid(self, query: str, limit: int = 10, kind: str = "all") -> Answer:
        most = max(8 * limit, 24)
        s = self.symbols()
        attrs = ["id", "type", "file", "name", "class", "sig", "loc", "insight", "refs"]
        at = lambda *o: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*o))  # noqa: E731  over at most `most` rows
        parts = [search.exact_search(s, query, most).withColumn("rank", at(F.desc("score"), "file", "name", "id")).select(F.lit("exact").alias("signal"), "rank", F.col("score").alias("native"), *attrs)]
        if terms := search.query_terms(self.spark, query):
            b = search.bm25(self.store.read("postings"), terms, search.COLUMN_WEIGHTS, lengths=self.store.read("doc_lengths")).orderBy(F.desc("score"), "doc_id").limit(most)
            parts.append(b.withColumn("rank", at(F.desc("score"), "doc_id")).join(s.select(*attrs), F.col("doc_id") == F.col("id")).select(F.lit("lexical").alias("signal"), "rank", (F.col("score") / (1 + F.col("score"))).alias("native"), *attrs))
        parts.append(search.regex_search(s, search.quoted(query), most).withColumn("rank", at("ordinal")).select(F.lit("regex").alias("signal"), "rank", F.lit(0.5).alias("native"), *attrs))
        if self.store.exists("vectors"):
            near = search.knn(self.store.read("vectors"), self.embedder.embed([query])[0], most, None if kind == "all" else kind)
            parts.append(near.withColumn("rank", at("distance", "id")).withColumnRenamed("id", "vid").join(s.select(*attrs), F.col("vid") == F.col("id")).select(F.lit("vector").alias("signal"), "rank", F.col("distance").alias("native"), *attrs))
        signals = parts[0].withColumn("text", F.lit(None).cast("string"))
        for p in parts[1:]:
            signals = signals.unionByName(p.withColumn("text", F.lit(None).cast("string")))
        if kind in ("all", "memory"):
            m = notes.matching(self.notes(), query).limit(most)
            blank = [F.lit(None).cast(t).alias(c) for c, t in (("name", "string"), ("class", "string"), ("sig", "string"), ("loc", "string"), ("insight", "string"), ("refs", "array<string>"))]
            for name, rows in (("memory", m), ("memory-similar", self.similar(query, most))):
                signals = signals.unionByName(rows.select(F.lit(name).alias("signal"), F.lit(1).alias("rank"), F.lit(0.0).alias("native"), "id", F.lit("memory").alias("type"), "file", *blank, "text"))
        fused = search.fuse(signals.withColumnRenamed("id", "key"), query)
        if kind != "all":
            fused = fused.where(F.col("type") == kind)
        fused = fused.withColumn("matched_by", search.matched_by(query))
        return Answer(fused.withColumnRenamed("key", "id").orderBy(F.desc("score"), "id").limit(limit), "hybrid", confidence=0.75)

    def smart_search(self, query: str, limit: int | None = None) -> Answer:
        """Candidates are fetched in excess and put in order by the reranker; ids it makes up are dropped."""
        n = resolve_limit(limit, self.config.default_limit, self.config.max_limit)
        if self.reranker is None:
            answer = self.search(query, limit=n)
            answer.telemetry = {"stage": "unavailable"}
            return answer
        answer = self.hybrid(query, candidate_limit(n, self.intent(query), self.config.multiplier))
        rows = [r.asDict() for r in answer.rows.collect()]  # at most the candidate limit
        chosen = [i for i in self.reranker.select(query, rows, n) if i in {r["id"] for r in rows}][:n]
        if not chosen:
            answer.rows, answer.telemetry = answer.rows.limit(n), {"stage": "fallback", "candidates": len(rows)}
            return answer
        order = self.spark.createDataFrame([(i, p) for p, i in enumerate(chosen)], "id string, place int")
        answer.rows, answer.telemetry = answer.rows.join(F.broadcast(order), "id").orderBy("place"), {"stage": "selected", "candidates": len(rows)}
        return answer

    def search_batch(self, queries: str, limit: int | None = None) -> dict[str, Answer]:
        each = list(dict.fromkeys(q.strip() for q in queries.split("|") if q.strip()))
        return {q: self.search(q, "exact", batch_limit(limit, len(each))) for q in each}

    def search_file(self, file: str, content: str, query: str, limit: int = 5) -> dict:
        """Hits inside one file: its classes and methods by name, and lines outside of those."""
        rows = self.symbols().where((F.col("file") == file) & F.lower("name").contains(query.lower())).orderBy(F.when(F.col("type") == "class", 0).otherwise(1), rules.range_start("loc")).select("type", "name", "loc").collect()
        spans = [tuple(map(int, r["loc"].split("-"))) for r in rows if re.match(r"\d+-\d+$", r["loc"] or "")]
        lines = [{"type": "line", "name": t.strip(), "loc": f"{i}-{i}"} for i, t in enumerate(content.split("\n"), 1) if query.lower() in t.lower() and not any(a <= i <= b for a, b in spans)]
        hits = [r.asDict() for r in rows] + lines
        return {"results": hits[:limit], "total": len(hits), "truncated": len(hits) > limit}

    # -- reading

    def files(self, query: str | None = None) -> DataFrame:
        t = self.store.read("tracked_files")
        return (t.where(F.lower("file").contains(query.lower())) if query else t).select("file").orderBy("file")

    def header(self, file: str) -> DataFrame:
        return self.store.read("headers").where(F.col("file") == file)

    @staticmethod
    def snippet(content: str, start: int, end: int) -> str:
        lines = content.split("\n")
        if not 1 <= start <= end or start > len(lines):
            raise ValueError(f"no lines {start}-{end} in {len(lines)}")
        return "\n".join(lines[start - 1 : min(end, len(lines))])

    @staticmethod
    def around(loc: str, total: int, padding: int, most: int) -> tuple[int, int]:
        """The range with `padding` lines on both sides, inside the file and at most `most` lines long."""
        a, b = map(int, loc.split("-"))
        a, b = max(1, a - padding), min(total, b + padding)
        return a, min(b, a + most - 1)

    def peek(self, content: str, loc: str) -> str:
        return self.snippet(content, *self.around(loc, content.count("\n") + 1, 3, 40))

    def open(self, content: str, loc: str) -> str:
        return self.snippet(content, *self.around(loc, content.count("\n") + 1, 12, 120))

    def symbol(self, query: str) -> DataFrame:
        return graph.resolve(self.symbols(), self.spark.createDataFrame([(query,)], "query string"))

    # -- graph

    def _target(self, query: str) -> DataFrame:
        return self.symbols().join(self.symbol(query).select("id"), "id", "left_semi")

    def refs(self, query: str, depth: int = 1) -> DataFrame:
        return graph.refs_depth(self.symbols(), self._target(query), depth)

    def callers(self, query: str) -> DataFrame:
        order = F.when(F.col("confidence") == "high", 0).otherwise(1)
        return graph.callers(self.symbols(), self._target(query)).orderBy(order, "file", rules.range_start("loc"), "name")

    def callees(self, query: str) -> DataFrame:
        return self.store.read("edges").join(self._target(query).select(F.col("id").alias("src_id")), "src_id", "left_semi")

    def trace(self, query: str, depth: int = 3) -> DataFrame:
        links = self.store.read("edges").where("dst_id IS NOT NULL").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")).distinct()
        steps = graph.reachable(links, self._target(query), max(1, min(5, depth)))
        return steps.join(self.symbols().select(F.col("id").alias("node"), "file", "name", "class", "loc"), "node").orderBy("steps", "file", "name")

    def state_refs(self, query: str | None = None, kind: str | None = None, limit: int = 50) -> DataFrame:
        return state_refs.list_references(self.store.read("state_refs"), query, kind, limit)

    def readers(self, path: str) -> DataFrame:
        return self.state_refs(path, "read")

    def writers(self, path: str) -> DataFrame:
        return self.state_refs(path, "write")

    # -- reports

    def impact(self, query: str) -> dict[str, DataFrame]:
        target = self._target(query)
        callers = self.callers(query)
        heads = self.store.read("headers").join(target.select("file"), "file", "left_semi")
        public = heads.select("file", F.explode("exports").alias("symbol")).select("file", "symbol", F.lit("export").alias("kind"))
        t = target.select(F.col("id").alias("target"), F.lit("").alias("project"), "file", F.array(F.concat_ws("#", "class", "name")).alias("symbols"))
        tests = audit.test_candidates(self.store.read("tracked_files").select(F.lit("").alias("project"), "file"), t)
        facts = self.spark.range(1).select(F.lit(callers.count()).alias("n_callers"), F.lit(target.where(rules.is_route_decorator(F.col("decorators"))).count()).alias("n_routes"), F.lit(public.count()).alias("n_exports"), F.lit(False).alias("stale"))
        return {"target": target, "callers": callers, "callees": self.callees(query), "trace": self.trace(query), "public": public, "tests": tests, "notes": notes.related(target, self.notes()), "risk": audit.risk(facts)}

    def prepare(self, task: str) -> dict:
        found = self.search(task)
        kind = self.spark.range(1).select(rules.prepare_intent(F.lit(task))).first()[0]
        return {"intent": kind, "results": found, "files": found.rows.select("file").distinct(), "notes": notes.matching(self.notes(), task)}

    def stale(self, root: str) -> DataFrame:
        disk = files.scan(self.spark, root, list(self.config.include), list(self.config.exclude)).select("file", checksum("text").alias("checksum"))
        s = self.symbols()
        return audit.stale_issues(self.store.read("tracked_files"), disk, self.store.read("headers"), s.where("type = 'method'"), self._n_vectors(), s.count(), list(self.config.languages), self.config.insights, self.pending_insights().agg(F.sum("n_pending")).first()[0] or 0)

    def _n_vectors(self) -> int:
        """Vectors of symbols; those of notes do not count."""
        return self.store.read("vectors").where("kind <> 'memory'").count() if self.store.exists("vectors") else 0

    def status(self) -> dict[str, int]:
        s = self.symbols()
        return {"files": self.store.count("tracked_files"), "symbols": s.count(), "methods": s.where("type = 'method'").count(), "vectors": self._n_vectors(), "pending": self.pending_insights().agg(F.sum("n_pending")).first()[0] or 0, "notes": self.store.count("memories")}

    # -- notes

    def remember(self, note: str, created_at: str, file: str | None = None, symbol: str | None = None, symbol_id: str | None = None) -> str:
        i = f"mem_{uuid.uuid4().hex[:6]}"
        scope = "symbol" if symbol or symbol_id else "file" if file else "project"
        row = self.spark.createDataFrame([(i, note, file, symbol, symbol_id, scope, created_at)], "id string, text string, file string, symbol string, symbol_id string, scope string, created_at string")
        self.store.upsert("memories", row, "id")
        said = self._embedded(row.select("id", F.lit(None).cast("string").alias("file"), F.lit("memory").alias("kind"), "text"))
        self.store.upsert("vectors", said.select("id", "file", "kind", "vector"), "id")
        return i

    def similar(self, query: str, limit: int = 5, most: float = 0.7) -> DataFrame:
        """Notes by the distance of their vectors to the query's; without vectors, or where none is near enough, by their words."""
        if self.store.exists("vectors"):
            near = notes.similar(self.notes(), self.store.read("vectors"), self.embedder.embed([query])[0], limit, most)
            if not near.isEmpty():
                return near.drop("distance")
        terms = search.query_terms(self.spark, query)
        scored = notes.lexical(self.notes(), terms, limit) if terms else None
        return self.notes().limit(0) if scored is None else self.notes().join(F.broadcast(scored), "id").orderBy(F.desc("score"), "id").drop("score")

    def memories(self, query: str | None = None, file: str | None = None, symbol_id: str | None = None) -> DataFrame:
        return notes.matching(self.notes(), query, file, symbol_id)

    def forget(self, note_id: str | None = None, before: str | None = None) -> int:
        old = self.notes()
        gone = old.where(F.col("id") == note_id) if note_id else notes.before(old, before or "")
        n = gone.count()
        if n:
            drop = gone.select("id")
            if self.store.exists("vectors"):
                self.store.write("vectors", self.store.read("vectors").join(drop, "id", "left_anti"))
            self.store.write("memories", old.join(drop, "id", "left_anti"))
        return n

    # -- watching

    def watch(self, root: str, read: Callable[[DataFrame], DataFrame], checkpoint: str):
        """Keeps the index in step with a folder: `read` turns (file) rows into (file, text)."""
        from orelith.streaming.watch import changes, debounce, watch

        def apply(batch: DataFrame, _: int) -> None:
            gone = batch.where("kind = 'unlink'").select("file")
            self.sync(read(batch.where("kind <> 'unlink'").select("file").distinct()), gone if not gone.isEmpty() else None)

        self._query = watch(debounce(changes(self.spark, root), self.config.debounce_ms), [apply], checkpoint)
        return self._query

    def stop(self) -> None:
        if self._query is not None:
            self._query.stop()
            self._query = None

    def clear(self, *tables: str) -> None:
        self.store.clear(*tables)


def format_row(row: dict, detailed: bool = False) -> str:
    """One result as text: kind, symbol, place, and with `detailed` the signature and score."""
    symbol = "#".join(x for x in (row.get("class"), row.get("name")) if x) or row.get("text") or row.get("id")
    place = f"{row.get('file') or '-'}" + (f":{row['loc']}" if row.get("loc") else "")
    line = f"[{row.get('type')}] {symbol} ({place})"
    return line + (f"\n    {row.get('sig') or ''} score={row.get('score')}" if detailed else "")


def compact_row(row: dict) -> dict:
    """Without nulls, empty texts, lists and dicts, at any depth."""
    out = {k: compact_row(v) if isinstance(v, dict) else v for k, v in row.items()}
    return {k: v for k, v in out.items() if v not in (None, "", [], {})}
