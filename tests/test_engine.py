import json

import pytest
from pyspark.sql import functions as F

from orelith.operators import audit, incremental, notes, search, sections, state_refs
from orelith.plans.engine import Config, Engine, compact_row, format_row
from orelith.sources import extract, providers, store

ALPHA = """import { go } from './beta';
export class Alpha extends Base implements IRun {
  @Get('x')
  async stepA(id: number, opts: any = {}): Promise<any> {
    this.user = props.value;
    return finish(store.auth.token, /[{"]/g);
  }
  entry() { this.stepA(1); }
}
export function finish(a) { return a + 1; }
"""
BETA = """const x = require('./alpha');
function go(n) { return Alpha.stepA(n); }
module.exports = { go };
"""
GAMMA = """using System;
namespace App.Core
{
public class Gamma : BaseThing, IGamma
{
    public async Task<int> Run(int id, string s)
    {
        var open = "{ no block (";
        return Helper.Do(id);
    }
}
}
"""


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    (root / "src").mkdir()
    for name, body in (("alpha.ts", ALPHA), ("beta.js", BETA), ("gamma.cs", GAMMA), ("notes.md", "intro text\n# One\nbody one\n## Two\n"), ("skip.bin", "x"), ("long.txt", "first para\nmore\n\nsecond para")):
        (root / "src" / name).write_text(body)
    return root


@pytest.fixture(scope="module")
def engine(spark, project, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('state')}", Config(include=("src/**/*.ts", "src/**/*.js", "src/**/*.cs")))
    e.counts = e.scan(str(project))
    return e


def test_extractors():
    a, b, g = extract.parse_script(ALPHA, "a.ts"), extract.parse_script(BETA, "b.js"), extract.parse_csharp(GAMMA, "g.cs")
    assert [(m["name"], m["class"]) for m in a["methods"]] == [("stepA", "Alpha"), ("entry", "Alpha"), ("finish", None)]
    m = a["methods"][0]
    assert m["refs"] == ["finish"] and m["is_async"] and m["decorators"] == ["Get"] and "opts: any = {}" in m["sig"] and m["loc"] == "4-7"
    assert a["classes"][0]["extends_name"] == "Base" and a["classes"][0]["implements"] == ["IRun"] and a["imports"] == ["./beta"] and a["exports"] == ["Alpha", "finish"]
    assert b["imports"] == ["./alpha"] and b["exports"] == ["go"] and b["methods"][0]["refs"] == ["Alpha.stepA"]
    assert g["classes"][0]["extends_name"] == "BaseThing" and g["classes"][0]["implements"] == ["IGamma"] and g["ns"] == "App.Core"
    assert g["methods"][0]["refs"] == ["Helper.Do"] and g["imports"] == ["System"] and g["exports"] == ["App.Core", "Gamma"]
    assert extract.parse_script("", "x.js")["methods"] == [] and extract.parse_script("class {", "x.js")["classes"] == []


def test_scan_search_graph(engine, project):
    assert engine.counts == {"added": 5}
    assert engine.scan(str(project)) == {"unchanged": 5}
    hit = engine.search("stepA")
    assert hit.mode == "exact" and hit.rows.first()["name"] == "stepA"
    assert engine.search("stepA(x)").fallback in ("normalized-exact", "semantic")
    assert {r["name"] for r in engine.callers("Alpha.stepA").collect()} == {"entry", "go"}
    assert {r["confidence"] for r in engine.callees("Alpha.entry").collect()} == {"high"}
    assert {r["name"] for r in engine.trace("Alpha.entry").collect()} == {"entry", "stepA", "finish"}
    assert {r["ref"] for r in engine.refs("Alpha.entry", 2).collect()} == {"this.stepA", "finish"}
    assert engine.symbol("nothing").count() == 0 and engine.search("(", "regex").rows.count() == 0
    assert engine.hybrid("step a", 5).rows.count() > 0
    assert {r["file"] for r in engine.files("beta").collect()} == {"src/beta.js"}
    names = {r["name"] for r in engine.symbols().where(F.col("file").endswith(".md") | F.col("file").endswith(".txt")).collect()}
    assert {"intro", "One", "paragraph 1", "paragraph 2"} == names


def test_state_impact_stale(engine, project):
    assert [r["path"] for r in engine.writers("user").collect()] == ["this.user"]
    assert {r["path"] for r in engine.readers("store").collect()} == {"store.auth.token"}
    impact = engine.impact("Alpha.stepA")
    assert impact["risk"].first()["risk_level"] == "high" and impact["callers"].count() == 2
    assert engine.stale(str(project)).where("severity <> 'low'").count() == 0
    assert engine.status()["files"] == 5


def test_sync_notes_and_rerank(engine):
    assert engine.sync(engine.spark.createDataFrame([("src/beta.js", BETA + "function extra() {}\n")], "file string, text string")) == {"changed": 1, "vanished": 4}
    assert engine.search("extra", "exact").rows.count() == 1
    engine.sync(engine.spark.createDataFrame([], "file string, text string"), engine.spark.createDataFrame([("src/gamma.cs",)], "file string"))
    assert engine.search("Gamma", "exact", kind="class").rows.count() == 0
    i = engine.remember("careful with stepA", "2025-01-01", file="src/alpha.ts")
    engine.remember("old", "2024-01-01")
    assert engine.memories("stepa").first()["id"] == i and engine.forget(before="2025-01-01") == 1 and engine.forget("none") == 0

    class Last:
        def select(self, query, candidates, limit):
            return ["made up", candidates[-1]["id"]]

    engine.reranker = Last()
    out = engine.smart_search("step a", 1)
    assert out.telemetry["stage"] == "selected" and out.rows.count() == 1
    assert list(engine.search_batch("entry | go |entry")) == ["entry", "go"]
    found = engine.search_file("src/alpha.ts", ALPHA, "step")
    assert found["total"] == 2 and not found["truncated"]
    assert engine.peek("\n".join(map(str, range(1, 21))), "6-8").split("\n")[0] == "3"
    with pytest.raises(ValueError):
        engine.snippet("a", 5, 6)
    assert format_row({"type": "method", "name": "a", "class": "B", "file": "f", "loc": "1-2"}) == "[method] B#a (f:1-2)" and compact_row({"a": None, "b": {"c": []}, "d": 1}) == {"d": 1}


def test_index_follows_deletions_and_remembers(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}", Config(insights=True))
    f = lambda *rows: spark.createDataFrame(list(rows), "file string, text string")
    e.ingest(f(("a.ts", "import { helper } from './b';\nexport function main() { helper(1); }\n"), ("b.ts", "export function helper(x) { return x; }\n")), complete=True)
    target = e.callees("main").first()
    assert target["confidence"] == "high" and target["dst_id"] is not None
    assert {r["file"]: r["n_pending"] for r in e.pending_insights().collect()} == {"a.ts": 1, "b.ts": 1} and e.status()["pending"] == 2
    cached = e.store.count("embedding_cache")
    e.sync(f().limit(0), spark.createDataFrame([("b.ts",)], "file string"))
    assert e.callees("main").first()["dst_id"] is None and e.store.count("embedding_cache") == cached
    runs = e.manifests().collect()
    assert [r["status"] for r in runs] == ["completed", "completed"] and runs[0]["is_latest"] and runs[1]["compaction"] and runs[1]["indexed_files"] == 2 and runs[1]["total_methods"] == 2
    n_vectors = e.status()["vectors"]
    i = e.remember("take care of the main entry point", "2025-01-01")
    assert e.status()["vectors"] == n_vectors and e.similar("main entry point", most=1.3).first()["id"] == i
    assert e.similar("entry", most=0.01).first()["id"] == i and e.similar("zzz qqq", most=0.01).count() == 0  # by words
    hits = {r["id"]: r for r in e.hybrid("main entry", 10).rows.collect()}
    assert "memory" in hits[i]["signals"] and "memory" in hits[i]["matched_by"] and any("name" in r["matched_by"] for r in hits.values())
    assert e.forget(i) == 1 and e.store.read("vectors").where("kind = 'memory'").count() == 0


def test_patterns_are_checked_by_the_engine_that_runs_them(spark):
    assert not search.valid_pattern(spark, "(?P<x>get)") and not search.valid_pattern(spark, "(") and search.valid_pattern(spark, "(?<x>get)")
    d = spark.createDataFrame([("a.b\\Ec",), ("aXb",)], "t string")
    assert [r["t"] for r in d.where(F.col("t").rlike(search.quoted("a.b\\Ec"))).collect()] == ["a.b\\Ec"]


def test_sections_cap_and_blanks(spark):
    long = "\n".join(["x"] * 80) + "\n\n" + "y"
    d = spark.createDataFrame([("a", "\n\none\ntwo\n\n\nthree", 1), ("b", long, 1), ("c", None, 1), ("d", "", 1), ("e", " \n ", 1)], "file string, text string, name int")
    got = {(r["file"], r["name"]): (r["start_line"], r["end_line"]) for r in sections.text_chunks(d).collect()}
    assert got == {("a", "paragraph 1"): (1, 4), ("a", "paragraph 2"): (6, 7), ("b", "paragraph 1"): (1, 80), ("b", "paragraph 2"): (81, 82)}
    m = spark.createDataFrame([("a", "# H\n```\n# in fence\nx\n```\n##### five\n"), ("b", "plain"), ("c", "# only head"), ("d", None)], "file string, text string")
    assert {(r["file"], r["name"]) for r in sections.markdown_sections(m).collect()} == {("a", "H"), ("a", "in fence"), ("b", "content")}


def test_incremental(spark):
    f = lambda rows: spark.createDataFrame(rows, "file string, checksum string")
    s = incremental.file_states(f([("a", "1"), ("b", "2"), ("c", None), ("d", "4")]), f([("a", "1"), ("b", "x"), ("c", "3"), ("e", "5"), ("d", "4")]), f([("a", "1")]))
    assert {tuple(r) for r in s.collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "changed"), ("d", "missing-header"), ("e", "vanished")}
    m = lambda rows: spark.createDataFrame(rows, "id string, file string, loc string, body string")
    d = incremental.method_diff(m([("1", "f", "1-2", "a"), ("2", "f", "3-4", "b"), ("3", "f", "5-6", "c")]), m([("1", "f", "1-2", "A"), ("9", "f", "3-4", "b"), ("8", "f", "7-8", "z")]))
    assert {(r["id"], r["state"]) for r in d.collect()} == {("1", "updated"), ("9", "updated"), ("8", "added"), ("3", "removed")}
    e = spark.createDataFrame([("a", 0, "change"), ("a", 5, "change"), ("a", 6, "unlink"), ("a", 30, "add"), (None, 1, "change")], "file string, s long, kind string").select("file", F.timestamp_seconds("s").alias("at"), "kind")
    assert {(r["kind"], r["at"].second) for r in incremental.debounced(e, 10).collect()} == {("change", 5), ("unlink", 6), ("add", 30)}
    assert incremental.upsert(f([("a", "1")]), f([]), "file").count() == 1


def test_audit_and_notes(spark):
    t = spark.createDataFrame([("a.ts", "1"), ("b.ts", "2"), ("c.py", "3"), ("d.ts", "4")], "file string, checksum string")
    disk = spark.createDataFrame([("a.ts", "9"), ("c.py", "3"), ("d.ts", "4")], "file string, checksum string")
    heads = spark.createDataFrame([("a.ts",), ("d.ts",)], "file string")
    methods = spark.createDataFrame([("a.ts", "m", None, None), ("b.ts", "n", None, None)], "file string, name string, class string, insight string")
    got = {r["issue"]: r["n_issues"] for r in audit.issue_counts(audit.stale_issues(t, disk, heads, methods, 1, 4, ["typescript"], pending=2)).withColumnRenamed("kind", "issue").collect()}
    assert got == {"changed-file": 1, "checksum-mismatch": 1, "missing-file": 1, "missing-header": 1, "parse-failed": 1, "unsupported-extension": 1, "stale-insight": 1, "missing-vector": 1, "vector-mismatch": 1, "pending-insight": 1}
    n = spark.createDataFrame([("1", "by symbol", "f", "s", "2025"), ("2", "by file", "f", None, "2026"), ("3", "100% sure", None, None, "2024")], "id string, text string, file string, symbol_id string, created_at string").withColumn("symbol", F.lit(None).cast("string"))
    r = spark.createDataFrame([("s", "f"), ("x", "f"), ("y", None)], "id string, file string")
    assert {(x["id"], x["hint"]) for x in notes.hints(r, n).collect()} == {("s", "by symbol"), ("x", "by file"), ("y", None)}
    assert [x["id"] for x in notes.matching(n, "0%").collect()] == ["3"] and notes.matching(n, "1%sure", like=True).count() == 1


def test_bm25_matches_plain_python(spark):
    import math

    docs = {"1": "red kettle kettle", "2": "kettles and pans", "3": "blue pan", "4": None, "5": ""}
    d = spark.createDataFrame(list(docs.items()), "doc_id string, text string")
    got = {r["doc_id"]: r["score"] for r in search.bm25(search.postings(d, {"text": F.col("text")}), ["kettle", "red"], {"text": 2.0}).collect()}
    toks = {k: (v or "").split() for k, v in docs.items() if v}
    avg = sum(map(len, toks.values())) / len(toks)
    want = {}
    for k, ts in toks.items():
        total, n_hit = 0.0, 0
        for q in ("kettle", "red"):
            f = 2.0 * sum(t.startswith(q) for t in ts)
            df = sum(any(t.startswith(q) for t in x) for x in toks.values())
            idf = math.log((len(toks) - df + 0.5) / (df + 0.5))
            if f:
                n_hit += 1
                total += (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(ts) / avg))
        if n_hit:
            want[k] = total * (2 if n_hit == 2 else 1)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_knn_ties_and_bad_vectors(spark):
    v = spark.createDataFrame([("a", "m", [1.0, 0.0]), ("b", "m", [1.0, 0.0]), ("c", "x", [0.0, 1.0]), ("d", "m", None), ("e", "m", [1.0])], "id string, kind string, vector array<float>")
    assert [r["id"] for r in search.knn(v, [1.0, 0.0], 3).collect()] == ["a", "b", "c"] and [r["id"] for r in search.knn(v, [1.0, 0.0], 3, "x").collect()] == ["c"]


def test_state_reference_kinds(spark):
    d = spark.createDataFrame([("f", "this.user = props.value;\nif (this.a == 1) { appConfig.x; JwtConfig.Issuer += 2; }\nthis.go(1); state?.n++;"), ("g", None)], "file string, text string")
    got = {(r["line"], r["path"], r["kind"]) for r in state_refs.state_references(d).collect()}
    assert got == {(1, "this.user", "write"), (1, "props.value", "read"), (2, "this.a", "read"), (2, "JwtConfig.Issuer", "write"), (3, "state.n", "write")}


def test_providers_and_cache(spark, tmp_path):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) == 1:
            raise providers.ProviderError("slow down", 429)
        return "ok"

    g = providers.Guard(sleep=lambda s: None)
    assert g.call(flaky) == "ok" and g.counts["retries"] == 1 and g.counts["rate_limits"] == 1

    def bad():
        raise providers.ProviderError("bad", 400)

    with pytest.raises(providers.ProviderError):
        g.call(bad)
    assert g.counts["non_retryable"] == 1
    sizes = []

    def context(t):
        sizes.append(len(t))
        raise providers.ProviderError("context length exceeded", 400)

    with pytest.raises(providers.ProviderError):
        providers.embed_shrinking(context, "x" * 5000)
    assert sizes == [2000, 1000, 500, 250]
    texts = spark.createDataFrame([("1", "a b"), ("2", "a b"), ("3", "c")], "id string, text string")
    cache = spark.createDataFrame([], "key string, vector array<float>")
    e = providers.HashingEmbedder(8)
    full, fresh = store.embed_missing(texts, cache, lambda d: providers.embed_frame(d, e), e.name, 8)
    assert fresh.count() == 2 and full.where("vector IS NULL").count() == 0
    assert store.embed_missing(texts, fresh, lambda d: providers.embed_frame(d, e), e.name, 8)[1].count() == 0
    s = store.IndexStore(spark, f"file://{tmp_path}")
    s.write("memories", texts)
    s.upsert("memories", spark.createDataFrame([("1", "new")], "id string, text string"), "id")
    s.vacuum()
    assert s.count("memories") == 3 and json.loads((tmp_path / "current.json").read_text()) == {"memories": 2}
    s.clear()
    assert s.count("memories") == 0
