from pyspark.sql import functions as F

from orelith.functions import rules, text
from orelith.functions.identity import method_ids
from orelith.functions.moments import month_of, text_micros, wall_micros
from orelith.functions.paths import clean_path
from orelith.plans.engine import batch_limit, candidate_limit, resolve_limit
from orelith.sources import files


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_words(spark):
    assert one(spark, text.split_identifier(F.lit("parseHTTPRequest_now.v2"))) == "parse HTTP Request now v2"
    assert one(spark, text.search_terms(F.lit("buildToken and the buildToken için x"))) == ["build", "token"]
    assert one(spark, text.compact(F.lit("Auth.Service#run"))) == "authservicerun"
    assert one(spark, text.normalize_query(F.lit("run(Map<string, int> x);"))) == "run Map x"
    assert one(spark, text.path_keywords(F.lit("src/auth/TokenBuilder.ts"))) == "auth Token Builder"
    assert one(spark, text.infer_namespace(F.array(F.lit("a.b"), F.lit("App.Core")))) == "App.Core"


def test_intents(spark):
    for q, want in (("trace login", "trace"), ("who callers", "dependency"), ("AuthService.run", "exact-symbol"), ("giriş akışı nerede", "semantic"), ("", "mixed"), ("a=b!", "mixed")):
        assert one(spark, rules.intent(F.lit(q))) == want
    assert one(spark, rules.prepare_intent(F.lit("Impact of it"))) == "dependency"


def test_references_ranges_signatures(spark):
    assert set(one(spark, rules.reference_keys(F.lit("this.deps?.run")))) == {"this.deps.run", "run", "deps.run"}
    assert set(one(spark, rules.reference_keys(F.lit("A#b")))) == {"A#b", "b"}
    assert set(one(spark, rules.selectors(F.lit("i"), F.lit("run"), F.lit("A")))) == {"i", "run", "A.run", "A#run"}
    assert set(one(spark, rules.selectors(F.lit("i"), F.lit("run"), F.lit(None).cast("string")))) == {"i", "run"}
    assert one(spark, rules.expand_range(F.lit("5-9"))) == "1-17" and one(spark, rules.expand_range(F.lit("?"))) == "?"
    s = F.lit("public static async Task<int> Go(int a, string b)")
    assert one(spark, rules.visibility(s)) == "public" and one(spark, rules.is_static(s)) and one(spark, rules.parameters(s)) == ["int a", "string b"]
    assert one(spark, rules.return_type(s, F.lit("Go"))) == "Task<int>"
    assert one(spark, rules.return_type(F.lit("go(a): Promise<any> {"), F.lit("go"))) == "Promise<any>"


def test_paths(spark):
    for raw, want in ((" .\\a\\\\b.ts ", "a/b.ts"), ("./a//b", "a/b"), (None, None)):
        assert one(spark, clean_path(F.lit(raw).cast("string"))) == want
    for raw, want in (("a/../b", "a/../b"), ("../x", None), ("", None), ("/etc/x", None), ("a/../../x", None)):
        assert one(spark, files.guarded(F.lit(raw))) == want
    for f, want in (("test/a.js", True), ("src/a.spec.ts", True), ("src/latest.ts", True), ("src/a.ts", False), ("src/__tests__/a.ts", True)):
        assert one(spark, rules.is_test_path(F.lit(f))) is want
    assert "src/b/c.ts" in one(spark, rules.import_candidates(F.lit("src/a/x.ts"), F.lit("import q from '../b/c'")))
    assert one(spark, rules.import_candidates(F.lit("src/a/x.ts"), F.lit("react"))) is None


def test_moments(spark):
    base = 1737348011304000
    for t in ("2025-01-20T04:40:11.304Z", "2025-01-20T07:40:11.304+03:00", "2025-01-20 04:40:11.304", "2025-01-20T01:40:11.304-0300"):
        assert one(spark, text_micros(F.lit(t))) == base
    assert one(spark, text_micros(F.lit("soon"))) is None
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert one(spark, wall_micros(F.expr("timestamp_ntz'2025-01-20 04:40:11.304'"))) == base
        assert one(spark, month_of(F.lit(base))) == "2025-01" and one(spark, text_micros(F.lit("2025-01-20 04:40:11.304"))) == base
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_ids_of_overloads(spark):
    rows = [("f", "A", "run", "run(a)", "1-2"), ("f", "A", "run", "run(a)", "5-6"), ("f", "A", "run", "run(b)", "8-9"), ("g", None, "run", None, None)]
    ids = [r["id"] for r in method_ids(spark.createDataFrame(rows, "file string, class string, name string, sig string, loc string")).collect()]
    assert len(set(ids)) == 4 and all(len(i) == 23 for i in ids)


def test_limits_and_globs(spark):
    assert [resolve_limit(x, 3, 20) for x in (None, 0, float("nan"), 99, 2.9, -4)] == [3, 3, 3, 20, 2, 1]
    assert [batch_limit(None, n) for n in (1, 4, 9)] == [3, 2, 1] and batch_limit(5, 9) == 5 and batch_limit(500, 1) == 100
    assert candidate_limit(2, "trace") == 8 and candidate_limit(2, "semantic") == 6
    for g, path, want in (("src/**/*.ts", "src/a.ts", True), ("src/**/*.ts", "src/x/y/a.ts", True), ("src/*.ts", "src/x/a.ts", False), ("*.{js,ts}", "a.js", True), ("**/.x/**", "a/.x/b", True)):
        assert one(spark, files.matches_any(F.lit(path), [g])) is want
    assert files.ignore_globs(["", "# c", "!keep", "dist/", "*.log"])[0] == "dist" and files.prose_globs(["src/**/*.ts"])[0] == "src/**/*.md"
    assert files.ignore_entry("a/b/", True) == "a/b/**"
