from pyspark.sql import functions as F

from orelith.functions import rules
from orelith.operators import graph

COLUMNS = "project string, id string, type string, file string, name string, class string, loc string, refs array<string>, imports array<string>, exports array<string>"


def symbols(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def test_imported_names(spark):
    texts = ["import { run as go, stop } from './worker'", "import Main from './main'", "App.Core.Tools", "./plain", "const { a, b } = require('x')", "", None]
    d = spark.createDataFrame([(t,) for t in texts], "i string").select("i", F.array_sort(rules.imported_names(F.col("i"))).alias("n"))
    got = {r["i"]: r["n"] for r in d.collect()}
    assert got[texts[0]] == ["go", "run", "stop"] and got[texts[1]] == ["Main"] and got[texts[2]] == ["App.Core.Tools", "Tools"]
    assert got["./plain"] == [] and got[texts[4]] == ["a", "b"] and got[""] == [] and got[None] in (None, [])


def test_a_reference_prefers_an_imported_file(spark):
    rows = [
        ("p", "1", "method", "src/main.ts", "start", None, "1-2", ["run", "go", "far", "this.own", "nowhere", None], ["import { run } from './worker'", "Lib.Tool", "'./gone'"], ["start"]),
        ("p", "2", "method", "src/a.ts", "run", None, "1-2", None, None, ["run2"]),
        ("p", "3", "method", "src/worker.ts", "run", None, "1-2", [], [], ["run"]),
        ("p", "4", "method", "lib/a.cs", "go", "Other", "1-2", [], [], None),
        ("p", "5", "method", "lib/z.cs", "go", "Tool", "1-2", [], [], ["Tool"]),
        ("p", "6", "method", "src/main.ts", "own", None, "5-6", [], ["import { run } from './worker'", "Lib.Tool", "'./gone'"], ["start"]),
        ("p", "7", "method", "x/far.ts", "far", None, "1-2", [], [], []),
        ("q", "8", "method", "q/nowhere.ts", "nowhere", None, "1-2", [], [], []),
    ]
    s = symbols(spark, rows)
    got = {r["ref"]: (r["dst_id"], r["confidence"]) for r in graph.edges(s).where("src_id = '1'").collect()}
    assert got == {"run": ("3", "high"), "go": ("5", "high"), "far": ("7", "medium"), "this.own": ("6", "high"), "nowhere": (None, "missing-index")}
    assert graph.edges(s.limit(0)).count() == 0
    near = {tuple(r) for r in graph.preferred_files(s).collect()}
    assert near == {("src/main.ts", "src/worker.ts"), ("src/main.ts", "lib/z.cs")}


def test_callers_stay_in_their_project(spark):
    rows = [("p", "1", "method", "a.ts", "run", None, "1-2", [], [], []), ("p", "2", "method", "b.ts", "x", None, "1-2", ["run"], [], []), ("q", "3", "method", "c.ts", "y", None, "1-2", ["run"], [], [])]
    s = symbols(spark, rows)
    assert [r["id"] for r in graph.callers(s, s.where("id = '1'")).collect()] == ["2"]


def test_resolution_by_path(spark):
    rows = [("p", str(i), "method", f, "run", "Job", f"{i}-{i + 1}", [], [], []) for i, f in enumerate(["src/a/job.ts", "src/b/job.ts", "lib/only.cs"])]
    s = symbols(spark, rows)
    q = spark.createDataFrame([("a/job.ts#run",), ("JOB#run",), ("only#RUN",), ("job.ts#run",), ("lib/only.cs#nothing",), (None,), ("",), ("Job.run",)], "query string")
    got = {r["query"]: (r["id"], r["match"], r["ambiguous"]) for r in graph.resolve(s, q).collect()}
    assert got["a/job.ts#run"] == ("0", "exact", False) and got["JOB#run"][1:] == ("qualified", True) and got["Job.run"][1] == "qualified"
    assert "lib/only.cs#nothing" not in got and "job.ts#run" not in got
    files = {r["query"]: r["file"] for r in graph.indexed_files(s, spark.createDataFrame([("only",), ("b/JOB",), ("job",), ("none",), (None,)], "query string")).collect()}
    assert files == {"only": "lib/only.cs", "b/JOB": "src/b/job.ts"}
