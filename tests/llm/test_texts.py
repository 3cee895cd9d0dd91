import random

from pyspark.sql import functions as F

from orelith.llm.authored import features, file_classes, is_templated, style, templates
from orelith.llm.grammar import lex, pairs
from orelith.llm.history import History, lcs, restates
from orelith.llm.subjects import document_subjects, repaired, sentences, subject_counts
from orelith.llm.syntax import syntax_errors
from orelith.session import new_path


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(12))] for _ in range(2))
        assert lcs(a, b) == brute_lcs(a, b)


def brute_history(notes, threshold=0.85):
    accepted, out = [], {}
    for i, g, t, b, at in sorted(notes, key=lambda n: (n[3], n[4], n[0])):
        w = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        hit = next((j for j, h, x in accepted if h == g and restates(w, x, threshold)), None)
        if hit is None:
            accepted.append((i, g, w))
        else:
            out[i] = hit
    return out


def test_history_against_brute_force(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    seeds = [[rnd.choice(words) for _ in range(rnd.randrange(8, 30))] for _ in range(12)]
    notes = []
    for n in range(150):
        w = list(rnd.choice(seeds))
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        notes.append((f"n{n:03d}", rnd.choice([None, "A", "B.c"]), rnd.choice([" ".join(w), ", ".join(w).upper()]), n // 40, rnd.randrange(5)))
    notes += [("e1", None, None, 0, 0), ("e2", None, "", 1, 0), ("e3", None, " !! ", 2, 0), ("x", "A", "one two", 2, 1)]
    h = History(spark, new_path(spark, "history"))
    got = {}
    for b in range(4):
        batch = spark.createDataFrame([n for n in notes if n[3] == b] * 2, "id string, grp string, text string, batch long, at long")
        got |= {r["id"]: r["other"] for r in h.absorb(batch).collect()}
        h = History(spark, h.path)  # the state is on disk
    want = brute_history(notes)
    assert set(got) == set(want)
    assert sum(got[k] == want[k] for k in want) >= 0.95 * len(want)
    assert h.accepted().count() == len(notes) - len(want) and len(h.state["runs"]) < 4
    assert h.absorb(spark.createDataFrame([], "id string, grp string, text string, batch long, at long")).count() == 0


def test_history_reads_no_more_when_it_grows(spark, monkeypatch):
    from pathlib import Path

    from orelith.llm import history as hist

    monkeypatch.setattr(hist, "KEYS_PER_RANGE", 100)

    def batch(n, at, first=0):
        d = spark.range(first, first + n).select(F.format_string("n%07d", "id").alias("id"), F.lit("g").alias("grp"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.substring(F.sha1(F.concat("id", F.lit(" "), i)), 1, 6)), " ").alias("text"))
        return d.withColumns({"batch": F.lit(at).cast("long"), "at": F.lit(at).cast("long")})

    read = []
    h = History(spark, new_path(spark, "history"))
    for step, n in enumerate((2000, 18_000)):  # the history grows tenfold
        h.absorb(batch(n, step, step * 10_000))
        keyed = h._keys(spark.createDataFrame([(f"x{i}", 9, i, "=g", [i * 7 + j for j in range(12)]) for i in range(10)], hist._NOTE), 1)
        touched = h._touched(keyed.select("key").distinct())
        read.append(sum(f.stat().st_size for r, spans in touched for x in spans for f in Path(h.path.removeprefix("file://"), f"keys-{r['run']}", f"span={x}").glob("*.parquet")))
    assert h.accepted().count() == 20_000 and len(h.state["runs"]) == 2 and max(r["bits"] for r in h.state["runs"]) >= 9
    assert 0 < read[1] < 2.5 * read[0]  # two runs instead of one


def test_history_merges_runs_of_like_size(spark):
    h = History(spark, new_path(spark, "history"))
    h.state["runs"] = []
    rows = lambda k, n: spark.createDataFrame([(f"{k}-{i}", k, i, "=g", [k * 1000 + i, i]) for i in range(n)], "id string, batch long, at long, grp string, toks array<int>")
    h._count(rows(0, 5))
    for k, n in enumerate((64, 3, 3)):
        h._write(rows(k, n))
    assert h._compact() == [] and h.accepted().count() == 70
    h._write(rows(9, 3))
    assert len(h._compact()) == 3 and [r["rows"] for r in h.state["runs"]] == [64, 9] and h.accepted().count() == 73


def test_history_hot_group_of_copies(spark):
    text = " ".join(f"t{i}" for i in range(20))
    d = spark.range(600).select(F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("id"), F.lit(None).cast("string").alias("grp"), F.when(F.col("id") % 3 == 0, F.lit(text)).otherwise(F.concat(F.lit("own words of "), F.sha1(F.col("id").cast("string")))).alias("text"), F.lit(1).alias("batch"), F.col("id").alias("at"))
    out = History(spark, new_path(spark, "history")).absorb(d).collect()
    assert len(out) == 199 and {r["other"] for r in out} == {"n0000"}


GOOD = {
    "a.ts": "import { x as y } from './z';\nexport class A<T extends B> extends ns.C<T> implements I {\n  private readonly n?: Map<string, number[]> = new Map();\n  constructor(private a: any, b = 1) { super(a); }\n  @Input() get v(): string | null { return this.n!.get(`a${b ? `}` : '{'}`)?.x ?? null }\n  async *gen(...r: any[]): AsyncGenerator<any> { for await (const q of r) yield q as any; }\n}\ntype F = (a: string) => void;\nenum E { P = 1, Q }\nlet re = /[{(\\/\"]+/g, o = { a, b: 1, ...r, async m() {} };\nlabel: for (;;) { if (a) continue label; else break }\n",
    "b.js": "#!/usr/bin/env node\n'use strict'\nconst a = require('./b')\nlet f = async (x, { y = 2, ...z } = {}) => ({ x, y })\nfunction* g() { const t = yield* h(); return t }\nmodule.exports = { a, f }\nif (a) b(); else if (c) { d() } else e()\ntry { x() } catch { y() } finally { z() }\nswitch (a) { case 1: b(); break; default: c() }\n!function(){var c=d||{};return e>5?c.n:h.r(f)}();\n/* <<<<<<< HEAD */ var s = '=======';\ndo { i++ } while (i < 3)\nnew Foo;\n",
    "c.cs": "using System;\nnamespace A.B\n{\n[Serializable]\npublic abstract partial class C<T> : D<T>, I where T : class, new()\n{\n    private readonly int[] _a = { 1, 2 };\n    public string Name { get; private set; } = \"x\";\n    public int this[int i] => _a[i];\n    public C(int a) : base(a) { }\n    public async Task<Dictionary<string, int>> Run(string s, params object[] r)\n    {\n        var q = $\"a {s} {{b}}\"; var v = @\"c:\\x\"\"\"; char c = '{';\n        if (s is string t && t.Length > 0) { throw new Exception(nameof(s)); }\n        foreach (var p in s.Split(',')) { continue; }\n        return await Task.FromResult(x => x?.Y ?? 1);\n    }\n    int Z => 1;\n}\n}\n",
    "view.tsx": "export function V<T>({ a, b }: P<T>): any {\n  const f = <U,>(x: U) => x;\n  if (a < b) { f(a); }\n  return (\n    <>\n      <Box.Item key={a} {...b} on-click='x' open>It's {a ? <b>yes</b> : null} {/* no */}</Box.Item>\n      <hr/>\n    </>\n  );\n}\n",
    "else.jsx": "if(a)if(b)c();else d={};else e();if (a) { b() } else if (c) for (;;) { d() } else { e() }\nif (a) do x(); while (y); else z()\n",
    "blank.ts": "\ufeff", "comment.cs": "// only\n/* this */\n", "null.js": None,
}
BAD = {
    "cut.ts": "export class A {\n  run() {\n    let total = ite", "conflict.js": "let a = 1;\n<<<<<<< ours\nlet b = 2;\n=======\nlet b = 3;\n>>>>>>> theirs\n", "python.js": "def f(rows):\n    for r in rows:\n        print(r)\n",
    "html.cs": "<!doctype html>\n<html><body>x</body></html>\n", "sharp.ts": "using System;\npublic class A { public int Id { get; set; } }\n", "typed.cjs": "function f(row: Row) { return row; }\n", "face.js": "interface Row { id: number }\n",
    "note.ts": "Some notes about this\n- ask again\n", "string.cs": "class A { string s = \"open; }\n", "comment.js": "let a; /* never ends", "paren.ts": "f((a, b);\n", "mixed.js": "f(a];\n", "ts.cs": "export function F(id: number): number {\n  return id;\n}\n",
    "head.ts": "export class A", "catch.js": "try { a() }\nb()\n", "import.ts": "import * as a\n",
    "else.js": "function f(a) {\n  g(a);\n  } else {\nreturn a;\n}\n", "else.ts": "class A {\n  f(a: any): any {\n    g(a);\n    } else {\n    return a;\n  }\n}\n", "else2.js": "a();\nb();\nelse c();\n",
    "tag.jsx": "const a = <A><b></A>;\n", "hole.tsx": "const a = <A x={1 +}/>;\n",
}


def test_syntax(spark):
    rows = [("r", f, t, "x") for f, t in [*GOOD.items(), *BAD.items()]] + [("r", "a.ts", GOOD["a.ts"], "x"), ("r", "x.md", "not code (", "x"), (None, "n.ts", "(", "x")]
    got = {r["file"]: r["errors"] for r in syntax_errors(spark.createDataFrame(rows, "repo string, file string, text string, lang string")).collect()}
    assert set(got) == set(BAD), (set(got) ^ set(BAD), got)
    assert syntax_errors(spark.createDataFrame([], "repo string, file string, text string")).count() == 0


def test_grammars_and_lexer():
    for lang in ("js", "ts", "cs"):
        anywhere, _ = pairs(lang)
        assert ("=", ";") not in anywhere and ("BOF", "<") not in anywhere or lang == "ts"
    assert ("id", "id") not in pairs("js")[0] and ("id", "id") in pairs("cs")[0]
    assert lex("a /b/ c", "js")[0] == ["id", "/", "id", "/", "id"] and lex("= /b/g", "js")[0] == ["=", "re"]
    assert lex("x" * 200_000, "ts")[0] == ["id"] and lex("'a", "js")[2] == "string without end"


def test_file_classes(spark):
    hand = "import {a} from './b';\nexport class Order%dQueue extends Base {\n  async load%sPart(id: number): Promise<any> {\n    const total = Number(id) + 1;\n    if (total > 3) { this.save%sItem(total); }\n    return total;\n  }\n  save%sItem(x) { return x; }\n  find%sRow(y) { for (const k of y) { use(k); } }\n}\n"
    names = ["Alpha", "Bravo", "Carol", "Delta", "Echo", "Fox", "Golf", "Hotel"]
    files = [("r", f"h{i}.ts", hand % (i, n, n, n, n), 1) for i, n in enumerate(names)]
    lib = "/*! lib */\n" + "\n".join(f"function {v}Thing{i}(id, opts) {{\n  let next = {i};\n  return next;\n}}" for i, v in enumerate(("load", "merge", "apply", "find", "parse")))
    mini = "!function(){" + "".join(f"function {c}{i}(a,b){{var c=a||{{}};return b>{i}?c.k:a.p(b)}}" for i, c in enumerate("abcdefghij")) + "}();"
    gen = "\n".join(f"function yyaction_{i:03d}(s0) {{\n  return yytable[{i}] + {i};\n}}" for i in range(40))
    files += [("r", "lib.ts", lib, 1), ("r", "m.js", mini, 1), ("r", "g.ts", gen, 1), ("r", "d.ts", "export default [\n" + ",\n".join(f'  {{ "id": {i}, "code": "abc{i}xyz" }}' for i in range(40)) + "];", 1), ("r", "blob.js", 'module.exports = "' + "QUJD/+" * 200 + '";', 1), ("r", "e.ts", None, 1), ("r", "e2.ts", "", 1), ("r", "x.md", "text", 1), ("q", "lib.ts", lib, 1)]
    got = {(r["repo"], r["file"]): r["file_class"] for r in file_classes(spark.createDataFrame(files, "repo string, file string, text string, names int")).collect()}
    assert got[("r", "m.js")] == "minified" and got[("r", "g.ts")] == "generated" and got[("r", "d.ts")] == got[("r", "blob.js")] == "data" and got[("r", "lib.ts")] == got[("q", "lib.ts")] == "vendored"
    assert all(got[("r", f"h{i}.ts")] is None for i in range(8)) and got[("r", "e.ts")] is None and ("r", "x.md") not in got
    assert style("scheduleQueue0") == "lower0" and style("a_b00") == "lower_00" and features("", "js")[0] == []
    assert style("_md5Sum") == "_lower-inner" and style("parseHTTPHead") == "lower-abbr" and style("run") == "flat" and style("$") == "$"
    assert file_classes(spark.createDataFrame([], "repo string, file string, text string")).count() == 0


def test_vendored_third_and_minified_third(spark):
    verbs, nouns = ["load", "merge", "apply", "find", "parse"], ["Alpha", "Bravo", "Carol", "Delta", "Echo", "Fox", "Golf", "Hotel", "India", "Julia", "Kilo", "Lima"]
    hand = "export class %sQueue {\n  async load%sPart(id) {\n    const total = Number(id) + 1;\n    if (total > 3) { this.save%sItem(total); }\n    return total;\n  }\n  save%sItem(value) { return value; }\n}\n"
    lib = "\n".join(f"function {v}Thing{i}(id, opts) {{\n  let next = id + opts;\n  return next;\n}}" for i, v in enumerate(verbs))
    mini = "!function(){" + "".join(f"function {c}{i}(a,b){{var c=a||{{}};return b>{i}?c.k:a.p(b)}}" for i, c in enumerate("abcdefghij")) + "}();"
    files = [(f"r{i % 6}", f"h{i}.js", hand % ((n,) * 4)) for i, n in enumerate(nouns)]
    files += [(f"r{i % 6}", f"lib{i}.js", f"{lib}\nlet patch{n} = {i};\n") for i, n in enumerate(nouns)]  # one source, edited in every copy
    files += [(f"r{i % 6}", f"m{i}.js", f"{mini}var z{i}={i};") for i in range(12)]
    got = {r["file"]: r["file_class"] for r in file_classes(spark.createDataFrame(files, "repo string, file string, text string")).collect()}
    assert {f: c for f, c in got.items() if c} == {f"lib{i}.js": "vendored" for i in range(12)} | {f"m{i}.js": "minified" for i in range(12)}


def test_generated_by_any_template():
    words = ["Alpha", "Bravo", "Carol", "Delta", "Echo", "Fox", "Golf", "Hotel", "India"]
    single = "\n".join(f"function get{i}(s0) {{\n  return table[{i}];\n}}" for i in range(1, 10))
    stubs = "\n".join(f"function get{w}Stub(s) {{\n  return call{w}(s);\n}}" for w in words)
    own = "\n".join(f"function {v}(row) {{\n  return row.{w};\n}}" for v, w in zip(["open", "closeAll", "readLine", "send", "tidy", "mapRow", "sumUp", "countOf", "drop"], words, strict=True))
    kinds = [is_templated(f[0]) for f in (features(t, "js") for t in (single, stubs, own))]
    assert kinds == [True, True, False]
    assert len(templates("aB" * 100_000)) == 100_001 and templates("run") == set() and templates("get1") & templates("get27")


def test_each_name_test_decides(spark):
    verbs, nouns = ["load", "merge", "apply", "find", "parse"], ["Alpha", "Bravo", "Carol", "Delta", "Echo", "Fox", "Golf", "Hotel", "India", "Julia", "Kilo", "Lima"]
    hand = "export class %sQueue {\n  async load%sPart(id) {\n    const total = Number(id) + 1;\n    if (total > 3) { this.save%sItem(total); }\n    return total;\n  }\n  save%sItem(value) { return value; }\n}\n"
    files = [(f"r{i % 6}", f"h{i}.js", hand % ((n,) * 4)) for i, n in enumerate(nouns)]
    files.append(("r0", "snake.js", "\n".join(f"function {v}_thing_of(id, opts) {{\n  let next = id + opts;\n  return next;\n}}" for v in verbs)))  # foreign without any number
    files.append(("r1", "marked.js", "\n".join(f"function _{v}Thing(id, opts) {{\n  let next = id + opts;\n  return next;\n}}" for v in verbs)))
    files.append(("r2", "m.js", "!function(){" + "".join(f"function {c}(a,b){{var c=a||{{}};return b>{i}?c.k:a.p(b)}}" for i, c in enumerate("qwzjvxhygu")) + "}();"))
    files.append(("r3", "g.js", "\n".join(f"function get{n}Stub(s) {{\n  return call{n}(s);\n}}" for n in nouns)))
    files.append(("r4", "told.js", "run();"))
    d = spark.createDataFrame(files, "repo string, file string, text string")
    told = spark.createDataFrame([("r4", "told.js", ["do_this", "do_that", "not_this"], 1), ("r1", "marked.js", None, 1), ("r0", None, ["x"], 1)], "repo string, file string, names array<string>, text int")

    def verdicts():
        return {r["file"]: r["file_class"] for r in file_classes(d, told).where("file_class IS NOT NULL").collect()}

    assert verdicts() == {"snake.js": "vendored", "marked.js": "vendored", "told.js": "vendored", "m.js": "minified", "g.js": "generated"}


WORDS = {"law": "court verdict notary statute hearing bailiff", "food": "kettle recipe dough broth oven pantry", "sport": "goalkeeper league referee sprint relay trophy"}
FILL = ["Nothing else to do here.", "Run the whole suite before you push.", "Please keep lines short."]
TEMPLATES = ["The {a} of a {b} is rounded only at the end.", "Since then the {a} is linked with its {b} by key.", "Reading the {a} twice is cheap while writing the {b} is not.", "Merging two {a} entries keeps the older {b}."]


def test_subjects(spark):
    rnd = random.Random(5)
    docs, labels, truth = [], [], {}
    for i in range(400):
        s = rnd.choice(list(WORDS))
        w = WORDS[s].split()
        said = [rnd.choice(TEMPLATES).format(a=rnd.choice(w), b=rnd.choice(w)) for _ in range(4)] + [rnd.choice(FILL)]
        rnd.shuffle(said)
        docs.append((i, " ".join(said), rnd.choice(["en", "EN", "en-US", None]), False))
        truth[i] = {s}
        if i % 4 == 0:
            labels.append((i, s if i % 40 else rnd.choice(list(WORDS))))
    docs += [(900, None, "en", False), (901, "", None, False), (902, "!!! ...", "xx", False), (903, " ".join(FILL), "en", False), (904, "kettle dough", "en", True)]
    truth[903], truth[904] = set(), {"food"}
    d = spark.createDataFrame(docs, "doc_id long, text string, tag string, whole boolean").withColumn("subject", F.lit("clash"))
    items = spark.createDataFrame([(1, None)], "item_id long, text string")
    subs = spark.createDataFrame([(k, k) for k in WORDS], "subject string, description string")
    counts = subject_counts(d, spark.createDataFrame(labels, "doc_id long, subject string"), subs, items)
    got = {}
    for r in document_subjects(counts).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    right = sum(got.get(i, set()) == t for i, t in truth.items())
    assert right >= 0.95 * len(truth) and got.get(903, set()) == set() and not {900, 901, 902} & set(got)
    assert subject_counts(d.limit(0), spark.createDataFrame(labels, "doc_id long, subject string"), subs, items).count() == 0


def test_sentences():
    assert repaired("kavÅŸak Ã¼ şu ü x") == "kavşak ü şu ü x"
    assert sentences("# head\n- One line.\n- Two! Three?\n\n", False) == ["- One line.", "- Two!", "Three?"] and sentences("a. b", True) == ["a. b"] and sentences(" ", True) == []


def test_syntax_takes_linear_time_in_a_file(spark):
    import time

    def seconds(n):
        d = spark.createDataFrame([("r", "a.js", "f(a);\n" * n)], "repo string, file string, text string")
        began = time.time()
        assert syntax_errors(d).count() == 0
        return time.time() - began

    seconds(10)
    assert seconds(40_000) < 3 * seconds(20_000) + 2
