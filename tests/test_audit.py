import random
import re

from orelith.operators import audit

TARGETS, FILES = "target string, project string, file string, symbols array<string>", "project string, file string"


def _strip(x):
    return re.sub(r"(?i)\.(?:test|spec)(?=\.)|tests?", "", x).lower()


def _brute(files, targets):
    out = []
    for target, project, file, symbols in targets:
        base = _strip(re.sub(r"\.[^.]*$", "", re.sub(r"^.*/", "", file)))
        words = {p.lower() for s in symbols or [] if s for p in re.split(r"[^A-Za-z0-9]+", re.sub(r"([A-Z])", r" \1", s)) if len(p) >= 3}
        found = set()
        for q, f in files:
            low = "/" + f.lower()
            if q == project and (any(x in low for x in ("__tests__/", "/test/", "/tests/", ".test.", ".spec.")) or re.search(r"tests?\.[^.]+$", low)):
                hay = _strip(f)
                found.add((-20 - 50 * (base != "" and base in hay) - 30 * any(w in hay for w in words), f))
        out += [(target, f, -s, "high" if s <= -70 else "medium" if s <= -45 else "low") for s, f in sorted(found)[:8]]
    return sorted(out)


def _rows(spark, files, targets):
    found = audit.test_candidates(spark.createDataFrame(files, FILES), spark.createDataFrame(targets, TARGETS))
    return sorted(map(tuple, found.collect())), found._jdf.queryExecution().executedPlan().toString()


def test_candidates_are_those_of_all_pairs(spark):
    r = random.Random(5)
    words = ["Order", "Cart", "get", "of", "Id", "Payment", "AuthenticationServiceFactoryOfPayments", "x", "test", "Spec"]
    name = lambda: "".join(r.choice(words) for _ in range(r.randint(1, 4)))
    files = [("pqr"[r.randrange(3)], f"{r.choice(['src', 'test', 'src/cart', 'lib/__tests__', 'Tests/get'])}/{name()}{r.choice(['.ts', '.test.ts', '.spec.js', 'Test.cs', ''])}") for _ in range(240)]
    files += [("p", "tests/a.ts"), ("p", "a\nb/cart.test.ts"), ("p", "test/"), ("p", "a\nb/cart.ts"), ("q", "test.ts"), ("s", "src/Cart.ts")]
    files += files[:20]
    targets = [(f"{p}{i}", p, f, [r.choice([name(), f"{name()}#{name()}", None, "", "a.b"]) for _ in range(r.randint(0, 4))]) for i, (p, f) in enumerate(files)]
    targets += [("none", "p", "src/Cart.ts", None), ("elsewhere", "z", "src/Cart.ts", ["cart"])]
    rows, _ = _rows(spark, files, targets)
    assert rows == _brute(files, targets) and {s for _, _, s, _ in rows} == {20, 50, 70, 100}


def test_letter_runs_are_not_broadcast(spark):
    files = [("p", f"test/Kettle{i}.test.ts") for i in range(40)]
    targets = [(f"src/Kettle{i}.ts", "p", f"src/Kettle{i}.ts", [f"KettleOf{i}"]) for i in range(40)]
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20  # at which one side, seen before it is exploded, looks small
    rows, plan = _rows(spark, files, targets)
    assert "BroadcastExchange" not in plan and rows == _brute(files, targets)
