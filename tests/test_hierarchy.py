import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from orelith.operators import hierarchy as hier
from orelith.operators.hierarchy import descendants, hierarchy
from orelith.session import materialise


def brute(links):
    parent = {(t, n): p for t, n, p in links}
    out = {}
    for t, n in parent:
        path, x, seen = [n], n, {n}
        while True:
            p = parent[(t, x)]
            if p is None or (t, p) not in parent:
                out[(t, n)] = ("tree", path[-1], len(path) - 1, ">".join(reversed(path)))
                break
            if p in seen:
                out[(t, n)] = ("cycle" if p == n else "below-cycle", "", -1, "")
                break
            seen.add(p)
            path.append(p)
            x = p
    return out


def solve(spark, links, size):
    d = spark.createDataFrame([(*x, 1) for x in links], "tree string, node string, parent string, root int").drop("root")
    return {(r["tree"], r["node"]): (r["state"], r["root"], r["depth"], r["path"]) for r in hierarchy(d, size).collect()}


@pytest.mark.parametrize("size", [16, 1000])
def test_random_forests_with_cycles(spark, size):
    rnd = random.Random(size)
    links = []
    for t in "xyz":
        for i in range(14):
            links.append((t, f"n{i}", rnd.choice([None, "gone", *[f"n{rnd.randrange(14)}" for _ in range(5)]])))
    assert solve(spark, links, size) == brute(links)


def test_chain_over_many_fragments_and_self_parent(spark):
    links = [("t", f"c{i}", f"c{i - 1}" if i else None) for i in range(12)] + [("t", "self", "self"), ("t", "kid", "self")]
    got = solve(spark, links, 4)
    assert got == brute(links)
    assert got[("t", "c11")][2] == 11 and got[("t", "self")][0] == "cycle" and got[("t", "kid")][0] == "below-cycle"


def test_cycle_across_fragments(spark):
    links = [("t", f"c{i}", f"c{(i + 1) % 9}") for i in range(9)] + [("t", f"b{i}", f"c{i}") for i in range(9)]
    assert solve(spark, links, 4) == brute(links)


def test_hot_parent_empty_and_null(spark):
    links = [("t", "root", None)] + [("t", f"k{i}", "root") for i in range(40)]
    assert solve(spark, links, 8) == brute(links)
    assert solve(spark, [], 8) == {}
    d = spark.createDataFrame([(None, "a", None), (None, "b", "a"), ("t", None, "a")], "tree string, node string, parent string")
    assert {(r["node"], r["depth"]) for r in hierarchy(d).collect()} == {("a", 0), ("b", 1)}
    down = descendants(hierarchy(d)).collect()
    assert [(r["ancestor"], r["node"], r["distance"]) for r in down] == [("a", "b", 1)]


def _parts(nodes, per):
    d = materialise(nodes.select("tree", "node", "parent", F.col("node").alias("top"), F.col("node").alias("frag"), F.lit(1).alias("size"), F.lit("").alias("fate")), "test")
    return materialise(hier._cut(d, per, 0), "parts")


def _chain_and_forest(spark, n):
    chain = spark.range(n).select(F.lit("c").alias("tree"), F.col("id").cast("string").alias("node"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"))
    bush = spark.range(n).select(F.lit("f").alias("tree"), F.col("id").cast("string").alias("node"), F.when(F.col("id") > 0, F.pmod(F.xxhash64("id"), F.col("id")).cast("string")).alias("parent"))
    return chain, bush


def test_fragments_keep_edges_and_stay_small(spark):
    chain, bush = _chain_and_forest(spark, 40_000)
    star = spark.range(40_000).select(F.lit("s").alias("tree"), F.col("id").cast("string").alias("node"), F.when(F.col("id") > 0, "0").alias("parent"))
    for nodes, least in ((chain, 0.75), (bush, 0.3), (star, 0.0)):
        cut = _parts(nodes, 4000)
        assert cut.groupBy("part").count().agg(F.max("count")).first()[0] <= 4000 and cut.count() == 40_000
        above = cut.select("tree", F.col("node").alias("parent"), F.col("part").alias("p"))
        assert cut.join(above, ["tree", "parent"]).where("p = part").count() >= least * 40_000


def test_quotient_is_smaller_and_no_group_exceeds_a_fragment(spark, monkeypatch):
    seen, real = [], hier._solve

    def spy(nodes, per, sep, level):
        seen.append(nodes.count())
        return real(nodes, per, sep, level)

    monkeypatch.setattr(hier, "_solve", spy)
    n = 100_000
    chain, bush = _chain_and_forest(spark, n)
    out = hierarchy(chain, 5000, paths=False)
    got = out.agg(F.count("*"), F.sum((F.col("depth") == F.col("node").cast("int")).cast("int")), F.countDistinct("root", "state")).first()
    assert tuple(got) == (n, n, 1)
    assert seen[0] == n and all(b < 0.4 * a for a, b in zip(seen, seen[1:])) and seen[-1] <= 5000
    seen.clear()
    out = hierarchy(bush, 5000, paths=False).select("node", "depth", "root")
    above = out.select(F.col("node").alias("p"), F.col("depth").alias("d"))
    stepped = out.join(bush.select("node", "parent"), "node").join(above, F.col("parent") == F.col("p"))
    assert stepped.where("depth = d + 1 AND root = '0'").count() == n - 1
    assert all(b < 0.6 * a for a, b in zip(seen, seen[1:])) and seen[-1] <= 5000


def test_chains_that_meet_are_walked_once():
    rows = [("t", "r", None)] + [("t", f"a{i}", f"a{i - 1}" if i else "r") for i in range(50)] + [("t", f"{s}{i}", f"{s}{i - 1}" if i else "a49") for s in "xy" for i in range(5)]
    pdf = pd.DataFrame([(*x, x[1], x[1], 1, "") for x in rows], columns=["tree", "node", "parent", "top", "frag", "size", "fate"])
    q = hier._contract(pdf, pd.DataFrame({"tree": ["t", "t"], "node": ["x4", "y4"]}), ">").set_index("node")
    assert dict(q["parent"]) == {"x4": "a49", "y4": "a49", "a49": None} and dict(q["size"]) == {"x4": 5, "y4": 5, "a49": 51}
