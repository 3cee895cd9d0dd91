import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from orelith.operators import orphans
from orelith.operators.orphans import _Range, dangling

REF, PAR = "src string, space string, record_id string, ref_key string, moment long, reason string", "space string, parent_key string, valid_from long, valid_to long, src string"


def brute(refs, parents):
    out = set()
    for src, space, rec, key, t in refs:
        if key is None:
            continue
        own = [(a, b) for s, k, a, b in parents if (s, k) == (space, key) and a is not None]
        if not own:
            out.add((src, rec, key, "missing"))
        elif t is not None and not any(a <= t and (b is None or b > t) for a, b in own):
            out.add((src, rec, key, "deleted" if any(a <= t for a, b in own) else "late"))
    return out


def check(spark, refs, parents):
    r = spark.createDataFrame([(*x, "z") for x in refs], REF)
    p = spark.createDataFrame([(*x, "z") for x in parents], PAR)
    got = {(x["src"], x["record_id"], x["ref_key"], x["reason"]) for x in dangling(r, p).collect()}
    assert got == brute(refs, parents)


def test_random_intervals_and_nulls(spark):
    rnd = random.Random(3)
    parents = [(rnd.choice("pq"), rnd.choice([None, *"abcdef"]), rnd.choice([None, *range(20)]), rnd.choice([None, *range(25)])) for _ in range(60)]
    refs = [("s", rnd.choice("pqr"), str(i % 150), rnd.choice([None, *"abcdefgh"]), rnd.choice([None, *range(25)])) for i in range(200)]
    refs = list({(r[0], r[2], r[3]): r for r in refs}.values())
    check(spark, refs, parents)
    check(spark, [], parents)
    check(spark, refs[:5], [])


def test_hot_key_is_split_and_whole(spark):
    r = spark.range(6000).select(F.lit("s").alias("src"), F.lit("p").alias("space"), F.col("id").cast("string").alias("record_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("ref_key"), F.lit(5).cast("long").alias("moment"))
    p = spark.createDataFrame([("p", "hot", 9, None)], "space string, parent_key string, valid_from long, valid_to long")
    r = r.unionByName(r)
    out = dangling(r, p)
    assert out.where("ref_key = 'hot' AND reason = 'late'").count() == 2000 and out.count() == 6000
    per = {x["part"]: x["count"] for x in orphans._routed(r, p).where("is_ref > 0").groupBy("part").count().collect()}
    assert sum(per.values()) == 12_000 and len(per) >= 12 and max(per.values()) < 2500  # 4000 of the references share a key


def test_equal_hashes_are_told_apart():
    known = _Range(pd.DataFrame({"h": [7, 7], "full_key": ["a", "b"], "a": [1, 5], "b": [3, 9]}))
    got = known.reasons(np.array([7, 7, 7, 7]), np.array(["a", "b", "b", "c"], object), np.array([2, 2, 6, 6]), np.ones(4, bool))
    assert list(got) == ["", "late", "", "missing"]
