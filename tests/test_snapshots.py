from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orelith.operators.snapshots import latest_by, snapshot_changes

SCHEMA = "k string, other string, rank int, at int, checksum string, methods array<string>, change_kind string"


def run(spark, rows, last):
    d = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    out = snapshot_changes(d, ["k", "other"], "rank", last, ["checksum"], ["methods"], "at")
    return {(r["k"], r["rank"]): (r["change_kind"], tuple(r["changed_fields"])) for r in out.collect()}


def test_kinds_nulls_order_and_gaps(spark):
    rows = [
        ("a", "r", 1, 1, "x", ["m1", "m2"]), ("a", "r", 2, 1, "x", ["m2", "m1", "m1"]),  # order and repetition mean nothing
        ("b", "r", 1, 1, None, ["m"]), ("b", "r", 2, 1, "y", ["m"]),  # unknown checksum is no change
        ("c", "r", 1, 1, "x", None), ("c", "r", 2, 1, "x", []),  # null is an empty set
        ("d", "r", 1, 1, "x", ["m", None]), ("d", "r", 2, 1, "z", ["n"]),
        ("e", "r", 1, 1, "x", None), ("f", "r", 2, 1, "x", None), ("g", "r", 1, 1, "x", None), ("g", "r", 3, 1, "x", None),
        (None, "r", 1, 1, "x", None), (None, "r", 2, 1, "y", None),
    ]
    got = run(spark, rows, 3)
    assert got[("d", 2)] == ("changed", ("checksum", "methods"))
    assert got[("e", 2)][0] == "removed" and got[("f", 2)][0] == "added"
    assert got[("g", 2)][0] == "removed" and got[("g", 3)][0] == "added"
    assert got[(None, 2)][0] == "changed" and got[(None, 3)][0] == "removed"
    assert not {("a", 2), ("b", 2), ("c", 2)} & set(got)
    assert run(spark, [], 3) == {}


def test_latest_counts_and_ties_are_settled(spark):
    d = spark.createDataFrame([("1", 1, "a"), ("1", 2, "b"), ("1", 2, "c"), (None, 9, "z"), ("2", None, "q")], "id string, at int, v string")
    assert {tuple(r) for r in latest_by(d, "id", "at", ["v"]).collect()} == {("1", 2, "c"), ("2", None, "q")}


def test_hot_record_is_one_row(spark):
    d = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k"), F.lit("r").alias("other"), (F.col("id") % 2 + 1).cast("int").alias("rank"), F.col("id").cast("int").alias("at"), F.lit("c").alias("checksum"), F.array(F.col("id").cast("string")).alias("methods"))
    out = snapshot_changes(d, ["k", "other"], "rank", 2, ["checksum"], ["methods"], "at")
    assert out.where("k = 'hot'").count() == 1 and out.count() == 2001


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.tuples(st.sampled_from("abcde"), st.integers(1, 3)), st.tuples(st.sampled_from([None, "x", "y"]), st.sets(st.sampled_from("mno"), max_size=2)), max_size=12))
def test_against_brute_force(spark, snap):
    want = {}
    for r in (2, 3):
        for k in "abcde":
            a, b = snap.get((k, r - 1)), snap.get((k, r))
            if a is None and b is not None:
                want[(k, r)] = "added"
            elif a is not None and b is None:
                want[(k, r)] = "removed"
            elif a is not None and (a[1] != b[1] or (a[0] and b[0] and a[0] != b[0])):
                want[(k, r)] = "changed"
    got = run(spark, [(k, "r", r, 1, c, sorted(m)) for (k, r), (c, m) in snap.items()], 3)
    assert {k: v[0] for k, v in got.items()} == want
