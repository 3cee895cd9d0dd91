from pyspark.sql import functions as F

from orelith.functions import text
from orelith.functions.moments import shown
from orelith.operators import audit, graph


def test_read_ranges(spark):
    r = lambda rows: spark.createDataFrame(rows, "file string, start_line int, end_line int")
    asked = r([("a", 5, 6), ("a", 1, 20), ("b", 1, 2), (None, 1, 1), ("a", 8, 9)])
    left = {tuple(x) for x in audit.unread(asked, r([("a", 4, 7), ("a", 4, 5), ("a", 8, 8), (None, 1, 1)])).collect()}
    assert left == {("a", 1, 20), ("b", 1, 2), (None, 1, 1), ("a", 8, 9)} and audit.unread(asked.limit(0), asked).count() == 0


def test_lists_lines_and_times(spark):
    d = spark.createDataFrame([("[\"a\",\"b\"]", "\n".join(map(str, range(100))), 86_400_000_000 + 61_500_000), ("no list", "x", -1), (None, None, None)], "j string, t string, m long")
    rows = d.select(text.parse_list("j").alias("l"), text.bounded_lines(F.split("t", "\n")).alias("b"), shown(F.col("m")).alias("s")).collect()
    assert rows[0]["l"] == ["a", "b"] and rows[1]["l"] is None and len(rows[0]["b"]) == 80 and rows[0]["b"][59:61] == ["59", "80"] and rows[1]["b"] == ["x"]
    assert [x["s"] for x in rows] == ["1970-01-02 00:01:01", "1969-12-31 23:59:59", None]


def test_public_symbols_ages_and_matches(spark):
    p = spark.createDataFrame([("f", "TokenBuilder"), ("f", "To"), ("f", "other"), ("f", None)], "file string, symbol string")
    assert {r["symbol"] for r in audit.of_symbol(p, "token").collect()} == {"TokenBuilder", "To"} and audit.of_symbol(p, " ").count() == 4
    m = spark.sql("SELECT TIMESTAMP_NTZ'2025-01-01 00:00:00' AS finished_at, TIMESTAMP_NTZ'2025-01-02 01:30:00' AS now UNION ALL SELECT NULL, TIMESTAMP_NTZ'2025-01-02 01:30:00'")
    assert {(r["age_hours"], r["is_old"]) for r in audit.index_age(m, F.col("now")).collect()} == {(25, True), (None, False)}
    s = spark.createDataFrame([("1", "method", "f", "1-2", "run", "Job"), ("2", "method", "f", "5-6", "runner", None), ("3", "class", "f", "1-9", "Job", "Job"), ("4", "method", "g", "1-2", "run", None)], "id string, type string, file string, loc string, name string, class string")
    assert {tuple(r) for r in audit.same_file_symbols(s, s.where("id = '1'")).collect()} == {("1", "2"), ("1", "3")}
    assert {r["id"]: r["score"] for r in graph.match_candidates(s, s, "Job#run").collect()} == {"1": 110, "2": 60, "4": 60}
    worth = s.select("id", graph.match_score("run", F.lit(False), F.col("file") == "g", F.lit(True)).alias("w")).collect()
    assert {r["id"]: r["w"] for r in worth} == {"1": 125, "2": 85, "3": 85, "4": 150}
