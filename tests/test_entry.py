import __spark_entry__ as entry


def test_entry_and_oracle_cover(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_run(spark, sf):
    for name in ("p1_found", "p2_found", "p7_found", "exact_search", "text_chunks", "stale_report"):
        assert entry.queries()[name](spark, sf).columns


def test_sql_agrees_on_a_sample_of_queries(spark, sf):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    for name in ("p1_found", "p7_found", "search_terms", "callees", "state_references", "method_diff"):
        got = entry.queries()[name](spark, sf)
        want = con.sql(entry.oracle_sql()[name])
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        at = [want.columns.index(c) for c in cols]
        assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall()), name
