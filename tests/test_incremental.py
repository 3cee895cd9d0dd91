from orelith.operators.incremental import manifest_history


def test_previous_generations_are_marked_for_compaction(spark):
    rows = [(f"g{i:02d}", f"2026-01-{i + 1:02d}") for i in range(25)]
    d = spark.createDataFrame([*rows, rows[3]], "generation_id string, started_at string")
    got = {r["generation_id"]: (r["age"], r["is_latest"], r["compaction"]) for r in manifest_history(d).collect()}
    assert got == {f"g{i:02d}": (24 - i, i == 24, i < 24) for i in range(4, 25)}
