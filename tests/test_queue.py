from orelith.operators import queue
from orelith.sources.providers import insight_prompt, insights, rerank_prompt, selected_ids


def test_queue_states(spark):
    q = spark.createDataFrame([], queue.SCHEMA)
    new = spark.createDataFrame([("f", "a", "x"), ("f", "b", "y"), ("f", "a", "z"), (None, "c", "n")], "file string, method_id string, code string")
    q = queue.enqueue(queue.enqueue(q, new, "1"), new, "2")
    assert q.count() == 2 and {r["queued_at"] for r in q.collect()} == {"1"}
    q, got = queue.take(q, 1)
    assert [r["method_id"] for r in got.collect()] == ["a"] and q.where("state = 'processing'").count() == 1
    q = queue.fail(q, got)
    assert {(r["method_id"], r["state"], r["retries"]) for r in q.collect()} == {("a", "pending", 1), ("b", "pending", 0)}
    q = queue.complete(q, got)
    assert [tuple(r) for r in queue.pending_by_file(q).collect()] == [("f", 1)]


def test_answers():
    known = ["m:1", "m:2", "m:3"]
    assert selected_ids('{"selectedIds": ["m:2", "x", "m:2"]}', known) == ["m:2"]
    assert selected_ids('Sure: {"ids": ["m:3", "m:1"]} ok', known) == ["m:3", "m:1"] and selected_ids("first m:3 then m:1", known) == ["m:3", "m:1"] and selected_ids("", known) == []
    assert insights("1. method:ab: loads it\nnoise\nmethod:cd:   saves: all") == {"method:ab": "loads it", "method:cd": "saves: all"}
    assert "m:1 |" in rerank_prompt("q", [{"id": "m:1"}]) and "method:ab" in insight_prompt([{"id": "method:ab", "code": "x"}])
