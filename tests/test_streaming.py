import time

from orelith.streaming.watch import _Changes, changes, debounce, watch


def test_changes_and_deletions_are_seen(tmp_path):
    (tmp_path / "a.ts").write_text("1")
    r = _Changes(str(tmp_path), False)
    start = r.initialOffset()
    (tmp_path / "a.ts").write_text("22")
    (tmp_path / "b.ts").write_text("1")
    rows, mid = r.read(start)
    assert [(x[0], x[1]) for x in rows] == [("a.ts", "change"), ("b.ts", "add")]
    (tmp_path / "a.ts").unlink()
    rows, end = r.read(mid)
    assert [(x[0], x[1]) for x in rows] == [("a.ts", "unlink")]
    assert [(x[0], x[1]) for x in r.readBetweenOffsets(mid, end)] == [("a.ts", "unlink")]


def test_stream_to_listeners(spark, tmp_path):
    root, seen = tmp_path / "p", []
    root.mkdir()
    stream = changes(spark, str(root), initial=True)

    def broken(batch, epoch):
        raise ValueError("one listener fails")

    q = watch(debounce(stream, 200), [broken, lambda b, _: seen.extend((r["file"], r["kind"]) for r in b.collect())], str(tmp_path / "cp"), "300 milliseconds")
    try:
        (root / "x.ts").write_text("1")
        end = time.time() + 120
        while time.time() < end and not seen:
            time.sleep(0.5)
        (root / "x.ts").unlink()
        while time.time() < end and ("x.ts", "unlink") not in seen:
            time.sleep(0.5)
    finally:
        q.stop()
    assert seen[0] == ("x.ts", "add") and ("x.ts", "unlink") in seen
