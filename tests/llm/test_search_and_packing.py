import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orelith.llm import neighbours as nb
from orelith.llm import packing
from orelith.llm.leaks import automaton, hits, leaks
from orelith.llm.packing import pack, pack_group, token_counts, tokenizer_path


def brute_pairs(ids, kinds, x, k, least):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for i in range(len(ids)):
        s = sorted(((-round(float(x[i] @ x[j]), 6), ids[j]) for j in range(len(ids)) if j != i and kinds[j] == kinds[i] and x[i] @ x[j] >= least))[:k]
        out |= {(ids[i], j) for _, j in s}
    return out


def test_neighbours_recall_copies_and_unusable(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([b + 0.12 * rng.standard_normal((8, 16)) for b in base])
    ids, kinds = [f"v{i:03d}" for i in range(len(x))], ["m" if i % 3 else "c" for i in range(len(x))]
    rows = [(i, k, [float(y) for y in v], 1) for i, k, v in zip(ids, kinds, x.astype(np.float32), strict=True)]
    bad = [("n1", "m", None, 1), ("n2", "m", [0.0] * 16, 1), ("n3", "m", [1.0], 1), ("n4", "m", [float("nan")] + [1.0] * 15, 1), ("n5", "m", [None] + [1.0] * 15, 1), ("n6", None, [1.0] * 16, 1), (None, "m", [1.0] * 16, 1)]
    d = spark.createDataFrame(rows + bad, "id string, kind string, vector array<float>, rep int")
    got = {(r["id"], r["neighbour"]) for r in nb.neighbours(d, 16, 5, 0.85).collect()}
    want = brute_pairs(ids, kinds, x.astype(np.float32).astype(float), 5, 0.85)
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
    assert nb.neighbours(d.limit(0), 16, 5, 0.85).count() == 0


def test_hot_group_of_copies_is_linear(spark):
    d = spark.range(900).withColumnRenamed("id", "n").select(F.format_string("c%04d", "n").alias("id"), F.lit("m").alias("kind"), F.when(F.col("n") < 300, F.array(*[F.lit(float(i % 3 + 1)) for i in range(8)])).otherwise(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(i * F.col("n")))).cast("array<float>").alias("vector"))
    near = nb.neighbours(d, 8, 5, 0.85)
    hot = [r for r in near.collect() if r["id"] < "c0300"]
    per = {}
    for r in hot:
        per.setdefault(r["id"], []).append(r["neighbour"])
    assert len(per) == 300 and all(len(v) == 5 for v in per.values()) and sorted(per["c0299"]) == [f"c{i:04d}" for i in range(5)]


def test_scan_abandons_no_neighbour():
    rng = np.random.default_rng(2)
    q = rng.standard_normal((30, 64)).astype(np.float32)
    m = np.concatenate([q + 0.05 * rng.standard_normal((30, 64)), rng.standard_normal((500, 64))]).astype(np.float32)
    q, m = (a / np.linalg.norm(a, axis=1, keepdims=True) for a in (q, m))
    at, other, sim = nb.scan_list(q, m, 5, 0.85)
    assert {(i, i) for i in range(30)} <= set(zip(at.tolist(), other.tolist(), strict=True)) and (sim >= 0.85).all()


def test_bounds_fall_to_the_kth_distance(monkeypatch):
    rng = np.random.default_rng(3)
    q, m = (a / np.linalg.norm(a, axis=1, keepdims=True) for a in (rng.standard_normal((20, 64)).astype(np.float32), rng.standard_normal((6000, 64)).astype(np.float32)))
    bounds = np.full(20, 4.0)
    at, other, sim = nb.scan_list(q, m, 5, -1.0, bounds)  # no least similarity: only the k-th distance abandons
    true = np.sort(2 - 2 * (q @ m.T), axis=1)[:, 5]
    assert (np.abs(bounds - true) < 1e-3).all()
    got = {(a, b) for a, b in zip(at.tolist(), other.tolist(), strict=True)}
    want = {(i, j) for i in range(20) for j in np.argsort(-(q @ m.T)[i])[:5].tolist()}
    assert len(got & want) >= 0.98 * len(want)


def test_two_level_lists_and_split_askers(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((500, 16)).astype(np.float32)
    c = nb.fit_lists(x / np.linalg.norm(x, axis=1, keepdims=True), 100)
    tops = nb.fit_lists(c, 10)
    member = np.argmax(c @ tops.T, axis=1)
    got = nb.nearest_lists(x, c, tops, [np.flatnonzero(member == g) for g in range(10)], 10)
    exact = np.argsort(-(x @ c.T), axis=1)[:, :10]
    assert all(len(g) == 10 for g in got) and np.mean([len(set(g) & set(e)) / 10 for g, e in zip(got, exact, strict=True)]) > 0.75 and np.mean([g[0] == e[0] for g, e in zip(got, exact, strict=True)]) > 0.95
    monkeypatch.setattr(nb, "LIST_SIZE", 50)
    monkeypatch.setattr(nb, "ASKERS", 30)
    x = np.concatenate([x[:150], x[:150] + 0.05 * rng.standard_normal((150, 16)).astype(np.float32)])
    ids = [f"{i:03d}" for i in range(300)]
    d = spark.createDataFrame([(i, "m", [float(y) for y in v]) for i, v in zip(ids, x, strict=True)], "id string, kind string, vector array<float>")
    got = {(r["id"], r["neighbour"]) for r in nb.neighbours(d, 16, 3, 0.9).collect()}
    assert got == brute_pairs(ids, ["m"] * 300, x.astype(float), 3, 0.9)


def test_large_list_is_chunked(spark, monkeypatch):
    monkeypatch.setattr(nb, "LIST_SIZE", 50)
    monkeypatch.setattr(nb, "MAX_LIST", 10)
    monkeypatch.setattr(nb, "BUNDLE", 20)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 12)).astype(np.float32)
    x = np.concatenate([x, x + 0.05 * rng.standard_normal((60, 12)).astype(np.float32)])
    ids = [f"{i:03d}" for i in range(120)]
    d = spark.createDataFrame([(i, "m", [float(y) for y in v]) for i, v in zip(ids, x, strict=True)], "id string, kind string, vector array<float>")
    got = {(r["id"], r["neighbour"]) for r in nb.neighbours(d, 12, 3, 0.9).collect()}
    assert got == brute_pairs(ids, ["m"] * 120, x.astype(float), 3, 0.9)


def first_fit(sizes, cap):
    room = []
    for s in sorted(sizes, reverse=True):
        i = next((i for i, r in enumerate(room) if r >= s), None)
        if i is None:
            room.append(cap - s)
        else:
            room[i] -= s
    return len(room)


def test_packing_whole_and_tight(spark, monkeypatch):
    rnd = random.Random(4)
    sizes = [rnd.choice([0, 3, 10, 40, 64, 65, 128, 200, rnd.randrange(1, 64)]) for _ in range(400)]
    items = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)] + [(1000, None)], "doc_id long, n_tokens long")
    wins = spark.createDataFrame([("w", 64), ("x", 100), ("bad", 0), ("none", None)], "window_name string, capacity int")
    for deal in (20_000, 60):
        rows = pack(items, wins, deal).collect()
        for w, cap in (("w", 64), ("x", 100)):
            own = [r for r in rows if r["window_name"] == w]
            by_doc, load = {}, {}
            for r in own:
                by_doc.setdefault(r["doc_id"], []).append(r["n_tokens"])
                load[r["bin_id"]] = load.get(r["bin_id"], 0) + r["n_tokens"]
            assert set(by_doc) == {*range(400), 1000} and all(sum(by_doc[i]) == s for i, s in enumerate(sizes))
            assert all(len(by_doc[i]) == (1 if s <= cap else -(-s // cap)) for i, s in enumerate(sizes)) and max(load.values()) <= cap
            assert len({r["bin_id"] for r in own if r["n_tokens"]}) <= first_fit([r["n_tokens"] for r in own], cap) + (0 if deal > 400 else 6)
        assert {r["window_name"] for r in rows} == {"w", "x"}
    assert pack(items.limit(0), wins).count() == 0


def test_local_search_empties_bins():
    sizes = sorted([6, 6, 5, 5, 5, 4, 4, 3, 2], reverse=True)
    bins = pack_group(sizes, 10)
    assert sorted(i for b in bins for i in b) == list(range(9)) and len(bins) == 4 and all(sum(sizes[i] for i in b) <= 10 for b in bins)


def test_local_search_goes_on_while_it_helps():
    for seed, most in ((743, 14), (934, 18), (1918, 8)):
        rnd = random.Random(seed)
        sizes = sorted((rnd.randrange(10, 60) for _ in range(rnd.randrange(20, 60))), reverse=True)
        bins = pack_group(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and len(bins) <= most and all(sum(sizes[i] for i in b) <= 100 for b in bins)


def best_fit(sizes, cap):
    room = []
    for s in sorted(sizes, reverse=True):
        b = min((i for i, r in enumerate(room) if r >= s), key=lambda i: room[i], default=None)
        if b is None:
            room.append(cap - s)
        else:
            room[b] -= s
    return len(room)


def test_local_search_closes_bins_that_best_fit_does_not():
    saved = 0
    for seed in range(40):
        rnd = random.Random(seed)
        sizes = [rnd.randrange(24, 49) for _ in range(400)]
        start = packing.Search(sizes, 100)
        opened = len(start.room)
        start.run()
        assert len(start.room) <= best_fit(sizes, 100) and len(start.room) < 0.95 * opened
        saved += best_fit(sizes, 100) - len(start.room)
        assert sorted(i for b in start.bins for i in b) == list(range(400)) and all(sum(sizes[i] for i in b) == x <= 100 for b, x in zip(start.bins, start.load, strict=True))
    assert saved >= 40


def test_equal_swaps_free_small_pieces():
    s = packing.Search([60, 60, 30, 30, 40, 20], 90)  # 60 | 60 30 | 30 40 20
    s.run()
    assert len(s.room) == 3 and packing._exchange(60, 0, [], []) is None
    s = packing.Search([5, 5, 4, 3, 3], 10)
    s.bins, s.load, s.of, s.room = [[0, 3], [1, 2, 4][:1] + [4], [2]], [8, 8, 4], [0, 1, 2, 0, 1], [(2, 0), (2, 1), (6, 2)]
    s.run()
    assert len(s.room) == 2


def test_token_counts(spark):
    d = spark.createDataFrame([(1, "hello world", 9), (2, None, 9), (3, "", 9), (4, "ş" * 50_000, 9), (1, "hello", 9)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(d, tokenizer_path()).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 10_000


def test_leaks_offsets_ties_and_nulls(spark):
    run = "Alpha beta gamma Delta1 epsilon zeta eta theta iota kappa lambda mu"
    items = spark.createDataFrame([(1, run + " nu"), (2, "short item"), (3, None), (4, run), (None, run)], "item_id long, text string")
    docs = [(1, "see: " + run.upper().replace(" ", ", ") + "!", "a"), (2, run.replace(" mu", ""), "b"), (3, None, "c"), (4, "", "d"), (5, ("x " * 60_000) + run + " nu", "e"), (6, "pre" + run, "f"), (1, "again", "g")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    got = {(r["doc_id"], r["item_id"]): r for r in leaks(d, items).collect()}
    assert set(got) == {(1, 1), (1, 4), (5, 1), (5, 4)}
    assert got[(1, 1)]["first_at"] == 5 and got[(5, 1)]["n_runs"] == 2 and got[(5, 1)]["first_at"] == 120_000
    assert leaks(d.limit(0), items).count() == 0 and leaks(d, items.limit(0)).count() == 0


def test_automaton_against_brute_force():
    rnd = random.Random(8)
    items = [(i, " ".join(rnd.choice("abc") for _ in range(9))) for i in range(20)]
    machine = automaton(items, 4)
    for _ in range(200):
        t = " ".join(rnd.choice("abc") for _ in range(rnd.randrange(12)))
        runs = {tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)}
        want = {i for i, x in items if runs & {tuple(x.split()[j : j + 4]) for j in range(6)}}
        assert {h[0] for h in hits(machine, t)} == want


@pytest.mark.parametrize("cap", [7, 50])
def test_pack_group_keeps_all(cap):
    rnd = random.Random(cap)
    sizes = sorted((rnd.randrange(1, cap) for _ in range(300)), reverse=True)
    bins = pack_group(sizes, cap)
    assert sorted(i for b in bins for i in b) == list(range(300)) and all(sum(sizes[i] for i in b) <= cap for b in bins)
    assert len(bins) <= 1.1 * sum(sizes) / cap + 1
