"""Most similar vectors for every vector: inverted lists scanned dimension block by dimension block.

Rotated unit vectors are kept in column blocks. Within a probed list the partial distance over the first block of
dimensions is known for all candidates at once; a hypothesis test abandons those whose full distance can hardly lie
within the query's bound, which falls to its k-th smallest distance as members are scanned, so the remaining dimensions
are read for few candidates only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orelith.session import materialise

SAMPLE = 40_000  # vectors on which the lists are fitted, over all types
LIST_SIZE = 600  # vectors a list should hold
MAX_LIST = 4_000  # a larger list is cut into chunks, all of which are probed
PROBES = 10  # lists probed per vector
BUNDLE = 24_000  # vectors of neighbouring lists that one task holds
ASKERS = 400_000  # probes that one task answers, which is at most so many vectors
STEP = 1_024  # members scanned before the bounds are lowered
BLOCK = 16  # dimensions per column block
EPSILON = 2.1  # strictness of the abandoning test; larger keeps more candidates
SEED = 7


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """(id, kind, unit) of vectors that take part: not null, dims finite numbers, not all zero; unit is little-endian float32.

    vectors: (id, kind, vector), one row per id. Works in doubles, rounds once.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = rotation(dims)
        for pdf in batches:
            m = np.array(pdf["vector"].to_list(), np.float64).reshape(len(pdf), dims)
            norm = np.linalg.norm(m, axis=1)
            ok = np.isfinite(norm) & (norm > 0)
            unit = ((m[ok] / norm[ok, None]) @ turn).astype("<f4")
            yield pd.DataFrame({"id": pdf["id"][ok], "kind": pdf["kind"][ok], "unit": [u.tobytes() for u in unit]})

    fit = (F.size("vector") == dims) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x))
    return vectors.where(F.col("id").isNotNull() & F.col("kind").isNotNull() & fit).mapInPandas(run, "id string, kind string, unit binary")


def rotation(dims: int) -> np.ndarray:
    """A fixed random orthogonal matrix: spreads every vector's length evenly over the dimensions, as the test assumes."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def fit_lists(sample: np.ndarray, n_lists: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means; empty lists are refilled from the sample."""
    rng = np.random.default_rng(SEED)
    n_lists = max(1, min(n_lists, len(sample)))
    centres = sample[rng.choice(len(sample), n_lists, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([np.argmax(sample[i : i + 512] @ centres.T, axis=1) for i in range(0, len(sample), 512)])
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        bad = norm[:, 0] < 1e-9
        total[bad] = sample[rng.choice(len(sample), int(bad.sum()))]
        norm[bad] = 1
        centres = total / norm
    return centres.astype(np.float32)


def _near_order(centres: np.ndarray) -> np.ndarray:
    """Centres in an order in which neighbours stand close: recursive halving along the widest direction."""
    def halve(rows: np.ndarray) -> list[int]:
        if len(rows) <= 2:
            return rows.tolist()
        x = centres[rows] - centres[rows].mean(0)
        along = x @ np.linalg.svd(x, full_matrices=False)[2][0]
        rows = rows[np.argsort(along, kind="stable")]
        return halve(rows[: len(rows) // 2]) + halve(rows[len(rows) // 2 :])

    return np.array(halve(np.arange(len(centres))), int)


def neighbours(vectors: DataFrame, dims: int, k: int = 5, least: float = 0.85, probes: int = PROBES) -> DataFrame:
    """Rows (id, neighbour, similarity): for every usable vector its k most similar of the same kind, similarity at least `least`.

    Vectors that are null, of another length, all zero or hold null or NaN take no part. Ties go to the smaller id.
    Exact copies are one class while searching and are then given their k nearest without pairing all copies; lists are
    fitted on a bounded sample (SAMPLE), every vector is indexed. Approximate: a neighbour whose list is not among the
    `probes` nearest is missed. A list larger than MAX_LIST is searched in chunks, and where many vectors probe a bundle of
    lists they are dealt to several tasks, each with its own copy of the members: no task grows with a hot region.
    """
    spark = vectors.sparkSession
    clean = usable(vectors, dims)
    classes = clean.groupBy("kind", "unit").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = materialise(classes, "classes")
    counts = {r["kind"]: (r["n"], r["copies"]) for r in classes.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("copies")).collect()}  # one row per kind
    total = sum(n for n, _ in counts.values())
    if not total:
        return spark.createDataFrame([], "id string, neighbour string, similarity double")
    share = min(1.0, SAMPLE / total)
    drawn = classes.where(F.pmod(F.xxhash64("rep", F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("kind", "unit").toPandas()  # bounded by SAMPLE
    centres, kinds = [], []
    for kind, own in drawn.groupby("kind"):
        x = np.frombuffer(b"".join(own["unit"]), "<f4").reshape(-1, dims)
        c = fit_lists(x, -(-counts[kind][0] // LIST_SIZE))
        centres.append(c[_near_order(c)])
        kinds += [kind] * len(c)
    for kind in set(counts) - set(kinds):  # too small a kind to be drawn: one list
        centres.append(np.full((1, dims), dims**-0.5, np.float32))
        kinds.append(kind)
    lists = spark.sparkContext.broadcast((np.concatenate(centres), np.array(kinds)))  # at most SAMPLE rows
    assigned = materialise(classes.mapInPandas(_assign(lists, dims, probes), "kind string, rep string, unit binary, own int, probes array<int>"), "lists")
    sizes = {r["own"]: r["n"] for r in assigned.groupBy("own").agg(F.count("*").alias("n")).collect()}  # one row per list
    asked = {r["list"]: r["n"] for r in assigned.select(F.explode("probes").alias("list")).groupBy("list").agg(F.count("*").alias("n")).collect()}  # one row per list
    # chunks of lists are packed into bundles in the order in which neighbouring lists stand
    chunks, askers, filled, first = [], [0], 0, [0]
    cap = max(LIST_SIZE, min(BUNDLE, -(-total // max(1, spark.sparkContext.defaultParallelism))))
    for i in range(len(kinds)):
        n = max(1, -(-sizes.get(i, 0) // MAX_LIST))
        for _ in range(n):
            part = sizes.get(i, 0) / n
            if filled and filled + part > cap:
                askers.append(0)
                filled = 0
            filled += part
            askers[-1] += asked.get(i, 0)  # an upper bound: a vector that probes two lists of a bundle comes once
            chunks.append(len(askers) - 1)
        first.append(len(chunks))
    deals = [max(1, -(-n // ASKERS)) for n in askers]
    place = spark.sparkContext.broadcast((np.array(first), np.array(chunks), np.concatenate([[0], np.cumsum(deals)])))
    sent = assigned.mapInPandas(_send(place), "task int, rep string, unit binary, chunk int, wanted array<int>")
    found = sent.repartitionById(sum(deals), F.col("task")).mapInPandas(_scan(dims, k, least), "rep string, other string, similarity double")
    near = found.where(F.col("rep") != F.col("other")).withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("similarity"), "other"))).where(F.col("r") <= k).drop("r")
    if not any(c for _, c in counts.values()):
        return near.select(F.col("rep").alias("id"), F.col("other").alias("neighbour"), "similarity")
    return _with_copies(clean, classes.select("kind", "unit", "rep", "n"), near, k)


def _assign(lists, dims: int, probes: int):
    """The nearest lists by two levels: the centres are grouped, and only those of the nearest groups are compared."""
    def run(batches):
        centres, kinds = lists.value
        levels = {}
        for k in np.unique(kinds):
            ids = np.flatnonzero(kinds == k)
            tops = fit_lists(centres[ids], int(np.ceil(len(ids) ** 0.5)))
            member = np.argmax(centres[ids] @ tops.T, axis=1)
            levels[k] = tops, [ids[member == g] for g in range(len(tops))]
        for pdf in batches:
            for kind, own in pdf.groupby("kind"):
                x = np.frombuffer(b"".join(own["unit"]), "<f4").reshape(-1, dims)
                top = [nearest_lists(x[i : i + 1024], centres, *levels[kind], probes) for i in range(0, len(x), 1024)]
                top = [t for part in top for t in part]
                yield pd.DataFrame({"kind": kind, "rep": own["rep"], "unit": own["unit"], "own": np.array([t[0] for t in top], "int32"), "probes": top})

    return run


def nearest_lists(x: np.ndarray, centres: np.ndarray, tops: np.ndarray, groups: list[np.ndarray], probes: int) -> list[np.ndarray]:
    """Per row the numbers of at most `probes` nearest centres, nearest first, out of the third (at least four) of the groups that are nearest."""
    coarse = x @ tops.T
    width = min(len(tops), max(4, -(-len(tops) // 3)))
    into = np.argpartition(-coarse, width - 1, axis=1)[:, :width]
    rows, lists, sims = [], [], []
    for g, members in enumerate(groups):
        at = np.flatnonzero((into == g).any(1))
        if len(at) and len(members):
            s = x[at] @ centres[members].T
            p = min(probes, len(members))
            best = np.argpartition(-s, p - 1, axis=1)[:, :p]
            rows.append(np.repeat(at, p))
            lists.append(members[best].ravel())
            sims.append(np.take_along_axis(s, best, 1).ravel())
    row, number, sim = np.concatenate(rows), np.concatenate(lists), np.concatenate(sims)
    order = np.lexsort((number, -sim, row))
    row, number = row[order], number[order].astype("int32")
    start = np.searchsorted(row, np.arange(len(x) + 1))
    return [number[a : min(a + probes, b)] for a, b in zip(start[:-1], start[1:], strict=True)]


def _send(place):
    """A vector goes as member to every task of its chunk's bundle, and as asker to one task of each bundle it probes."""
    def run(batches):
        first, chunks, tasks = place.value
        for pdf in batches:
            out = []
            for rep, unit, own, probes in zip(pdf["rep"], pdf["unit"], pdf["own"], pdf["probes"], strict=True):
                drawn = hash_of(rep)
                home = int(first[own] + drawn % (first[own + 1] - first[own]))
                want: dict[int, list[int]] = {}
                for p in probes:
                    for c in range(first[p], first[p + 1]):
                        b = chunks[c]
                        want.setdefault(int(tasks[b] + drawn // 65_536 % (tasks[b + 1] - tasks[b])), []).append(c)
                at = chunks[home]
                for t in range(tasks[at], tasks[at + 1]):
                    out.append((t, rep, unit, home, want.pop(t, [])))
                out += [(t, rep, unit, -1, c) for t, c in want.items()]
            yield pd.DataFrame(out, columns=["task", "rep", "unit", "chunk", "wanted"]).astype({"task": "int32", "chunk": "int32"})

    return run


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


def _scan(dims: int, k: int, least: float):
    """One task: a bundle's members in column blocks, and vectors that probe them."""
    def run(batches):
        rows = [p for p in batches if len(p)]
        if not rows:
            return
        pdf = pd.concat(rows, ignore_index=True)
        x = np.frombuffer(b"".join(pdf["unit"]), "<f4").reshape(-1, dims)
        ids, chunk = pdf["rep"].to_numpy(object), pdf["chunk"].to_numpy()
        bounds = np.full(len(x), 2 - 2 * least)  # squared distances; a vector's falls from chunk to chunk
        for b in np.unique(pdf["task"]):
            here = (pdf["task"] == b).to_numpy()
            wanted = pdf["wanted"][here]
            ask = np.repeat(np.flatnonzero(here), [len(w) for w in wanted])
            of = np.concatenate([np.asarray(w, np.int64) for w in wanted]) if len(wanted) else np.array([], np.int64)
            order = np.argsort(of, kind="stable")
            ask, of = ask[order], of[order]
            edges = np.flatnonzero(np.diff(of, prepend=-1)) if len(of) else []
            for i, lo in enumerate(edges):
                queries = ask[lo : edges[i + 1] if i + 1 < len(edges) else len(of)]
                members = np.flatnonzero(here & (chunk == of[lo]))
                if len(members):
                    for part in np.array_split(queries, -(-len(queries) // 2048)):
                        own = bounds[part]
                        q, m, s = scan_list(x[part], x[members], k, least, own)
                        bounds[part] = own
                        if len(q):
                            yield pd.DataFrame({"rep": ids[part[q]], "other": ids[members[m]], "similarity": s})

    return run


def scan_list(queries: np.ndarray, members: np.ndarray, k: int, least: float, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, similarity): per query up to k + 1 members with similarity >= least, abandoning early.

    With squared distance d = 2 - 2s over unit vectors, the partial distance over the first b of D dimensions scaled by
    D / b estimates d; a candidate is given up once that estimate exceeds the query's bound by the factor
    (1 + EPSILON / sqrt(b))^2. The bound is what `least` allows, or the query's (k + 1)-th smallest distance so far
    (it may meet itself) where that is less; bounds is lowered in place.
    """
    dims = queries.shape[1]
    bounds = np.full(len(queries), 2 - 2 * least) if bounds is None else bounds
    of_q = [np.ascontiguousarray(queries[:, i : i + BLOCK]) for i in range(0, dims, BLOCK)]
    of_m = [np.ascontiguousarray(members[:, i : i + BLOCK]) for i in range(0, dims, BLOCK)]
    head_q, head_m = (of_q[0] ** 2).sum(1), (of_m[0] ** 2).sum(1)
    best = np.tile(bounds[:, None], (1, k + 1))
    found = []
    for lo in range(0, len(members), STEP):
        head = head_q[:, None] + head_m[lo : lo + STEP] - 2 * (of_q[0] @ of_m[0][lo : lo + STEP].T)
        seen = of_q[0].shape[1]
        q, m = np.nonzero(head <= (bounds * (1 + EPSILON / seen**0.5) ** 2 * seen / dims + 1e-6)[:, None])
        d = head[q, m].astype(np.float64)
        m += lo
        for a, b in zip(of_q[1:], of_m[1:], strict=True):
            if not len(q):
                break
            d += ((a[q] - b[m]).astype(np.float64) ** 2).sum(1)
            seen += a.shape[1]
            keep = d <= bounds[q] * (1.0 if seen >= dims else (1 + EPSILON / seen**0.5) ** 2 * seen / dims) + 1e-6
            q, m, d = q[keep], m[keep], d[keep]
        if not len(q):
            continue
        found.append((q, m))
        order = np.lexsort((d, q))
        q, d = q[order], d[order]
        at = np.arange(len(q)) - np.searchsorted(q, q, "left")
        few = at <= k
        new = np.full_like(best, np.inf)
        new[q[few], at[few]] = d[few]
        best = np.sort(np.concatenate([best, new], axis=1), axis=1)[:, : k + 1]
        np.minimum(bounds, best[:, k] + 1e-6, out=bounds)
    q, m = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.array([], int), np.array([], int))
    s = np.einsum("ij,ij->i", queries[q].astype(np.float64), members[m].astype(np.float64))
    keep = s >= least
    q, m, s = q[keep], m[keep], s[keep]
    order = np.lexsort((m, -s, q))
    q, m, s = q[order], m[order], s[order]
    place = np.arange(len(q)) - np.searchsorted(q, q, "left")
    keep = place <= k  # one more than k: a query may meet itself
    return q[keep], m[keep], s[keep]


def _with_copies(clean: DataFrame, classes: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """From neighbours of class representatives to neighbours of every vector; of a class only its k + 1 smallest ids are offered."""
    of = clean.join(classes.where("n > 1").drop("n"), ["kind", "unit"]).select("id", "rep")
    few = of.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).select(F.col("rep").alias("other"), F.col("id").alias("neighbour"))
    offered = near.join(few, "other", "left").withColumn("neighbour", F.coalesce("neighbour", "other")).select("rep", "neighbour", "similarity")
    within = few.select(F.col("other").alias("rep"), "neighbour", F.lit(1.0).alias("similarity"))
    offered = offered.unionByName(within)
    best = offered.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("similarity"), "neighbour"))).where(F.col("r") <= k + 1).drop("r")
    members = best.join(of, "rep", "left").withColumn("id", F.coalesce("id", "rep")).where(F.col("id") != F.col("neighbour"))
    return members.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))).where(F.col("r") <= k).select("id", "neighbour", "similarity")
