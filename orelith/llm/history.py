"""Deduplicating new batches against all history by persisted multi-key sorted-neighbourhood runs.

A text restates another of the same group if their longest common subsequence of words is at least THRESHOLD of the
longer text's words. Such a pair shares at least that many words, so under any fixed order of words their first
n - ceil(THRESHOLD n) + 1 words (the rarest ones) have one in common: each of these is a sort key of the text. Accepted
texts are kept in runs, sorted by key and cut into key ranges of about equal size, so a run has the more ranges the longer
it is. A batch is sorted by the same keys, reads only the ranges that its keys fall into, and is compared only inside the
windows of equal key and near enough length around its own records. Runs of like size are merged.
"""

from __future__ import annotations

import bisect
import json
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelith.session import drop_path, materialise

THRESHOLD = 0.85
KEYS_PER_RANGE = 200_000  # about; the number of ranges of a run is a power of two
RUNS = 4  # from so many runs on, the newest are merged with each older one that is at most so many times as long
COMMON = 1e-4  # a word in this share of the texts counts as common; there are at most (words a text) / COMMON of them
_NOTE = "id string, batch long, at long, grp string, toks array<int>"
_KEYED = "key long, len int, id string, batch long, at long, state int, toks array<int>"
_LINK = "id string, other string, obatch long, oat long, accepted boolean"


def least_common(n: int, threshold: float = THRESHOLD) -> int:
    return math.ceil(threshold * n - 1e-9)


def places(a: list[int]) -> dict[int, int]:
    """Where each word stands, as bits."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    return where


def lcs(a: list[int], b: list[int], where: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, one machine-word-parallel step per element of b. where: the places of a."""
    where = places(a) if where is None else where
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if u := v & where.get(x, 0):
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def restates(a: list[int], b: list[int], threshold: float = THRESHOLD) -> bool:
    need = least_common(max(len(a), len(b)), threshold)
    return min(len(a), len(b)) >= need and lcs(a, b) >= need


class History:
    """Accepted texts under one folder.

    absorb(batch) takes (id, grp, text, batch, at), goes through it in the order (batch, at, id) after all earlier
    batches, and gives (id, other): each rejected text with the earliest accepted one it restates. Null groups are one
    group; a null text counts as empty, and empty texts restate each other; rows of one id are one text, the first
    counts; rows without id are dropped. Words are compared by 32-bit hashes.

    Exact copies within a batch are compared once. Of near copies only those that restate no earlier text of the window
    are compared with the whole window, the others with these alone, so a large group costs no pairs of all its members.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: float = THRESHOLD):
        self.spark, self.path, self.threshold = spark, path.rstrip("/"), threshold
        self.state = self._load() or {"runs": [], "next": 0, "order": None}

    # -- the pointer file names the runs that count; a run is written before the pointer names it
    def _file(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/state.json")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _load(self) -> dict | None:
        fs, p = self._file()
        return json.loads(self.spark.read.text(str(p.toString()), wholetext=True).first()[0]) if fs.exists(p) else None

    def _save(self) -> None:
        fs, p = self._file()
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()

    def accepted(self) -> DataFrame:
        """(id, batch, at, grp, toks) of all accepted texts."""
        return self._notes(self.state["runs"])

    def _notes(self, runs: list[dict]) -> DataFrame:
        runs = [f"{self.path}/notes-{r['run']}" for r in runs]
        return self.spark.read.schema(_NOTE).parquet(*runs) if runs else self.spark.createDataFrame([], _NOTE)

    def _keys(self, notes: DataFrame, state: int) -> DataFrame:
        threshold, common = self.threshold, self._common()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            df = common.value
            for pdf in batches:
                rows = []
                for i, batch, at, grp, toks in zip(pdf["id"], pdf["batch"], pdf["at"], pdf["grp"], pdf["toks"], strict=True):
                    toks = toks.tolist()
                    n = len(toks)
                    seen: Counter = Counter()
                    each = []
                    for t in toks:
                        seen[t] += 1
                        each.append((df.get(t, 0), t, seen[t]))
                    each.sort()
                    for _, t, occ in each[: n - least_common(n, threshold) + 1] or [(0, 0, 0)]:
                        rows.append((_mix(grp, t, occ), n, i, batch, at, state, toks))
                yield pd.DataFrame(rows, columns=["key", "len", "id", "batch", "at", "state", "toks"])

        return notes.mapInPandas(run, _KEYED)

    def _common(self):
        at = self.state["order"]
        if at is None:
            return self.spark.sparkContext.broadcast({})
        rows = self.spark.read.parquet(at).toPandas()  # bounded, see COMMON
        return self.spark.sparkContext.broadcast(dict(zip(rows["t"].tolist(), rows["df"].tolist(), strict=True)))

    def _count(self, notes: DataFrame) -> None:
        """Fixes the order of words until the next merge of runs."""
        n = notes.count()
        df = notes.select(F.explode(F.array_distinct("toks")).alias("t")).groupBy("t").agg(F.count("*").alias("df")).where(F.col("df") >= max(3, int(COMMON * n)))
        at = f"{self.path}/order-{self.state['next']}"
        df.write.mode("overwrite").parquet(at)
        self.state["order"] = at

    def _write(self, notes: DataFrame) -> None:
        """A run: the texts, and their keys in a folder a key range, sorted."""
        r = self.state["next"]
        notes.write.mode("overwrite").parquet(f"{self.path}/notes-{r}")
        notes = self.spark.read.schema(_NOTE).parquet(f"{self.path}/notes-{r}")
        n, keys = notes.agg(F.count("*"), F.sum(F.greatest(F.size("toks") * (1 - self.threshold) + 1, F.lit(1.0)))).first()
        bits = max(0, math.ceil(math.log2(max(1.0, (keys or 0) / KEYS_PER_RANGE))))
        if n:
            keyed = self._keys(notes, 0).withColumn("span", span_of(bits))
            parts = max(1, min(1 << bits, 4 * self.spark.sparkContext.defaultParallelism))
            keyed.repartitionById(parts, F.pmod("span", F.lit(parts)).cast("int")).sortWithinPartitions("span", "key", "len").write.mode("overwrite").partitionBy("span").parquet(f"{self.path}/keys-{r}")
            self.state["runs"].append({"run": r, "rows": n, "bits": bits})
        self.state["next"] += 1

    def _touched(self, keys: DataFrame) -> list[tuple[dict, list[int]]]:
        """Per run the ranges that keys (key) fall into."""
        return [(r, [x[0] for x in keys.select(span_of(r["bits"]).alias("s")).distinct().collect()]) for r in self.state["runs"]]  # at most one a range

    def _near(self, keys: DataFrame) -> DataFrame:
        """Rows of all runs with one of the keys, from the ranges that hold any of them."""
        out = self.spark.createDataFrame([], _KEYED)
        for r, spans in self._touched(keys):
            run = self.spark.read.schema(_KEYED + ", span int").parquet(f"{self.path}/keys-{r['run']}")
            out = out.unionByName(run.where(F.col("span").isin(spans)).drop("span"))
        return out.join(keys, "key", "left_semi")

    def absorb(self, batch: DataFrame) -> DataFrame:
        words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1))
        grp = F.coalesce(F.concat(F.lit("="), F.col("grp").cast("string")), F.lit("-"))
        notes = batch.where(F.col("id").isNotNull()).select("id", F.col("batch").cast("long").alias("batch"), F.col("at").cast("long").alias("at"), grp.alias("grp"), F.transform(words, lambda w: F.hash(w)).alias("toks"))
        notes = notes.groupBy("id").agg(F.min(F.struct("batch", "at", "grp", "toks")).alias("n")).select("id", "n.*")
        notes = notes.withColumn("same", F.sha1(F.concat_ws(" ", "grp", F.col("toks").cast("string"))))
        notes = materialise(notes, "notes")
        if self.state["order"] is None:
            self._count(notes)
        first = notes.groupBy("same").agg(F.min(F.struct("batch", "at", "id")).alias("f"))
        copies = materialise(notes.join(first, "same").select("id", "batch", "at", "grp", "toks", F.col("f.id").alias("rep"), F.col("f.batch").alias("rbatch"), F.col("f.at").alias("rat")), "copies")
        reps = copies.where("id = rep").select("id", "batch", "at", "grp", "toks")
        keyed = materialise(self._keys(reps, 1), "keyed")
        keyed_old = materialise(self._near(keyed.select("key").distinct()), "near") if self.state["runs"] else self.spark.createDataFrame([], _KEYED)
        undecided, taken, rejected = keyed, None, None
        while True:
            rows = keyed_old.unionByName(undecided)
            links = rows.repartition("key").sortWithinPartitions("key").mapInPandas(_windows(self.threshold), _LINK)
            order = F.struct("obatch", "oat", "other")
            per = links.groupBy("id").agg(F.min(F.when(F.col("accepted"), order)).alias("hit"), F.collect_set(F.when(~F.col("accepted"), order)).alias("wait"))
            ids = undecided.select("id").distinct()
            now = materialise(ids.join(per, "id", "left"), "round")
            new = now.where("hit IS NULL AND coalesce(size(wait), 0) <= 0").select("id")
            via = now.where("hit IS NULL").select("id", F.explode("wait").alias("w")).join(new.withColumnRenamed("id", "o"), F.col("w.other") == F.col("o")).groupBy("id").agg(F.min("w").alias("hit"))
            out = materialise(now.where("hit IS NOT NULL").select("id", "hit").unionByName(via), "rejected")
            rejected = out if rejected is None else rejected.unionByName(out)
            taken = new if taken is None else taken.unionByName(new)
            done = new.unionByName(out.select("id"))
            if now.join(done, "id", "left_anti").isEmpty():
                break
            keyed_old = materialise(keyed_old.unionByName(undecided.join(new, "id", "left_semi").withColumn("state", F.lit(0))), "near")
            undecided = materialise(undecided.join(done, "id", "left_anti"), "keyed")
        self._write(reps.join(taken, "id", "left_semi"))
        gone = self._compact()
        self._save()
        for r in gone:  # the pointer no longer names them
            for kind in ("notes", "keys"):
                drop_path(self.spark, f"{self.path}/{kind}-{r['run']}")
        rejected = rejected.select(F.col("id").alias("rep"), F.col("hit.other").alias("other"))
        kept = copies.join(rejected, "rep", "left")
        return kept.where(F.col("other").isNotNull() | (F.col("id") != F.col("rep"))).select("id", F.coalesce("other", "rep").alias("other"))

    def _compact(self) -> list[dict]:
        """Merges the newest runs, so that a text is rewritten a number of times that grows with the logarithm of the history; gives the runs that are no longer needed. When all are merged, words are ordered by their present frequency."""
        runs = self.state["runs"]
        if len(runs) < RUNS:
            return []
        gone, rows = [runs[-1]], runs[-1]["rows"]
        for r in reversed(runs[:-1]):
            if r["rows"] > RUNS * rows:
                break
            gone, rows = [*gone, r], rows + r["rows"]
        if len(gone) < 2:
            return []
        notes = self._notes(gone)
        if len(gone) == len(runs):
            self._count(notes)
        self.state["runs"] = [r for r in runs if r not in gone]
        self._write(notes)
        return gone


def span_of(bits: int):
    """The key range of `key` among 2^bits equal ones."""
    return F.lit(0) if bits == 0 else F.shiftrightunsigned("key", 64 - bits).cast("int")


def _mix(grp: str, token: int, occ: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{token} {occ} {grp}".encode()) - (1 << 63)


def _windows(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            if held and held[-1]["key"].iloc[-1] != pdf["key"].iloc[0]:
                yield from _blocks(pd.concat(held), threshold)
                held = []
            at = int(np.searchsorted(pdf["key"].to_numpy(), pdf["key"].iloc[-1], "left"))
            if at:
                yield from _blocks(pd.concat([*held, pdf.iloc[:at]]), threshold)
                held = []
            held.append(pdf.iloc[at:])
        if held:
            yield from _blocks(pd.concat(held), threshold)

    return run


def _blocks(pdf: pd.DataFrame, threshold: float) -> Iterator[pd.DataFrame]:
    key = pdf["key"].to_numpy()
    edges = np.flatnonzero(np.diff(key, prepend=key[0] - 1 if key[0] > -(1 << 63) else key[0] + 1))
    ends = np.append(edges[1:], len(key))
    state = pdf["state"].to_numpy()
    many = [(a, b) for a, b in zip(edges, ends, strict=True) if b - a > 1 and state[a:b].any()]
    if not many:
        return
    length, ids, batch, at, toks = (pdf[c].to_numpy() for c in ("len", "id", "batch", "at", "toks"))
    seen: dict[int, tuple[list[int], set[int]]] = {}

    def words(i: int) -> tuple[list[int], set[int]]:
        if i not in seen:
            ws = toks[i].tolist()
            seen[i] = (ws, set(ws))
        return seen[i]

    for a, b in many:
        seen.clear()
        rows = sorted(range(a, b), key=lambda i: (state[i], batch[i], at[i], ids[i]))  # accepted ones first
        heads: list[tuple[int, int]] = []  # (length, row), by length: the window is the slice of near enough length
        others: list[tuple[int, int]] = []
        links = []
        for i in rows:
            if not state[i]:
                bisect.insort(heads, (int(length[i]), i))
                continue
            n = int(length[i])
            low, high = (least_common(n, threshold), -1), (int(n / threshold + 1e-9), 1 << 60)
            own, distinct = words(i)
            where, spare = None, n - len(distinct)
            hits = []
            for of in (heads, others):
                for m, j in of[bisect.bisect_left(of, low) : bisect.bisect_right(of, high)]:
                    theirs, also = words(j)
                    need = least_common(max(n, m), threshold)
                    if min(n, m) < need or len(distinct & also) + min(spare, m - len(also)) < need:
                        continue  # not even as many words in common in any order
                    where = where or places(own)
                    if lcs(own, theirs, where) >= need:
                        hits.append(j)
                if hits:
                    break
            bisect.insort(others if hits and of is heads else heads, (n, i))
            links += [(ids[i], ids[j], batch[j], at[j], not state[j]) for j in hits]
        if links:
            yield pd.DataFrame(links, columns=["id", "other", "obatch", "oat", "accepted"])
