"""References to records that do not exist, no longer exist or do not exist yet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelith.functions.moments import month_of
from orelith.session import materialise

ALWAYS = 2**62
PARENTS_PER_RANGE = 100_000
RANGES_PER_CORE = 4  # at least
PARTITIONS_PER_CORE = 16  # at most; a partition holds neighbouring ranges one after the other
DRAWN = 20  # keys drawn per range to place the bounds


def dangling(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Distinct rows (src, record_id, ref_key, reason, ref_month) of references that resolve to no parent.

    refs: (src, space, record_id, ref_key, moment) and parents: (space, parent_key, valid_from, valid_to), moments in
    microseconds, valid_to exclusive, null for still valid; `space` separates key spaces (a repo, a table) and ref_key
    is looked up as parent_key in its space. A reference or parent without a key, and a parent without valid_from, takes
    no part. A reference without a moment can only be `missing`; its month is null.

    Keys are partitioned into ranges of their order; the bounds are quantiles of keys drawn from all references and from
    the distinct parent keys. A range's parents become sorted arrays, the references stream past them in Arrow batches
    and are probed by binary search over the keys' hashes; equal hashes are settled by the keys themselves. A key that
    holds many references takes up several bounds: its references are dealt to all the ranges between, each with its own
    copy of the key's parents, so no task grows with a hot key. Both inputs are read once.
    """
    miss = _routed(refs, parents).mapInPandas(_probe, "src string, record_id string, ref_key string, reason string, moment long")
    return miss.select("src", "record_id", "ref_key", "reason", month_of(F.col("moment")).alias("ref_month")).distinct()


def _routed(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Parents and references by range (part), parents first."""
    spark = refs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    full_key, hashed = F.concat_ws("\u0001", "space", "ref_key").alias("full_key"), F.xxhash64("space", "ref_key").alias("h")
    parents = parents.where(F.col("parent_key").isNotNull() & F.col("valid_from").isNotNull())
    # of the parents of one key that start together only the longest matters
    parents = parents.groupBy("space", F.col("parent_key").alias("ref_key"), "valid_from").agg(F.max(F.coalesce("valid_to", F.lit(ALWAYS))).alias("valid_to"))
    parents = materialise(parents, "parents")
    refs = materialise(refs.where(F.col("ref_key").isNotNull()).select("src", "space", "record_id", "ref_key", "moment"), "references")
    n_parents = parents.count()
    ranges = max(RANGES_PER_CORE * cores, -(-n_parents // PARENTS_PER_RANGE))
    share = min(1.0, DRAWN * ranges / max(1, n_parents + refs.count()))
    low = F.lit(min(2**63 - 1, int(share * 2**64) - 2**63))
    drawn = refs.where(F.xxhash64("src", "record_id", "ref_key") <= low).select(full_key).unionAll(parents.where(hashed <= low).select(full_key).distinct())
    drawn = sorted(r[0] for r in drawn.collect())  # about DRAWN keys a range
    bounds = spark.sparkContext.broadcast(np.array([drawn[len(drawn) * i // ranges] for i in range(1, ranges)] if drawn else [], object))

    @F.pandas_udf("first int, last int")
    def place(key: pd.Series) -> pd.DataFrame:
        key = key.to_numpy(object)
        return pd.DataFrame({"first": np.searchsorted(bounds.value, key, "left").astype("int32"), "last": np.searchsorted(bounds.value, key, "right").astype("int32")})

    first, last = F.col("at.first"), F.col("at.last")
    side_p = (
        parents.select(full_key, hashed, F.col("valid_from").alias("a"), F.col("valid_to").alias("b")).withColumn("at", place("full_key"))
        .select(F.explode(F.sequence(first, last)).alias("part"), F.lit(0).alias("is_ref"), "h", "full_key", "a", "b", F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("record_id"), F.lit(None).cast("string").alias("ref_key"))
    )
    side_r = (
        refs.select("*", full_key, hashed).withColumn("at", place("full_key"))
        .select((first + F.pmod(F.xxhash64("src", "record_id"), last - first + 1)).cast("int").alias("part"), F.when(F.col("moment").isNull(), 2).otherwise(1).alias("is_ref"), "h", "full_key", F.coalesce("moment", F.lit(0)).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "src", "record_id", "ref_key")
    )
    partitions = min(ranges, PARTITIONS_PER_CORE * cores)
    return side_p.unionByName(side_r).repartitionById(partitions, F.floor(F.col("part") * (partitions / ranges)).cast("int")).sortWithinPartitions("part", "is_ref")


class _Range:
    """The parents of one range as sorted arrays."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values(["h", "full_key", "a"], kind="stable")
        h, key = pdf["h"].to_numpy(np.int64), pdf["full_key"].to_numpy(object)
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1])
        self.code = np.cumsum(new) - 1
        self.hash, self.key = h[new], key[new]
        begin, end = pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64)
        self.moments = np.unique(begin)
        self.width = len(self.moments) + 1
        self.start = self.code * self.width + np.searchsorted(self.moments, begin, "left")
        ends = np.unique(end)
        most = np.maximum.accumulate(self.code * len(ends) + np.searchsorted(ends, end)) if len(h) else self.code
        self.until = ends[most - self.code * len(ends)] if len(h) else end  # latest end among the parents started so far
        self.mixed = bool((self.hash[1:] == self.hash[:-1]).any())
        self.by_key = {k: i for i, k in enumerate(self.key)} if self.mixed else {}

    def reasons(self, h: np.ndarray, key: np.ndarray, moment: np.ndarray, dated: np.ndarray) -> np.ndarray:
        """'' where a reference resolves."""
        out = np.full(len(h), "missing", object)
        if not len(self.hash):
            return out
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        found = (self.hash[at] == h) & (self.key[at] == key)
        for i in np.flatnonzero((self.hash[at] == h) & ~found) if self.mixed else ():
            if (c := self.by_key.get(key[i])) is not None:
                at[i], found[i] = c, True
        probe = at * self.width + np.searchsorted(self.moments, moment, "right") - 1
        last = np.searchsorted(self.start, probe, "right") - 1
        begun = (last >= 0) & (self.code[np.maximum(last, 0)] == at)
        valid = begun & (self.until[np.maximum(last, 0)] > moment)
        out[found] = np.where(~dated | valid, "", np.where(begun, "deleted", "late"))[found]
        return out


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, held, ready = None, [], None
    blank = pd.DataFrame({"h": np.array([], np.int64), "full_key": np.array([], object), "a": np.array([], np.int64), "b": np.array([], np.int64)})
    for pdf in batches:
        for p, own in pdf.groupby("part", sort=True):
            if p != part:
                part, held, ready = p, [], None
            known = own[own["is_ref"] == 0]
            if len(known):
                held.append(known[["h", "full_key", "a", "b"]])
            asked = own[own["is_ref"] > 0]
            if not len(asked):
                continue
            if ready is None:
                ready = _Range(pd.concat(held) if held else blank)
                held = []
            dated = (asked["is_ref"] == 1).to_numpy()
            moment = asked["a"].to_numpy(np.int64)
            reason = ready.reasons(asked["h"].to_numpy(np.int64), asked["full_key"].to_numpy(object), moment, dated)
            bad = reason != ""
            if bad.any():
                yield pd.DataFrame({"src": asked["src"][bad], "record_id": asked["record_id"][bad], "ref_key": asked["ref_key"][bad], "reason": reason[bad], "moment": asked["a"].where(asked["is_ref"] == 1)[bad].astype("Int64")})
