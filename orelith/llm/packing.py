"""Filling fixed-capacity containers by swap-based local search.

Pieces are laid into containers as they come; moves, one-for-one and two-for-one swaps between underfull containers that
raise the sum of squared fills then empty containers one after the other. What stays underfull is dealt and searched again.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelith.session import materialise, widen

DEAL = 4_000  # pieces that are packed together


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the image keeps the public tokenizers; pass another path where they lie elsewhere."""
    return f"/opt/tokenizers/{name}"


def token_counts(documents: DataFrame, vocabulary: str, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) by a byte-level vocabulary in rank format; null and empty texts have 0 tokens.

    A doc_id that comes twice counts once, with its longest text. Texts are tokenised whole.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        if pattern is None:
            import public_tokenizers

            split = public_tokenizers.PATTERN
        else:
            split = pattern
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]})

    docs = widen(documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text"))
    return docs.mapInPandas(run, "doc_id long, n_tokens long").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def pack(items: DataFrame, windows: DataFrame, deal: int = DEAL) -> DataFrame:
    """items (doc_id, n_tokens) into containers of each window (window_name, capacity):
    (window_name, capacity, bin_id, doc_id, piece_no, n_tokens), one row for every item or piece of an item.

    An item larger than the capacity is cut into full pieces and a rest; no other item is split. Items of size 0 or of
    unknown size lie in a container like others, taking no room. A window without a positive capacity is left out.

    Full pieces fill their container alone. The others are dealt at random into groups of about `deal` pieces, each
    packed by local search (`pack_group`). The pieces of bins that are not full are dealt once more, now several groups'
    together, so that less than about one bin's room stays unused per second-level group.
    """
    spark = items.sparkSession
    wins = [(r["window_name"], int(r["capacity"])) for r in windows.where("capacity > 0").select("window_name", "capacity").distinct().collect()]  # a handful of capacities
    items = materialise(items.select("doc_id", "n_tokens"), "sizes")  # texts are tokenised once
    n = items.count()
    if not wins:
        return spark.createDataFrame([], "window_name string, capacity int, bin_id string, doc_id long, piece_no int, n_tokens long")
    w = F.explode(F.array(*[F.struct(F.lit(a).alias("window_name"), F.lit(b).alias("capacity")) for a, b in wins])).alias("w")
    size = F.coalesce("n_tokens", F.lit(0)).cast("long")
    each = items.select("doc_id", size.alias("n_tokens"), w).select("doc_id", "n_tokens", "w.*")
    whole = F.floor(F.col("n_tokens") / F.col("capacity")).cast("int")
    pieces = F.when(F.col("n_tokens") > F.col("capacity"), F.transform(F.sequence(F.lit(0), whole), lambda i: F.struct(i.alias("piece_no"), F.when(i < whole, F.col("capacity").cast("long")).otherwise(F.col("n_tokens") % F.col("capacity")).alias("size"))))
    pieces = F.coalesce(pieces, F.array(F.struct(F.lit(0).alias("piece_no"), F.col("n_tokens").alias("size"))))
    cut = each.select("window_name", "capacity", "doc_id", "n_tokens", F.explode(pieces).alias("p")).where((F.col("p.size") > 0) | (F.col("n_tokens") == 0))
    cut = cut.select("window_name", "capacity", "doc_id", "p.piece_no", F.col("p.size").alias("n_tokens"))
    full = cut.where(F.col("n_tokens") == F.col("capacity")).withColumn("bin_id", F.concat_ws("-", F.lit("f"), "doc_id", "piece_no"))
    groups = max(1, -(-n // deal))
    loose = cut.where(F.col("n_tokens") < F.col("capacity")).withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(groups)).cast("int"))
    schema = "window_name string, capacity int, bin_id string, doc_id long, piece_no int, n_tokens long, done boolean"
    once = materialise(loose.groupBy("window_name", "deal").applyInPandas(_packer("a", groups == 1), schema), "packed")
    out = full.unionByName(once.where("done").drop("done"))
    if groups > 1:
        # as many groups' underfull bins together as fill a deal again
        left = once.where("NOT done").drop("bin_id", "done")
        share = max(1, -(-left.count() // (deal * len(wins))))
        again = left.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(1)), F.lit(share)).cast("int")).groupBy("window_name", "deal").applyInPandas(_packer("b", True), schema)
        out = out.unionByName(again.drop("done"))
    return out.select("window_name", "capacity", "bin_id", "doc_id", "piece_no", "n_tokens")


def _packer(stage: str, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mixed = pdf["doc_id"].to_numpy(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pdf["piece_no"].to_numpy(np.int64).astype(np.uint64)
        pdf = pdf.iloc[np.argsort(mixed, kind="stable")]  # in an order that has nothing to do with the sizes and is the same in every run
        cap, group = int(pdf["capacity"].iat[0]), int(pdf["deal"].iat[0])
        sizes = pdf["n_tokens"].tolist()
        own = np.zeros(len(pdf), np.int64)
        done = np.zeros(len(pdf), bool)
        for b, members in enumerate(pack_group(sizes, cap)):
            own[members] = b
            done[members] = last or sum(sizes[i] for i in members) == cap
        return pd.DataFrame({
            "window_name": pdf["window_name"], "capacity": pdf["capacity"], "bin_id": [f"{stage}-{group}-{b}" for b in own], "doc_id": pdf["doc_id"],
            "piece_no": pdf["piece_no"], "n_tokens": pdf["n_tokens"], "done": done,
        })

    return run


def pack_group(sizes: list[int], cap: int) -> list[list[int]]:
    """Bins as lists of positions in sizes, each 0 to cap.

    The search starts from the pieces as they come. Where it ends above the least number of bins that the sizes allow, it
    starts again from best fit in decreasing order, and the better end counts.
    """
    some = [i for i, s in enumerate(sizes) if s > 0]
    search = Search([sizes[i] for i in some], cap)
    search.run()
    if len(search.room) > search.least:
        falling = sorted(some, key=lambda i: -sizes[i])
        again = Search([sizes[i] for i in falling], cap, tight=True)
        again.run()
        if len(again.room) < len(search.room):
            some, search = falling, again
    bins = [[some[i] for i in b] for b in search.bins if b]
    none = [i for i, s in enumerate(sizes) if s <= 0]
    if none:
        bins = bins or [[]]
        bins[0] += none  # what has no size lies anywhere
    return bins


class Search:
    """A packing under local search; starts with every piece in the last bin opened (or, tight, in the fullest that takes it), or a new one where it does not fit."""

    def __init__(self, sizes: list[int], cap: int, tight: bool = False):
        self.sizes, self.cap = sizes, cap
        self.least = -(-sum(sizes) // cap)
        self.bins: list[list[int]] = []
        self.load: list[int] = []
        self.of: list[int] = []
        self.room: list[tuple[int, int]] = []  # free room of every bin in use, sorted
        for i, s in enumerate(sizes):
            at = bisect.bisect_left(self.room, (s, -1)) if tight else len(self.room)
            b = self.room[at][1] if at < len(self.room) else len(self.bins) - 1
            if not self.bins or self.load[b] + s > cap:
                b = len(self.bins)
                self.bins.append([])
                self.load.append(0)
            self.bins[b].append(i)
            self.of.append(b)
            self._fill(b, s)

    def run(self) -> None:
        """Until no smaller number of bins is possible or nothing helps. Every step raises the sum of squared fills, or
        keeps it and takes one piece of an underfull bin apart into two, so the search ends."""
        while len(self.room) > self.least:
            if not self._pass() and not self._split():
                break

    def _underfull(self) -> list[int]:
        return sorted((b for f, b in self.room if f), key=lambda b: self.load[b])

    def _pass(self) -> bool:
        """Every underfull bin once, emptiest first."""
        better = False
        for a in self._underfull():
            if 0 < self.load[a] < self.cap:
                better |= self._drain(a)
            if 0 < self.load[a] < self.cap:
                better |= self._swap(a)
        return better

    def _fill(self, b: int, by: int) -> None:
        if self.load[b]:
            self.room.pop(bisect.bisect_left(self.room, (self.cap - self.load[b], b)))
        self.load[b] += by
        if self.load[b]:
            bisect.insort(self.room, (self.cap - self.load[b], b))

    def _give(self, i: int, a: int, b: int) -> None:
        self.bins[a].remove(i)
        self.bins[b].append(i)
        self.of[i] = b

    def _move(self, i: int, a: int, b: int) -> int:
        s, grown = self.sizes[i], 2 * self.sizes[i] * (self.load[b] - self.load[a] + self.sizes[i])
        self._give(i, a, b)
        self._fill(a, -s)
        self._fill(b, s)
        return grown

    def _drain(self, a: int) -> bool:
        """Moves the pieces of a, largest first, each into the tightest bin that takes it; undone if squared fill has not grown by all of them."""
        grown, moved = 0, []
        for i in sorted(self.bins[a], key=lambda i: -self.sizes[i]):
            at = bisect.bisect_left(self.room, (self.sizes[i], -1))
            if at < len(self.room) and self.room[at][1] == a:
                at += 1
            if at < len(self.room):
                b = self.room[at][1]
                grown += self._move(i, a, b)
                moved.append((i, b))
        if grown <= 0:
            for i, b in reversed(moved):
                self._move(i, b, a)
        return grown > 0

    def _swap(self, a: int) -> bool:
        """Gives each piece of a, largest first, to the bin where it fills most against one or two smaller ones."""
        better = False
        for i in sorted(self.bins[a], key=lambda i: -self.sizes[i]):
            best, s = None, self.sizes[i]
            for f, b in reversed(self.room[: bisect.bisect_left(self.room, (s, -1))]):
                if f == 0 or (best and best[0] >= f):
                    break  # no bin from here on can be filled by more
                if b != a and self.load[b] >= self.load[a]:
                    found = _exchange(s, f, self.bins[b], self.sizes)
                    if found and (best is None or found[0] > best[0]):
                        best = (found[0], b, found[1])
            if best:
                gain, b, back = best
                for j in back:
                    self._give(j, b, a)
                self._give(i, a, b)
                self._fill(a, -gain)
                self._fill(b, gain)
                better = True
        return better

    def _split(self) -> bool:
        """Swaps pieces of underfull bins for two of a full one that have the same size together: fills stay, but small pieces come free."""
        pairs: dict[int, list[tuple[int, int, int]]] = {}
        for b, members in enumerate(self.bins):
            if self.load[b] == self.cap:
                for x, j in enumerate(members):
                    for k in members[x + 1 :]:
                        pairs.setdefault(self.sizes[j] + self.sizes[k], []).append((j, k, b))
        better = False
        for a in self._underfull():
            for i in sorted(self.bins[a], key=lambda i: -self.sizes[i]):
                for j, k, b in pairs.get(self.sizes[i], ()):
                    if self.of[j] == self.of[k] == b:
                        for x, old, new in ((j, b, a), (k, b, a), (i, a, b)):
                            self._give(x, old, new)
                        better = True
                        break
        return better


def _exchange(s: int, f: int, members: list[int], sizes: list[int]) -> tuple[int, tuple[int, ...]] | None:
    """(gain, pieces given back) of the best exchange of a piece of size s for one or two smaller ones of a bin with f free."""
    small = sorted((sizes[j], j) for j in members if sizes[j] < s)
    best = None
    # what is given back must be at least s - f, and as little above as there is, below s
    x = bisect.bisect_left(small, (s - f, -1))
    if x < len(small):
        best = (s - small[x][0], (small[x][1],))
    for x, (one, j) in enumerate(small):
        if best and best[0] == f:
            break
        y = bisect.bisect_left(small, (s - f - one, -1), x + 1)
        if y < len(small) and small[y][0] < s - one and (best is None or s - one - small[y][0] > best[0]):
            best = (s - one - small[y][0], (j, small[y][1]))
    return best
