"""Parent-child links to full hierarchies: root, depth, path and state of every node; descendants from the paths."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelith.session import materialise

SEP = ">"
NODES_PER_FRAGMENT = 50_000
DOUBLINGS = 3  # a node's label is chosen among itself and its 2^DOUBLINGS nearest ancestors
_QUOTIENT = "tree string, node string, parent string, top string, frag string, size int, fate string"
_SOLVED = "tree string, node string, state string, top string, path string, depth int"
Key = tuple[str, str]


def hierarchy(links: DataFrame, per_fragment: int = NODES_PER_FRAGMENT, paths: bool = True) -> DataFrame:
    """links: distinct (tree, node, parent), at most one row per node of a tree, parent null or unknown for a root.

    Gives (tree, node, root, depth, path, state): state `tree`, `cycle` (on a cycle, a node that is its own parent
    included) or `below-cycle`; for the last two root and path are '' and depth -1. A parent that is no node of the tree
    makes its child a root. Null nodes are dropped; null trees are one tree. With paths=False all paths are '': a chain
    of n nodes has paths of n^2 names, while root and depth stay small.

    The forest is cut along edges into fragments (see `_cut`), however small it is. Within a fragment every chain from
    an asked-for node, one whose child lies in another fragment, is contracted to the next such node, to a node where
    two such chains meet, or to the chain's exit into another fragment. These nodes are the quotient forest, solved in the
    same way with other cuts until it fits into one fragment; then the fragments' paths are expanded. Cycles are found
    where they close: inside a fragment, or as a cycle of the quotient. A parent with very many children is asked for
    once per fragment, never once per child.
    """
    tree = F.coalesce("tree", F.lit(""))
    name = F.col("node") if paths else F.lit("")
    nodes = links.where(F.col("node").isNotNull()).select(tree.alias("tree"), "node", "parent", F.col("node").alias("top"), name.alias("frag"), F.lit(1).alias("size"), F.lit("").alias("fate"))
    out = _solve(materialise(nodes, "forest"), per_fragment, SEP if paths else "", 0)
    return out.select("tree", "node", F.col("top").alias("root"), "depth", "path", "state")


def descendants(solved: DataFrame) -> DataFrame:
    """(tree, ancestor, node, distance) for each node of state `tree` and each of its proper ancestors, from the paths; the result has one row per such pair. Names must not hold the separator."""
    steps = solved.where(F.col("state") == "tree").select("tree", "node", "depth", F.posexplode(F.split("path", SEP)).alias("at", "ancestor"))
    return steps.where(F.col("at") < F.col("depth")).select("tree", "ancestor", "node", (F.col("depth") - F.col("at")).alias("distance"))


def _cut(nodes: DataFrame, per_fragment: int, level: int) -> DataFrame:
    """Adds part, the fragment of every node, such that most parents lie in the fragment of their children.

    A node's label is the least hash among itself and its nearest ancestors, found by pointer doubling over pairs of
    64-bit hashes: along a chain neighbours share it with probability 1 - 2 / (ancestors looked at + 2). A label that too
    many nodes share is replaced by that of fewer ancestors, in the end by the node's own hash; labels are then hashed
    to fragments. Any cut gives the right result, so equal hashes do no harm.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    cuts = max(spark.sparkContext.defaultParallelism, -(-4 * n // per_fragment))
    most = max(1, per_fragment // (4 * (DOUBLINGS + 1)))
    h, up = F.xxhash64("tree", "node", F.lit(level)), F.when(F.col("parent").isNotNull(), F.xxhash64("tree", "parent", F.lit(level)))
    rows = nodes.select(h.alias("h"), up.alias("jump")).groupBy("h").agg(F.min("jump").alias("jump")).withColumn("m0", F.least("h", F.coalesce("jump", "h")))
    for k in range(1, DOUBLINGS + 1):
        rows = materialise(rows, f"jumps{level}")
        ahead = rows.select(F.col("h").alias("jump"), F.col("jump").alias("_far"), F.col(f"m{k - 1}").alias("_m"))
        # a parent of very many children is a skewed key of the left side only, which adaptive execution splits
        rows = rows.join(ahead, "jump", "left").select("h", F.col("_far").alias("jump"), *[f"m{i}" for i in range(k)], F.least(f"m{k - 1}", F.coalesce("_m", f"m{k - 1}")).alias(f"m{k}"))
    rows = materialise(rows, f"labels{level}")
    each = rows.select("h", F.posexplode(F.array(*[f"m{k}" for k in range(DOUBLINGS + 1)])).alias("k", "label"))
    hot = each.groupBy("k", "label").agg(F.count("*").alias("n")).where(F.col("n") > most).select("k", "label")
    label = each.join(hot, ["k", "label"], "left_anti").groupBy("h").agg(F.max_by("label", "k").alias("label"))
    part = F.pmod(F.xxhash64(F.coalesce("label", "h"), F.lit(level)), F.lit(cuts)).cast("int").alias("part")
    return nodes.withColumn("h", h).join(label, "h", "left").select(*nodes.columns, part)


def _solve(nodes: DataFrame, per_fragment: int, sep: str, level: int) -> DataFrame:
    """nodes: materialised."""
    if level and nodes.count() <= per_fragment:
        return nodes.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(lambda pdf: _finish(pdf, {}, sep), _SOLVED)
    nodes = materialise(_cut(nodes, per_fragment, level), f"fragments{level}")
    crossing = nodes.where("parent IS NOT NULL AND fate = ''").select("tree", F.col("parent").alias("node"), F.col("part").alias("asker")).distinct()
    asks = materialise(crossing.join(nodes.select("tree", "node", "part"), ["tree", "node"]).where("part <> asker"), f"exits{level}")
    quotient = nodes.groupBy("part").cogroup(asks.select("tree", "node", "part").distinct().groupBy("part")).applyInPandas(lambda own, asked: _contract(own, asked, sep), _QUOTIENT)
    solved = _solve(materialise(quotient, f"quotient{level}"), per_fragment, sep, level + 1)
    # a solved node goes to the fragments that asked for it and to its own, which may lie on a cycle with it
    wanted = asks.select("tree", "node", F.explode(F.array("asker", "part")).alias("part")).distinct()
    given = wanted.join(solved, ["tree", "node"])
    return nodes.groupBy("part").cogroup(given.groupBy("part")).applyInPandas(lambda own, known: _expand(own, known, sep), _SOLVED)


class _Fragment:
    """Local parent chains. up: the parent in the fragment; exit: the parent that is not; end: state of nodes from which no chain goes on."""

    def __init__(self, pdf: pd.DataFrame):
        keys = list(zip(pdf["tree"], pdf["node"], strict=True))
        self.top: dict[Key, str] = dict(zip(keys, pdf["top"], strict=True))
        self.frag: dict[Key, str] = dict(zip(keys, pdf["frag"], strict=True))
        self.size: dict[Key, int] = dict(zip(keys, pdf["size"].tolist(), strict=True))
        self.end: dict[Key, str] = {k: fate for k, fate in zip(keys, pdf["fate"], strict=True) if fate}
        self.up: dict[Key, Key] = {}
        self.exit: dict[Key, Key] = {}
        for key, parent in zip(keys, pdf["parent"], strict=True):
            if parent is None or parent != parent or key in self.end:
                continue
            above = (key[0], parent)
            (self.up if above in self.top else self.exit)[key] = above
        self.end.update(dict.fromkeys(self._cycles(), "cycle"))

    def _cycles(self) -> set[Key]:
        walked: set[Key] = set()
        on: set[Key] = set()
        for key in self.top:
            walk: dict[Key, int] = {}
            at: Key | None = key
            while at is not None and at not in walked and at not in walk:
                walk[at] = len(walk)
                at = self.up.get(at)
            if at is not None and at in walk:
                on.update(list(walk)[walk[at]:])
            walked.update(walk)
        return on

    def stops(self, asked: Iterable[Key]) -> list[Key]:
        """The asked-for nodes and those at which the chains of two of them meet."""
        stops, seen = dict.fromkeys(asked), set()
        for key in list(stops):
            at = None if key in self.end else self.up.get(key)
            while at is not None and at not in stops and at not in self.end:
                if at in seen:
                    stops[at] = None
                    break
                seen.add(at)
                at = self.up.get(at)
        return list(stops)


def _contract(nodes: pd.DataFrame, asks: pd.DataFrame, sep: str) -> pd.DataFrame:
    """The quotient's nodes, each with what lies between it and the next one or the exit; a chain is walked once."""
    f = _Fragment(nodes)
    stops = set(f.stops(zip(asks["tree"], asks["node"], strict=True)))
    rows = []
    for key in stops:
        fate, above, chain = f.end.get(key, ""), None, [key]
        at = None if fate else f.up.get(key)
        while at is not None:
            if at in stops:
                above = at
                break
            if at in f.end:
                fate = "below-cycle"
                break
            chain.append(at)
            at = f.up.get(at)
        if at is None and not fate:
            above = f.exit.get(chain[-1])
        rows.append((*key, above[1] if above else None, f.top[chain[-1]], sep.join(f.frag[x] for x in reversed(chain)), sum(f.size[x] for x in chain), fate))
    return pd.DataFrame(rows, columns=["tree", "node", "parent", "top", "frag", "size", "fate"]).astype({"size": "int32"})


def _expand(nodes: pd.DataFrame, given: pd.DataFrame, sep: str) -> pd.DataFrame:
    known = {(t, n): x for t, n, *x in zip(given["tree"], given["node"], given["state"], given["top"], given["path"], given["depth"].tolist(), strict=True)}
    return _finish(nodes, known, sep)


def _finish(nodes: pd.DataFrame, given: dict[Key, tuple], sep: str) -> pd.DataFrame:
    """Solves the nodes of a fragment from what is known of the nodes that its chains exit to."""
    f = _Fragment(nodes)
    done: dict[Key, tuple] = {x: (fate, "", "", -1) for x, fate in f.end.items()}
    for entry, (state, *_) in given.items():
        at = entry if state == "cycle" and entry in f.top else None
        while at is not None and at not in done:  # a cycle that closes elsewhere runs from its entry to the exit
            done[at] = ("cycle", "", "", -1)
            at = f.up.get(at)
    for start in f.top:
        chain, at = [], start
        while at is not None and at not in done:
            chain.append(at)
            at = f.up.get(at)
        for x in reversed(chain):
            above = done.get(f.up[x]) if x in f.up else given.get(f.exit.get(x))
            if above is None:
                done[x] = ("tree", f.top[x], f.frag[x], f.size[x] - 1)
            elif above[0] == "tree":
                done[x] = ("tree", above[1], above[2] + sep + f.frag[x], above[3] + f.size[x])
            else:
                done[x] = ("below-cycle", "", "", -1)
    return pd.DataFrame([(*x, *done[x]) for x in f.top], columns=["tree", "node", "state", "top", "path", "depth"]).astype({"depth": "int32"})
