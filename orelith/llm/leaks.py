"""Passages of held-out items inside documents: one Aho-Corasick automaton, each text scanned once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 12
WORD = re.compile(r"[^\W_]+")
BLOCK_WORDS = 2_000_000  # words of items in one automaton; more items make more automata, each scans all texts


def normalised(text: str) -> tuple[str, list[int], list[int]]:
    """Lower-case words, each between blanks, with the start in this string and in the original of every word.

    The string is ` w1 w2 ... wn `; starts point at the blank before a word.
    """
    parts, at, origin = [" "], [], []
    here = 0
    for m in WORD.finditer(text):
        w = m.group().lower()
        at.append(here)
        origin.append(m.start())
        parts.append(w + " ")
        here += len(w) + 1
    return "".join(parts), at, origin


def automaton(items: list[tuple[int, str]], words: int):
    """Every run of `words` words of the items, pointing at the ids of all items that have it."""
    import ahocorasick

    ids: dict[str, set[int]] = {}
    for item, text in items:
        line, at, _ = normalised(text or "")
        for i in range(len(at) - words + 1):
            end = at[i + words] + 1 if i + words < len(at) else len(line)
            ids.setdefault(line[at[i] : end], set()).add(item)
    machine = ahocorasick.Automaton()
    for run, own in ids.items():
        machine.add_word(run, (len(run), tuple(sorted(own))))
    if len(ids):
        machine.make_automaton()
    return machine if len(ids) else None


def leaks(documents: DataFrame, items: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, item_id, first_at, last_at, n_runs): documents that hold at least `words` consecutive words of an item.

    documents: (doc_id, text), items: (item_id, text). Words are runs of letters and digits, compared in lower case.
    first_at is the offset of the first word of the earliest run in the original text, last_at that of the latest run's
    first word, n_runs how many runs of `words` words match. Null ids, null and empty texts take no part; items with
    fewer words cannot leak; rows of one doc_id are reported as one document. Very long texts are scanned whole.

    The items are a stated query set: they are read in blocks of at most BLOCK_WORDS words, one automaton a block.
    """
    import pickle

    spark = documents.sparkSession
    known = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    for row in known.toLocalIterator():
        n = len(WORD.findall(row["text"]))
        if size and size + n > BLOCK_WORDS:
            blocks.append([])
            size = 0
        blocks[-1].append((row["item_id"], row["text"]))
        size += n
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    out = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(pickle.dumps(block))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            machine = built(shared.value, words)
            for pdf in batches:
                rows = []
                for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                    if machine is not None:
                        rows += [(doc, *hit) for hit in hits(machine, text)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "first_at", "last_at", "n_runs"])

        part = docs.mapInPandas(run, "doc_id long, item_id long, first_at long, last_at long, n_runs long")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.max("n_runs").alias("n_runs"))


@lru_cache(maxsize=4)
def built(pickled: bytes, words: int):
    """The automaton of pickled items, built once a worker."""
    import pickle

    return automaton(pickle.loads(pickled), words)


def hits(machine, text: str) -> list[tuple[int, int, int, int]]:
    """(item, first_at, last_at, n_runs) of one text."""
    import bisect

    line, at, origin = normalised(text)
    found: dict[int, list[int]] = {}
    for end, (length, items) in machine.iter(line):
        start = origin[bisect.bisect_left(at, end - length + 1)]
        for item in items:
            if item in found:
                found[item][1] = start
                found[item][2] += 1
            else:
                found[item] = [start, start, 1]
    return [(item, *x) for item, x in found.items()]
