"""Embedding and language-model providers: protocols, a guard with retries, and built-ins that need no network."""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Embedder(Protocol):
    """Runs in the executors, so it must be picklable."""

    dims: int
    name: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def select(self, query: str, candidates: list[dict], limit: int) -> list[str]:
        """Ids of the chosen candidates, best first."""


@dataclass(frozen=True)
class HashingEmbedder:
    """Words and their trigrams hashed into a fixed number of signed dimensions, scaled to length one; deterministic."""

    dims: int = 64
    name: str = "hashing"

    def embed(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = np.zeros((len(texts), self.dims))
        for i, t in enumerate(texts):
            for w in re.findall(r"[^\W_]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", t).lower()):
                for g in [w, *(w[j : j + 3] for j in range(len(w) - 2))]:
                    h = zlib.crc32(g.encode())
                    out[i, h % self.dims] += 1 if h & 0x80000000 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()


class ProviderError(Exception):
    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def retryable(error: Exception) -> bool:
    """Rate limits, timeouts and server errors; not a bad request nor a text too long for the model."""
    if isinstance(error, TimeoutError | ConnectionError):
        return True
    status = getattr(error, "status", None)
    return status == 429 or (status is not None and status >= 500)


def too_long(error: Exception) -> bool:
    return bool(re.search(r"context|too long|maximum", str(error), re.I)) and not retryable(error)


@dataclass
class Guard:
    """Calls with retries, growing pauses and counters; one per task, so the cluster-wide limit is the number of tasks."""

    retries: int = 3
    base: float = 0.4
    most: float = 10.0
    sleep: Callable[[float], None] = time.sleep
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("attempts", "retries", "failures", "timeouts", "rate_limits", "non_retryable"), 0))

    def call(self, f: Callable, *args):
        for n in range(self.retries + 1):
            self.counts["attempts"] += 1
            try:
                return f(*args)
            except Exception as e:
                self.counts["timeouts"] += isinstance(e, TimeoutError)
                self.counts["rate_limits"] += getattr(e, "status", None) == 429
                if not retryable(e):
                    self.counts["non_retryable"] += 1
                    self.counts["failures"] += 1
                    raise
                if n == self.retries:
                    self.counts["failures"] += 1
                    raise
                self.counts["retries"] += 1
                self.sleep(min(self.most, self.base * 2**n + random.random() * 0.1))


def embed_shrinking(embed: Callable[[str], list[float]], text: str, size: int = 2000, least: int = 250) -> list[float]:
    """Cuts a prompt to `size` characters and halves it while the model finds it too long, down to `least`."""
    while True:
        try:
            return embed(text[:size])
        except Exception as e:
            if not too_long(e) or size <= least:
                raise
            size = max(least, size // 2)


def embed_frame(texts: DataFrame, embedder: Embedder, batch: int = 64) -> DataFrame:
    """texts (key, text) to (key, vector) in Arrow batches; a null text is an empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        guard = Guard()
        for pdf in batches:
            said = pdf["text"].fillna("").tolist()
            vectors = [v for i in range(0, len(said), batch) for v in guard.call(embedder.embed, said[i : i + batch])]
            yield pd.DataFrame({"key": pdf["key"], "vector": vectors})

    return texts.select("key", "text").mapInPandas(run, "key string, vector array<float>")


def selected_ids(answer: str, known: list[str]) -> list[str]:
    """Ids a model chose: the list under selectedIds or ids of its JSON, else of the first braces in the text, else known ids in the order in which they are mentioned."""
    import json

    for part in (answer, *(m.group() for m in [re.search(r"\{[\s\S]*\}", answer)] if m)):
        try:
            said = json.loads(part)
        except ValueError:
            continue
        ids = said.get("selectedIds") or said.get("ids") if isinstance(said, dict) else None
        if isinstance(ids, list):
            return list(dict.fromkeys(str(i) for i in ids if str(i) in known))
    return sorted((i for i in known if i in answer), key=answer.index)


def insights(answer: str) -> dict[str, str]:
    """Insight by method id from lines `1. kind:id: text`; lines without such an id are skipped."""
    out = {}
    for line in answer.splitlines():
        if m := re.match(r"\s*(?:\d+\.\s*)?([^:\s]+:[^:\s]+):\s*(\S.*)$", line):
            out[m.group(1)] = m.group(2).strip()
    return out


def rerank_prompt(query: str, candidates: list[dict]) -> str:
    rows = "\n".join(f"{c['id']} | {c.get('type')} | {c.get('file')} | {c.get('sig') or c.get('name') or ''}" for c in candidates)
    return f'Question: {query}\nCandidates, one a line as id | kind | file | signature:\n{rows}\nAnswer with JSON {{"selectedIds": [...]}}, best first, using only ids from above.'


def insight_prompt(methods: list[dict]) -> str:
    rows = "\n\n".join(f"{m['id']}\n{m['code']}" for m in methods)
    return f"Say in one short sentence what each method below is for. Answer one line a method, as its id, a colon and the sentence.\n\n{rows}"
