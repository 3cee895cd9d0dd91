"""The index on disk: one folder per generation, a pointer file that names the current one, and an embedding cache."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelith.operators.incremental import upsert, without_files
from orelith.session import drop_path

TABLES = ("tracked_files", "headers", "symbols", "state_refs", "vectors", "memories", "edges", "insight_queue", "postings", "doc_lengths")


class IndexStore:
    """Parquet tables under <root>/<table>/gen=<n>. A write makes a new version and then moves the pointer, so readers and
    failed jobs never see half a table; older versions stay until `vacuum`.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def versions(self) -> dict[str, int]:
        fs, path = self._fs("current.json")
        return json.loads(self.spark.read.text(str(path.toString()), wholetext=True).first()[0]) if fs.exists(path) else {}

    def _point(self, state: dict[str, int]) -> None:
        fs, fresh = self._fs("next.json")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        _, path = self._fs("current.json")
        sc = self.spark.sparkContext
        kind = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
        over = sc._gateway.new_array(kind, 1)
        over[0] = kind.OVERWRITE
        # in one step, so that a reader finds the old pointer or the new one
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(fresh, path, over)

    def exists(self, table: str) -> bool:
        return table in self.versions()

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}/gen={self.versions()[table]}")

    def write(self, table: str, df: DataFrame) -> None:
        """Replaces a table."""
        state = self.versions()
        n = state.get(table, 0) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/gen={n}")
        self._point(state | {table: n})

    def upsert(self, table: str, new: DataFrame, key: str | list[str]) -> None:
        """Rows of new take the place of rows with the same key."""
        self.write(table, upsert(self.read(table), new, key) if self.exists(table) else new)

    def remove_files(self, files: DataFrame, tables: tuple[str, ...] = ("tracked_files", "headers", "symbols", "state_refs", "vectors")) -> None:
        """Deletes all rows of the files from every table that has a file column."""
        for t in tables:
            if self.exists(t) and "file" in self.read(t).columns:
                self.write(t, without_files(self.read(t), files))

    def clear(self, *tables: str) -> None:
        """Empties tables (all if none is named); emptied headers make a scan parse every file again."""
        for t in tables or TABLES:
            if self.exists(t):
                self.write(t, self.read(t).limit(0))

    def count(self, table: str) -> int:
        return self.read(table).count() if self.exists(table) else 0

    def vacuum(self) -> None:
        """Deletes versions that are not current."""
        for t, n in self.versions().items():
            for old in range(1, n):
                drop_path(self.spark, f"{self.root}/{t}/gen={old}")


def cache_keys(texts: DataFrame, model: str, dims: int, version: str = "1") -> DataFrame:
    """Adds key to texts (text): everything that decides on an embedding."""
    return texts.withColumn("key", F.concat_ws(":", F.lit(model), F.lit(str(dims)), F.lit(version), F.sha2("text", 256)))


def embed_missing(texts: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame], model: str, dims: int) -> tuple[DataFrame, DataFrame]:
    """(texts with vectors, rows to append to the cache). embed turns (key, text) into (key, vector); vectors of a wrong length are not cached."""
    keyed = cache_keys(texts, model, dims)
    missing = keyed.select("key", "text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    fresh = embed(missing).where(F.size("vector") == dims).select("key", "vector")
    return keyed.join(cache.select("key", "vector").unionByName(fresh), "key", "left"), fresh
