"""Watching a project: a change source for Structured Streaming, a trailing-edge debounce, and a sync sink."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "file string, kind string, checksum string, at timestamp"


class ChangeSource(DataSource):
    """Format `orelith_changes`: additions, changes and deletions of files under the folder in option `path`.

    Offsets are the known state of the folder (size, time and checksum by file), so rewritten and deleted files are seen
    and a restart continues where it stopped. Files present at the start are no events unless option `initial` is true.
    """

    @classmethod
    def name(cls) -> str:
        return "orelith_changes"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Changes(self.options["path"], self.options.get("initial", "false") == "true")


class _Changes(SimpleDataSourceStreamReader):
    def __init__(self, path: str, initial: bool):
        self.path, self.initial = path, initial

    def _listed(self, known: dict) -> dict:
        out = {}
        for folder, _, names in os.walk(self.path):
            for n in names:
                full = os.path.join(folder, n)
                rel = os.path.relpath(full, self.path).replace(os.sep, "/")
                try:
                    stat = os.stat(full)
                    old = known.get(rel)
                    if old and old[0] == stat.st_size and old[1] == stat.st_mtime_ns:
                        out[rel] = old
                    else:
                        with open(full, "rb") as f:
                            out[rel] = [stat.st_size, stat.st_mtime_ns, hashlib.sha256(f.read()).hexdigest()[:8]]
                except OSError:  # gone between listing and reading
                    continue
        return out

    def initialOffset(self) -> dict:
        return {"files": json.dumps({} if self.initial else self._listed({}))}

    def _diff(self, old: dict, new: dict) -> list[tuple]:
        now = pd.Timestamp.now("UTC").to_pydatetime()
        rows = [(f, "add" if f not in old else "change", new[f][2], now) for f in sorted(new) if f not in old or old[f][2] != new[f][2]]
        return rows + [(f, "unlink", None, now) for f in sorted(old) if f not in new]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        old = json.loads(start["files"])
        new = self._listed(old)
        return iter(self._diff(old, new)), {"files": json.dumps(new)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._diff(json.loads(start["files"]), json.loads(end["files"])))

    def commit(self, end: dict) -> None:
        pass

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return super().partitions(start, end)


def changes(spark: SparkSession, path: str, initial: bool = False) -> DataFrame:
    spark.dataSource.register(ChangeSource)
    return spark.readStream.format("orelith_changes").option("path", path).option("initial", str(initial).lower()).load()


def debounce(stream: DataFrame, gap_ms: int = 1000) -> DataFrame:
    """The last change of a burst once its file was quiet for the gap; deletions pass at once and leave a pending change alone.

    Keeps one row of state per file with a running timer.
    """

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            kind, checksum, at = state.get
            state.remove()
            yield pd.DataFrame({"file": [key[0]], "kind": [kind], "checksum": [checksum], "at": [pd.Timestamp(at, unit="us")]})
            return
        for pdf in pdfs:
            gone = pdf[pdf["kind"] == "unlink"]
            if len(gone):
                yield gone[["file", "kind", "checksum", "at"]]
            rest = pdf[pdf["kind"] != "unlink"].sort_values("at")
            if len(rest):
                last = rest.iloc[-1]
                state.update((last["kind"], last["checksum"], int(last["at"].value // 1000)))
        if state.exists:
            state.setTimeoutDuration(gap_ms)

    return stream.groupBy("file").applyInPandasWithState(step, SCHEMA, "kind string, checksum string, at long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def watch(stream: DataFrame, listeners: list[Callable[[DataFrame, int], None]], checkpoint: str, interval: str = "1 second"):
    """Starts a query that hands every micro-batch to all listeners; the failure of one does not keep it from the others."""

    def fan_out(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            failed = []
            for f in listeners:
                try:
                    f(batch, epoch)
                except Exception as e:  # noqa: BLE001
                    failed.append(e)
            if failed and len(failed) == len(listeners):
                raise failed[0]
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(fan_out).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
