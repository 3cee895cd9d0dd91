"""Incremental maintenance: what changed, what vanished, keyed upserts and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of new replace rows of old with the same key; columns that one side lacks are null. Null keys never match."""
    return old.join(new.select(*([key] if isinstance(key, str) else key)).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def without_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of other files: the delete by file of every table."""
    return rows.join(files.select("file").distinct(), "file", "left_anti")


def file_states(current: DataFrame, tracked: DataFrame, headers: DataFrame) -> DataFrame:
    """(file, state) of files now or then known: added, changed, unchanged, missing-header (must be parsed again) or vanished.

    current and tracked: (file, checksum); headers: (file). A null checksum on either side counts as changed.
    """
    h = headers.select("file").distinct().withColumn("_h", F.lit(True))
    both = current.select("file", F.col("checksum").alias("_now")).withColumn("_c", F.lit(True)).join(tracked.select("file", F.col("checksum").alias("_then")).withColumn("_t", F.lit(True)), "file", "full_outer").join(h, "file", "left")
    state = (
        F.when(F.col("_c").isNull(), "vanished").when(F.col("_t").isNull(), "added").when(F.coalesce(F.col("_now") != F.col("_then"), F.lit(True)), "changed")
        .when(F.col("_h").isNull(), "missing-header").otherwise("unchanged")
    )
    return both.select("file", state.alias("state"))


def method_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, file, state): methods added, updated or removed, matched by id, else by file and location.

    old and new: (id, file, loc, body). A method whose id is gone but whose place is taken by a new id is updated.
    """
    o = old.select("id", "file", "loc", "body").dropDuplicates(["id"])
    n = new.select("id", "file", "loc", "body").dropDuplicates(["id"])
    same = n.join(o.select("id", F.col("body").alias("_b")), "id").where(~F.col("body").eqNullSafe(F.col("_b"))).select("id", "file", F.lit("updated").alias("state"))
    fresh, gone = n.join(o, "id", "left_anti"), o.join(n, "id", "left_anti")
    place = ["file", "loc"]
    moved = fresh.join(gone.select(*place).distinct(), place, "left_semi").select("id", "file", F.lit("updated").alias("state"))
    added = fresh.join(gone.select(*place).distinct(), place, "left_anti").select("id", "file", F.lit("added").alias("state"))
    removed = gone.join(fresh.select(*place).distinct(), place, "left_anti").select("id", "file", F.lit("removed").alias("state"))
    return same.unionByName(moved).unionByName(added).unionByName(removed)


def debounced(events: DataFrame, gap_seconds: int) -> DataFrame:
    """(file, at, kind): the last event of every burst of a file; deletions pass at once and end no burst.

    events: (file, at, kind), kind add, change or unlink. A change is given out if the file's next change comes later
    than the gap, or never. Events without file or time are dropped.
    """
    rows = events.where(F.col("file").isNotNull() & F.col("at").isNotNull())
    w = Window.partitionBy("file").orderBy("at", "kind")
    changes = rows.where("kind <> 'unlink'").withColumn("_next", F.lead("at").over(w))
    last = changes.where(F.col("_next").isNull() | (F.col("_next") > F.col("at") + F.expr(f"INTERVAL {int(gap_seconds)} SECONDS"))).drop("_next")
    return last.select("file", "at", "kind").unionByName(rows.where("kind = 'unlink'").select("file", "at", "kind"))


def manifest_history(manifests: DataFrame, keep: int = 21) -> DataFrame:
    """The latest generation and up to 20 before it, which are marked as candidates for compaction; older ones are left out. A small table."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("started_at"), F.desc("generation_id"))
    ranked = manifests.dropDuplicates(["generation_id"]).withColumn("age", F.row_number().over(w) - 1)
    return ranked.where(F.col("age") < keep).withColumns({"is_latest": F.col("age") == 0, "compaction": F.col("age") > 0})
