"""The queue of methods that wait for an insight, as a table with a state per (file, method_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelith.operators.incremental import upsert

SCHEMA = "file string, method_id string, code string, state string, retries int, queued_at string"
KEY = ["file", "method_id"]


def enqueue(queue: DataFrame, new: DataFrame, at: str) -> DataFrame:
    """Adds (file, method_id, code) as pending; what is queued already stays as it is. Rows without a key are dropped."""
    fresh = new.where("file IS NOT NULL AND method_id IS NOT NULL").groupBy(*KEY).agg(F.min("code").alias("code")).join(queue.select(*KEY), KEY, "left_anti")
    return queue.unionByName(fresh.select(*KEY, "code", F.lit("pending").alias("state"), F.lit(0).alias("retries"), F.lit(at).alias("queued_at")))


def take(queue: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(queue with the n oldest pending entries in process, those entries)."""
    chosen = queue.where("state = 'pending'").orderBy("queued_at", *KEY).limit(n).withColumn("state", F.lit("processing"))
    return upsert(queue, chosen, KEY), chosen


def complete(queue: DataFrame, done: DataFrame) -> DataFrame:
    return queue.join(done.select(*KEY).distinct(), KEY, "left_anti")


def fail(queue: DataFrame, failed: DataFrame) -> DataFrame:
    """Failed entries are pending again, with one retry more."""
    hit = failed.select(*KEY).distinct().withColumn("_f", F.lit(True))
    rows = queue.join(hit, KEY, "left")
    again = F.col("_f").isNotNull()
    return rows.select(*KEY, "code", F.when(again, "pending").otherwise(F.col("state")).alias("state"), (F.col("retries") + again.cast("int")).alias("retries"), "queued_at")


def pending_by_file(queue: DataFrame) -> DataFrame:
    return queue.where("state IN ('pending', 'processing')").groupBy("file").agg(F.count("*").alias("n_pending"))
