"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRESENT = ""


def latest_by(df: DataFrame, key: str, order: str, payload: list[str]) -> DataFrame:
    """One row per key, the one with the greatest order; ties are settled by the greatest payload.

    Aggregates map-side, so a key that holds a third of all rows crosses the shuffle once per partition.
    Rows without a key are kept apart as a record each would be unidentifiable: they are dropped.
    """
    best = F.max(F.struct(F.col(order).alias("_o"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(payload)])).alias("_b")
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(best)
    return out.select(key, F.col("_b._o").alias(order), *[F.col(f"_b._{i}").alias(c) for i, c in enumerate(payload)])


def snapshot_changes(records: DataFrame, key: list[str], rank: str, last_rank: int, scalars: list[str], sets: list[str], version: str) -> DataFrame:
    """Rows (key, rank of the later snapshot, change_kind, changed_fields) for each pair of consecutive ranks 1..last_rank.

    records holds at most a few rows for one (key, rank); of those the greatest `version` counts. Every record is
    unpivoted into signed cells, `+1` in the pair where it is the later snapshot and `-1` where it is the earlier,
    plus a presence marker. Cells that both snapshots share cancel out; what is left classifies the record.
    A scalar that is null in one of the two is unknown there and no change; a null set is an empty set, its order and
    repetitions mean nothing. Null keys compare equal. A snapshot without any record removes all of the one before.
    The records move once, by key, before they are unpivoted: all later grouping stays inside its partition.
    """
    clash = {"_pair", "_sign", "_field", "_value", "_sum"} & set(records.columns)
    if clash:
        raise ValueError(f"columns reserved for cells: {sorted(clash)}")
    own = [version, *scalars, *sets]
    one = records.select(*key, rank, *own).repartition(*key).groupBy(*key, rank).agg(F.max(F.struct(*own)).alias("_r"))
    cells = [F.array(F.struct(F.lit(PRESENT).alias("f"), F.lit("").alias("v")))]
    cells += [F.when(F.col(f"_r.{c}").isNotNull(), F.array(F.struct(F.lit(c).alias("f"), F.col(f"_r.{c}").cast("string").alias("v")))) for c in scalars]
    cells += [_members(c) for c in sets]
    empty = F.array().cast("array<struct<f:string,v:string>>")
    cell = one.select(*key, rank, F.explode(F.concat(*[F.coalesce(c, empty) for c in cells])).alias("_c"))
    sides = F.array(F.struct(F.col(rank).alias("p"), F.lit(1).alias("s")), F.struct((F.col(rank) + 1).alias("p"), F.lit(-1).alias("s")))
    signed = cell.select(*key, F.col("_c.f").alias("_field"), F.col("_c.v").alias("_value"), F.explode(sides).alias("_s"))
    signed = signed.where((F.col("_s.p") > 1) & (F.col("_s.p") <= last_rank))
    left = (
        signed.groupBy(*key, F.col("_s.p").alias("_pair"), "_field", "_value")
        .agg(F.sum("_s.s").alias("_sum"))
        .where(F.col("_sum") != 0)
    )

    def of(field: str) -> Column:
        return F.when(F.col("_field") == field, F.col("_sum"))

    aggs = [F.sum(of(PRESENT)).alias("_here")]
    aggs += [((F.max(of(c)) > 0) & (F.min(of(c)) < 0)).alias(f"_d{i}") for i, c in enumerate(scalars)]
    aggs += [F.max(of(c)).isNotNull().alias(f"_e{i}") for i, c in enumerate(sets)]
    rows = left.groupBy(*key, "_pair").agg(*aggs)
    differs = [F.when(F.col(f"_d{i}"), F.lit(c)) for i, c in enumerate(scalars)] + [F.when(F.col(f"_e{i}"), F.lit(c)) for i, c in enumerate(sets)]
    rows = rows.select(
        *key,
        F.col("_pair").alias(rank),
        F.when(F.col("_here") > 0, "added").when(F.col("_here") < 0, "removed").otherwise("changed").alias("change_kind"),
        F.array_compact(F.array(*differs)).alias("changed_fields"),
    )
    return rows.where((F.col("change_kind") != "changed") | (F.size("changed_fields") > 0))


def _members(field: str) -> Column:
    cell = lambda x: F.struct(F.lit(field).alias("f"), x.cast("string").alias("v"))
    return F.transform(F.array_distinct(F.filter(F.col(f"_r.{field}"), lambda x: x.isNotNull())), cell)


def completed_ranks(manifests: DataFrame) -> DataFrame:
    """(generation_id, started_at, rank) of completed generations by start; one row per run of the indexer, a small table."""
    done = manifests.where(F.col("status") == "completed").select("generation_id", "started_at").distinct()
    order = Window.partitionBy(F.lit(0)).orderBy("started_at", "generation_id")
    return done.withColumn("rank", F.row_number().over(order))
