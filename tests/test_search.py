from pyspark.sql import functions as F

from orelith.operators import search
from orelith.plans import core

TEXTS = ["name", "class", "sig", "file", "insight", "namespace", "return_type", "extends_name"]


def test_tiers_count_every_match(spark, monkeypatch):
    n = (1 << 20) + 500
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("id"), F.lit("method").alias("type"), F.when(F.col("id") == 0, "er").when(F.col("id") == 1, "none").otherwise("a").alias("name"),
        F.when(F.col("id") > 1, "the user").alias("insight"), *[F.lit(None).cast("string").alias(c) for c in TEXTS if c not in ("name", "insight")], *[F.lit(None).cast("array<string>").alias(c) for c in search.LISTS],
    )
    monkeypatch.setattr(core, "_symbols", lambda spark, sf: rows)
    assert {r["tier"]: r["n_symbols"] for r in core.exact_tiers(spark, "").collect()} == {0: 1, 8: n - 2}
    few = search.exact_search(rows.where("id < 300"), "er", 3)
    assert [r["id"] for r in few.collect()] == ["0", "10", "100"]
