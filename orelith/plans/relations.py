"""The engine's relations over the delivered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orelith.functions.paths import clean_path
from orelith.operators.snapshots import completed_ranks, latest_by
from orelith.session import table


def headers(spark: SparkSession, sf: str) -> DataFrame:
    """Headers of the last full snapshot: (project, file, lang, checksum, namespace, classes, methods, imports, exports); file is `project/clean path`."""
    last = completed_ranks(table(spark, sf, "manifests")).orderBy(F.desc("rank")).select("generation_id").first()
    h = table(spark, sf, "headers")
    body = F.struct("repo", F.concat_ws("/", "repo", clean_path("file")).alias("file"), "lang", "checksum", "ns", "classes", "methods", "imports", "exports")
    of_last = F.col("generation_id") == (last[0] if last else "")
    h = latest_by(h.select("header_id", "delivered_at", "generation_id", F.when(of_last, body).alias("b")), "header_id", "delivered_at", ["generation_id", "b"]).where(of_last)
    return h.select(F.col("b.repo").alias("project"), F.col("b.file").alias("file"), F.col("b.lang").alias("lang"), F.col("b.checksum").alias("checksum"), F.col("b.ns").alias("namespace"), "b.classes", "b.methods", "b.imports", "b.exports", "generation_id")


def symbols(heads: DataFrame) -> DataFrame:
    """The flat symbol index: one row per class and method of the headers."""
    none, lists = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    shared = ["project", "file", "lang", "namespace", "imports", "exports", "generation_id"]
    m = heads.select(*shared, F.explode("methods").alias("m")).select(*shared, F.col("m.id").alias("id"), F.lit("method").alias("type"), F.col("m.method_name").alias("name"), F.col("m.class_name").alias("class"), F.col("m.sig").alias("sig"), F.col("m.loc").alias("loc"), F.col("m.insight").alias("insight"), F.col("m.refs").alias("refs"), lists.alias("decorators"), lists.alias("parameters"), F.col("m.return_type").alias("return_type"), none.alias("extends_name"), lists.alias("implements"), F.col("m.visibility").alias("visibility"), F.col("m.is_async").alias("is_async"))
    c = heads.select(*shared, F.explode("classes").alias("c")).select(*shared, F.col("c.id").alias("id"), F.lit("class").alias("type"), F.col("c.class_name").alias("name"), F.col("c.class_name").alias("class"), none.alias("sig"), F.col("c.loc").alias("loc"), none.alias("insight"), lists.alias("refs"), F.col("c.decorators").alias("decorators"), lists.alias("parameters"), none.alias("return_type"), F.col("c.extends_name").alias("extends_name"), F.col("c.implements").alias("implements"), F.col("c.visibility").alias("visibility"), F.lit(None).cast("boolean").alias("is_async"))
    first = Window.partitionBy("id").orderBy("file", "type", "loc", "name")
    both = m.unionByName(c).withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    return both.withColumn("ordinal", F.concat_ws("|", "file", "id"))


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """Notes, one row per id: (id, project, text, file, symbol, symbol_id, scope, created_at, batch_no)."""
    m = table(spark, sf, "memories")
    m = m.groupBy("id").agg(F.min(F.struct("batch_no", "created_at", "repo", "text", "file", "symbol", "symbol_id", "scope")).alias("m")).select("id", "m.*")
    sid = F.nullif(F.lower(F.trim("symbol_id")), F.lit(""))
    return m.select("id", F.col("repo").alias("project"), "text", F.concat(F.col("repo"), F.lit("/"), clean_path("file")).alias("file"), "symbol", sid.alias("symbol_id"), "scope", "created_at", "batch_no")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors, the latest per id: (id, kind, vector)."""
    v = table(spark, sf, "vectors").select("id", "indexed_at", F.lower(F.trim("vec_type")).alias("kind"), "vector")
    return latest_by(v, "id", "indexed_at", ["kind", "vector"]).select("id", "kind", "vector")


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Source files: (project, file, text), one row per file."""
    s = table(spark, sf, "source_files")
    return s.groupBy(F.col("repo").alias("project"), F.concat_ws("/", "repo", "file").alias("file")).agg(F.max("src_text").alias("text"))
