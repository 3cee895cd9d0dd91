"""Queries of the general problems: changes between snapshots, dangling references, class hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelith.functions.moments import text_micros, wall_micros
from orelith.functions.paths import clean_path
from orelith.operators.hierarchy import descendants, hierarchy
from orelith.operators.orphans import dangling
from orelith.operators.snapshots import completed_ranks, latest_by, snapshot_changes
from orelith.session import table


def _changes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    ranks = completed_ranks(table(spark, sf, "manifests"))
    last = ranks.agg(F.max("rank")).first()[0] or 0
    h = table(spark, sf, "headers").select("header_id", "delivered_at", "generation_id", "repo", clean_path("file").alias("file"), F.lower(F.regexp_replace("checksum", r"^\s+|\s+$", "")).alias("checksum"), F.col("methods.id").alias("methods"))
    h = latest_by(h, "header_id", "delivered_at", ["generation_id", "repo", "file", "checksum", "methods"])
    h = h.join(ranks.select("generation_id", "rank"), "generation_id")
    out = snapshot_changes(h, ["repo", "file"], "rank", last, ["checksum"], ["methods"], "delivered_at")
    return out.join(ranks.select("rank", "generation_id"), "rank"), ranks


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = _changes(spark, sf)
    return out.select("repo", "file", "generation_id", "change_kind")


def p1_changed_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Per later generation, kind and changed field: how many records."""
    out, _ = _changes(spark, sf)
    return out.withColumn("field", F.explode_outer("changed_fields")).groupBy("generation_id", "change_kind", F.when(F.col("change_kind") == "changed", F.col("field")).alias("field")).agg(F.countDistinct("repo", "file").alias("n_records"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "headers")
    started = table(spark, sf, "manifests").select("generation_id", wall_micros("started_at").alias("moment"))
    outside = table(spark, sf, "external_callees").select(F.col("callee").alias("ref")).distinct()
    ref_lists = F.array_distinct(F.transform(F.flatten(F.filter("methods.refs", lambda x: x.isNotNull())), lambda x: F.replace(F.regexp_replace(x, r"^\s+|\s+$", ""), F.lit("?."), F.lit("."))))

    def exploded(rows: DataFrame) -> DataFrame:
        each = rows.select("header_id", "generation_id", "repo", F.explode("refs").alias("ref"))
        each = each.join(outside, "ref", "left_anti")
        return each.select(F.lit("headers").alias("src"), F.concat(F.lit("m:"), "repo").alias("space"), F.col("header_id").cast("string").alias("record_id"), F.nullif(F.regexp_extract("ref", r"([^.#]*)$", 1), F.lit("")).alias("ref_key"), "generation_id")

    heads = h.select("header_id", "delivered_at", "generation_id", "repo", ref_lists.alias("refs"))
    latest = latest_by(heads, "header_id", "delivered_at", ["generation_id", "repo", "refs"]).where(F.col("generation_id").isNotNull())
    h_refs = exploded(latest).join(started, "generation_id", "left").drop("generation_id")
    memories = table(spark, sf, "memories").select(F.lit("memories").alias("src"), F.lit("i").alias("space"), F.col("id").alias("record_id"), F.nullif(F.lower(F.regexp_replace("symbol_id", r"^\s+|\s+$", "")), F.lit("")).alias("ref_key"), text_micros("created_at").alias("moment"))
    kind = F.nullif(F.translate(F.lower(F.regexp_replace("kind", r"^\s+|\s+$", "")), "_", "-"), F.lit(""))
    issues = table(spark, sf, "stale_issues").select(F.lit("stale_issues").alias("src"), F.lit("k").alias("space"), F.col("issue_id").cast("string").alias("record_id"), kind.alias("ref_key"), wall_micros("detected_at").alias("moment"))
    symbols = table(spark, sf, "symbols").select("id", "sym_type", "repo", "sym_name", wall_micros("indexed_at").alias("valid_from"), wall_micros("removed_at").alias("valid_to"))
    methods = symbols.where(F.lower(F.trim("sym_type")) == "method").select(F.concat(F.lit("m:"), "repo").alias("space"), F.col("sym_name").alias("parent_key"), "valid_from", "valid_to")
    ids = symbols.select(F.lit("i").alias("space"), F.col("id").alias("parent_key"), "valid_from", "valid_to")
    kinds = table(spark, sf, "issue_kinds").select(F.lit("k").alias("space"), F.col("kind").alias("parent_key"), wall_micros("introduced_at").alias("valid_from"), wall_micros("retired_at").alias("valid_to"))
    refs = h_refs.unionByName(memories).unionByName(issues)
    return dangling(refs, methods.unionByName(ids).unionByName(kinds))


def p2_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references per referring table, reason and month."""
    return p2_found(spark, sf).groupBy("src", "reason", "ref_month").agg(F.count("*").alias("n_refs"))


def _classes(spark: SparkSession, sf: str) -> DataFrame:
    """(tree, node, parent) of the last full snapshot."""
    last = completed_ranks(table(spark, sf, "manifests")).orderBy(F.desc("rank")).select("generation_id").first()
    last = last[0] if last else ""
    trimmed = lambda x: F.nullif(F.regexp_replace(x, r"^\s+|\s+$", ""), F.lit(""))
    short = F.transform("classes", lambda c: F.struct(c["class_name"].alias("n"), trimmed(c["extends_name"]).alias("e"), F.get(F.filter(c["implements"], lambda i: trimmed(i).isNotNull()), F.lit(0)).alias("i")))
    h = table(spark, sf, "headers").select("header_id", "delivered_at", "generation_id", "repo", clean_path("file").alias("file"), F.when(F.col("generation_id") == last, short).alias("cs"))
    h = latest_by(h, "header_id", "delivered_at", ["generation_id", "repo", "file", "cs"]).where(F.col("generation_id") == last)
    each = h.select("repo", "file", F.posexplode("cs").alias("at", "c")).where(F.col("c.n").isNotNull())
    order = F.struct("file", "at")
    one = each.groupBy("repo", F.col("c.n").alias("node")).agg(F.min_by("c.e", F.when(F.col("c.e").isNotNull(), order)).alias("e"), F.min_by("c.i", F.when(F.col("c.i").isNotNull(), order)).alias("i"))
    name = F.regexp_replace(F.regexp_replace(F.coalesce("e", "i"), "<.*$", ""), r"^.*(\.|::)", "")
    return one.select(F.col("repo").alias("tree"), "node", F.nullif(F.regexp_replace(name, r"\s+", ""), F.lit("")).alias("parent"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    h = hierarchy(_classes(spark, sf))
    return h.select(F.col("tree").alias("repo"), F.col("node").alias("class_name"), F.col("root").alias("root_name"), F.col("depth").cast("int").alias("node_depth"), F.col("path").alias("node_path"), F.col("state").alias("node_state"))


def p7_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Number of descendants and greatest distance of every class that has any."""
    d = descendants(hierarchy(_classes(spark, sf)))
    return d.groupBy(F.col("tree").alias("repo"), F.col("ancestor").alias("class_name")).agg(F.count("*").alias("n_descendants"), F.max("distance").alias("height"))


def p7_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every class with each of its descendants."""
    d = descendants(hierarchy(_classes(spark, sf)))
    return d.select(F.col("tree").alias("repo"), F.col("ancestor").alias("class_name"), F.col("node").alias("descendant"), F.col("distance").cast("int").alias("distance"))


QUERIES = {f.__name__: f for f in (p1_found, p1_changed_fields, p2_found, p2_by_month, p7_found, p7_descendants, p7_pairs)}
