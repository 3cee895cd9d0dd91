"""Queries of the language-model problems and, where SQL can say them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelith.functions.moments import text_micros
from orelith.functions.paths import extension
from orelith.llm.authored import file_classes
from orelith.llm.grammar import LANGUAGE_OF
from orelith.llm.history import History
from orelith.llm.leaks import leaks
from orelith.llm.neighbours import neighbours
from orelith.llm.packing import pack, token_counts, tokenizer_path
from orelith.llm.subjects import SHARE, document_subjects, subject_counts
from orelith.llm.syntax import syntax_errors
from orelith.operators.snapshots import latest_by
from orelith.plans import relations
from orelith.session import materialise, new_path, table, widen

DIMS = 64


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "vectors").select("id", "indexed_at", F.lower(F.regexp_replace("vec_type", r"^\s+|\s+$", "")).alias("kind"), "vector")
    return latest_by(v, "id", "indexed_at", ["kind", "vector"]).select("id", "kind", "vector")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    near = neighbours(_vectors(spark, sf), DIMS, 5, 0.85)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The batches in their order against the growing history; the history starts empty in a folder of its own."""
    m = table(spark, sf, "memories").select("id", F.replace("symbol", F.lit("#"), F.lit(".")).alias("grp"), "text", F.col("batch_no").alias("batch"), text_micros("created_at").alias("at"))
    m = materialise(m, "memories")
    history = History(spark, new_path(spark, "history"))
    out = None
    for (batch,) in m.select("batch").distinct().orderBy("batch").collect():  # one row per delivered batch
        found = materialise(history.absorb(m.where(F.col("batch").eqNullSafe(F.lit(batch)))), "restated")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "id_a string, id_b string")
    return out.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"))


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_files").select("repo", "file", F.col("src_text").alias("text"))


def _declared(spark: SparkSession, sf: str) -> DataFrame:
    """(repo, file, names): the methods of the headers of the last full snapshot."""
    h = relations.headers(spark, sf)
    return h.select(F.col("project").alias("repo"), F.expr("substring(file, length(project) + 2)").alias("file"), F.col("methods.method_name").alias("names"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return file_classes(_sources(spark, sf), _declared(spark, sf)).where("file_class IS NOT NULL").select("repo", "file", "file_class")


def p5_by_repo(spark: SparkSession, sf: str) -> DataFrame:
    """Per repo and language: files of each class, hand-written ones included."""
    return file_classes(_sources(spark, sf), _declared(spark, sf)).groupBy("repo", "lang", F.coalesce("file_class", F.lit("hand-written")).alias("file_class")).agg(F.count("*").alias("n_files"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return syntax_errors(_sources(spark, sf)).select("repo", "file")


def p6_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Per repo and language: files, invalid files and their share."""
    lang = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])
    files = table(spark, sf, "source_files").select("repo", "file", lang[extension("file")].alias("lang")).where("lang IS NOT NULL").distinct()
    bad = syntax_errors(_sources(spark, sf)).select("repo", "file", F.lit(1).alias("bad"))
    out = files.join(bad, ["repo", "file"], "left").groupBy("repo", "lang").agg(F.count("*").alias("n_files"), F.count("bad").alias("n_invalid"))
    return out.withColumn("share", F.round(F.col("n_invalid") / F.col("n_files"), 6))


def p8_assign(spark: SparkSession, sf: str) -> DataFrame:
    return pack(token_counts(table(spark, sf, "documents"), tokenizer_path()), table(spark, sf, "context_windows"))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Per window: containers used, the least any packing needs, and the share of room that stays unused."""
    bins = p8_assign(spark, sf).groupBy("window_name", "capacity", "bin_id").agg(F.sum("n_tokens").alias("load"))
    out = bins.groupBy("window_name", "capacity").agg(F.count("*").alias("n_bins"), F.ceil(F.sum("load") / F.first("capacity")).alias("least_bins"), F.sum("load").alias("n_tokens"))
    return out.withColumn("unused_share", F.round(1 - F.col("n_tokens") / (F.col("n_bins") * F.col("capacity")), 6))


def p8_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Per window: documents placed, containers filled beyond their capacity, and documents split although they fit."""
    rows = materialise(p8_assign(spark, sf), "assigned")
    loads = rows.groupBy("window_name", "bin_id").agg((F.sum("n_tokens") > F.first("capacity")).cast("int").alias("over")).groupBy("window_name").agg(F.sum("over").alias("n_overfull"))
    docs = rows.groupBy("window_name", "doc_id").agg(((F.count("*") > 1) & (F.sum("n_tokens") <= F.first("capacity"))).cast("int").alias("split"))
    return docs.groupBy("window_name").agg(F.count("*").alias("n_docs"), F.sum("split").alias("n_split")).join(loads, "window_name")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(widen(table(spark, sf, "documents").select("doc_id", "text")), table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p9_leaked_items(spark: SparkSession, sf: str) -> DataFrame:
    """Per test item: in how many documents it leaked, and how many runs of words matched."""
    out = leaks(widen(table(spark, sf, "documents").select("doc_id", "text")), table(spark, sf, "eval_items"))
    return out.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.sum("n_runs").alias("n_runs"))


def _subject_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("tag"), F.coalesce(F.col("source") == "search-log", F.lit(False)).alias("whole"))
    return subject_counts(docs, table(spark, sf, "subject_labels").select("doc_id", "subject"), table(spark, sf, "subjects"), table(spark, sf, "eval_items"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return document_subjects(_subject_counts(spark, sf))


def p10_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Per source and subject: documents of that subject and sentences about it."""
    counts = _subject_counts(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return counts.groupBy("source", "subject").agg(F.count(F.when(F.col("n_about") >= SHARE * F.col("n_sentences"), 1)).alias("n_docs"), F.sum("n_about").alias("n_sentences"))


QUERIES = {f.__name__: f for f in (p3_found, p4_found, p5_found, p5_by_repo, p6_found, p6_rates, p8_assign, p8_fill, p8_whole, p9_found, p9_leaked_items, p10_found, p10_composition)}

_LEAKS = r"""
WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS ws FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM w WHERE len(ws) >= 12),
dr AS (SELECT doc_id, array_to_string(ws[i:i + 11], ' ') AS run FROM d),
v AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS ws FROM eval_items),
e AS (SELECT item_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM v WHERE len(ws) >= 12),
er AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 11], ' ') AS run FROM e),
hit AS (SELECT doc_id, item_id, count(*) AS n_runs FROM dr JOIN er USING (run) GROUP BY ALL)
"""

_RESTATED = r"""
WITH RECURSIVE n AS (
  SELECT id, coalesce('=' || replace(symbol, '#', '.'), '-') AS grp, batch_no, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{Nd}]+') AS ws,
         CAST(CASE WHEN regexp_matches(created_at, '(Z|[+-]\d\d:\d\d)$') THEN created_at ELSE created_at || 'Z' END AS TIMESTAMPTZ) AS mom
  FROM memories WHERE id IS NOT NULL),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch_no, mom) AS rn FROM n) WHERE rn = 1),
o AS MATERIALIZED (SELECT id, grp, ws, row_number() OVER (ORDER BY batch_no, mom, id) AS k FROM one),
pair AS (
  SELECT a.k AS a, b.k AS b, a.ws AS x, b.ws AS y, CAST(ceil(0.85 * greatest(len(a.ws), len(b.ws)) - 1e-9) AS INT) AS need
  FROM o a JOIN o b ON a.grp = b.grp AND b.k < a.k
  WHERE least(len(a.ws), len(b.ws)) >= 0.85 * greatest(len(a.ws), len(b.ws)) - 1e-9 
    AND len(list_intersect(a.ws, b.ws)) + least(len(a.ws) - len(list_distinct(a.ws)), len(b.ws) - len(list_distinct(b.ws))) >= 0.85 * greatest(len(a.ws), len(b.ws)) - 1e-9),
dp AS (
  SELECT a, b, x, y, need, 0 AS i, list_transform(range(len(y) + 1), lambda j: 0) AS d FROM pair
  UNION ALL
  SELECT a, b, x, y, need, i + 1, list_reduce(list_concat([[0]], list_transform(range(1, len(y) + 1), lambda m: [CASE WHEN x[i + 1] = y[m] THEN d[m] + 1 ELSE d[m + 1] END])), lambda acc, c: list_append(acc, greatest(acc[-1], c[1])))
  FROM dp WHERE i < len(x)),
near AS MATERIALIZED (SELECT a, list(b ORDER BY b) AS bs FROM dp WHERE i = len(x) AND d[len(y) + 1] >= need GROUP BY a),
c AS MATERIALIZED (SELECT o.k, coalesce(bs, []) AS bs FROM o LEFT JOIN near ON near.a = o.k),
step AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS hit
  UNION ALL
  SELECT t.k + 1, CASE WHEN f.hit IS NULL THEN list_append(t.taken, t.k + 1) ELSE t.taken END, f.hit
  FROM step t JOIN c ON c.k = t.k + 1, LATERAL (SELECT list_filter(c.bs, lambda b: list_contains(t.taken, b))[1] AS hit) f)
SELECT least(p.id, q.id) AS id_a, greatest(p.id, q.id) AS id_b FROM step s JOIN o p ON p.k = s.k JOIN o q ON q.k = s.hit"""

SQL = {
    "p4_found": _RESTATED,
    "p8_whole": "SELECT window_name, (SELECT count(DISTINCT doc_id) FROM documents) AS n_docs, CAST(0 AS BIGINT) AS n_split, CAST(0 AS BIGINT) AS n_overfull FROM (SELECT DISTINCT window_name FROM context_windows WHERE capacity > 0)",
    "p9_found": _LEAKS + "SELECT doc_id, item_id FROM hit",
    "p9_leaked_items": _LEAKS + "SELECT item_id, count(*) AS n_docs, CAST(sum(n_runs) AS BIGINT) AS n_runs FROM hit GROUP BY ALL",
    "p3_found": """
WITH v AS (SELECT id, lower(trim(vec_type)) AS kind, CAST(vector AS DOUBLE[]) AS vector FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC) AS rn FROM vectors) WHERE rn = 1),
u AS (SELECT * FROM v WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND list_sum(list_transform(vector, lambda x: x * x)) > 0),
s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.vector, b.vector) AS sim FROM u a JOIN u b ON a.kind = b.kind AND a.id <> b.id),
r AS (SELECT a, b, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rn FROM s WHERE sim >= 0.85)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE rn <= 5""",
}
