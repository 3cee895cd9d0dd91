"""Notes: lists, hints for results, lexical and vector similarity, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelith.operators.search import bm25, knn, postings


def matching(notes: DataFrame, search: str | None = None, file: str | None = None, symbol_id: str | None = None, like: bool = False) -> DataFrame:
    """Notes whose text, file or symbol holds `search`, of a file, of a symbol; newest text timestamp first, ties by id.

    search is literal and in any case; with like=True it may hold % and _.
    """
    out = notes
    if search is not None:
        def holds(c: str) -> Column:
            low = F.lower(F.coalesce(c, F.lit("")))
            return low.like(f"%{search.lower()}%") if like else low.contains(search.lower())

        out = out.where(holds("text") | holds("file") | holds("symbol"))
    if file is not None:
        out = out.where(F.col("file") == file)
    if symbol_id is not None:
        out = out.where(F.col("symbol_id") == symbol_id)
    return out.orderBy(F.desc("created_at"), "id")


def before(notes: DataFrame, moment: str) -> DataFrame:
    """Notes whose timestamp text is less than the given text: what a deletion by date takes."""
    return notes.where(F.col("created_at") < moment)


def hints(results: DataFrame, notes: DataFrame) -> DataFrame:
    """Adds hint to results (id, file): the newest note of the symbol, else the newest note of the file.

    Both sides are reduced to one note per key before they meet the results.
    """
    newest = F.max_by("text", F.struct("created_at", "id")).alias("_n")
    by_symbol = notes.where("symbol_id IS NOT NULL").groupBy(F.col("symbol_id").alias("id")).agg(newest).withColumnRenamed("_n", "_s")
    by_file = notes.where("file IS NOT NULL").groupBy("file").agg(newest).withColumnRenamed("_n", "_f")
    return results.join(by_symbol, "id", "left").join(by_file, "file", "left").withColumn("hint", F.coalesce("_s", "_f")).drop("_s", "_f")


def lexical(notes: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """(id, score): BM25 over text, file and symbol with equal weights; ties by id."""
    cols = {c: F.col(c) for c in ("text", "file", "symbol")}
    scored = bm25(postings(notes.withColumn("doc_id", F.col("id")), cols), terms, dict.fromkeys(cols, 1.0), double_all=False)
    return scored.select(F.col("doc_id").alias("id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def similar(notes: DataFrame, vectors: DataFrame, query: list[float], limit: int, most: float | None = None) -> DataFrame:
    """The notes nearest to a query vector, with their distance, at most `most` if given; vectors: (id, kind, vector), those of kind memory count."""
    near = knn(vectors, query, limit, "memory")
    near = near if most is None else near.where(F.col("distance") <= most)
    return notes.join(F.broadcast(near), "id").orderBy("distance", "id")  # at most `limit` rows


def scope(symbol_id: Column, symbol: Column, file: Column) -> Column:
    return F.when(symbol_id.isNotNull() | symbol.isNotNull(), "symbol").when(file.isNotNull(), "file").otherwise("project")


def related(nodes: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes of the symbol, or else of the file, of nodes (id, file)."""
    own = nodes.select("id", "file").join(notes.select(F.col("symbol_id").alias("id"), F.col("id").alias("note_id"), "text"), "id")
    rest = nodes.join(own.select("id").distinct(), "id", "left_anti").join(notes.where("symbol_id IS NULL").select("file", F.col("id").alias("note_id"), "text"), "file")
    return own.select("id", "note_id", "text").unionByName(rest.select("id", "note_id", "text"))
