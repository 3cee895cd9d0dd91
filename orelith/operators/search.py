"""Exact, pattern, lexical, vector and fused search over the symbol index.

symbols: (ordinal, id, type, file, name, class, sig, loc, insight, refs, namespace, decorators, parameters, return_type,
extends_name, implements, imports, exports); lists are array<string>. Null texts never match. Queries are literals, so
that every predicate runs inside whole-stage code generation and only the top rows leave the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orelith.functions.text import compact, list_json, search_terms, split_identifier, tokens

# ---- fixed values: weights of signals, of lexical columns
SIGNAL_WEIGHTS = {"exact": 4.5, "lexical": 2.5, "regex": 1.7, "vector": 1.4, "memory-similar": 1.6, "memory": 2.2}
COLUMN_WEIGHTS = {"file": 2.0, "name": 5.0, "class": 4.0, "sig": 2.5, "insight": 1.5, "refs": 1.0, "content": 0.8}
LISTS = ("refs", "decorators", "parameters", "implements", "imports", "exports")
RANK_BASE = 60


def _low(c: str | Column) -> Column:
    return F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def with_list_text(symbols: DataFrame) -> DataFrame:
    """Adds <list>_json, the text in which a list is searched."""
    return symbols.withColumns({f"{c}_json": list_json(c) for c in LISTS})


def _qualified(sep: str, owner: str = "class") -> Column:
    return F.concat(F.coalesce(owner, F.lit("")), F.lit(sep), F.col("name"))


def searched_fields() -> list[Column]:
    plain = ["name", "class", "sig", "file", "insight", "refs_json", "namespace", "decorators_json", "parameters_json", "return_type", "extends_name", "implements_json", "imports_json", "exports_json"]
    return [_low(c) for c in plain] + [_low(_qualified(".")), _low(_qualified("#")), _low(_qualified(".", "namespace"))]


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def exact_matches(symbols: DataFrame, query: str) -> DataFrame:
    """Every symbol that contains the query literally, in any case, in any field; adds tier. Nothing is cut or ordered."""
    q = query.lower().strip()
    rows = with_list_text(symbols).where(_any([f.contains(q) for f in searched_fields()]))
    name, cls = _low("name"), _low("class")
    tier = (
        F.when(name == q, 0).when(cls == q, 1).when((_low(_qualified(".")) == q) | (_low(_qualified("#")) == q), 2).when(_low(_qualified(".", "namespace")) == q, 3)
        .when(name.startswith(q), 4).when(cls.startswith(q), 5).when(_low("sig").contains(q), 6).when(_low("file").contains(q), 7).when(_low("insight").contains(q), 8).when(_low("refs_json").contains(q), 9).otherwise(20)
    )
    return rows.withColumn("tier", tier)


def exact_search(symbols: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The best of `exact_matches`; adds score.

    Two stages: the best max(50 limit, 200) rows by tier, shortest file and name, then the best `limit` by score; ties by file, name, id.
    """
    first = exact_matches(symbols, query).orderBy("tier", F.length("file"), "name", "id").limit(max(50 * limit, 200))
    return first.withColumn("score", exact_score(query)).orderBy(F.desc("score"), "file", "name", "id").limit(limit)


def exact_score(query: str) -> Column:
    q = query.lower()
    flat = compact(F.lit(query))
    name, cls = _low("name"), _low("class")
    dot = F.when(cls == "", name).otherwise(F.concat(cls, F.lit("."), name))
    hash_ = F.when(cls == "", name).otherwise(F.concat(cls, F.lit("#"), name))
    spaced = F.when(_low("namespace") == "", name).otherwise(F.concat(_low("namespace"), F.lit("."), name))
    fields = ["file", "name", "class", "sig", "insight", "refs_json", "namespace", "decorators_json", "parameters_json", "return_type", "extends_name", "implements_json", "imports_json", "exports_json"]
    content = search_terms(F.lower(F.array_join(F.filter(F.array(*[F.col(c) for c in fields]), lambda x: x.isNotNull() & (x != "")), " ")))
    terms = search_terms(F.lit(query))
    n, hit = F.size(terms), F.size(F.array_intersect(terms, content))
    pts = lambda cond, value: F.when(cond, value).otherwise(0.0)
    score = (
        pts(name == q, 10.0) + pts(cls == q, 9.0) + pts((dot == q) | (hash_ == q) | (spaced == q), 12.0)
        + pts((compact(name) == flat) | (compact(cls) == flat), 7.0) + pts((compact(dot) == flat) | (compact(hash_) == flat), 9.0)
        + pts(name.startswith(q) | cls.startswith(q), 5.0) + pts(_low("sig").contains(q), 3.0) + pts(_low("file").contains(q), 2.0)
        + pts(_low("insight").contains(q), 2.0) + pts(_low("refs_json").contains(q), 1.5)
        + pts(n > 0, hit / F.greatest(n, F.lit(1)) * 3.0) + pts((n > 0) & (hit == n), 2.0)
        + F.when(F.col("type") == "method", 0.3).when(F.col("type") == "class", 0.2).otherwise(0.0)
    )
    return F.round(score, 6)


def valid_pattern(spark: SparkSession, pattern: str) -> bool:
    """Whether the engine that will run the pattern, Java's, takes it."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def quoted(text: str) -> str:
    """A pattern that matches the text itself."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def regex_search(symbols: DataFrame, pattern: str, limit: int = 20) -> DataFrame:
    """Symbols of which any field matches the pattern in any case, in index order; an invalid pattern matches nothing."""
    if not valid_pattern(symbols.sparkSession, pattern):
        return symbols.limit(0)
    plain = ["name", "class", "sig", "file", "insight", "refs_json", "namespace", "decorators_json", "parameters_json", "return_type", "extends_name", "implements_json", "imports_json", "exports_json"]
    fields = [F.coalesce(c, F.lit("")) for c in plain] + [_qualified("."), _qualified("#")]
    hit = _any([f.rlike("(?i)" + pattern) for f in fields])
    return with_list_text(symbols).where(hit).orderBy("ordinal").limit(limit)


def postings(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(doc_id, col, term, tf): the inverted index. Terms are lower-case letter and digit runs.

    Counted inside each row before the shuffle-free explode, so a row yields one posting per distinct term and column.
    """
    cols = F.array(*[F.struct(F.lit(k).alias("col"), F.filter(F.split(F.lower(F.coalesce(v, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "").alias("ts")) for k, v in columns.items()])
    each = docs.select("doc_id", F.explode(cols).alias("c")).select("doc_id", "c.*")
    return each.select("doc_id", "col", F.explode("ts").alias("term")).groupBy("doc_id", "col", "term").agg(F.count("*").alias("tf"))


def stored(index: DataFrame, write: Callable[[str, DataFrame], None], read: Callable[[str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) once written: postings in ranges of terms, sorted, so that a prefix reads few row groups, and the
    length of every document beside them, so that a query need not read all postings for it. A term in very many documents takes up several ranges."""
    write("postings", index.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"))
    write("doc_lengths", read("postings").groupBy("doc_id").agg(F.sum("tf").alias("len")))
    return read("postings"), read("doc_lengths")


def bm25(index: DataFrame, query_terms: list[str], weights: dict[str, float], k1: float = 1.2, b: float = 0.75, double_all: bool = True, lengths: DataFrame | None = None) -> DataFrame:
    """(doc_id, score) of documents that hold any query term as prefix.

    f = weighted count of tokens that start with the term; idf = ln((N - n + 0.5) / (n + 0.5)), 1e-6 where not positive;
    a document with all of two or more terms scores double. N and the average length are over all documents; lengths
    (doc_id, len) are summed from the index where they are not given.
    """
    stats = index.groupBy("doc_id").agg(F.sum("tf").alias("len")) if lengths is None else lengths
    total = stats.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    hits = index.where(_any([F.col("term").startswith(t) for t in query_terms]))
    q = F.explode(F.filter(F.array(*[F.lit(t) for t in query_terms]), lambda t: F.col("term").startswith(t))).alias("q")
    f = hits.select("doc_id", "col", "tf", q).groupBy("doc_id", "q").agg(F.sum(F.col("tf") * w[F.col("col")]).alias("f"))
    df = f.groupBy("q").agg(F.count("*").alias("df"))  # one row per query term
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.when(idf > 0, idf).otherwise(1e-6) * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = f.join(F.broadcast(df), "q").join(stats, "doc_id").join(F.broadcast(total))  # one row of totals
    out = scored.groupBy("doc_id").agg(F.sum(part).alias("score"), F.count("*").alias("n"))
    twice = F.when((F.col("n") == len(query_terms)) & F.lit(double_all and len(query_terms) > 1), 2.0).otherwise(1.0)
    return out.select("doc_id", (F.col("score") * twice).alias("score"))


def symbol_postings(symbols: DataFrame) -> DataFrame:
    s = with_list_text(symbols)
    content = F.concat_ws(" ", *[split_identifier(F.coalesce(c, F.lit(""))) for c in ("file", "name", "class", "sig")])
    cols = {"file": F.col("file"), "name": F.col("name"), "class": F.col("class"), "sig": F.col("sig"), "insight": F.col("insight"), "refs": F.col("refs_json"), "content": content}
    return postings(s.withColumn("doc_id", F.col("id")), cols)


def query_terms(spark, query: str, most: int = 8) -> list[str]:
    """The distinct search terms of a query string, at most eight."""
    return [str(t) for t in spark.range(1).select(search_terms(F.lit(query)).alias("t")).first()["t"]][:most]


def knn(vectors: DataFrame, query: list[float], k: int, kind: str | None = None) -> DataFrame:
    """(id, distance): the k nearest vectors by Euclidean distance in doubles, filtered by kind first; ties by id.

    Vectors that are null or of another length take no part. The query is a literal; each task keeps only its k best rows.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.where(F.size("vector") == len(query))
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    squares = F.zip_with(F.col("vector").cast("array<double>"), q, lambda a, b: (a - b) * (a - b))
    dist = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
    return rows.select("id", F.round(dist, 6).alias("distance")).orderBy("distance", "id").limit(k)


def fuse(signals: DataFrame, query: str) -> DataFrame:
    """Hybrid fusion. signals: (signal, rank, native, key, type, file, name, class, sig, insight, refs, text), rank from 1.

    score = sum over signals of weight / (60 + rank) + native, plus the best direct boost, path proximity and type priority.
    One grouping by key; the sets of signals and the first known attributes are merged with it.
    """
    w = F.create_map(*[F.lit(x) for kv in SIGNAL_WEIGHTS.items() for x in kv])
    native = (
        F.when(F.col("native").isNull() | F.isnan("native"), 0.0).when(F.col("signal") == "vector", 1 / (1 + F.greatest(F.col("native"), F.lit(0.0))))
        .when(F.col("signal") == "lexical", F.greatest(F.col("native"), F.lit(0.0))).otherwise(F.least(F.greatest(F.col("native"), F.lit(0.0)), F.lit(1.0)))
    )
    priority = F.when(F.col("type") == "method", 0.3).when(F.col("type") == "class", 0.2).otherwise(0.0)
    base = direct_boost(query) + path_proximity(query) + priority
    order = F.struct("signal", "rank")
    rows = signals.withColumn("_part", w[F.col("signal")] / (RANK_BASE + F.col("rank")) + native).withColumn("_base", base)
    keep = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("type", "file", "name", "class", "sig", "insight", "refs", "text")]
    out = rows.groupBy("key").agg(F.sum("_part").alias("_s"), F.max("_base").alias("_b"), F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("signals"), *keep)
    return out.select("key", "type", "file", "name", "class", "sig", "insight", "refs", "text", "signals", F.round(F.col("_s") + F.col("_b"), 6).alias("score"))


def direct_boost(query: str) -> Column:
    q, flat, terms = query.lower().strip(), compact(F.lit(query)), tokens(F.lit(query))
    name, cls, file, sig, insight, text = (_low(c) for c in ("name", "class", "file", "sig", "insight", "text"))
    refs = F.lower(F.array_join(F.coalesce("refs", F.array().cast("array<string>")), " "))
    dot, hash_ = F.concat(cls, F.lit("."), name), F.concat(cls, F.lit("#"), name)
    symbol = F.array_join(F.filter(F.array(name, cls, dot, hash_), lambda x: x != ""), " ")
    every = tokens(F.concat_ws(" ", file, symbol, sig, refs, insight, text))
    own = tokens(symbol)
    pts = lambda cond, value: F.when(cond, value).otherwise(0.0)
    n, hit = F.size(terms), F.size(F.filter(terms, lambda t: F.array_contains(every, t)))
    each = F.aggregate(terms, F.lit(0.0), lambda s, t: s + F.when(F.array_contains(own, t), 1.5).otherwise(0.0) + F.when(file.contains(t) | sig.contains(t) | refs.contains(t) | insight.contains(t) | text.contains(t), 0.5).otherwise(0.0))
    return (
        pts((name == q) | (cls == q) | (dot == q) | (hash_ == q), 6.0) + pts((compact(name) == flat) | (compact(cls) == flat), 5.0) + pts((compact(dot) == flat) | (compact(hash_) == flat), 6.0)
        + pts(file.contains(q), 3.0) + pts(sig.contains(q), 2.0) + pts(insight.contains(q), 2.0) + pts(refs.contains(q), 1.5) + pts(text.contains(q), 2.0)
        + pts(n > 0, hit / F.greatest(n, F.lit(1)) * 2.5) + pts((n > 0) & (hit == n), 2.0) + each
    )


def matched_by(query: str) -> Column:
    """In which fields of (type, name, class, sig, file, refs, insight) a result meets the query: as text, without marks, or by one of its words."""
    q, flat, terms = query.lower(), compact(F.lit(query)), tokens(F.lit(query))

    def meets(c: Column) -> Column:
        low, own = F.lower(F.coalesce(c, F.lit(""))), tokens(F.coalesce(c, F.lit("")))
        return low.contains(q) | ((F.length(flat) > 1) & compact(F.coalesce(c, F.lit(""))).contains(flat)) | F.exists(terms, lambda t: F.array_contains(own, t) | low.contains(t))

    fields = [("name", meets(F.col("name"))), ("class", meets(F.col("class"))), ("signature", meets(F.col("sig"))), ("file path", meets(F.col("file"))), ("memory", F.col("type") == "memory"), ("refs", F.coalesce(F.exists("refs", meets), F.lit(False))), ("insight", meets(F.col("insight")))]
    return F.array_compact(F.array(*[F.when(hit, label) for label, hit in fields]))


def path_proximity(query: str) -> Column:
    terms, file = tokens(F.lit(query)), _low("file")
    parts = tokens(F.coalesce("file", F.lit("")))
    near = F.size(F.filter(terms, lambda t: F.array_contains(parts, t)))
    inside = F.size(F.filter(terms, lambda t: file.contains(F.concat(F.lit("/"), t, F.lit("/")))))
    return (near + inside) * 0.35


def clusters(results: DataFrame, most: int = 3) -> DataFrame:
    """Per (file, class or else name): the best result and up to three related ones. results: (file, class, name, id, score)."""
    owner = F.coalesce("class", "name")
    w = Window.partitionBy("file", "owner").orderBy(F.desc("score"), "id")
    ranked = results.withColumn("owner", owner).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most + 1)
    related = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") > 1, F.struct("rn", "id")))), lambda x: x["id"]), ",")
    return ranked.groupBy("file", "owner").agg(F.max(F.when(F.col("rn") == 1, F.col("id"))).alias("id"), F.max("score").alias("score"), related.alias("related"))


