"""Subject areas of documents: weighted terms, truncated singular value decomposition, centroids grown from seeds.

The decomposed matrix holds, for each pair of terms of one language, how often they stand in different sentences of one
document, as the deviation from independence over the roots of the terms' frequencies. Words of a sentence pattern occur
with any subject, deviate little and get short vectors; words of a subject area attract each other across sentences.
Sentences are sums of term vectors and are assigned to the nearest subject centroid of their language.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelith.llm.leaks import WORD, built, normalised
from orelith.session import materialise, widen

LANGUAGES = ("en", "tr", "de")
DIMS = 48  # of the truncated decomposition
EXTRA = 12  # directions carried along for accuracy
PASSES = 4  # of the subspace iteration
MIN_DOCS, MIN_SHARE = 3, 5e-5  # a term counts from so many documents on; at most (terms a document) / MIN_SHARE terms
SMOOTH = 5.0
ROUNDS = 2  # of centroid refinement
NEAR = 0.45  # least cosine of a sentence with its subject's centroid
LONG = 0.08  # least length of a sentence's vector: shorter ones hold no word of any subject
SHARE = 0.25  # of a document's sentences
HELD = 100_000  # terms whose partial sums a task holds before it passes them on
SLICE = 20_000  # terms that are summed together

_BREAK = re.compile(r"(?<=[.!?])\s+|\n+")
_CAMEL = re.compile(r"(?<=[^\W\d_A-Z])(?=[A-Z])")
_WIDE = re.compile(r"[^\x00-\x7f]+")
_TERM = re.compile(r"[^\W\d_]{3,}")


def terms(sentence: str) -> list[str]:
    """Lower-case letter runs of three or more, identifiers taken apart."""
    return [t.lower() for t in _TERM.findall(_CAMEL.sub(" ", sentence))]


def repaired(text: str) -> str:
    """Undoes UTF-8 that was read as Windows-1252, run by run; what is no such run stays."""
    def fix(m: re.Match) -> str:
        try:
            return m.group().encode("cp1252").decode("utf-8")
        except UnicodeError:
            return m.group()

    return _WIDE.sub(fix, text)


def sentences(text: str, whole: bool, machine=None, words: int = 12) -> list[str]:
    """Sentences and list lines of a text, headings aside, without those that share a run of `words` words with machine's items."""
    if whole:
        return [text] if WORD.search(text) else []
    spans = []
    if machine is not None:
        import bisect

        line, at, origin = normalised(text)
        for end, (length, _) in machine.iter(line):
            i = bisect.bisect_left(at, end - length + 1)
            spans.append((origin[i], origin[min(i + words - 1, len(origin) - 1)]))
    out, start = [], 0
    for end, following in [(m.start(), m.end()) for m in _BREAK.finditer(text)] + [(len(text), len(text))]:
        s = text[start:end]
        if WORD.search(s) and not s.lstrip().startswith("#") and not any(a < end and b >= start for a, b in spans):
            out.append(s)
        start = following
    return out


def subject_counts(documents: DataFrame, labels: DataFrame, subjects: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, lang, n_sentences, subject, n_about) for every subject that any sentence of a document is about.

    documents: (doc_id, text, tag, whole), tag a language tag or null, whole true for texts that are one sentence.
    labels: (doc_id, subject), some may be wrong. subjects: (subject, description). items: (item_id, text), passages of
    which do not count as sentences; a fixed set, held in one automaton. Null or empty texts and texts without words give
    no rows; documents of one doc_id count together. A text's language is decided by its words, tags only train that.
    A subject without labels in a language is seeded by its description's words there, or else never assigned there.
    """
    import pickle

    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(pickle.dumps([(r["item_id"], r["text"]) for r in items.select("item_id", "text").distinct().collect()]))  # fixed set of test items
    docs = widen(documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "tag", "whole"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = built(shared.value, 12)
        for pdf in batches:
            rows = []
            for doc, text, tag, whole in zip(pdf["doc_id"], pdf["text"], pdf["tag"], pdf["whole"], strict=True):
                said = [sorted(set(terms(repaired(html.unescape(s))))) for s in sentences(text, bool(whole), machine)]
                if said:
                    t = (tag or "").strip().lower()[:2]
                    rows.append((doc, t if t in LANGUAGES else None, said))
            yield pd.DataFrame(rows, columns=["doc_id", "tag", "said"])

    parsed = materialise(docs.mapInPandas(parse, "doc_id long, tag string, said array<array<string>>"), "parsed")
    n_docs = parsed.count()
    per_tag = {r["tag"]: r["n"] for r in parsed.where("tag IS NOT NULL").groupBy("tag").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not per_tag:
        return spark.createDataFrame([], "doc_id long, lang string, n_sentences int, subject string, n_about int")
    langs = [x for x in LANGUAGES if x in per_tag]
    each = parsed.select("tag", F.explode(F.array_distinct(F.flatten("said"))).alias("term"))
    counted = each.groupBy("term").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("tag") == x, 1)).alias(f"n_{x}") for x in langs])
    kept = counted.where(F.col("n") >= max(MIN_DOCS, int(MIN_SHARE * n_docs))).orderBy("term").toPandas()  # bounded, see MIN_SHARE
    n_terms = len(kept)
    if not n_terms:
        return spark.createDataFrame([], "doc_id long, lang string, n_sentences int, subject string, n_about int")
    odds = np.stack([kept[f"n_{x}"].to_numpy() / per_tag[x] for x in langs], 1)
    odds = np.log(odds / np.maximum(odds.sum(1, keepdims=True), 1e-12) + 0.01)
    vocabulary = spark.sparkContext.broadcast(({t: i for i, t in enumerate(kept["term"])}, odds))

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, odds = vocabulary.value
        for pdf in batches:
            rows = []
            for doc, said in zip(pdf["doc_id"], pdf["said"], strict=True):
                ids = [[index[t] for t in s if t in index] for s in said]
                flat = [i for s in ids for i in s]
                lang = int(odds[flat].sum(0).argmax()) if flat else 0
                rows.append((doc, lang, [[lang * n_terms + i for i in s] for s in ids]))
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "said"])

    coded = materialise(parsed.mapInPandas(code, "doc_id long, lang int, said array<array<int>>"), "coded")
    size = n_terms * len(langs)
    mass = _product(coded, size, np.ones((size, 1), np.float32))[:, 0]
    vectors = _decompose(coded, size, n_terms, mass)
    centres, own, of = _seeds(coded, labels, subjects, vectors, kept["term"].tolist(), len(langs), n_terms)
    if not len(own):
        return spark.createDataFrame([], "doc_id long, lang string, n_sentences int, subject string, n_about int")
    for _ in range(ROUNDS):
        centres = _refine(coded, vectors, centres, of)
    model = spark.sparkContext.broadcast((vectors, centres, own, of))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors, centres, own, of = model.value
        for pdf in batches:
            rows = []
            sent, doc, lang, _ = embed(pdf, vectors)
            best = nearest(sent, lang, centres, of)
            size = np.bincount(doc, minlength=len(pdf))
            about = Counter((int(d), own[b]) for d, b in zip(doc, best, strict=True) if b >= 0)
            rows = [(pdf["doc_id"].iat[d], langs[int(pdf["lang"].iat[d])], int(size[d]), s, n) for (d, s), n in about.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "n_sentences", "subject", "n_about"])

    return coded.mapInPandas(assign, "doc_id long, lang string, n_sentences int, subject string, n_about int")


def document_subjects(counts: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, subject): subjects of at least `share` of a document's sentences."""
    return counts.where(F.col("n_about") >= share * F.col("n_sentences")).select("doc_id", "subject").distinct()


def _flat(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term, sentence and document number of every term occurrence; sentences are numbered through the batch, empty ones included."""
    lengths = [[len(s) for s in said] for said in pdf["said"]]
    per_doc = np.array([len(x) for x in lengths], np.int64)
    per_sent = np.array([n for x in lengths for n in x], np.int64)
    term = np.concatenate([np.asarray(s, np.int64) for said in pdf["said"] for s in said]) if per_sent.sum() else np.array([], np.int64)
    doc = np.repeat(np.arange(len(pdf)), per_doc)
    return term, np.repeat(np.arange(len(per_sent)), per_sent), doc


def _sums(rows: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by group number."""
    out = np.zeros((n, rows.shape[1]), np.float64)
    if len(group):
        order = np.argsort(group, kind="stable")
        g = group[order]
        at = np.flatnonzero(np.diff(g, prepend=-1))
        out[g[at]] = np.add.reduceat(rows[order], at, axis=0)
    return out


def embed(pdf: pd.DataFrame, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sentence vectors, their document, their language, their term counts)."""
    term, sent, doc = _flat(pdf)
    lang = pdf["lang"].to_numpy()[doc] if len(doc) else np.array([], int)
    return _sums(vectors[term], sent, len(doc)), doc, lang, np.bincount(sent, minlength=len(doc))


def nearest(sent: np.ndarray, lang: np.ndarray, centres: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of the sentence's language, -1 where none is near enough."""
    length = np.linalg.norm(sent, axis=1)
    cos = (sent / np.maximum(length, 1e-12)[:, None]) @ centres.T
    cos[lang[:, None] != of[None, :]] = -1
    best = cos.argmax(1) if len(cos) else np.array([], int)
    ok = (length > LONG) & (cos[np.arange(len(cos)), best] > NEAR)
    return np.where(ok, best, -1)


def _product(coded: DataFrame, size: int, right: np.ndarray) -> np.ndarray:
    """X @ right, X being the sum over documents of (occurrences in different sentences) / (sentences - 1)."""
    spark = coded.sparkSession
    given = spark.sparkContext.broadcast(right.astype(np.float32))
    width = right.shape[1]
    slices = -(-size // SLICE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = given.value
        place = np.full(size, -1, np.int32)  # of each term among those held
        held, total, n = np.zeros(0, np.int64), np.zeros((0, width)), 0

        def passed() -> pd.DataFrame:
            own, sums = held[:n], total[:n]
            rows = [(s, own[at].astype("<i8").tobytes(), sums[at].astype("<f8").tobytes()) for s in np.unique(own // SLICE).tolist() for at in [np.flatnonzero(own // SLICE == s)]]
            return pd.DataFrame(rows, columns=["slice", "terms", "sums"])

        for pdf in batches:
            for lo in range(0, len(pdf), 2000):
                part = pdf.iloc[lo : lo + 2000]
                term, sent, doc = _flat(part)
                if not len(term):
                    continue
                own = _sums(q[term], sent, len(doc))
                all_of = _sums(own, doc, len(part))
                count = np.bincount(doc, minlength=len(part))
                weight = np.where(count > 1, 1 / np.maximum(count - 1, 1), 0.0)[doc]
                other = (all_of[doc] - own) * weight[:, None]
                order = np.argsort(term, kind="stable")
                t = term[order]
                at = np.flatnonzero(np.diff(t, prepend=-1))
                fresh = t[at][place[t[at]] < 0]
                if n + len(fresh) > len(held):
                    more = max(len(held), len(fresh), 1024)
                    held, total = np.concatenate([held, np.zeros(more, np.int64)]), np.concatenate([total, np.zeros((more, width))])
                place[fresh] = np.arange(n, n + len(fresh))
                held[n : n + len(fresh)] = fresh
                n += len(fresh)
                total[place[t[at]]] += np.add.reduceat(other[sent[order]], at, axis=0)
                if n > HELD:
                    yield passed()
                    place[held[:n]] = -1
                    total[:n] = 0
                    n = 0
        yield passed()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for s, terms_, part in zip(pdf["slice"], pdf["terms"], pdf["sums"], strict=True):
                total = sums.setdefault(s, np.zeros((min(SLICE, size - s * SLICE), width)))
                total[np.frombuffer(terms_, "<i8") - s * SLICE] += np.frombuffer(part, "<f8").reshape(-1, width)
        yield pd.DataFrame({"slice": list(sums), "sums": [x.astype("<f8").tobytes() for x in sums.values()]}).astype({"slice": "int32"})

    parts = coded.mapInPandas(run, "slice int, terms binary, sums binary").repartitionById(slices, F.col("slice")).mapInPandas(add, "slice int, sums binary").collect()  # one matrix, bounded by the vocabulary
    out = np.zeros((size, width))
    for r in parts:
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["sums"], "<f8").reshape(-1, width)
    return out


def _decompose(coded: DataFrame, size: int, n_terms: int, mass: np.ndarray) -> np.ndarray:
    """Leading directions of the matrix of deviations, each term's row scaled by the root of the direction's strength."""
    scale = 1 / np.sqrt(mass + SMOOTH)
    blocks = [slice(i, i + n_terms) for i in range(0, size, n_terms)]

    def deviation(q: np.ndarray) -> np.ndarray:
        scaled = q * scale[:, None]
        out = _product(coded, size, scaled)
        for b in blocks:  # what independence within a language would give
            if mass[b].sum() > 0:
                out[b] -= np.outer(mass[b], mass[b] @ scaled[b]) / mass[b].sum()
        return out * scale[:, None]

    k = min(DIMS + EXTRA, size)
    q = np.linalg.qr(np.random.default_rng(11).standard_normal((size, k)))[0]
    for _ in range(PASSES):
        q = np.linalg.qr(deviation(q))[0]
    small = q.T @ deviation(q)
    value, turn = np.linalg.eigh((small + small.T) / 2)
    keep = np.argsort(-value)[:DIMS]
    return ((q @ turn[:, keep]) * np.sqrt(np.maximum(value[keep], 0))).astype(np.float32)


def _grouped(rows: DataFrame, per_batch: Callable, n: int, dims: int) -> np.ndarray:
    """Sums of the n x dims matrices that per_batch makes of each batch; the tasks' sums meet row by row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, dims))
        for pdf in batches:
            total += per_batch(pdf)
        some = np.flatnonzero(total.any(1))
        yield pd.DataFrame({"row": some.astype("int32"), "sums": list(total[some])})

    out = np.zeros((n, dims))
    each = rows.mapInPandas(run, "row int, sums array<double>").groupBy("row").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"d{i}") for i in range(dims)])
    for r in each.collect():  # one row a centroid
        out[r["row"]] = r[1:]
    return out


def _seeds(coded, labels, subjects, vectors, words, n_langs, n_terms):
    """Centroids from labelled documents: (centres, subject of each, language of each)."""
    spark = coded.sparkSession
    described = {r["subject"]: r["description"] or "" for r in subjects.select("subject", "description").collect()}  # fixed set of subjects
    names = sorted(described)
    place = {s: i for i, s in enumerate(names)}
    said = labels.where(F.col("subject").isin(names)).groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    known = coded.join(said, "doc_id")
    shared = spark.sparkContext.broadcast(vectors)
    dims = vectors.shape[1]

    def sums(pdf: pd.DataFrame) -> np.ndarray:
        sent, doc, lang, _ = embed(pdf, shared.value)
        out = np.zeros((n_langs * len(names), dims))
        for d, subs in enumerate(pdf["subjects"]):
            total = sent[doc == d].sum(0)
            for s in subs:
                out[int(pdf["lang"].iat[d]) * len(names) + place[s]] += total / len(subs)
        return out

    total = _grouped(known, sums, n_langs * len(names), dims)
    index = {t: i for i, t in enumerate(words)}
    for lang in range(n_langs):
        for s in names:
            row = lang * len(names) + place[s]
            if not total[row].any():
                ids = [lang * n_terms + index[t] for t in terms(described[s]) if t in index]
                total[row] = vectors[ids].sum(0) if ids else 0
    length = np.linalg.norm(total, axis=1)
    keep = np.flatnonzero(length > 1e-9)
    return total[keep] / length[keep, None], [names[i % len(names)] for i in keep], keep // len(names)


def _refine(coded, vectors, centres, of):
    """Centroids as the directions of the sentences that are now nearest to them."""
    shared = coded.sparkSession.sparkContext.broadcast((vectors, centres, of))
    n, dims = centres.shape

    def sums(pdf: pd.DataFrame) -> np.ndarray:
        vectors, centres, of = shared.value
        sent, _, lang, _ = embed(pdf, vectors)
        best = nearest(sent, lang, centres, of)
        ok = best >= 0
        unit = sent[ok] / np.linalg.norm(sent[ok], axis=1, keepdims=True)
        return _sums(unit, best[ok], n)

    total = _grouped(coded, sums, n, dims)
    length = np.linalg.norm(total, axis=1, keepdims=True)
    return np.where(length > 1e-9, total / np.maximum(length, 1e-9), centres)
