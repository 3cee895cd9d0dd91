"""Source files that nobody wrote by hand: data, minified, generated and vendored files, told by their names.

A character trigram model of identifiers is trained per language on the distinct texts that are neither data nor
template-like nor full of very short names. A name is mangled if letters drawn evenly explain it in fewer bits than the
model does, which is trained without it; a file most of whose names are mangled is minified. Names are template-like if they differ from several others in a number or one word only; a file most of whose
names are has a low diversity and is generated. The naming styles of the remaining files are counted by source; declared names
in styles that are rare there are foreign, and a file with mostly foreign ones is vendored. Comments, layout and folder
names are not evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelith.functions.paths import extension
from orelith.llm.grammar import CS_CONTEXTUAL, CS_RESERVED, CS_TYPES, JS_RESERVED, LANGUAGE_OF, TS_CONTEXTUAL
from orelith.session import materialise

LITERAL_SHARE = 0.6  # of a data file's characters outside comments
MANGLED_SHARE, EVEN_BITS = 0.8, 7.0  # of a minified file's names; bits a character of a name drawn evenly: one of 64 signs, and whether it ends
SHORT_SHARE = 0.6  # a file with so many names of one or two characters does not train the model
TEMPLATE_SHARE, MIN_NAMES = 0.5, 6  # of a generated file's names; least distinct names, also of a minified file and of one template
FOREIGN_SHARE, FOREIGN_BITS, MIN_DECLARED = 0.6, 2.5, 3  # of a vendored file's declared names

_TOKEN = re.compile(r"/\*[\s\S]*?(?:\*/|$)|//[^\n]*|`(?:[^`\\]|\\[\s\S])*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[^\W\d][\w$]*|\d[\w.]*|\S")
_COMMENT = re.compile(r"/\*[\s\S]*?(?:\*/|$)|//[^\n]*")
_WORDS = JS_RESERVED | TS_CONTEXTUAL | CS_RESERVED | CS_CONTEXTUAL | CS_TYPES
_STATEMENTS = set("function return if for while switch try var let const foreach throw".split())
_JS_DECLARED = re.compile(r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)|\bclass\s+([A-Za-z_$][\w$]*)|^[ \t]*(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*([A-Za-z_$][\w$]*)\s*\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)\s*(?::[^{;\n]+)?\{", re.M)
_CS_DECLARED = re.compile(r"\b(?:class|interface|struct|record|enum)\s+([A-Za-z_]\w*)|^[ \t]*(?:(?:public|private|protected|internal|static|async|override|virtual|sealed|partial|readonly)\s+)+[\w<>\[\],.? ]+?\s+([A-Za-z_]\w*)\s*[({\n=;]", re.M)
_NO_NAME = set("if for while switch catch function return".split())
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^A-Za-z\d]")
_FEATURES = "repo string, file string, lang string, sha string, trains boolean, names array<string>, uses array<int>, declared array<string>, literal double, statements int"


def features(text: str, lang: str) -> tuple[list[str], list[int], list[str], float, int]:
    """(distinct names, how often each is used, declared names, share of characters in literals, statement words)."""
    tokens = [t for t in _TOKEN.findall(text.lstrip("\ufeff")) if not t.startswith(("//", "/*"))]
    uses = Counter(t for t in tokens if (t[0].isalpha() or t[0] == "_") and t not in _WORDS)
    names = sorted(uses)
    literal = sum(len(t) for t in tokens if t[0] in "\"'`" or t[0].isdigit())
    found = (_CS_DECLARED if lang == "cs" else _JS_DECLARED).findall(_COMMENT.sub(" ", text))
    declared = [n for m in found for n in m if n and n not in _NO_NAME]
    return names, [uses[n] for n in names], declared, literal / max(1, sum(map(len, tokens))), sum(t in _STATEMENTS for t in tokens)


def grams(name: str) -> list[str]:
    """Character trigrams of a name; digits count as one letter, what is not ASCII as another, so that there are at most 66^3."""
    s = "^^" + re.sub(r"[^\x00-\x7f]", "?", re.sub(r"\d", "0", name)) + "$"
    return [s[i - 2 : i + 1] for i in range(2, len(s))]


def style(name: str) -> str:
    """Leading marks, case, underscores, abbreviations and numbering of a name: one of some hundred styles."""
    bare = name.lstrip("_$")
    mark = name[: len(name) - len(bare)][:1]
    if not bare:
        return mark
    case = "upper" if bare.isupper() and len(bare) > 1 else "pascal" if bare[0].isupper() else "lower" if re.search("[A-Z]", bare) or "_" in bare.strip("_") else "flat"
    tail = re.search(r"\d*$", bare).group()
    inside = bare[: len(bare) - len(tail)]
    number = "00" if len(tail) > 1 else "0" if tail else ""
    return f"{mark}{case}{'_' if '_' in bare.strip('_') else ''}{'-abbr' if case != 'upper' and re.search('[A-Z]{3}', bare) else ''}{'-inner' if re.search(r'[0-9]', inside) else ''}{number}"


def is_data(literal: float, statements: int) -> bool:
    return literal >= LITERAL_SHARE and not statements


def templates(name: str) -> set[tuple]:
    """What is left of a name of several parts when its numbers are masked, alone and with each of its words in turn."""
    parts = ["0" if p.isdigit() else p for p in _PARTS.findall(name)]
    head, tail = [0], [0]  # hashes of the parts before and behind, so that a name of any length takes linear time
    for a, b in zip(parts, reversed(parts), strict=True):
        head.append(hash((head[-1], a)))
        tail.append(hash((tail[-1], b)))
    n = len(parts)
    return ({(n, head[-1])} if "0" in parts else set()) | {(n, i, head[i], tail[n - 1 - i]) for i, p in enumerate(parts) if n > 1 and p.isalpha()}


def is_templated(names: list[str]) -> bool:
    """Whether most names follow templates, each shared by several names: few templates a name."""
    if len(names) < MIN_NAMES:
        return False
    each = [templates(n) for n in names]
    held = Counter(t for ts in each for t in ts)
    return sum(any(held[t] >= MIN_NAMES for t in ts) for ts in each) >= TEMPLATE_SHARE * len(names)


def file_classes(files: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(repo, file, lang, file_class) of files (repo, file, text) with a known extension; file_class null: hand-written.

    data: values or an encoded blob; minified: packed script with mangled names; generated: names out of a template;
    vendored: declared names in a style foreign to the collection. declared: (repo, file, names), the names that an index
    knows to be declared in a file; where it has none, they are looked for in the text. Null and empty texts are
    hand-written. A file that comes twice is judged once, by its greatest text. Each distinct text trains the trigrams
    once with its distinct names, numbers masked; where a language has only texts that should not train, they do. Files that declare the same names are one source, which counts
    once for a style however often it was copied or edited inside; a library of many different files counts with each
    of them. Data, minified and generated files do not count for styles.
    """
    spark = files.sparkSession
    known = files.where(F.col("repo").isNotNull() & F.col("file").isNotNull()).withColumn("ext", extension("file")).where(F.col("ext").isin(list(LANGUAGE_OF)))
    one = known.groupBy("repo", "file", "ext").agg(F.max("text").alias("text"))
    if declared is None:
        one = one.withColumn("told", F.lit(None).cast("array<string>"))
    else:
        told = declared.select("repo", "file", F.col("names").alias("_n")).groupBy("repo", "file").agg(F.max("_n").alias("told"))
        one = one.join(told, ["repo", "file"], "left")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for pdf in batches:
            rows = []
            for repo, file, ext, text, told in zip(pdf["repo"], pdf["file"], pdf["ext"], pdf["text"], pdf["told"], strict=True):
                names, uses, found, *rest = features(text or "", LANGUAGE_OF[ext])
                own = [n for n in told if n] if told is not None else []
                short = sum(u for n, u in zip(names, uses, strict=True) if len(n) <= 2)
                trains = not (is_data(*rest) or is_templated(names)) and short < SHORT_SHARE * max(1, sum(uses))
                sha = hashlib.sha1((text or "").encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((repo, file, LANGUAGE_OF[ext], sha, trains, names, uses, own or found, *rest))
            yield pd.DataFrame(rows, columns=["repo", "file", "lang", "sha", "trains", "names", "uses", "declared", "literal", "statements"])

    seen = materialise(one.mapInPandas(read, _FEATURES), "names")
    texts = seen.dropDuplicates(["lang", "sha"]).select("lang", "trains", "names")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in batches:
            for lang, trains, names in zip(pdf["lang"], pdf["trains"], pdf["names"], strict=True):
                for n in names:
                    total.update((lang, trains, g) for g in grams(n))
        yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["lang", "trains", "gram", "n"])

    grammed = texts.mapInPandas(count, "lang string, trains boolean, gram string, n long").groupBy("lang", "trains", "gram").agg(F.sum("n").alias("n")).toPandas()  # bounded by the alphabet
    kept = set(grammed["lang"][grammed["trains"]])
    grammed = grammed[grammed["trains"] | ~grammed["lang"].isin(kept)]
    trigrams = spark.sparkContext.broadcast(grammed)

    def name_based(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = {lang: Names(own) for lang, own in trigrams.value.groupby("lang")}
        for pdf in batches:
            out = [_class_by_names(models.get(lang), *x) for lang, *x in zip(pdf["lang"], pdf["names"], pdf["uses"], pdf["literal"], pdf["statements"], strict=True)]
            styles = [[style(n) for n in d] for d in pdf["declared"]]
            source = ["\n".join(sorted(set(d))) for d in pdf["declared"]]
            yield pd.DataFrame({"repo": pdf["repo"], "file": pdf["file"], "lang": pdf["lang"], "file_class": pd.Series(out, dtype=object, index=pdf.index), "styles": styles, "source": source})

    first = seen.mapInPandas(name_based, "repo string, file string, lang string, file_class string, styles array<string>, source string")
    first = materialise(first.withColumn("source", F.sha1("source")), "first")
    sources = first.where("file_class IS NULL AND size(styles) > 0").groupBy("lang", "source").agg(F.array_distinct(F.first("styles")).alias("styles"))
    counted = sources.select("lang", F.explode(F.array_union(F.array(F.lit("")), "styles")).alias("style")).groupBy("lang", "style").agg(F.count("*").alias("n")).toPandas()  # at most some hundred styles
    styles = spark.sparkContext.broadcast({(r.lang, r.style): int(r.n) for r in counted.itertuples()})

    def style_based(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [c if c or not is_foreign(lang, list(s), styles.value) else "vendored" for lang, c, s in zip(pdf["lang"], pdf["file_class"], pdf["styles"], strict=True)]
            yield pd.DataFrame({"repo": pdf["repo"], "file": pdf["file"], "lang": pdf["lang"], "file_class": pd.Series(out, dtype=object, index=pdf.index)})

    return first.mapInPandas(style_based, "repo string, file string, lang string, file_class string")


def _class_by_names(model: Names | None, names, uses, literal: float, statements: int) -> str | None:
    names = list(names)
    if is_data(literal, statements):
        return "data"
    if model is not None and model.is_mangled_file(names, list(uses)):
        return "minified"
    return "generated" if is_templated(names) else None


def is_foreign(lang: str, styles: list[str], counts: dict[tuple[str, str], int]) -> bool:
    """Whether most of a file's declared names have styles that few sources of the language use. The file's own source counts among them."""
    sources = counts.get((lang, ""), 0)
    rare = [s for s in styles if -math.log2((counts.get((lang, s), 0) + 0.5) / (sources + 1)) >= FOREIGN_BITS]
    return len(styles) >= MIN_DECLARED and len(rare) >= FOREIGN_SHARE * len(styles)


class Names:
    """Trigram counts of the distinct names of one language."""

    def __init__(self, counts: pd.DataFrame):
        self.gram = dict(zip(counts["gram"], counts["n"].astype(int), strict=True))
        self.context: Counter = Counter()
        for g, n in self.gram.items():
            self.context[g[:2]] += n
        self.known: dict[str, bool] = {}

    def bits(self, name: str) -> float:
        """What a name takes under the model of all other names."""
        gs = grams(name)
        own, ctx = Counter(gs), Counter(g[:2] for g in gs)
        return sum(-math.log2((max(0, self.gram.get(g, 0) - own[g]) + 0.1) / (max(0, self.context[g[:2]] - ctx[g[:2]]) + 6)) for g in gs)

    def is_mangled(self, name: str) -> bool:
        if name not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[name] = self.bits(name) > EVEN_BITS * len(name)
        return self.known[name]

    def is_mangled_file(self, names: list[str], uses: list[int]) -> bool:
        return len(names) >= MIN_NAMES and sum(u for n, u in zip(names, uses, strict=True) if self.is_mangled(n)) >= MANGLED_SHARE * sum(uses)
