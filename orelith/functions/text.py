"""Text rules of the index as columns; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: stop words by language, path words without meaning
STOP_WORDS = {
    "en": ["and", "or", "the", "for", "with", "from", "into", "that", "this"],
    "tr": ["bir", "bu", "su", "şu", "ile", "ve", "veya", "icin", "için"],
}
PATH_NOISE = ["src", "lib", "app", "index", "dist", "out", "obj", "bin", "wwwroot", "js", "cs", "ts"]

_NOT_WORD = r"[^\p{L}\p{N}_]+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stop_words(languages: tuple[str, ...] = ("en", "tr")) -> list[str]:
    return [w for x in languages for w in STOP_WORDS[x]]


def split_identifier(c: str | Column) -> Column:
    """Blanks between the words of camelCase, ACRONYMWords and a.b_c#d:e/f-g."""
    c = F.regexp_replace(_col(c), r"([a-z0-9])([A-Z])", "$1 $2")
    c = F.regexp_replace(c, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.regexp_replace(c, r"[._#:/\\\-]+", " ")


def tokens(c: str | Column, languages: tuple[str, ...] = ("en", "tr")) -> Column:
    """Lower-case words of the split text, longer than one letter and no stop words; repetitions stay."""
    words = F.split(F.lower(split_identifier(c)), _NOT_WORD)
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(stop_words(languages)))


def search_terms(c: str | Column, languages: tuple[str, ...] = ("en", "tr")) -> Column:
    """Distinct words of 2 to 63 letters."""
    return F.array_distinct(F.filter(tokens(c, languages), lambda w: F.length(w) < 64))


def compact(c: str | Column) -> Column:
    """Lower case without anything but letters, digits and underscores."""
    return F.regexp_replace(F.lower(_col(c)), _NOT_WORD, "")


def normalize_query(c: str | Column) -> Column:
    """Type arguments dropped, brackets and separators as blanks, blanks collapsed."""
    c = F.regexp_replace(_col(c), r"<[^>]+>", "")
    c = F.regexp_replace(c, r"[()\[\]{};,]+", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def path_keywords(file: str | Column) -> Column:
    """Distinct words of directories, then of the file's base name, without noise words, joined by blanks."""
    file = _col(file)
    bare = F.regexp_replace(file, r"\.[^./\\]+$", "")
    words = F.regexp_replace(F.regexp_replace(bare, r"([a-z])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    kept = F.filter(F.split(words, r"[\s_\-./\\]+"), lambda w: (F.length(w) > 1) & ~F.lower(w).isin(PATH_NOISE))
    return F.array_join(F.array_distinct(kept), " ")


def search_content(parts: list[Column]) -> Column:
    """Every part followed by its split form; null and empty parts are left out."""
    both = F.flatten(F.transform(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), lambda p: F.array(p, split_identifier(p))))
    return F.array_join(both, " ")


def join_present(parts: list[Column], sep: str = " ") -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), sep)


def infer_namespace(exports: str | Column) -> Column:
    """The first export that is a dotted name starting with a capital or underscore; null if none."""
    return F.get(F.filter(_col(exports), lambda e: e.contains(".") & e.rlike(r"^[A-Z_][\w.]+$")), F.lit(0))


def list_json(c: str | Column) -> Column:
    """A list of strings as JSON text, null when empty: the form in which lists are searched."""
    c = _col(c)
    return F.when(F.size(c) > 0, F.to_json(c))


def parse_list(c: str | Column) -> Column:
    """The texts of a JSON list; null for what is none."""
    return F.from_json(F.col(c) if isinstance(c, str) else c, "array<string>")


def bounded_lines(lines: Column, most: int = 80) -> Column:
    """At most `most` lines: the first three quarters of them and the last quarter, where there are more."""
    head = most * 3 // 4
    return F.when(F.size(lines) <= most, lines).otherwise(F.concat(F.slice(lines, 1, head), F.slice(lines, -(most - head), most - head)))
