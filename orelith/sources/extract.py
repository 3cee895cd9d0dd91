"""Code files to headers: classes, methods, imports and exports of TypeScript, JavaScript and C#.

A registry of parsers by extension; a parser takes (text, file) and gives a dict in the shape of HEADER. The built-in
parser blanks out comments and literals, then reads declarations and matches brackets. Known gaps: JSX, computed names.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelith.functions.paths import extension

CLASS = "struct<name:string,loc:string,ns:string,extends_name:string,implements:array<string>,decorators:array<string>,visibility:string>"
METHOD = "struct<name:string,class:string,loc:string,sig:string,refs:array<string>,decorators:array<string>,visibility:string,is_async:boolean,is_static:boolean>"
HEADER = f"file string, lang string, ns string, classes array<{CLASS}>, methods array<{METHOD}>, imports array<string>, exports array<string>"

_HIDE = re.compile(r"/\*[\s\S]*?(?:\*/|$)|//[^\n]*|@?\$?@?\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`|(?<=[=(,:;!&|?{}\[])[ \t]*/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_NOT_CALLS = set("if for while switch catch function return typeof super await new throw else do in of using lock foreach nameof sizeof".split())
_CALL = re.compile(r"(?<![\w$.])((?:[A-Za-z_$][\w$]*)(?:\s*\??\.\s*[A-Za-z_$][\w$]*)*)\s*(?:<[\w\s,.<>\[\]]*>)?\s*\(")
_JS_CLASS = re.compile(r"(?P<mods>(?:export\s+|default\s+|abstract\s+|declare\s+)*)class\s+(?P<name>[A-Za-z_$][\w$]*)[^{;]*?\{", re.S)
_TS_FACE = re.compile(r"(?:export\s+|declare\s+)*interface\s+(?P<name>[A-Za-z_$][\w$]*)[^{;]*?\{", re.S)
_JS_METHOD = re.compile(r"^[ \t]*(?P<mods>(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*)\*?\s*(?P<name>[A-Za-z_$#][\w$]*)\s*(?:<[^()]*?>)?\(", re.M)
_JS_FUNCTION = re.compile(r"(?P<mods>(?:export\s+|default\s+|async\s+)*)function\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^()]*?>)?\(")
_JS_ARROW = re.compile(r"(?P<mods>(?:export\s+)?(?:const|let|var)\s+)(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=;]+)?=\s*(?P<async>async\s+)?(?P<params>\([^()]*(?:\([^()]*\)[^()]*)*\)|[A-Za-z_$][\w$]*)\s*(?::[^={};]+)?=>")
_JS_ASSIGNED = re.compile(r"(?P<name>[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+)\s*=\s*(?P<mods>async\s+)?(?:function\b[^(]*\(|\([^()]*\)\s*=>)")
_CS_TYPE = re.compile(r"(?P<mods>(?:(?:public|private|protected|internal|static|abstract|sealed|partial|readonly|ref)\s+)*)(?P<kind>class|struct|record|interface)\s+(?P<name>[A-Za-z_]\w*)(?P<rest>[^{;]*?)\{", re.S)
_CS_METHOD = re.compile(r"^[ \t]*(?P<mods>(?:(?:public|private|protected|internal|static|async|override|virtual|sealed|abstract|partial|new|extern|unsafe|readonly)\s+)*)(?P<ret>[\w.<>\[\],? ]+?\s+)?(?P<name>[A-Za-z_]\w*)\s*(?:<[\w\s,]+>)?\(", re.M)

Parser = Callable[[str, str], dict]
_PARSERS: dict[str, Parser] = {}


def register(extensions: list[str], parser: Parser) -> None:
    """Makes a parser responsible for extensions; it must be importable by the executors."""
    _PARSERS.update(dict.fromkeys(map(str.lower, extensions), parser))


def _blank(text: str) -> str:
    """The text with comments and literals as blanks; length and lines stay."""
    return _HIDE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _close(text: str, at: int) -> int:
    """Position of the bracket that closes the one at `at`, the last position if none does."""
    pair, depth = {"(": ")", "{": "}", "[": "]"}[text[at]], 0
    for m in re.compile(re.escape(text[at]) + "|" + re.escape(pair)).finditer(text, at):
        depth += 1 if m.group() == text[at] else -1
        if not depth:
            return m.start()
    return len(text) - 1


def _decorators(text: str, at: int) -> list[str]:
    """Names of @decorators or [attributes] right before a position, in order."""
    before, out = text[:at].rstrip(), []
    while m := re.search(r"(?:@([A-Za-z_$][\w$.]*)(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?|\[([A-Za-z_][\w.]*)[^\[\]]*\])$", before):
        out.insert(0, m.group(1) or m.group(2))
        before = before[: m.start()].rstrip()
    return out


def _calls(body: str) -> list[str]:
    found = (re.sub(r"\s+", "", m.group(1)) for m in _CALL.finditer(body))
    return list(dict.fromkeys(c for c in found if c not in _NOT_CALLS and not c.startswith("function")))


class _Source:
    def __init__(self, text: str):
        self.text, self.plain = text, _blank(text)
        self.ends = [m.start() for m in re.finditer("\n", text)]

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.ends, at) + 1

    def loc(self, a: int, b: int) -> str:
        return f"{self.line(a)}-{self.line(b)}"

    def body(self, at: int) -> tuple[int, int] | None:
        """(start, end) of the block or expression after a parameter list that opens at `at`; None if it is a call or a mere signature."""
        end = _close(self.plain, at)
        m = re.compile(r"\s*(?::\s*[^={};()]+(?:\([^()]*\)[^={};()]*)*|where[^{;]+)?\s*(\{|=>)").match(self.plain, end + 1)
        if not m:
            return None
        if m.group(1) == "{":
            return m.end() - 1, _close(self.plain, m.end() - 1)
        semi = self.plain.find(";", m.end())
        return m.start(1), semi if semi >= 0 else len(self.plain) - 1

    def method(self, start: int, name: str, owner: str | None, body: tuple[int, int], mods: str) -> dict:
        brace, end = body
        head = self.text[start:brace]
        words = mods.split()
        seen = next((w for w in words if w in ("public", "private", "protected", "internal", "export")), None)
        return {"name": name, "class": owner, "loc": self.loc(start, end), "sig": re.sub(r"\s+", " ", head).strip(), "refs": _calls(self.plain[brace + 1 : end]), "decorators": _decorators(self.text, start), "visibility": seen, "is_async": "async" in words, "is_static": "static" in words}


def parse_script(text: str, file: str) -> dict:
    """TypeScript and JavaScript."""
    s = _Source(text)
    classes, methods, spans = [], [], []
    for m in [*_JS_CLASS.finditer(s.plain), *_TS_FACE.finditer(s.plain)]:
        brace = m.end() - 1
        end = _close(s.plain, brace)
        head = m.group()
        up = re.search(r"\bextends\s+([\w$.]+(?:<[^{]*?>)?)", head)
        faces = re.search(r"\bimplements\s+([^{]+)\{", head)
        is_class = bool(re.search(r"\bclass\s", head))
        start = m.start()
        classes.append({"name": m.group("name"), "loc": s.loc(start, end), "ns": None, "extends_name": up.group(1).strip() if up else None, "implements": [x.strip() for x in faces.group(1).split(",")] if faces else [], "decorators": _decorators(s.text, start), "visibility": "export" if "export" in head else None})
        if is_class:
            spans.append((brace, end, m.group("name")))
    for a, b, owner in spans:
        at = a + 1
        while at < b and (m := _JS_METHOD.search(s.plain, at, b)):
            at = m.end()
            if m.group("name") in _NOT_CALLS or s.plain.count("{", a + 1, m.start()) != s.plain.count("}", a + 1, m.start()):
                continue
            if (body := s.body(m.end() - 1)) is None:
                continue
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            methods.append(s.method(start, m.group("name"), owner, body, m.group("mods")))
            at = body[1]
    inside = lambda p: any(a < p < b for a, b, _ in spans)
    for pattern in (_JS_FUNCTION, _JS_ARROW, _JS_ASSIGNED):
        for m in pattern.finditer(s.plain):
            if inside(m.start()):
                continue
            if pattern is _JS_ARROW:
                tail = re.compile(r"\s*\{").match(s.plain, m.end())
                body = (m.end() - 2, _close(s.plain, tail.end() - 1) if tail else max(m.end(), s.plain.find(";", m.end())))
            else:
                opened = s.plain.find("(", m.end() - 1 if pattern is _JS_FUNCTION else m.start())
                body = s.body(opened) if opened >= 0 else None
                if body is None:
                    continue
            mods = (m.group("mods") or "") + (m.groupdict().get("async") or "")
            methods.append(s.method(m.start(), m.group("name").rsplit(".", 1)[-1], None, body, mods))
    imports = [x.group(2) for x in re.finditer(r"\bimport\b[^;'\"]*?(['\"])([^'\"\n]+)\1", text)]
    imports += [x.group(2) for x in re.finditer(r"\brequire\(\s*(['\"])([^'\"\n]+)\1\s*\)", text)]
    exports = [x.group(1) for x in re.finditer(r"\bexport\s+(?:default\s+)?(?:abstract\s+|declare\s+|async\s+)*(?:class|function\s*\*?|interface|enum|type|const|let|var|namespace)\s+([A-Za-z_$][\w$]*)", s.plain)]
    for x in re.finditer(r"\bexport\s*\{([^}]*)\}|module\.exports\s*=\s*\{([^}]*)\}", s.plain):
        exports += [re.split(r"\s+as\s+|\s*:", p.strip())[-1 if " as " in p else 0] for p in (x.group(1) or x.group(2) or "").split(",") if p.strip()]
    exports += [x.group(1) for x in re.finditer(r"module\.exports\s*=\s*([A-Za-z_$][\w$]*)\s*;?", s.plain)]
    if re.search(r"\bexport\s+default\b(?!\s+(?:abstract\s+)?(?:class|function)\s*\*?\s+[A-Za-z_$])", s.plain):
        exports.append("default")
    return {"ns": None, "classes": classes, "methods": sorted(methods, key=lambda m: int(m["loc"].split("-")[0])), "imports": list(dict.fromkeys(imports)), "exports": list(dict.fromkeys(exports))}


def parse_csharp(text: str, file: str) -> dict:
    s = _Source(text)
    spaces = [(m.end() - 1, _close(s.plain, m.end() - 1) if m.group(2) == "{" else len(s.plain), m.group(1)) for m in re.finditer(r"\bnamespace\s+([\w.]+)\s*(\{|;)", s.plain)]
    classes, methods, spans, exports = [], [], [], [x[2] for x in spaces]
    for m in _CS_TYPE.finditer(s.plain):
        end = _close(s.plain, m.end() - 1)
        bases = re.search(r":\s*(.+?)(?:\bwhere\b|$)", m.group("rest"), re.S)
        listed = [x.strip() for x in re.findall(r"[\w.:]+(?:<[^<>]*(?:<[^<>]*>[^<>]*)*>)?", bases.group(1))] if bases else []
        up = None
        if m.group("kind") in ("class", "record") and listed and not re.match(r"I[A-Z]", listed[0].rsplit(".", 1)[-1]):
            up, listed = listed[0], listed[1:]
        ns = next((n for a, b, n in reversed(spaces) if a < m.start() <= b), None)
        words = m.group("mods").split()
        seen = next((w for w in words if w in ("public", "private", "protected", "internal")), None)
        classes.append({"name": m.group("name"), "loc": s.loc(m.start(), end), "ns": ns, "extends_name": up, "implements": listed, "decorators": _decorators(s.text, m.start()), "visibility": seen})
        spans.append((m.end() - 1, end, m.group("name")))
        if seen == "public":
            exports.append(m.group("name"))
    for m in _CS_METHOD.finditer(s.plain):
        owner = next((n for a, b, n in reversed(spans) if a < m.start() < b), None)
        if owner is None or m.group("name") in _NOT_CALLS or (m.group("ret") or "").strip() in ("new", "return", "await", "else", "throw", "var"):
            continue
        if not m.group("mods").strip() and not (m.group("ret") or "").strip() and m.group("name") != owner:
            continue
        if (body := s.body(m.end() - 1)) is not None:
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            methods.append(s.method(start, m.group("name"), owner, body, m.group("mods")))
    imports = [x.group(1) for x in re.finditer(r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", s.plain, re.M)]
    return {"ns": spaces[0][2] if spaces else None, "classes": classes, "methods": methods, "imports": list(dict.fromkeys(imports)), "exports": list(dict.fromkeys(exports))}


register([".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"], parse_script)
register([".cs"], parse_csharp)


def headers(files: DataFrame) -> DataFrame:
    """files (file, text) to HEADER rows; files without a parser are left out, null texts give empty headers, ids are added later."""
    parsers = dict(_PARSERS)
    langs = {".cs": "csharp", ".ts": "typescript", ".tsx": "typescript"}
    known = files.select("file", "text", extension("file").alias("_ext")).where(F.col("_ext").isin(list(parsers)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"file": f, "lang": langs.get(e, "javascript"), **parsers[e](t or "", f)} for f, t, e in zip(pdf["file"], pdf["text"], pdf["_ext"], strict=True)]
            yield pd.DataFrame(rows, columns=["file", "lang", "ns", "classes", "methods", "imports", "exports"])

    return known.mapInPandas(run, HEADER)
