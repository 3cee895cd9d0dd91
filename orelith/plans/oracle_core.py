"""SQL of the core queries."""

from orelith.functions.rules import DEPENDENCY_WORDS, IMPORT_SUFFIXES, MODIFIERS, PREPARE_DEPENDENCY_WORDS, PREPARE_TRACE_WORDS, ROUTE_SEGMENTS, TRACE_WORDS, WARNING_WORDS
from orelith.functions.text import PATH_NOISE, stop_words
from orelith.operators.audit import EXTENSIONS
from orelith.operators.search import COLUMN_WEIGHTS, SIGNAL_WEIGHTS
from orelith.operators.state_refs import PATTERN as STATE
from orelith.plans.core import NOTE, PATTERN, QUERY, WORD, WORDS

# ---- expressions


def _in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _split(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[._#:/\\\-]+', ' ', 'g')"


def _tokens(x: str) -> str:
    return rf"list_filter(string_split_regex(lower({_split(x)}), '[^\p{{L}}\p{{N}}_]+'), lambda w: len(w) > 1 AND w NOT IN {_in(stop_words())})"


def _terms(x: str) -> str:
    return f"list_distinct(list_filter({_tokens(x)}, lambda w: len(w) < 64))"


def _compact(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_]+', '', 'g')"


def _words(words: list[str]) -> str:
    return r"(?i)\b(" + "|".join(words) + r")\b"


def _present(*xs: str, sep: str = " ") -> str:
    return f"array_to_string(list_filter([{', '.join(xs)}], lambda p: p IS NOT NULL AND p <> ''), '{sep}')"


def _a(x: str = "loc") -> str:
    return rf"TRY_CAST(regexp_extract({x}, '^(\d+)-(\d+)$', 1) AS INT)"


def _b(x: str = "loc") -> str:
    return rf"TRY_CAST(regexp_extract({x}, '^(\d+)-(\d+)$', 2) AS INT)"


def _keywords(file: str) -> str:
    bare = rf"regexp_replace(regexp_replace(regexp_replace({file}, '\.[^./\\]+$', ''), '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')"
    kept = rf"list_filter(string_split_regex({bare}, '[\s_\-./\\]+'), lambda w: len(w) > 1 AND lower(w) NOT IN {_in(PATH_NOISE)})"
    return f"array_to_string(list_filter({kept}, lambda w, i: list_position({kept}, w) = i), ' ')"


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(file, '^\s+|\s+$', '', 'g'), '[\\/]+', '/', 'g'), '^(\./)+', '')"
_EXT = r"lower(regexp_extract(file, '(\.[^./\\]+)$', 1))"
_SUM = "substr(sha256({}), 1, 8)"
_BASE = rf"""
WITH RECURSIVE hh AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY header_id ORDER BY delivered_at DESC) AS rn FROM headers) WHERE rn = 1),
gens AS (SELECT generation_id, row_number() OVER (ORDER BY started_at DESC, generation_id DESC) AS back FROM (SELECT DISTINCT generation_id, started_at FROM manifests WHERE status = 'completed')),
hd AS (SELECT repo AS project, repo || '/' || {_CLEAN} AS file, lang, checksum, ns AS namespace, classes, methods, imports, exports, generation_id FROM hh WHERE generation_id = (SELECT generation_id FROM gens WHERE back = 1)),
ms AS (SELECT project, file, lang, namespace, imports, exports, unnest(methods) AS m FROM hd),
cs AS (SELECT project, file, lang, namespace, imports, exports, unnest(classes) AS c FROM hd),
al AS (
  SELECT project, file, lang, namespace, imports, exports, m.id AS id, 'method' AS type, m.method_name AS name, m.class_name AS class, m.sig AS sig, m.loc AS loc, m.insight AS insight, m.refs AS refs, m.return_type AS return_type, NULL::VARCHAR AS extends_name, NULL::VARCHAR[] AS implements, NULL::VARCHAR[] AS decorators FROM ms
  UNION ALL SELECT project, file, lang, namespace, imports, exports, c.id, 'class', c.class_name, c.class_name, NULL::VARCHAR, c.loc, NULL::VARCHAR, NULL::VARCHAR[], NULL::VARCHAR, c.extends_name, c.implements, c.decorators FROM cs),
sym AS (
  SELECT * EXCLUDE (rn), file || '|' || id AS ordinal, CASE WHEN len(refs) > 0 THEN to_json(refs)::VARCHAR END AS refs_json, CASE WHEN len(decorators) > 0 THEN to_json(decorators)::VARCHAR END AS decorators_json,
         CASE WHEN len(implements) > 0 THEN to_json(implements)::VARCHAR END AS implements_json, CASE WHEN len(imports) > 0 THEN to_json(imports)::VARCHAR END AS imports_json, CASE WHEN len(exports) > 0 THEN to_json(exports)::VARCHAR END AS exports_json
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file, type, loc, name) AS rn FROM al) WHERE rn = 1),
nt AS (
  SELECT id, project, text, file, symbol, symbol_id, scope, created_at FROM (
    SELECT id, repo AS project, text, repo || '/' || {_CLEAN} AS file, symbol, nullif(lower(trim(symbol_id)), '') AS symbol_id, scope, created_at, row_number() OVER (PARTITION BY id ORDER BY batch_no, created_at) AS rn FROM memories) WHERE rn = 1),
vc AS (SELECT id, lower(trim(vec_type)) AS kind, vector FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC) AS rn FROM vectors) WHERE rn = 1),
fl AS (SELECT repo AS project, repo || '/' || file AS file, max(src_text) AS text FROM source_files GROUP BY ALL)
"""

_FIELDS = ["file", "name", "class", "sig", "insight", "refs_json", "namespace", "decorators_json", "return_type", "extends_name", "implements_json", "imports_json", "exports_json"]


def _low(c: str) -> str:
    return f"lower(coalesce({c}, ''))"


def _holds(q: str) -> str:
    return "(" + " OR ".join(f"contains(lower({f}), '{q}')" for f in [f"coalesce({c}, '')" for c in _FIELDS] + ["coalesce(class, '') || '.' || name", "coalesce(class, '') || '#' || name"]) + ")"


def _exact(q: str, limit: int, name: str = "ex") -> str:
    """CTEs that end in `name` (id, tier, score and all columns of sym)."""
    ql = q.lower()
    flds = [_low(c) for c in _FIELDS] + [f"lower(coalesce(class, '') || '.' || name)", f"lower(coalesce(class, '') || '#' || name)", f"lower(coalesce(namespace, '') || '.' || name)"]  # noqa: F541
    where = " OR ".join(f"contains({f}, '{ql}')" for f in flds)
    n, c = _low("name"), _low("class")
    dot = f"(CASE WHEN {c} = '' THEN {n} ELSE {c} || '.' || {n} END)"
    hsh = f"(CASE WHEN {c} = '' THEN {n} ELSE {c} || '#' || {n} END)"
    nsn = f"(CASE WHEN {_low('namespace')} = '' THEN {n} ELSE {_low('namespace')} || '.' || {n} END)"
    content = _terms("lower(" + _present(*_FIELDS) + ")")
    qt = _terms(f"'{q}'")
    flat = _compact(f"'{q}'")
    return f""", {name}_t AS (
  SELECT *, CASE WHEN {n} = '{ql}' THEN 0 WHEN {c} = '{ql}' THEN 1 WHEN {c} || '.' || {n} = '{ql}' OR {c} || '#' || {n} = '{ql}' THEN 2 WHEN {_low('namespace')} || '.' || {n} = '{ql}' THEN 3
    WHEN starts_with({n}, '{ql}') THEN 4 WHEN starts_with({c}, '{ql}') THEN 5 WHEN contains({_low('sig')}, '{ql}') THEN 6 WHEN contains({_low('file')}, '{ql}') THEN 7 WHEN contains({_low('insight')}, '{ql}') THEN 8 WHEN contains({_low('refs_json')}, '{ql}') THEN 9 ELSE 20 END AS tier
  FROM sym WHERE {where} ORDER BY tier, length(file), name, id LIMIT {max(50 * limit, 200)}),
{name} AS (
  SELECT *, round(
    CASE WHEN {n} = '{ql}' THEN 10.0 ELSE 0 END::DOUBLE + CASE WHEN {c} = '{ql}' THEN 9 ELSE 0 END + CASE WHEN {dot} = '{ql}' OR {hsh} = '{ql}' OR {nsn} = '{ql}' THEN 12 ELSE 0 END
    + CASE WHEN {_compact(n)} = {flat} OR {_compact(c)} = {flat} THEN 7 ELSE 0 END + CASE WHEN {_compact(dot)} = {flat} OR {_compact(hsh)} = {flat} THEN 9 ELSE 0 END
    + CASE WHEN starts_with({n}, '{ql}') OR starts_with({c}, '{ql}') THEN 5 ELSE 0 END + CASE WHEN contains({_low('sig')}, '{ql}') THEN 3 ELSE 0 END + CASE WHEN contains({_low('file')}, '{ql}') THEN 2 ELSE 0 END
    + CASE WHEN contains({_low('insight')}, '{ql}') THEN 2 ELSE 0 END + CASE WHEN contains({_low('refs_json')}, '{ql}') THEN 1.5::DOUBLE ELSE 0 END
    + len(list_intersect({qt}, {content})) / greatest(len({qt}), 1)::DOUBLE * 3 + CASE WHEN len({qt}) > 0 AND len(list_intersect({qt}, {content})) = len({qt}) THEN 2 ELSE 0 END
    + CASE type WHEN 'method' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END, 6) AS score
  FROM {name}_t ORDER BY score DESC, file, name, id LIMIT {limit})"""


def _postings(src: str, cols: dict[str, str], name: str = "po") -> str:
    one = " UNION ALL ".join(rf"SELECT doc_id, '{k}' AS field, unnest(list_filter(string_split_regex(lower(coalesce({v}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')) AS term FROM {src}" for k, v in cols.items())
    return f", {name} AS (SELECT doc_id, field, term, count(*) AS tf FROM ({one}) GROUP BY ALL)"


_SYMBOL_COLS = {"file": "file", "name": "name", "class": "class", "sig": "sig", "insight": "insight", "refs": "refs_json", "content": " || ' ' || ".join(_split(f"coalesce({c}, '')") for c in ("file", "name", "class", "sig"))}
_SYMBOL_PO = ", sd AS (SELECT *, id AS doc_id FROM sym)" + _postings("sd", _SYMBOL_COLS)


def _bm25(terms: list[str], weights: dict[str, float], double: bool = True, name: str = "bm", po: str = "po") -> str:
    w = "CASE field " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in weights.items()) + " END"
    q = " UNION ALL ".join(f"SELECT '{t}' AS q" for t in terms)
    twice = f"CASE WHEN count(*) = {len(terms)} THEN 2 ELSE 1 END" if double and len(terms) > 1 else "1"
    return f""", {name}_l AS (SELECT doc_id, sum(tf) AS len FROM {po} GROUP BY ALL), {name}_n AS (SELECT count(*) AS n, avg(len) AS avg_len FROM {name}_l),
{name}_f AS (SELECT doc_id, q, sum(tf * {w}) AS f FROM {po} JOIN ({q}) ON starts_with(term, q) GROUP BY ALL), {name}_d AS (SELECT q, count(*) AS df FROM {name}_f GROUP BY ALL),
{name} AS (SELECT doc_id, round(sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))) * {twice}, 6) AS score
  FROM {name}_f JOIN {name}_d USING (q) JOIN {name}_l USING (doc_id) CROSS JOIN {name}_n GROUP BY doc_id)"""


def _knn(kind: str | None, rel: str = "vc", name: str = "kn", first: str = "WHERE kind = 'method'") -> str:
    ok = "len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0"
    return f""", {name}_q AS (SELECT CAST(vector AS DOUBLE[]) AS qv FROM (SELECT * FROM {rel} {first}) WHERE {ok} ORDER BY id LIMIT 1),
{name} AS (SELECT id, round(list_distance(CAST(vector AS DOUBLE[]), qv), 6) AS distance FROM {rel} CROSS JOIN {name}_q WHERE {ok} {f"AND kind = '{kind}'" if kind else ''} ORDER BY distance, id LIMIT 20)"""


def _gen(back: int, name: str) -> str:
    return f", {name} AS (SELECT repo || '/' || {_CLEAN} AS file, lower(trim(checksum)) AS checksum, methods FROM hh WHERE generation_id = (SELECT generation_id FROM gens WHERE back = {back}))"


_STATES = _gen(1, "g1") + _gen(2, "g2") + """, states AS (
  SELECT coalesce(a.file, b.file) AS file, CASE WHEN a.file IS NULL THEN 'vanished' WHEN b.file IS NULL THEN 'added' WHEN coalesce(a.checksum <> b.checksum, true) THEN 'changed' WHEN a.methods IS NULL THEN 'missing-header' ELSE 'unchanged' END AS state
  FROM g1 a FULL JOIN g2 b ON a.file = b.file)"""


def _gm(g: str, name: str) -> str:
    return f""", {name} AS (SELECT id, (x).file AS file, (x).loc AS loc, (x).body AS body FROM (SELECT m.id AS id, min({{'file': file, 'loc': m.loc, 'body': array_to_string(list_filter([m.sig, m.insight, array_to_string(m.refs, ',')], lambda z: z IS NOT NULL), '|')}}) AS x FROM (SELECT file, unnest(methods) AS m FROM {g}) GROUP BY ALL))"""


_KEYS = r"""list_distinct(list_concat([r], CASE WHEN len(string_split(r, '.')) > 1 THEN [string_split(r, '.')[-1], array_to_string(string_split(r, '.')[-2:], '.')] ELSE [] END,
  CASE WHEN starts_with(r, 'this.') THEN [substr(r, 6)] WHEN starts_with(r, 'super.') THEN [substr(r, 7)] ELSE [] END, CASE WHEN len(string_split(r, '#')) > 1 THEN [string_split(r, '#')[-1], array_to_string(string_split(r, '#')[-2:], '#')] ELSE [] END))"""
_REFS = f""", rr AS (SELECT DISTINCT id AS src_id, file AS src_file, project, unnest(refs) AS ref FROM sym WHERE type = 'method'),
rk AS (SELECT src_id, src_file, project, ref, r, unnest({_KEYS}) AS key FROM (SELECT *, replace(trim(ref), '?.', '.') AS r FROM rr))"""
_RELATIVE = rf""", im AS (SELECT DISTINCT file, unnest(imports) AS import_text FROM hd), sp AS (SELECT *, CASE WHEN regexp_extract(import_text, '(?:from\s+|require\()[''"]([^''"]+)[''"]', 1) <> '' THEN regexp_extract(import_text, '(?:from\s+|require\()[''"]([^''"]+)[''"]', 1) ELSE import_text END AS spec FROM im),
wi AS (SELECT file, import_text, string_split(regexp_replace(file, '[^/]*$', '') || spec, '/') AS ps, 0 AS i, []::VARCHAR[] AS acc FROM sp WHERE starts_with(spec, '.')
  UNION ALL SELECT file, import_text, ps, i + 1, CASE WHEN ps[i + 1] IN ('', '.') THEN acc WHEN ps[i + 1] = '..' THEN acc[:greatest(len(acc) - 1, 0)] ELSE list_append(acc, ps[i + 1]) END FROM wi WHERE i < len(ps)),
cd AS (SELECT file, import_text, unnest(list_transform({'[' + ', '.join(repr(x) for x in IMPORT_SUFFIXES) + ']'}, lambda s: array_to_string(acc, '/') || s)) AS target FROM wi WHERE i = len(ps)),
ri AS (SELECT file, import_text, min(target) AS target FROM cd WHERE target IN (SELECT file FROM hd) GROUP BY ALL)"""
_NAMED = r""", inm AS (SELECT DISTINCT project, file, unnest(list_concat(
    flatten(list_transform(string_split(regexp_extract(i, '\{([^}]*)\}', 1), ','), lambda x: string_split_regex(trim(x), '(?i)\s+as\s+'))),
    [regexp_extract(i, 'import\s+([A-Za-z_$][\w$]*)\s+from', 1)], CASE WHEN regexp_matches(i, '^[A-Za-z_][\w.]+$') THEN [i, string_split(i, '.')[-1]] ELSE [] END)) AS name FROM (SELECT project, file, unnest(imports) AS i FROM hd)),
xp AS (SELECT DISTINCT project, file AS target, unnest(exports) AS name FROM hd)"""
_IMPORTED = _RELATIVE + _NAMED + """, pf AS (SELECT file, target FROM ri UNION SELECT n.file, min(x.target) FROM inm n JOIN xp x ON x.project = n.project AND x.name = n.name AND x.target <> n.file WHERE n.name <> '' GROUP BY n.project, n.file, n.name)"""
_EDGES = _IMPORTED + r""", ek AS (SELECT src_id, src_file, project, ref, regexp_extract(r, '([^.#]*)$', 1) AS key, nullif(regexp_extract(r, '([^.#]*)[.#][^.#]*$', 1), '') AS owner FROM (SELECT *, replace(trim(ref), '?.', '.') AS r FROM rr)),
dc AS (SELECT id AS dst_id, file AS dst_file, project, name AS key, class AS dst_class, loc AS dst_loc FROM sym WHERE type = 'method'),
ea AS (SELECT project, key, arg_min(dst_id, (dst_file, dst_loc, dst_id)) AS d FROM dc GROUP BY ALL), eh AS (SELECT dst_file, key, arg_min(dst_id, (dst_loc, dst_id)) AS d FROM dc GROUP BY ALL),
eo AS (SELECT project, dst_class AS owner, key, arg_min(dst_id, (dst_file, dst_loc, dst_id)) AS d FROM dc WHERE dst_class IS NOT NULL GROUP BY ALL),
ei AS (SELECT pf.file AS src_file, key, arg_min(dst_id, (dst_file, dst_loc, dst_id)) AS d FROM pf JOIN dc ON dc.dst_file = pf.target GROUP BY ALL),
ed AS (SELECT src_id, ek.src_file, ref, coalesce(eo.d, eh.d, ei.d, ea.d) AS dst_id, CASE WHEN eo.d IS NOT NULL OR eh.d IS NOT NULL OR ei.d IS NOT NULL THEN 'high' WHEN ea.d IS NOT NULL THEN 'medium' ELSE 'missing-index' END AS confidence
  FROM ek LEFT JOIN ea ON ea.project = ek.project AND ea.key = ek.key LEFT JOIN eh ON eh.dst_file = ek.src_file AND eh.key = ek.key LEFT JOIN ei ON ei.src_file = ek.src_file AND ei.key = ek.key LEFT JOIN eo ON eo.project = ek.project AND eo.owner = ek.owner AND eo.key = ek.key)"""
_PATHS = r""", fk AS (SELECT DISTINCT file, unnest(list_distinct([lower(file), regexp_replace(lower(file), '\.[^/.]+$', '')])) AS f FROM hd)"""
_STATE_REFS = rf""", sl AS (SELECT file, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS l, generate_subscripts(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), 1) AS line FROM fl),
sh AS (SELECT file, line, trim(l) AS context, unnest(regexp_extract_all(l, '{STATE}')) AS m FROM sl),
sp AS (SELECT file, line, context, replace(regexp_extract(m, '^[\w.?]+'), '?.', '.') AS path, trim(substr(m, length(regexp_extract(m, '^[\w.?]+')) + 1)) AS tail FROM sh),
sr AS (SELECT DISTINCT file, line, path, CASE WHEN tail = '' THEN 'read' ELSE 'write' END AS ref_kind, context FROM sp WHERE NOT starts_with(tail, '('))"""
_N_FILES = "substr(sha256({0}), 1, 8)"


def _intent(x: str) -> str:
    t = f"trim({x})"
    return rf"""CASE WHEN {t} = '' THEN 'mixed' WHEN regexp_matches({t}, '{_words(TRACE_WORDS)}') THEN 'trace' WHEN regexp_matches({t}, '{_words(DEPENDENCY_WORDS)}') THEN 'dependency'
  WHEN regexp_matches({t}, '^[A-Za-z_][\w.<>#-]*$') AND regexp_matches({t}, '[A-Z_#.]') THEN 'exact-symbol' WHEN regexp_matches({t}, '\s') AND regexp_matches({t}, '^[\p{{L}}\p{{N}}\s._/#-]+$') THEN 'semantic' ELSE 'mixed' END AS intent,
  CASE WHEN regexp_matches({x}, '{_words(PREPARE_TRACE_WORDS)}') THEN 'trace' WHEN regexp_matches({x}, '{_words(PREPARE_DEPENDENCY_WORDS)}') THEN 'dependency' WHEN regexp_matches({t}, '^[A-Za-z_][\w.<>#-]*$') AND regexp_matches({x}, '[A-Z_#.]') THEN 'symbol' WHEN regexp_matches({x}, '\s') THEN 'semantic' ELSE 'mixed' END AS prepare_intent"""


def _method_hash(extra: str = "") -> str:
    return f"'method:' || substr(sha1(file || '␟' || coalesce(class, '') || '␟' || name || '␟' || coalesce(sig, ''){extra}), 1, 16)"


_PARTS = r"list_filter(list_transform(string_split_regex(regexp_replace({}, '([A-Z])', ' \1', 'g'), '[^A-Za-z0-9]+'), lambda p: lower(p)), lambda p: p <> '')"
_STRIP = r"lower(regexp_replace(regexp_replace(regexp_replace({}, '\.(test|spec)\.', '.', 'gi'), 'tests?', '', 'gi'), '__tests__', '', 'gi'))"
_SUPPORTED = _in([e for x in ("typescript", "javascript", "text") for e in EXTENSIONS[x]])

SQL = {
    "text_chunks": r"""
WITH RECURSIVE d AS (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, ls, 0 AS i, 1 AS a, false AS t, NULL::INT AS ca, NULL::INT AS cb FROM d
  UNION ALL
  SELECT doc_id, ls, i + 1, CASE WHEN fl THEN i + 2 ELSE a END, CASE WHEN fl THEN false ELSE t2 END, CASE WHEN fl THEN a END, CASE WHEN fl THEN CASE WHEN blank AND t THEN i ELSE i + 1 END END
  FROM (SELECT *, (blank AND t) OR (i + 1 - a + 1 >= 80 AND t2) AS fl FROM (SELECT *, trim(ls[i + 1]) = '' AS blank, t OR trim(ls[i + 1]) <> '' AS t2 FROM w WHERE i < len(ls)))),
c AS (SELECT doc_id, ls, ca, cb FROM w WHERE ca IS NOT NULL UNION ALL SELECT doc_id, ls, a, len(ls) FROM w WHERE i = len(ls) AND t)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'paragraph ' || row_number() OVER (PARTITION BY doc_id ORDER BY ca) AS name, ca AS start_line, cb AS end_line, substr(sha256(trim(array_to_string(ls[ca:cb], chr(10)), ' ' || chr(10) || chr(9) || chr(13))), 1, 8) AS text_sum FROM c""",
    "markdown_sections": _BASE
    + rf""", l AS (SELECT file, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), 1) AS i FROM fl WHERE {_EXT} IN ('.md', '.mdx')),
h AS (SELECT *, nullif(trim(regexp_extract(line, '^#{{1,4}}\s+(.+)$', 1)), '') AS head FROM l),
k AS (SELECT *, count(head) OVER (PARTITION BY file ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM h),
s AS (SELECT file, k, max(head) AS head, min(i) AS a, max(i) AS b, trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (head IS NULL), ''), ' ' || chr(10) || chr(9) || chr(13)) AS text FROM k GROUP BY ALL),
n AS (SELECT *, max(k) OVER (PARTITION BY file) AS mk FROM s)
SELECT file, CASE WHEN head IS NOT NULL THEN head WHEN mk > 0 THEN 'intro' ELSE 'content' END AS name, CAST(a AS INT) AS start_line, CAST(b AS INT) AS end_line, substr(sha256(text), 1, 8) AS text_sum FROM n WHERE text <> ''""",
    "file_checksum": _BASE + "SELECT file, substr(sha256(text), 1, 8) AS checksum FROM fl",
    "symbol_identity": _BASE
    + f""", p AS (SELECT id, {_method_hash()} AS plain, {_method_hash(" || '␟' || loc")} AS precise, count(*) OVER (PARTITION BY file, {_method_hash()}) AS n FROM sym WHERE type = 'method')
SELECT id AS given, CASE WHEN n > 1 THEN precise ELSE plain END AS new_id FROM p UNION ALL SELECT id, 'class:' || substr(sha1(file || '␟' || name || '␟' || loc), 1, 16) FROM sym WHERE type = 'class'""",
    "duplicate_identity": _BASE + "SELECT file, m.class_name AS class, m.method_name AS name, m.sig AS sig, count(*) AS n_methods FROM ms GROUP BY ALL HAVING count(*) > 1",
    "identifier_split": _BASE + f"SELECT id, {_split('name')} AS words FROM sym",
    "search_terms": _BASE + f"SELECT id, array_to_string(list_sort({_terms('concat_ws(' + chr(39) + ' ' + chr(39) + ', file, name, sig, insight)')}), '|') AS terms FROM sym",
    "compact_token": _BASE + f"SELECT id, {_compact('concat_ws(' + chr(39) + '#' + chr(39) + ', class, name)')} AS token FROM sym",
    "normalize_query": _BASE + r"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(sig, '<[^>]+>', '', 'g'), '[()\[\]{};,]+', ' ', 'g'), '\s+', ' ', 'g')) AS query FROM sym WHERE sig IS NOT NULL",
    "intent_class": f"SELECT doc_id, {_intent('text')} FROM documents WHERE source = 'search-log' AND text IS NOT NULL",
    "symbol_intent": _BASE + f"SELECT symbol, {_intent('symbol')} FROM (SELECT DISTINCT symbol FROM nt WHERE symbol IS NOT NULL)",
    "path_keywords": _BASE + f"SELECT file, {_keywords('file')} AS keywords FROM hd",
    "vector_text": _BASE + f"SELECT id, {_present('namespace', 'class', 'name', 'sig', 'return_type', 'insight', _keywords('file'))} AS vector_text FROM sym",
    "class_vector_text": _BASE
    + f""", mm AS (SELECT file, class, array_to_string(list_sort(list_distinct(list(name))), ' ') AS methods FROM sym WHERE type = 'method' AND class IS NOT NULL GROUP BY ALL)
SELECT id, {_present('namespace', 'class', 'extends_name', 'methods', _keywords('file'))} AS vector_text FROM (SELECT s.*, mm.methods FROM sym s LEFT JOIN mm ON mm.file = s.file AND mm.class = s.class WHERE type = 'class')""",
    "search_content": _BASE + "SELECT id, " + _present(*[x for c in ("file", "name", "class", "sig", "insight") for x in (c, _split(c))]) + " AS content FROM sym",
    "meta_infer": _BASE
    + rf"""SELECT id, nullif(lower(regexp_extract(sig, '(?i)\b(public|private|protected|internal|export)\b', 1)), '') AS visibility, regexp_matches(sig, '(?i)\basync\b|Promise<|Task<|ValueTask<') AS is_async, regexp_matches(sig, '(?i)\bstatic\b') AS is_static,
  CASE WHEN trim(regexp_extract(sig, '\(([^)]*)\)', 1)) <> '' THEN array_to_string(list_filter(list_transform(string_split(regexp_extract(sig, '\(([^)]*)\)', 1), ','), lambda p: trim(p)), lambda p: p <> ''), '|') END AS parameters,
  CASE WHEN trim(regexp_extract(sig, '\)\s*:\s*([^={{;]+)', 1)) <> '' THEN trim(regexp_extract(sig, '\)\s*:\s*([^={{;]+)', 1)) WHEN contains(sig, name) THEN list_filter(string_split_regex(trim(split_part(sig, name, 1)), '\s+'), lambda w: w <> '' AND lower(w) NOT IN {_in(MODIFIERS)})[-1] END AS return_type,
  list_filter(exports, lambda e: contains(e, '.') AND regexp_matches(e, '^[A-Z_][\w.]+$'))[1] AS export_namespace FROM sym WHERE type = 'method' AND sig IS NOT NULL""",
    "reference_keys": _BASE + f"SELECT ref, array_to_string(list_sort({_KEYS}), '|') AS ref_keys FROM (SELECT DISTINCT ref, replace(trim(ref), '?.', '.') AS r FROM (SELECT unnest(refs) AS ref FROM sym WHERE type = 'method') WHERE ref IS NOT NULL)",
    "selector_set": _BASE + "SELECT id, array_to_string(list_sort(list_distinct(list_concat([id, name], CASE WHEN coalesce(class, '') <> '' THEN [class || '.' || name, class || '#' || name] ELSE [] END))), '|') AS selectors FROM sym WHERE type = 'method'",
    "expand_loc": _BASE + f"SELECT id, CASE WHEN {_a()} >= 1 AND {_b()} >= {_a()} THEN greatest(1, {_a()} - 8) || '-' || ({_b()} + 8) ELSE loc END AS wide, {_a()} AS start_line, {_b()} AS end_line FROM sym",
    "symbol_parts": _BASE + f"SELECT id, array_to_string({_PARTS.format('concat_ws(' + chr(39) + '#' + chr(39) + ', class, name)')}, '|') AS parts FROM sym",
    "exact_search": _BASE + _exact(QUERY, 20) + "SELECT id, CAST(tier AS INT) AS tier, score FROM ex",
    "exact_tiers": _BASE + _exact("er", 1 << 20) + "SELECT CAST(tier AS INT) AS tier, count(*) AS n_symbols FROM ex GROUP BY ALL",
    "regex_search": _BASE + "SELECT id FROM sym WHERE " + " OR ".join(f"regexp_matches({f}, '(?i){PATTERN}')" for f in [f"coalesce({c}, '')" for c in _FIELDS] + ["coalesce(class, '') || '.' || name", "coalesce(class, '') || '#' || name"]) + " ORDER BY ordinal LIMIT 30",
    "postings": _BASE + _SYMBOL_PO + "SELECT doc_id, field, term, tf FROM po",
    "lexical_bm25": _BASE + _SYMBOL_PO + _bm25(["kettle", "recipe"], COLUMN_WEIGHTS) + "SELECT doc_id, score FROM bm",
    "document_bm25": "WITH dd AS (SELECT doc_id, text FROM documents)" + _postings("dd", {"text": "text"}) + _bm25(["kettle", "recipe"], {"text": 1.0}) + "SELECT doc_id, score FROM bm",
    "memory_lexical": _BASE + ", nd AS (SELECT *, id AS doc_id FROM nt)" + _postings("nd", {c: c for c in ("text", "file", "symbol")}) + _bm25(WORDS, dict.fromkeys(("text", "file", "symbol"), 1.0), False) + "SELECT doc_id AS id, score FROM bm ORDER BY score DESC, id LIMIT 20",
    "vector_knn": _BASE + _knn(None) + "SELECT id, distance FROM kn",
    "vector_knn_typed": _BASE + _knn("class") + "SELECT id, distance FROM kn",
    "embedding_knn": "WITH ee AS (SELECT vec_id AS id, 'e' AS kind, embedding AS vector FROM embeddings)" + _knn(None, "ee", "kn", "") + "SELECT id, distance FROM kn",
    "result_clusters": _BASE
    + _exact(QUERY, 50)
    + """, r AS (SELECT file, coalesce(class, name) AS owner, id, score, row_number() OVER (PARTITION BY file, coalesce(class, name) ORDER BY score DESC, id) AS rn FROM ex)
SELECT file, owner, max(CASE WHEN rn = 1 THEN id END) AS id, max(score) AS score, coalesce(string_agg(id, ',' ORDER BY rn) FILTER (rn > 1), '') AS related FROM r WHERE rn <= 4 GROUP BY ALL""",
    "batch_search": _BASE + "".join(_exact(q, 2, f"ex{i}") for i, q in enumerate(("kettle", "ledger", "tribunal"))) + " UNION ALL ".join(f"SELECT '{q}' AS query, id, score FROM ex{i}" for i, q in enumerate(("kettle", "ledger", "tribunal"))),
    "file_scoped_search": _BASE
    + f""", hi AS (SELECT file, {_a()} AS a, {_b()} AS b, type FROM sym WHERE contains(lower(name), '{WORD}')),
ln AS (SELECT file, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM fl),
lo AS (SELECT file, count(*) AS n_lines FROM ln WHERE contains(lower(l), '{WORD}') AND NOT EXISTS (SELECT 1 FROM hi WHERE hi.file = ln.file AND n BETWEEN a AND b) GROUP BY ALL),
hc AS (SELECT file, count(*) FILTER (type = 'class') AS n_classes, count(*) FILTER (type = 'method') AS n_methods FROM hi GROUP BY ALL)
SELECT coalesce(hc.file, lo.file) AS file, coalesce(n_classes, 0) AS n_classes, coalesce(n_methods, 0) AS n_methods, coalesce(n_lines, 0) AS n_lines, coalesce(n_classes, 0) + coalesce(n_methods, 0) + coalesce(n_lines, 0) > 5 AS truncated FROM hc FULL JOIN lo ON hc.file = lo.file""",
    "files_list": _BASE + "SELECT file, lang FROM hd WHERE contains(lower(file), 'oven') ORDER BY file",
    "memory_list": _BASE + f"SELECT id, created_at FROM nt WHERE contains({_low('text')}, '{NOTE}') OR contains({_low('file')}, '{NOTE}') OR contains({_low('symbol')}, '{NOTE}')",
    "memory_before": _BASE + "SELECT id FROM nt WHERE created_at < '2025-03-01'",
    "memory_hint": _BASE
    + _exact(QUERY, 50)
    + """, bs AS (SELECT symbol_id, arg_max(text, (created_at, id)) AS t FROM nt WHERE symbol_id IS NOT NULL GROUP BY ALL), bf AS (SELECT file, arg_max(text, (created_at, id)) AS t FROM nt WHERE file IS NOT NULL GROUP BY ALL)
SELECT ex.id, coalesce(bs.t, bf.t) AS hint FROM ex LEFT JOIN bs ON bs.symbol_id = ex.id LEFT JOIN bf ON bf.file = ex.file""",
    "memory_scope": _BASE
    + "SELECT id, CASE WHEN symbol_id IS NOT NULL OR symbol IS NOT NULL THEN 'symbol' WHEN file IS NOT NULL THEN 'file' ELSE 'project' END AS scope, "
    + " OR ".join(f"contains(lower(text), '{w.replace(chr(39), chr(39) * 2)}')" for w in WARNING_WORDS)
    + r" AS warns, epoch_us(CAST(CASE WHEN regexp_matches(created_at, '(Z|[+-]\d\d:\d\d)$') THEN created_at ELSE created_at || 'Z' END AS TIMESTAMPTZ)) AS micros FROM nt",
    "callers": _BASE
    + _REFS
    + f""", tk AS (SELECT DISTINCT project, target_id, unnest({_KEYS}) AS key FROM (SELECT project, id AS target_id, unnest(list_concat([id, name], CASE WHEN coalesce(class, '') <> '' THEN [class || '.' || name, class || '#' || name] ELSE [] END)) AS r FROM sym WHERE type = 'method'))
SELECT target_id, src_id AS caller_id, CASE WHEN bool_or(r = key) THEN 'high' ELSE 'medium' END AS confidence FROM rk JOIN tk USING (project, key) GROUP BY target_id, src_id""",
    "callees": _BASE + _REFS + _EDGES + "SELECT src_id, ref, dst_id, confidence FROM ed",
    "refs_depth": _BASE
    + _REFS
    + """, sl AS (SELECT file, id AS dst, unnest(list_concat([id, name], CASE WHEN coalesce(class, '') <> '' THEN [class || '.' || name, class || '#' || name] ELSE [] END)) AS key FROM sym WHERE type = 'method'),
lk AS (SELECT DISTINCT src_id AS src, dst FROM rk JOIN sl ON sl.file = rk.src_file AND sl.key = rk.key),
wk AS (SELECT id AS start, id AS node, 0 AS steps FROM sym WHERE type = 'method' UNION SELECT start, dst, steps + 1 FROM wk JOIN lk ON src = node WHERE steps < 2)
SELECT start, count(DISTINCT ref) AS n_refs FROM wk JOIN rr ON rr.src_id = node GROUP BY ALL""",
    "trace": _BASE
    + _REFS
    + _EDGES
    + """, lk AS (SELECT DISTINCT src_id AS src, dst_id AS dst FROM ed WHERE dst_id IS NOT NULL),
wk AS (SELECT id AS start, id AS node, 0 AS steps FROM sym WHERE type = 'method' UNION SELECT start, dst, steps + 1 FROM wk JOIN lk ON src = node WHERE steps < 3),
mn AS (SELECT start, node, min(steps) AS steps FROM wk GROUP BY ALL)
SELECT start AS start_id, steps, count(*) AS n_nodes FROM mn GROUP BY ALL""",
    "symbol_resolve": _BASE
    + """, q AS (SELECT DISTINCT symbol AS query FROM nt WHERE symbol IS NOT NULL),
c AS (SELECT lower(class || '.' || name) AS k, id, file, loc, 'qualified' AS match, 120 AS score FROM sym WHERE class IS NOT NULL UNION ALL SELECT lower(class || '#' || name), id, file, loc, 'qualified', 120 FROM sym WHERE class IS NOT NULL UNION ALL SELECT lower(name), id, file, loc, 'exact', 100 FROM sym UNION ALL SELECT lower(id), id, file, loc, 'id', 90 FROM sym),
h AS (SELECT query, id, any_value(file) AS file, any_value(loc) AS loc, max(score) AS score, arg_max(match, score) AS match FROM c JOIN q ON k = lower(query) GROUP BY query, id),
r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS nxt FROM h WINDOW w AS (PARTITION BY query ORDER BY score DESC, file, loc, id))
SELECT query, id, match, score, coalesce(nxt = score, false) AS ambiguous FROM r WHERE rn = 1""",
    "import_resolution": _BASE + _RELATIVE + "SELECT file, import_text, target FROM ri",
    "export_resolution": _BASE
    + _NAMED
    + r""", pn AS (SELECT project, file, name FROM inm UNION SELECT project, file, regexp_extract(c.extends_name, '([\w$]+)\s*(?:<.*)?$', 1) FROM (SELECT project, file, unnest(classes) AS c FROM hd))
SELECT n.file, n.name, min(x.target) AS target FROM pn n JOIN xp x ON x.project = n.project AND x.name = n.name AND x.target <> n.file WHERE n.name <> '' GROUP BY n.project, n.file, n.name""",
    "file_resolve": _BASE
    + _PATHS
    + """, q AS (SELECT DISTINCT string_split(file, '/')[-1] AS query FROM nt WHERE file IS NOT NULL)
SELECT query, min(file) AS file FROM fk JOIN q ON f = lower(query) OR ends_with(f, '/' || lower(query)) WHERE query <> '' GROUP BY query HAVING count(DISTINCT file) = 1""",
    "file_scoped_resolve": _BASE
    + _PATHS
    + r""", q AS (SELECT DISTINCT regexp_replace(file, '\.[^/.]+$', '') AS p, name FROM sym WHERE type = 'method' AND name NOT LIKE '%#%'),
pl AS (SELECT p, min(file) AS file FROM fk JOIN (SELECT DISTINCT p FROM q) ON f = lower(p) OR ends_with(f, '/' || lower(p)) GROUP BY p HAVING count(DISTINCT file) = 1),
h AS (SELECT p || '#' || q.name AS query, s.id, s.file, s.loc, CASE WHEN lower(s.name) = lower(q.name) THEN 100 ELSE 90 END AS score FROM q JOIN pl USING (p) JOIN sym s ON s.file = pl.file AND (lower(s.name) = lower(q.name) OR lower(s.id) = lower(q.name))),
r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS nxt FROM h WINDOW w AS (PARTITION BY query ORDER BY score DESC, file, loc, id))
SELECT query, id, CASE score WHEN 100 THEN 'exact' ELSE 'id' END AS match, score, coalesce(nxt = score, false) AS ambiguous FROM r WHERE rn = 1""",
    "state_writes_by_path": _BASE + _STATE_REFS + "SELECT path, count(*) FILTER (ref_kind = 'write') AS n_writes, count(*) FILTER (ref_kind = 'read') AS n_reads, count(DISTINCT file) AS n_files FROM sr GROUP BY path",
    "project_overloads": _BASE + "SELECT project, name, count(*) AS n_methods, count(DISTINCT file) AS n_files, count(DISTINCT class) AS n_owners FROM sym WHERE type = 'method' GROUP BY ALL HAVING count(*) > 1",
    "state_references": _BASE + _STATE_REFS + "SELECT file, CAST(line AS INT) AS line, path, ref_kind FROM sr",
    "state_writers": _BASE + _STATE_REFS + "SELECT file, CAST(line AS INT) AS line, path FROM sr WHERE ref_kind = 'write' AND (contains(lower(path), 'value') OR contains(lower(file), 'value')) ORDER BY file, line, path LIMIT 50",
    "state_readers": _BASE + _STATE_REFS + "SELECT file, CAST(line AS INT) AS line, path FROM sr WHERE ref_kind = 'read' ORDER BY file, line, path LIMIT 50",
    "changed_files": _BASE + _STATES + "SELECT file, state FROM states",
    "method_diff": _BASE
    + _gen(1, "g1")
    + _gen(2, "g2")
    + _gm("g1", "n")
    + _gm("g2", "o")
    + """, fresh AS (SELECT * FROM n WHERE id NOT IN (SELECT id FROM o)), gone AS (SELECT * FROM o WHERE id NOT IN (SELECT id FROM n))
SELECT n.id, n.file, 'updated' AS state FROM n JOIN o USING (id) WHERE n.body IS DISTINCT FROM o.body
UNION ALL SELECT id, file, CASE WHEN EXISTS (SELECT 1 FROM gone g WHERE g.file = f.file AND g.loc = f.loc) THEN 'updated' ELSE 'added' END FROM fresh f
UNION ALL SELECT id, file, 'removed' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.file = g.file AND f.loc = g.loc)""",
    "upsert": _BASE + _gen(1, "g1") + _gen(2, "g2") + "SELECT file, checksum FROM g1 UNION ALL SELECT file, checksum FROM g2 WHERE file NOT IN (SELECT file FROM g1)",
    "delete_by_file": _BASE + _STATES + _gm("g2", "o") + "SELECT id FROM o WHERE file NOT IN (SELECT file FROM states WHERE state = 'vanished')",
    "debounce_changes": """
WITH e AS (SELECT user_id AS file_key, ts AS at_ts, CASE event_type WHEN 'error' THEN 'unlink' WHEN 'signup' THEN 'add' ELSE 'change' END AS change_kind FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
c AS (SELECT *, lead(at_ts) OVER (PARTITION BY file_key ORDER BY at_ts, change_kind) AS nxt FROM e WHERE change_kind <> 'unlink')
SELECT file_key, at_ts AS "at", change_kind FROM c WHERE nxt IS NULL OR nxt > at_ts + INTERVAL 3600 SECONDS UNION ALL SELECT file_key, at_ts, change_kind FROM e WHERE change_kind = 'unlink'""",
    "manifest_history": "SELECT generation_id, CAST(age AS INT) AS age, age = 0 AS is_latest, status FROM (SELECT *, row_number() OVER (ORDER BY started_at DESC, generation_id DESC) - 1 AS age FROM manifests) WHERE age < 5",
    "insight_backlog": _BASE + "SELECT id, file FROM sym WHERE type = 'method' AND coalesce(insight, '') = ''",
    "embedding_cache_misses": _BASE + "SELECT id, type FROM sym WHERE id NOT IN (SELECT id FROM vc WHERE len(vector) = 64)",
    "stale_report": _BASE
    + f""", t AS (SELECT h.file, lower(trim(h.checksum)) AS checksum, substr(sha256(f.text), 1, 8) AS now, f.file IS NOT NULL AS here, h.methods IS NOT NULL AS has_header FROM hd h LEFT JOIN fl f ON f.file = h.file),
k AS (
  SELECT 'missing-file' AS kind FROM t WHERE NOT here UNION ALL SELECT 'unsupported-extension' FROM t WHERE here AND {_EXT} NOT IN {_SUPPORTED}
  UNION ALL SELECT 'changed-file' FROM t WHERE here AND checksum <> now UNION ALL SELECT 'checksum-mismatch' FROM t WHERE here AND checksum <> now
  UNION ALL SELECT 'missing-header' FROM t WHERE here AND NOT has_header UNION ALL SELECT 'parse-failed' FROM t WHERE here AND NOT has_header
  UNION ALL SELECT 'stale-insight' FROM sym JOIN t USING (file) WHERE type = 'method' AND coalesce(insight, '') = '' AND here AND has_header
  UNION ALL SELECT unnest(CASE WHEN v < s THEN ['missing-vector', 'vector-mismatch'] WHEN v > s THEN ['orphan-vector', 'vector-mismatch'] ELSE [] END) FROM (SELECT (SELECT count(*) FROM vc WHERE kind <> 'memory') AS v, (SELECT count(*) FROM sym) AS s))
SELECT CASE WHEN kind IN ('missing-file', 'changed-file') THEN 'files' WHEN kind = 'missing-header' THEN 'headers' WHEN kind IN ('parse-failed', 'unsupported-extension') THEN 'parser' WHEN kind = 'checksum-mismatch' THEN 'generation' WHEN kind = 'stale-insight' THEN 'insights' ELSE 'vectors' END AS category,
  kind AS issue_kind, CASE WHEN kind IN ('missing-file', 'changed-file') THEN 'high' WHEN kind IN ('unsupported-extension', 'stale-insight') THEN 'low' ELSE 'medium' END AS severity, count(*) AS n_issues FROM k GROUP BY ALL""",
    "issue_summary": "SELECT repo, issue_kind, count(*) AS n_issues FROM (SELECT DISTINCT issue_id, replace(lower(trim(kind)), '_', '-') AS issue_kind, repo FROM stale_issues) GROUP BY ALL",
    "status": _BASE + "SELECT (SELECT count(*) FROM hd) AS n_files, (SELECT count(DISTINCT generation_id) FROM hd) AS n_generations, count(*) AS n_symbols, count(*) FILTER (type = 'method') AS n_methods, count(*) FILTER (type = 'method' AND coalesce(insight, '') = '') AS n_pending FROM sym",
    "test_candidates": _BASE
    + rf""", tg AS (SELECT file AS target, project, {_STRIP.format("regexp_replace(regexp_replace(file, '^.*/', ''), '" + chr(92) + ".[^.]*$', '')")} AS base, list_filter(list_distinct(flatten(list_transform(coalesce(exports, []), lambda s: {_PARTS.format('s')}))), lambda x: len(x) >= 3) AS ws FROM hd),
te AS (SELECT DISTINCT project, file, {_STRIP.format('file')} AS hay FROM (SELECT project, file, '/' || lower(file) AS f FROM hd) WHERE contains(f, '__tests__/') OR contains(f, '/test/') OR contains(f, '/tests/') OR contains(f, '.test.') OR contains(f, '.spec.') OR regexp_matches(f, 'tests?\.[^.]+$')),
sc AS (SELECT target, file, 20 + CASE WHEN base <> '' AND contains(hay, base) THEN 50 ELSE 0 END + CASE WHEN len(list_filter(ws, lambda w: contains(hay, w))) > 0 THEN 30 ELSE 0 END AS score FROM tg JOIN te USING (project)),
rk AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, file) AS rn FROM sc)
SELECT target, file, CAST(score AS INT) AS score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'low' END AS confidence FROM rk WHERE rn <= 8""",
    "public_api": _BASE
    + "SELECT DISTINCT file, symbol, api_kind FROM (SELECT file, unnest(exports) AS symbol, 'export' AS api_kind FROM hd UNION ALL SELECT file, concat_ws('#', m.class_name, m.method_name), 'public-method' FROM ms WHERE m.visibility IN ('public', 'export'))",
    "public_api_of": _BASE
    + f"""SELECT DISTINCT file, symbol, api_kind FROM (SELECT file, unnest(exports) AS symbol, 'export' AS api_kind FROM hd UNION ALL SELECT file, concat_ws('#', m.class_name, m.method_name), 'public-method' FROM ms WHERE m.visibility IN ('public', 'export'))
WHERE contains(lower(symbol), '{WORD}') OR contains('{WORD}', lower(symbol))""",
    "same_file_symbols": _BASE + _exact(QUERY, 20) + ", t AS (SELECT sym.* FROM sym JOIN ex USING (id)) SELECT t.id AS target_id, s.id FROM t JOIN sym s ON s.file = t.file AND s.id <> t.id AND s.loc IS DISTINCT FROM t.loc",
    "match_candidates": _BASE
    + _exact(QUERY, 10)
    + f""", rg AS (SELECT id FROM sym WHERE {_holds(QUERY)} ORDER BY ordinal LIMIT 10)
SELECT id, file, CASE WHEN lower(id) = '{QUERY}' THEN 120 WHEN lower(class || '#' || name) = '{QUERY}' THEN 110 WHEN lower(class || '.' || name) = '{QUERY}' THEN 108 WHEN lower(name) = '{QUERY}' THEN 100 ELSE 60 END AS score
FROM sym WHERE type = 'method' AND id IN (SELECT id FROM ex UNION SELECT id FROM rg)""",
    "index_age": "SELECT generation_id, CAST(floor((epoch_us((SELECT max(started_at) FROM manifests)) - epoch_us(finished_at)) / 3600000000) AS BIGINT) AS age_hours, coalesce(floor((epoch_us((SELECT max(started_at) FROM manifests)) - epoch_us(finished_at)) / 3600000000) > 24, false) AS is_old FROM manifests WHERE finished_at IS NOT NULL",
    "unread_ranges": _BASE + f", s AS (SELECT id, file, type, {_a()} AS a, {_b()} AS b FROM sym) SELECT id FROM s m WHERE type = 'method' AND a IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s c WHERE c.type = 'class' AND c.file = m.file AND c.a <= m.a AND c.b >= m.b)",
    "bounded_files": _BASE
    + """, x AS (SELECT file, string_split(text, chr(10)) AS ls FROM fl), y AS (SELECT file, CASE WHEN len(ls) <= 80 THEN ls ELSE list_concat(ls[1:60], ls[len(ls) - 19:len(ls)]) END AS ls FROM x)
SELECT file, CAST(len(ls) AS INT) AS n_lines, substr(sha256(array_to_string(ls, chr(10))), 1, 8) AS shown_sum FROM y""",
    "note_times": _BASE + r"SELECT id, strftime(CAST(CASE WHEN regexp_matches(created_at, '(Z|[+-]\d\d:\d\d)$') THEN created_at ELSE created_at || 'Z' END AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS shown_at FROM nt",
    "parsed_lists": _BASE + "SELECT id, CAST(coalesce(len(list_filter(refs, lambda r: r IS NOT NULL)), 0) AS INT) AS n_refs FROM sym WHERE type = 'method'",
    "risk_level": _BASE
    + _REFS
    + _EDGES
    + _STATES
    + rf""", cr AS (SELECT s.file, count(DISTINCT e.src_id) AS n FROM ed e JOIN sym s ON s.id = e.dst_id JOIN sym x ON x.id = e.src_id WHERE x.file <> s.file GROUP BY ALL),
fx AS (SELECT h.file, coalesce(len(exports), 0) AS n_exports, len(list_filter(string_split(lower(h.file), '/'), lambda s: regexp_matches(s, '\b({'|'.join(ROUTE_SEGMENTS)})\b'))) > 0 AS route, coalesce(cr.n, 0) AS n_callers, coalesce(st.state = 'changed', false) AS stale FROM hd h LEFT JOIN cr ON cr.file = h.file LEFT JOIN states st ON st.file = h.file),
sc AS (SELECT file, CASE WHEN n_callers >= 5 THEN 3 WHEN n_callers >= 2 THEN 1 ELSE 0 END + CASE WHEN route THEN 3 ELSE 0 END + CASE WHEN n_exports > 0 THEN 2 ELSE 0 END + CASE WHEN stale THEN 1 ELSE 0 END AS s FROM fx)
SELECT file, CAST(s AS INT) AS risk_score, CASE WHEN s >= 4 THEN 'high' WHEN s >= 2 THEN 'medium' ELSE 'low' END AS risk_level FROM sc""",
    "enrich_deep": _BASE
    + _exact(QUERY, 50)
    + """, bi AS (SELECT file, m.id AS id, min({'sig': m.sig, 'namespace': namespace}) AS x FROM ms GROUP BY ALL), bn AS (SELECT file, m.method_name AS name, min({'sig': m.sig, 'namespace': namespace}) AS x FROM ms GROUP BY ALL)
SELECT ex.id, coalesce(bi.x.sig, bn.x.sig) AS sig, coalesce(bi.x.namespace, bn.x.namespace) AS namespace FROM ex LEFT JOIN bi ON bi.file = ex.file AND bi.id = ex.id LEFT JOIN bn ON bn.file = ex.file AND bn.name = ex.name""",
    "snippets": _BASE
    + f""", x AS (SELECT m.id AS id, {_a('m.loc')} AS a, {_b('m.loc')} AS b, string_split(text, chr(10)) AS ls FROM ms JOIN fl ON fl.file = ms.file)
SELECT id, CAST(len(ls[a:least(b, len(ls))]) AS INT) AS n_lines, substr(sha256(array_to_string(ls[a:least(b, len(ls))], chr(10))), 1, 8) AS snippet_sum FROM x WHERE a >= 1 AND a <= b AND a <= len(ls)""",
    "overload_groups": _BASE + "SELECT file, class, name, count(*) AS n_overloads, array_to_string(list_sort(list_distinct(list(loc))), ',') AS locs FROM sym WHERE type = 'method' GROUP BY ALL HAVING count(*) > 1",
    "enclosing_class": _BASE
    + f""", s AS (SELECT id, file, type, {_a()} AS a, {_b()} AS b FROM sym)
SELECT m.id, arg_min(c.id, (c.b - c.a, c.id)) AS class_id FROM s m JOIN s c ON c.file = m.file AND c.type = 'class' AND m.type = 'method' AND c.a <= m.a AND c.b >= m.b GROUP BY m.id""",
    "language_histogram": _BASE + f"SELECT project, string_split(file, '/')[2] AS top_dir, {_EXT} AS ext, count(*) AS n_files FROM hd GROUP BY ALL",
}


def _boost(q: str) -> str:
    """Direct boost and path proximity of a fused row."""
    ql, flat, qt = q.lower(), _compact(f"'{q}'"), _tokens(f"'{q}'")
    n, c, f, s, i, t = (_low(x) for x in ("name", "class", "file", "sig", "insight", "text"))
    r = "lower(coalesce(array_to_string(refs, ' '), ''))"
    dot, hsh = f"{c} || '.' || {n}", f"{c} || '#' || {n}"
    sy = f"array_to_string(list_filter([{n}, {c}, {dot}, {hsh}], lambda x: x <> ''), ' ')"
    every = _tokens(f"concat_ws(' ', {f}, {sy}, {s}, {r}, {i}, {t})")
    own, parts = _tokens(sy), _tokens("coalesce(file, '')")
    each = f"list_sum(list_transform({qt}, lambda k: CASE WHEN list_contains({own}, k) THEN 1.5::DOUBLE ELSE 0 END + CASE WHEN contains({f}, k) OR contains({s}, k) OR contains({r}, k) OR contains({i}, k) OR contains({t}, k) THEN 0.5::DOUBLE ELSE 0 END))"
    hit = f"len(list_filter({qt}, lambda k: list_contains({every}, k)))"
    near = f"len(list_filter({qt}, lambda k: list_contains({parts}, k))) + len(list_filter({qt}, lambda k: contains({f}, '/' || k || '/')))"
    return f"""(CASE WHEN {n} = '{ql}' OR {c} = '{ql}' OR {dot} = '{ql}' OR {hsh} = '{ql}' THEN 6.0::DOUBLE ELSE 0 END + CASE WHEN {_compact(n)} = {flat} OR {_compact(c)} = {flat} THEN 5 ELSE 0 END + CASE WHEN {_compact(dot)} = {flat} OR {_compact(hsh)} = {flat} THEN 6 ELSE 0 END
  + CASE WHEN contains({f}, '{ql}') THEN 3 ELSE 0 END + CASE WHEN contains({s}, '{ql}') THEN 2 ELSE 0 END + CASE WHEN contains({i}, '{ql}') THEN 2 ELSE 0 END + CASE WHEN contains({r}, '{ql}') THEN 1.5::DOUBLE ELSE 0 END + CASE WHEN contains({t}, '{ql}') THEN 2 ELSE 0 END
  + {hit} / len({qt})::DOUBLE * 2.5::DOUBLE + CASE WHEN {hit} = len({qt}) THEN 2 ELSE 0 END + {each} + ({near}) * 0.35::DOUBLE)"""


_AT = "id, type, file, name, class, sig, insight, refs"
_HYBRID = (
    _BASE
    + _exact(QUERY, 24)
    + _SYMBOL_PO
    + _bm25([QUERY], COLUMN_WEIGHTS)
    + _knn(None)
    + f""", bl AS (SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 24), rx AS (SELECT * FROM sym WHERE {" OR ".join(f"contains(lower({x}), '{QUERY}')" for x in [f"coalesce({c}, '')" for c in _FIELDS])} ORDER BY ordinal LIMIT 24),
nn AS (SELECT * FROM nt WHERE contains({_low('text')}, '{QUERY}') OR contains({_low('file')}, '{QUERY}') OR contains({_low('symbol')}, '{QUERY}') ORDER BY created_at DESC, id LIMIT 24),
sg AS (
  SELECT 'exact' AS signal, row_number() OVER (ORDER BY score DESC, file, name, id) AS rnk, least(greatest(score, 0), 1)::DOUBLE AS native, {_AT}, NULL::VARCHAR AS text FROM ex
  UNION ALL SELECT 'lexical', row_number() OVER (ORDER BY score DESC, doc_id), greatest(score / (1 + score), 0), {_AT}, NULL::VARCHAR FROM bl JOIN sym ON sym.id = bl.doc_id
  UNION ALL SELECT 'regex', row_number() OVER (ORDER BY ordinal), 0.5, {_AT}, NULL::VARCHAR FROM rx
  UNION ALL SELECT 'vector', rnk, 1 / (1 + greatest(distance, 0)), {_AT}, NULL::VARCHAR FROM (SELECT id AS vid, distance, row_number() OVER (ORDER BY distance, id) AS rnk FROM kn) JOIN sym ON sym.id = vid
  UNION ALL SELECT 'memory', 1, 0, id, 'memory', file, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR[], text FROM nn),
bo AS (SELECT *, {_boost(QUERY)} + CASE type WHEN 'method' THEN 0.3::DOUBLE WHEN 'class' THEN 0.2::DOUBLE ELSE 0 END AS base FROM sg),
fu AS (SELECT id AS key, any_value(type) AS type, array_to_string(list_sort(list_distinct(list(signal))), ',') AS signals, round(sum(CASE signal {" ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in SIGNAL_WEIGHTS.items())} END / (60 + rnk) + native) + max(base), 6) AS score FROM bo GROUP BY id)"""
)
SQL["hybrid_search"] = _HYBRID + "SELECT key, type, signals, score FROM fu ORDER BY score DESC, key LIMIT 20"
SQL["hybrid_typed"] = _HYBRID + "SELECT key, signals, score FROM fu WHERE type = 'class' ORDER BY score DESC, key LIMIT 20"
