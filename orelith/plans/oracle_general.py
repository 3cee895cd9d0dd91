"""SQL of the general problems."""

_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(file, '^\s+|\s+$', '', 'g'), '[\\/]+', '/', 'g'), '^(\./)+', '')"
_LATEST = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY header_id ORDER BY delivered_at DESC) AS rn FROM headers) WHERE rn = 1"
_RANKS = "SELECT generation_id, row_number() OVER (ORDER BY started_at, generation_id) AS rk FROM (SELECT DISTINCT generation_id, started_at FROM manifests WHERE status = 'completed')"

_CHANGES = rf"""
WITH h AS ({_LATEST}), ranks AS ({_RANKS}),
rec AS (
  SELECT repo, {_CLEAN} AS file, rk, nullif(lower(trim(checksum)), '') AS checksum,
         list_sort(list_distinct(coalesce(list_transform(methods, lambda m: m.id), []::VARCHAR[]))) AS ms
  FROM h JOIN ranks USING (generation_id)),
pair AS (
  SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.file, b.file) AS file, coalesce(b.rk, a.rk + 1) AS rk,
         CASE WHEN a.repo IS NULL THEN 'added' WHEN b.repo IS NULL THEN 'removed' ELSE 'changed' END AS change_kind,
         coalesce(a.checksum <> b.checksum, false) AS d_checksum, coalesce(a.ms <> b.ms, false) AS d_methods
  FROM rec a FULL JOIN rec b ON a.repo = b.repo AND a.file = b.file AND b.rk = a.rk + 1),
change AS (
  SELECT p.*, generation_id FROM pair p JOIN ranks USING (rk)
  WHERE rk > 1 AND (change_kind <> 'changed' OR d_checksum OR d_methods))
"""

_ORPHANS = rf"""
WITH h AS ({_LATEST}),
raw AS (
  SELECT CAST(header_id AS VARCHAR) AS record_id, repo, started_at AS moment, replace(trim(unnest(flatten(list_transform(methods, lambda m: m.refs)))), '?.', '.') AS ref
  FROM h JOIN manifests USING (generation_id)),
refs AS (
  SELECT DISTINCT 'headers' AS src, 'm:' || repo AS space, record_id, regexp_extract(ref, '([^.#]*)$', 1) AS ref_key, moment FROM raw WHERE ref NOT IN (SELECT callee FROM external_callees)
  UNION SELECT 'memories', 'i', id, lower(trim(symbol_id)), CAST(CASE WHEN regexp_matches(created_at, '(Z|[+-]\d\d:\d\d)$') THEN created_at ELSE created_at || 'Z' END AS TIMESTAMPTZ) AT TIME ZONE 'UTC' FROM memories
  UNION SELECT 'stale_issues', 'k', CAST(issue_id AS VARCHAR), replace(lower(trim(kind)), '_', '-'), detected_at FROM stale_issues),
parents AS (
  SELECT 'm:' || repo AS space, sym_name AS k, indexed_at AS s, removed_at AS e FROM symbols WHERE lower(trim(sym_type)) = 'method'
  UNION ALL SELECT 'i', id, indexed_at, removed_at FROM symbols
  UNION ALL SELECT 'k', kind, introduced_at, retired_at FROM issue_kinds),
seen AS (
  SELECT r.src, r.record_id, r.ref_key, r.moment, count(k) AS n, count(*) FILTER (s <= r.moment) AS begun, count(*) FILTER (s <= r.moment AND (e IS NULL OR e > r.moment)) AS valid
  FROM refs r LEFT JOIN parents p ON p.space = r.space AND p.k = r.ref_key WHERE r.ref_key <> '' GROUP BY ALL),
orphans AS (
  SELECT DISTINCT src, record_id, ref_key, CASE WHEN n = 0 THEN 'missing' WHEN begun = 0 THEN 'late' ELSE 'deleted' END AS reason, strftime(moment, '%Y-%m') AS ref_month
  FROM seen WHERE valid = 0)
"""

_TREES = rf"""
WITH RECURSIVE h AS ({_LATEST}),
last AS (SELECT generation_id FROM manifests WHERE status = 'completed' ORDER BY started_at DESC, generation_id DESC LIMIT 1),
decl AS (SELECT repo, {_CLEAN} AS file, unnest(classes) AS c FROM h WHERE generation_id = (SELECT generation_id FROM last)),
one AS (
  SELECT repo, c.class_name AS node,
         coalesce(min_by(nullif(trim(c.extends_name), ''), file) FILTER (trim(c.extends_name) <> ''), min_by(c.implements[1], file) FILTER (len(c.implements) > 0)) AS p
  FROM decl WHERE c.class_name IS NOT NULL GROUP BY ALL),
named AS (SELECT repo, node, regexp_replace(regexp_replace(regexp_replace(p, '<.*$', ''), '^.*(\.|::)', ''), '\s+', '', 'g') AS parent FROM one),
link AS (SELECT a.repo, a.node, b.node AS parent FROM named a LEFT JOIN named b ON a.repo = b.repo AND a.parent = b.node),
walk AS (
  SELECT repo, node, node AS root, 0 AS depth, node AS path FROM link WHERE parent IS NULL
  UNION ALL SELECT l.repo, l.node, w.root, w.depth + 1, w.path || '>' || l.node FROM link l JOIN walk w ON l.repo = w.repo AND l.parent = w.node),
bad AS (SELECT * FROM link l WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.repo = l.repo AND w.node = l.node)),
up AS (
  SELECT repo, node, parent AS at FROM bad
  UNION SELECT u.repo, u.node, b.parent FROM up u JOIN bad b ON u.repo = b.repo AND u.at = b.node)
"""

_STEPS = """, steps AS (SELECT repo, node, depth, unnest(string_split(path, '>')) AS anc, generate_subscripts(string_split(path, '>'), 1) - 1 AS pos FROM walk)
"""

SQL = {
    "p1_found": _CHANGES + "SELECT repo, file, generation_id, change_kind FROM change",
    "p1_changed_fields": _CHANGES
    + """SELECT generation_id, change_kind, field, count(*) AS n_records FROM (
  SELECT generation_id, change_kind, unnest(CASE WHEN change_kind <> 'changed' THEN [NULL] ELSE list_filter([CASE WHEN d_checksum THEN 'checksum' END, CASE WHEN d_methods THEN 'methods' END], lambda x: x IS NOT NULL) END) AS field FROM change) GROUP BY ALL""",
    "p2_found": _ORPHANS + "SELECT * FROM orphans",
    "p2_by_month": _ORPHANS + "SELECT src, reason, ref_month, count(*) AS n_refs FROM orphans GROUP BY ALL",
    "p7_found": _TREES
    + """, solved AS (
  SELECT repo, node, root, depth, path, 'tree' AS state FROM walk
  UNION ALL SELECT b.repo, b.node, '', -1, '', CASE WHEN EXISTS (SELECT 1 FROM up u WHERE u.repo = b.repo AND u.node = b.node AND u.at = b.node) THEN 'cycle' ELSE 'below-cycle' END FROM bad b)
SELECT repo, node AS class_name, root AS root_name, CAST(depth AS INT) AS node_depth, path AS node_path, state AS node_state FROM solved""",
    "p7_pairs": _TREES + _STEPS + "SELECT repo, anc AS class_name, node AS descendant, CAST(depth - pos AS INT) AS distance FROM steps WHERE pos < depth",
    "p7_descendants": _TREES
    + _STEPS
    + """SELECT repo, anc AS class_name, count(*) AS n_descendants, CAST(max(depth - pos) AS INT) AS height FROM steps WHERE pos < depth GROUP BY ALL""",
}
