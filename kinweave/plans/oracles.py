"""SQL that another engine runs over the raw tables to check :mod:`kinweave.plans.catalog`."""

from __future__ import annotations

from kinweave.extract.knowledge import DEFAULT_MARKERS
from kinweave.plans.oracle_views import with_views

ORACLES: dict[str, str] = {}


def oracle(name: str, body: str, extra: str = "") -> None:
    ORACLES[name] = with_views(body, extra)


# --- call graph ---------------------------------------------------------------

oracle("get_callers", """
SELECT DISTINCT c.dst AS seed, n.id, n.fqn, n.file_path, n.symbol_type FROM calls c JOIN symbols n ON n.id = c.src""")
oracle("get_callees", """
SELECT DISTINCT c.src AS seed, n.id, n.fqn, n.file_path, n.symbol_type FROM calls c JOIN symbols n ON n.id = c.dst""")
oracle("callees_unresolved", "SELECT id AS seed, unresolved_calls FROM symbols")

_WALK = """walk AS (
  SELECT seed, seed AS node, 0 AS depth FROM seeds
  UNION
  SELECT seed, {far}, depth + 1 FROM walk JOIN calls ON {near} = node WHERE depth < {depth})"""
_REACHED = """
SELECT seed, id, fqn, file_path, symbol_type, depth
FROM (SELECT seed, node, min(depth) AS depth FROM walk WHERE node <> seed GROUP BY seed, node) t
JOIN symbols ON id = node"""
oracle("get_impact", _REACHED, _WALK.format(near="src", far="dst", depth=3))
oracle("get_callers_transitive", _REACHED, _WALK.format(near="dst", far="src", depth=3))
oracle("impact_path", """
SELECT seed, node AS id, len(best) - 1 AS depth, array_to_string(best, ' > ') AS path
FROM (SELECT seed, node, arg_min(path, (len(path), path)) AS best FROM paths WHERE node <> seed GROUP BY seed, node) t""",
"""paths AS (
  SELECT seed, seed AS node, [seed] AS path FROM seeds
  UNION ALL
  SELECT seed, dst, list_append(path, dst) FROM paths JOIN (SELECT DISTINCT src, dst FROM calls) ON src = node WHERE len(path) <= 2)""")
oracle("get_supertypes", """
SELECT DISTINCT seed, s.id, s.fqn, s.symbol_type FROM up JOIN symbols s ON s.id = node""",
"""up AS (SELECT src AS seed, dst AS node FROM extends UNION SELECT seed, dst FROM up JOIN extends ON src = node)""")
oracle("containment", """
SELECT CASE WHEN j = 0 THEN file_path ELSE file_path || '::C' || c END AS src,
       CASE WHEN j = 0 THEN 'File' ELSE 'CodeSymbol' END AS src_label, id AS dst FROM symbols""")
oracle("ancestor_dirs", """
SELECT path, len(parts) - 1 - n AS n, array_to_string(parts[1:n], '/') AS dir, n AS depth
FROM (SELECT path, parts, unnest(range(1, len(parts))) AS n
      FROM (SELECT path, string_split(path, '/') AS parts FROM listing)) t""")
oracle("enclosing_scopes", "SELECT id, 0 AS n, file_path || '::C' || c AS scope FROM symbols WHERE j > 0")

# --- search and statistics ----------------------------------------------------

oracle("search_symbols", """
SELECT id, fqn, file_path, symbol_type, CASE WHEN fqn = 'ring' THEN 100 ELSE 50 END AS score
FROM symbols WHERE contains(lower(fqn), 'ring') ORDER BY score DESC, id LIMIT 20""")
oracle("search_symbols_indexed", """
SELECT id, fqn, file_path, symbol_type, CASE WHEN fqn = query THEN 100 ELSE 50 END AS score, query
FROM symbols, (VALUES ('ring', NULL), ('c1', 'class'), ('.', NULL), ('STEEL', 'method'), ('xyzzy', NULL)) v(query, kind)
WHERE contains(lower(fqn), lower(query)) AND symbol_type = coalesce(kind, symbol_type)""")
oracle("score_symbols", """
SELECT id, fqn, file_path, symbol_type, CASE WHEN fqn = 'C1' THEN 100 ELSE 50 END AS score
FROM symbols WHERE symbol_type = 'class' AND contains(lower(fqn), 'c1')""")
oracle("identifier_words", """
SELECT id, trim(regexp_replace(regexp_replace(fqn, '[._]+', ' ', 'g'), ' ?([A-Z])', ' \\1', 'g')) AS words FROM symbols""")
oracle("undocumented_symbols", """
SELECT id, fqn, symbol_type, file_path FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM about WHERE dst = s.id)""")

oracle("unwarned_symbols", """
SELECT id, fqn, symbol_type, file_path FROM symbols s
WHERE NOT EXISTS (SELECT 1 FROM about JOIN records r ON r.id = src WHERE dst = s.id AND kind = 'gotcha')""")
oracle("indexed_graph", "SELECT count(*) AS on_disk, (SELECT count(*) FROM records) AS indexed, false AS stale FROM log")

_COUNTS = """counts AS (
  SELECT 'symbols' AS metric, count(*) AS value FROM symbols UNION ALL SELECT 'files', count(*) FROM all_files
  UNION ALL SELECT 'records', count(*) FROM records UNION ALL SELECT 'live_records', count(*) FROM live_ids
  UNION ALL SELECT 'CONTAINS', count(*) FROM symbols UNION ALL SELECT 'CALLS', count(*) FROM calls
  UNION ALL SELECT 'ABOUT', count(*) FROM about
  UNION ALL SELECT 'SUPERSEDES', count(*) FROM log a JOIN log b ON a.ss = b.id)"""
oracle("graph_stats", "SELECT metric, value FROM counts", _COUNTS)
oracle("status_totals", """
SELECT metric, value FROM counts WHERE value > 0
UNION ALL SELECT 'nodes', CAST(sum(value) AS BIGINT) FROM counts WHERE metric IN ('symbols', 'files', 'records')
UNION ALL SELECT 'edges', CAST(sum(value) AS BIGINT) FROM counts WHERE metric = upper(metric)""", _COUNTS)
oracle("stale_graph", "SELECT count(*) AS on_disk, 0 AS indexed, count(*) > 0 AS stale FROM log")

_RECORD = 'id, kind, claim, because, given, when_, then_, ref, provenance'
oracle("search_records", f"""
SELECT {_RECORD} FROM records
WHERE live AND contains(lower(claim || ' ' || coalesce(because, '')), 'step 7') ORDER BY id LIMIT 50""")
oracle("match_records", f"""
SELECT {_RECORD} FROM records
WHERE live AND kind = 'gotcha' AND contains(lower(claim || ' ' || coalesce(because, '')), 'purchase')""")
oracle("records_by_kind", f"SELECT {_RECORD}, ts FROM records WHERE live AND kind = 'rejected'")
oracle("records_by_ref", f"SELECT {_RECORD}, ts FROM records WHERE live AND ref = 'docs/d7.md'")

# --- record log ---------------------------------------------------------------

_LINES = """one AS (
  SELECT event_id AS e, event_type, strftime(ts, '%Y%m%d%H%M%S') AS wire,
    '{"id":"e' || event_id || '","kn":"' || CASE WHEN event_id % 2 = 0 THEN 'gotcha' ELSE 'decision' END || '","sb":["s'
    || (event_id % 5) || '"],"cl":"' || event_type || ' by user ' || user_id || '","pv":"u","ts":"'
    || strftime(ts, '%Y%m%d%H%M%S') || '"}' AS one FROM events),
base AS (
  SELECT e + 1 AS line, event_type, CASE e % 19
    WHEN 0 THEN substr(one, 1, 20)
    WHEN 1 THEN regexp_replace(one, '"kn":"[a-z]+"', '"kn":"note"')
    WHEN 2 THEN regexp_replace(one, '"cl":"[^"]*"', '"cl":"   "')
    WHEN 3 THEN regexp_replace(one, '"ts":"[0-9]*"', '"ts":"20260231000000"')
    WHEN 4 THEN regexp_replace(one, '"sb":\\[[^\\]]*\\]', '"sb":"x"')
    WHEN 5 THEN replace(one, '"pv":"u"', '"pv":"z:1"')
    WHEN 6 THEN replace(one, '"id":"e', '"id":"E')
    WHEN 7 THEN regexp_replace(one, '"kn":"[a-z]+",', '')
    WHEN 8 THEN regexp_replace(one, '"cl":"[^"]*"', '"cl":7')
    WHEN 9 THEN '[' || one || ']'
    WHEN 10 THEN '   '
    WHEN 11 THEN regexp_replace(one, '"id":"e[0-9]+"', '"id":"e' || (e + 3) || '"')
    WHEN 12 THEN replace(one, '"pv":"u"', '"pv":"u","rf":"docs/x.md"')
    WHEN 13 THEN regexp_replace(one, '"kn":"[a-z]+"', '"kn":"behavior","wn":"run"')
    ELSE one END AS value FROM one),
lines AS (
  SELECT line, value FROM base UNION ALL SELECT line + 1000000000, value FROM base WHERE event_type = 'view'),
docs AS (
  SELECT line, value, json_valid(value) AS ok, CASE WHEN json_valid(value) THEN CAST(value AS JSON) END AS j
  FROM lines WHERE trim(value) <> ''),
typed AS (
  SELECT line, value, ok, json_type(j) AS t, j ->> '$.id' AS id, json_type(j, '$.id') AS id_t, j ->> '$.kn' AS kn,
    j ->> '$.cl' AS cl, json_type(j, '$.cl') AS cl_t, j ->> '$.pv' AS pv, j ->> '$.ts' AS ts, json_type(j, '$.sb') AS sb_t,
    CAST(CASE WHEN json_type(j, '$.sb') = 'ARRAY' THEN j -> '$.sb' ELSE '[]' END AS VARCHAR[]) AS sb,
    j ->> '$.wn' AS wn, j ->> '$.tn' AS tn, j ->> '$.rf' AS rf FROM docs),
problems AS (
  SELECT line, id, unnest(list_filter([
    CASE WHEN NOT ok OR t <> 'OBJECT' THEN '' END,
    CASE WHEN t = 'OBJECT' AND NOT regexp_full_match(id, '[0-9a-z]+') THEN 'id' END,
    CASE WHEN t = 'OBJECT' AND coalesce(kn, '') NOT IN (SELECT kind FROM priorities) THEN 'kn' END,
    CASE WHEN t = 'OBJECT' AND (cl_t <> 'VARCHAR' OR trim(cl) = '') THEN 'cl' END,
    CASE WHEN t = 'OBJECT' AND pv NOT IN ('u', 'a', 'i') AND NOT regexp_matches(pv, '^[gtnd]:.') THEN 'pv' END,
    CASE WHEN t = 'OBJECT' AND try_strptime(ts, '%Y%m%d%H%M%S') IS NULL THEN 'ts' END,
    CASE WHEN t = 'OBJECT' AND sb_t <> 'ARRAY' THEN 'sb' END,
    CASE WHEN kn = 'behavior' AND wn IS NULL THEN 'wn' END,
    CASE WHEN kn = 'behavior' AND tn IS NULL THEN 'tn' END,
    CASE WHEN coalesce(kn, '') <> 'source' AND rf IS NOT NULL THEN 'rf' END], lambda x: x IS NOT NULL)) AS key
  FROM typed),
good AS (
  SELECT t.*, first_value(line) OVER w AS first_line, first_value(value) OVER w AS first_value
  FROM typed t WHERE line NOT IN (SELECT line FROM problems) WINDOW w AS (PARTITION BY id ORDER BY line))"""
oracle("record_parse", """
SELECT line, id, kn, array_to_string(sb, '|') AS subjects, cl, pv, ts FROM good WHERE line = first_line""", _LINES)
oracle("record_errors", """
SELECT line, coalesce(id, '') AS id, key FROM problems
UNION ALL SELECT line, id, 'id' FROM good WHERE value <> first_value""", _LINES)
oracle("record_serialize", """
SELECT id, '{' || array_to_string(list_filter([
  '"id":"' || id || '"', '"kn":"' || kn || '"', '"sb":["' || array_to_string(sb, '","') || '"]', '"cl":"' || cl || '"',
  '"bc":"' || bc || '"', '"gv":"' || gv || '"', '"wn":"' || wn || '"', '"tn":"' || tn || '"', '"rf":"' || rf || '"',
  '"pv":"' || pv || '"', '"ts":"' || ts || '"', '"ss":"' || ss || '"'], lambda x: x IS NOT NULL), ',') || '}' AS json FROM log""")
oracle("record_live", "SELECT id, kn FROM log WHERE id IN (SELECT id FROM live_ids)")
oracle("record_nodes", f"SELECT {_RECORD}, provenance_kind, ts, live FROM records")
oracle("record_about", "SELECT src, dst, dst_label FROM about")
oracle("record_anchors", """
SELECT id, id AS path, CASE WHEN kind = 'dir' THEN '' ELSE '.' || split_part(id, '.', -1) END AS ext, kind
FROM all_files WHERE kind <> 'source'""")
oracle("record_unresolved", """
SELECT record_id, subject FROM subjects
WHERE subject NOT IN (SELECT target FROM targets) AND record_id IN (SELECT id FROM live_ids)""")
oracle("record_supersedes", "SELECT a.id AS src, b.id AS dst FROM log a JOIN log b ON a.ss = b.id")
oracle("record_index_stats", """
SELECT 'records' AS metric, count(*) AS value FROM log UNION ALL SELECT 'live', count(*) FROM live_ids
UNION ALL SELECT 'about', count(*) FROM about UNION ALL SELECT 'supersedes', count(ss) FROM log
UNION ALL SELECT 'unresolved', count(*) FROM subjects
  WHERE subject NOT IN (SELECT target FROM targets) AND record_id IN (SELECT id FROM live_ids)""")
oracle("provenance", """
SELECT id, split_part(pv, ':', 1) AS kind,
       CASE WHEN pv[1] = 'n' THEN regexp_replace(pv[3:], ':[0-9]+$', '') WHEN pv[1] IN ('t', 'd') THEN pv[3:] ELSE '' END AS pointer,
       CAST(pv IN ('a', 'i') AS INT) AS unvouched, CAST(pv IN ('a', 'i') AS INT) AS notify, 1 AS valid FROM log""")
oracle("ts_format", """
SELECT event_id, wire, coalesce(strftime(try_strptime(wire[1:6] || lpad(CAST(event_id % 40 AS VARCHAR), 2, '0') || wire[9:], '%Y%m%d%H%M%S'),
       '%Y%m%d%H%M%S'), '') AS shifted
FROM (SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS wire FROM events) t""")
_ADMIT = """pointers AS (
  SELECT id, cl, ss, kn, bc, pv, sb, CASE WHEN pv[1] = 'n' THEN regexp_replace(pv[3:], ':[0-9]+$', '')
                         WHEN pv[1] IN ('t', 'd') THEN pv[3:] END AS pointer FROM log),
verdicts AS (
  SELECT *, ss IS NOT NULL AND ss NOT IN (SELECT id FROM log WHERE ss IS NULL) AS dangling,
         pointer IS NOT NULL AND pointer NOT IN (SELECT path FROM on_disk) AS fabricated FROM pointers)"""
oracle("admit_records", """
SELECT kn, cl, bc, pv, ss, array_to_string(sb, '|') AS subjects, '20260101000000' AS ts
FROM verdicts WHERE NOT dangling AND NOT fabricated""", _ADMIT)
oracle("admit_rejections", """
SELECT claim, reason, count(*) AS n FROM (
  SELECT cl AS claim, 'supersedes' AS reason FROM verdicts WHERE dangling
  UNION ALL SELECT cl, 'provenance' FROM verdicts WHERE fabricated) t GROUP BY claim, reason""", _ADMIT)

# --- records in scope ---------------------------------------------------------

_SCOPE = """seed_parts AS (
  SELECT DISTINCT {seed} AS seed, split_part(seed, '::', 1) AS file, CASE WHEN {seed} LIKE '%::%.%' THEN 1 ELSE 0 END AS is_method FROM seeds),
scope AS (
  SELECT seed, seed AS target, 0 AS rank, false AS only_dir FROM seed_parts
  UNION ALL SELECT seed, file, 1, false FROM seed_parts
  UNION ALL SELECT seed, regexp_replace(seed, '\\.[^.]*$', ''), 2, false FROM seed_parts WHERE is_method = 1
  UNION ALL SELECT seed, id, 1000, false FROM seed_parts JOIN symbols ON file_path = seed
  UNION ALL SELECT seed, array_to_string(parts[1:n], '/'), 3000 - n, true FROM (
    SELECT seed, parts, unnest(range(1, len(parts))) AS n FROM (SELECT seed, string_split(file, '/') AS parts FROM seed_parts))),
hits AS (
  SELECT seed, src, arg_max(target, (rank, target)) AS subject
  FROM scope JOIN about ON dst = target WHERE NOT only_dir OR is_dir GROUP BY seed, src)"""
oracle("records_for_symbol", """
SELECT seed, id, kind, claim, subject, ts FROM hits JOIN records ON id = src WHERE live""", _SCOPE.format(seed="seed"))
oracle("records_for_symbol_all", "SELECT seed, src AS id, subject FROM hits", _SCOPE.format(seed="seed"))
oracle("records_for_file", "SELECT seed, id, kind, subject FROM hits JOIN records ON id = src WHERE live",
       _SCOPE.format(seed="split_part(seed, '::', 1)"))

_CONTEXT = """chain AS (
  SELECT path AS file, path AS anchor, 0 AS scope FROM files
  UNION ALL SELECT path, array_to_string(parts[1:n], '/'), 100 - n FROM (
    SELECT path, parts, unnest(range(1, len(parts))) AS n FROM (SELECT path, string_split(path, '/') AS parts FROM files))),
applies AS (
  SELECT file, src AS id, min(scope) AS scope, arg_min(chain.anchor, scope) AS anchor
  FROM chain JOIN anchored ON anchored.anchor = chain.anchor WHERE scope = 0 OR is_dir GROUP BY file, src),
ranked AS (
  SELECT file, r.*, scope, anchor, row_number() OVER (PARTITION BY file ORDER BY priority, scope, r.id) AS position,
         count(*) OVER (PARTITION BY file) AS total
  FROM applies JOIN records r ON r.id = applies.id JOIN priorities USING (kind))"""
oracle("context_topk", """
SELECT file, position, id, kind, scope, CASE WHEN scope > 0 THEN anchor ELSE '' END AS anchor_dir, total
FROM ranked WHERE position <= 12""", _CONTEXT)
_BULLET = """'  • [' || kind || '] ' || claim || CASE WHEN kind = 'source' THEN ' → consult ' || ref ELSE '' END
  || coalesce(' — ' || because, '') || {module} || '  (' || id || ', ' || provenance || ')'"""
oracle("context_lines", f"""
SELECT file, position, {_BULLET.format(module="CASE WHEN scope > 0 THEN ' [module: ' || anchor || ']' ELSE '' END")} AS line
FROM ranked WHERE position <= 12
UNION ALL SELECT DISTINCT file, 13, '  … ' || (total - 12) || ' more apply here; search by subject to see them'
FROM ranked WHERE total > 12""", _CONTEXT)
_SLUG = "regexp_replace(regexp_replace({0}, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
oracle("rules_by_file", f"""
SELECT anchor AS file, is_dir, 'kinweave-' || {_SLUG.format('anchor')} || '.mdc' AS rule_file, priority, id,
       {_BULLET.format(module="''")} AS line
FROM anchored JOIN records ON id = src JOIN priorities USING (kind)""")
oracle("rule_documents", f"""
SELECT rule_file, priority, id, sha256(line) AS line_sha256 FROM (
  SELECT 'kinweave-' || {_SLUG.format('anchor')} || '.mdc' AS rule_file, priority, id, {_BULLET.format(module="''")} AS line
  FROM anchored JOIN records ON id = src JOIN priorities USING (kind)
  UNION ALL SELECT 'kinweave-' || {_SLUG.format('anchor')} || '.mdc', v.priority, '', CASE WHEN v.priority < 0
    THEN concat_ws(chr(10), '---', 'description: Knowledge records for ' || anchor, 'globs: ' || anchor || CASE WHEN is_dir THEN '/**' ELSE '' END,
                   'alwaysApply: false', '---', '', '# Known about ' || CASE WHEN is_dir THEN 'module ' ELSE '' END || anchor, '')
    ELSE concat_ws(chr(10), '', 'Where an edit contradicts one of these, raise the conflict first; record new decisions when done.', '', '<!-- kinweave-managed-rule -->') END
  FROM (SELECT DISTINCT anchor, is_dir FROM anchored) t, (VALUES (-1), (1000)) v(priority)) lines""")
oracle("rules_stale", f"""
SELECT DISTINCT rule_file FROM (SELECT 'kinweave-' || {_SLUG.format("regexp_replace(path, '/[^/]*$', '')")} || '.mdc' AS rule_file, path FROM listing) t
WHERE path NOT LIKE 'tests/%' AND rule_file NOT IN (
  SELECT 'kinweave-' || {_SLUG.format('anchor')} || '.mdc' FROM anchored)""")
oracle("rule_slug", f"SELECT path, 'rule-' || {_SLUG.format('path')} || '.mdc' AS rule_file FROM listing")

# --- drift and change ---------------------------------------------------------

_DRIFT = """live_log AS (SELECT * FROM log WHERE id IN (SELECT id FROM live_ids)),
gone AS (
  SELECT id AS record_id, subject, cl AS claim FROM (SELECT id, cl, unnest(sb) AS subject FROM live_log) t
  WHERE subject NOT IN (SELECT id FROM symbols) AND subject NOT IN (SELECT id FROM files)),
cited AS (
  SELECT id AS record_id, cl AS claim, CASE WHEN pv[1] = 'n' THEN regexp_replace(pv[3:], ':[0-9]+$', '')
                                            WHEN pv[1] IN ('t', 'd') THEN pv[3:] END AS pointer FROM live_log),
fabricated AS (
  SELECT record_id, pointer, claim FROM cited WHERE pointer IS NOT NULL AND pointer NOT IN (SELECT path FROM on_disk)),
keys AS (
  SELECT record_id || ' ' || subject AS key, record_id, claim FROM gone
  UNION ALL SELECT record_id || ' pv:' || pointer, record_id, claim FROM fabricated)"""
oracle("drift_unresolved", "SELECT record_id, subject, claim FROM gone", _DRIFT)
oracle("drift_missing_refs", """
SELECT id AS record_id, rf AS ref, cl AS claim FROM live_log
WHERE rf NOT LIKE '%://%' AND rf NOT IN (SELECT path FROM on_disk)""", _DRIFT)
oracle("drift_fabricated", "SELECT record_id, pointer, claim FROM fabricated", _DRIFT)
oracle("drift_new", "SELECT key, record_id FROM keys WHERE claim NOT LIKE 'click%' AND claim NOT LIKE 'error%'", _DRIFT)
oracle("drift_preview", "SELECT record_id, pointer, claim FROM fabricated ORDER BY record_id, pointer LIMIT 3", _DRIFT)
oracle("drift_preview_rest", "SELECT greatest(count(*) - 3, 0) AS more FROM fabricated", _DRIFT)

_STAGED = """staged AS (
  SELECT DISTINCT file_path AS path, CASE WHEN c % 4 IN (0, 1) THEN 'removed' ELSE 'modified' END AS change
  FROM symbols WHERE c % 4 <> 3)"""
oracle("staged_parse", "SELECT path, change FROM staged", _STAGED)
oracle("staged_check", """
SELECT DISTINCT CASE WHEN change = 'removed' THEN 'violation' ELSE 'warning' END AS severity,
       r.id AS record_id, a.dst AS subject, r.claim
FROM about a JOIN records r ON r.id = a.src AND r.live JOIN staged ON path = split_part(a.dst, '::', 1)""", _STAGED)
oracle("manifest_diff", """
SELECT 'src/o' || o_orderkey || '.ts' AS path,
       CASE WHEN o_orderstatus = 'O' THEN 'added' WHEN o_orderstatus = 'F' THEN 'deleted' ELSE 'changed' END AS status
FROM orders WHERE o_orderstatus IN ('O', 'F') OR o_orderpriority = '1-URGENT'""")
_BURSTS = """gaps AS (
  SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOURS, true) AS opens FROM events),
numbered AS (
  SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM gaps),
bursts AS (
  SELECT user_id, burst, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n_events FROM numbered GROUP BY user_id, burst)"""
oracle("debounce_windows", """
SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS start, strftime("end", '%Y-%m-%d %H:%M:%S.%f') AS "end", n_events FROM bursts""", _BURSTS)
oracle("debounce_batches", """
SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS start, event_type, count(*) AS n_events
FROM numbered JOIN bursts USING (user_id, burst) GROUP BY user_id, start, event_type""", _BURSTS)
oracle("path_filter", """
SELECT page_id, CAST(list_has_any(segments, ['fr', 'es']) OR path = 'de' OR path LIKE 'de/%' OR path LIKE '.git/%' AS INT) AS ignored,
       CAST(list_has_any(segments[:-2], ['fr', 'es']) AS INT) AS excluded,
       lower(regexp_extract(segments[1], '.(\\.[^.]*)$', 1)) AS ext
FROM (SELECT page_id, path, string_split(path, '/') AS segments
      FROM (SELECT page_id, regexp_extract(url, '^https?://([^?]*)', 1) AS path FROM pages)) t""")
oracle("walk_sources", """
SELECT path, 'typescript' AS language FROM listing
WHERE path LIKE 'src/%' AND path LIKE '%.ts' AND path NOT LIKE '%/d1/%'""")

oracle("watch_roots", """
SELECT DISTINCT 'all' AS kind, split_part(path, '/', 1) AS root FROM listing WHERE path LIKE '%/%' AND path NOT LIKE 'docs/%'
UNION ALL SELECT 'named', folder FROM (VALUES ('src/m1'), ('docs')) v(folder) WHERE EXISTS (SELECT 1 FROM listing WHERE starts_with(path, folder || '/'))""")

# --- extraction ---------------------------------------------------------------

_SPACE = r"[\t-\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _clip(expr: str) -> str:
    return (f"CASE WHEN length({_strip(expr)}) > 280 THEN regexp_replace(left({_strip(expr)}, 279), '{_SPACE}+$', '') || '…' "
            f"ELSE {_strip(expr)} END")


def _collapse(expr: str) -> str:
    return _strip(f"regexp_replace({expr}, '{_SPACE}+', ' ', 'g')")


_MARKER = ("(?i)(?://+|#+|/\\*+|\\*+)" + _SPACE + "*(" + "|".join(DEFAULT_MARKERS) + ")(?:[:-]|" + _SPACE + ")+(.+?)"
           + _SPACE + "*(?:\\*/" + _SPACE + "*)?$")
_COMMENTS = f"""commented AS (
  SELECT 'docs/p' || doc_id || '.ts' AS file_path, i + 1 AS line, CASE i % 7
    WHEN 0 THEN '// HACK: ' || line WHEN 1 THEN '  # fixme - ' || line || ' ' WHEN 2 THEN '/* WARNING: ' || line || ' */'
    WHEN 3 THEN ' * Danger ' || line WHEN 4 THEN 'x = 1; ' || line WHEN 5 THEN '// TODO: ' || line ELSE '// a HACK ' || line END AS value
  FROM doc_lines),
found AS (
  SELECT file_path, line, upper(regexp_extract(value, '{_MARKER}', 1)) AS marker, regexp_extract(value, '{_MARKER}', 2) AS raw
  FROM commented WHERE regexp_matches(value, '{_MARKER}')),
markers AS (SELECT file_path, line, marker, {_clip('raw')} AS claim FROM found WHERE {_strip('raw')} <> '')"""
oracle("marker_scan", "SELECT file_path, line, marker, claim FROM markers", _COMMENTS)

_COMMITS = f"""commits AS (
  SELECT doc_id, split_part(replace(text, chr(31), ' '), chr(10), 1) AS first FROM documents),
reverts AS (
  SELECT sha1(CAST(doc_id AS VARCHAR))[1:9] AS sha, {_clip('first')} AS claim FROM commits
  WHERE doc_id % 3 = 0 AND first <> '' AND regexp_full_match({_strip("'Revert \"' || first || '\"'")}, 'Revert\\s+"(.+)"'))"""
oracle("revert_scan", "SELECT sha, claim FROM reverts", _COMMITS)
_DECISIONS = f"""raw_decisions AS (
  SELECT doc_id, source, lang, replace(text, chr(13), '') AS body FROM documents),
decisions AS (
  SELECT doc_id, 'docs/adr/' || doc_id || '.md' AS file_path, 'Use ' || source || ' for ' || lang || ' texts' AS claim,
         nullif({_clip(_collapse("regexp_extract(regexp_replace(regexp_replace(body, chr(10), '  ' || chr(10) || chr(10), 'g') || chr(10) || '## Later' || chr(10), '^' || '" + _SPACE + "+', ''), '(?s)^(.*?)(?:\\n\\s*\\n|\\n#{1,6}\\s)', 1)"))}, '') AS because
  FROM raw_decisions)"""
oracle("adr_scan", "SELECT file_path, claim, because FROM decisions", _DECISIONS)
_BOOTSTRAP = f"""candidates AS (
  SELECT 0 AS rank, file_path AS k0, line AS k1, 'gotcha' AS kn, claim AS cl, 'n:' || file_path || ':' || line AS pv FROM markers
  UNION ALL SELECT 1, sha, 0, 'rejected', claim, 'g:' || sha FROM reverts
  UNION ALL SELECT 2, file_path, 0, 'decision', claim, 'd:' || file_path FROM decisions),
keyed AS (SELECT *, kn || '|' || {_collapse('lower(cl)')} AS key FROM candidates),
earlier AS (
  SELECT 'decision|' || {_collapse('lower(claim)')} AS key FROM decisions WHERE doc_id IN (SELECT doc_id FROM labels)),
added AS (
  SELECT kn, cl, pv FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, k0, k1) AS rn FROM keyed) t
  WHERE rn = 1 AND key NOT IN (SELECT key FROM earlier))"""
_ALL_KNOWLEDGE = ", ".join([_COMMENTS, _COMMITS, _DECISIONS, _BOOTSTRAP])
oracle("bootstrap_records", "SELECT kn, cl, pv FROM added", _ALL_KNOWLEDGE)
oracle("bootstrap_counts", """
SELECT kn AS kind, count(*) AS n FROM added GROUP BY kn
UNION ALL SELECT 'skipped', (SELECT count(*) FROM candidates) - (SELECT count(*) FROM added)""", _ALL_KNOWLEDGE)
oracle("clip_claims", f"SELECT doc_id, {_clip('text')} AS claim FROM documents")
oracle("dedup_keys", f"SELECT 'gotcha|' || {_collapse('lower(line)')} AS key, count(*) AS n FROM doc_lines GROUP BY key")
oracle("sql_objects", """
SELECT file_path || '::' || name AS id, name AS fqn, kind AS symbol_type, file_path, line AS line_start,
       greatest(line, coalesce(lead(line) OVER (PARTITION BY file_path ORDER BY line) - 1, n_lines)) AS line_end
FROM (
  SELECT 'docs/p' || doc_id || '.sql' AS file_path, i + 1 AS line, n_lines,
    CASE i % 8 WHEN 0 THEN 'table' WHEN 1 THEN 'view' WHEN 3 THEN 'function' WHEN 4 THEN 'procedure' WHEN 5 THEN 'trigger' END AS kind,
    CASE i % 8 WHEN 0 THEN 't' WHEN 1 THEN 'v' WHEN 3 THEN 'f' WHEN 4 THEN 'p' WHEN 5 THEN 'g' END || i AS name
  FROM doc_lines) t WHERE kind IS NOT NULL""")
oracle("enclosing_symbol", """
SELECT file_path, line, symbol_id FROM (
  SELECT l.file_path, l.line, s.id AS symbol_id,
         row_number() OVER (PARTITION BY l.file_path, l.line ORDER BY s.line_end - s.line_start, s.k) AS rn
  FROM (SELECT DISTINCT 'src/m' || (l_partkey // 5 % 10) || '/d' || (l_partkey // 5 % 3) || '/f' || (l_partkey // 5) || '.ts' AS file_path,
               CAST(trunc(l_quantity) AS BIGINT) AS line FROM lineitem) l
  JOIN symbols s ON s.file_path = l.file_path AND l.line BETWEEN s.line_start AND s.line_end) t WHERE rn = 1""")
oracle("dedup_symbols", """
SELECT 'src/o' || l_orderkey || '.ts::' || l_returnflag AS id, l_returnflag AS fqn,
       min(l_partkey) + 1 AS line_start, min(l_partkey) + 5 AS line_end FROM lineitem GROUP BY l_orderkey, l_returnflag""")

# The generated sources have a fixed number of lines per block, so what must be
# found in them follows from the keys alone.
_SHAPES = {".ts": (5, 9, 1), ".php": (7, 9, 1), ".py": (6, 7, 2)}


def _generated(ext: str) -> str:
    header, block, first = _SHAPES[ext]
    return f"""groups AS (
  SELECT c, stem || '{ext}' AS path, CASE WHEN c = 0 THEN 0 ELSE (c - 1) // 3 END AS p, c + 1 AS n, count(*) FILTER (j > 0) AS blocks
  FROM members GROUP BY c, stem),
methods AS (
  SELECT m.c, path, p, n, method, path || '::C' || m.c || '.' || method AS id, {header} + {block} * (j - 1) + 1 AS first_line
  FROM members m JOIN groups USING (c) WHERE j > 0),
found AS (
  SELECT path, 'C' || c AS fqn, 'class' AS kind, 3 AS line_start, {header} + {block} * blocks + {1 if ext != '.py' else 0} AS line_end FROM groups
  UNION ALL SELECT path, 'C' || c || '.' || method, 'method', first_line + {first - 1}, first_line + {block} - 1 FROM methods
  {{more}})"""


_ROOT = """UNION ALL SELECT path, 'C' || c || '.{ctor}', 'method', {header}, {header} FROM groups
  UNION ALL SELECT path, 'Root' || c, 'class', {header} + 9 * blocks + 2, {header} + 9 * blocks + 5 FROM groups
  UNION ALL SELECT path, 'Root' || c || '.shared', 'method', {header} + 9 * blocks + 3, {header} + 9 * blocks + 3 FROM groups
  UNION ALL SELECT path, 'Root' || c || '.own' || c, 'method', {header} + 9 * blocks + 4, {header} + 9 * blocks + 4 FROM groups"""
_PY = """UNION ALL SELECT path, 'C' || c || '.LIMIT', 'constant', 4, 4 FROM groups
  UNION ALL SELECT path, 'C' || c || '.__init__', 'method', 5, 6 FROM groups
  UNION ALL SELECT path, 'helper', 'function', 7 + 7 * blocks, 8 + 7 * blocks FROM groups"""
_FOUND = """SELECT path || '::' || fqn AS id, fqn, kind AS symbol_type, path AS file_path, line_start, line_end FROM found"""
oracle("ts_symbols", _FOUND, _generated(".ts").replace("{more}", _ROOT.format(ctor="constructor", header=5)))
oracle("php_symbols", _FOUND, _generated(".php").replace("{more}", _ROOT.format(ctor="__construct", header=7)))
oracle("python_symbols", _FOUND, _generated(".py").replace("{more}", _PY))
_REFS = """
SELECT id AS caller_id, 'C' || c || '.shared' AS target_name, 'static_call' AS kind, first_line + 1 AS line FROM methods
UNION ALL SELECT id, 'C' || n || '.shared', 'static_call', first_line + 2 FROM methods
UNION ALL SELECT id, 'parent::shared', 'static_call', first_line + 3 FROM methods
UNION ALL SELECT id, 'C' || n || '.make', 'static_call', first_line + 4 FROM methods
UNION ALL SELECT id, 'C' || n, 'instantiation', first_line + 5 FROM methods
UNION ALL SELECT id, 'C' || p || '.shared', 'static_call', first_line + 6 FROM methods
UNION ALL SELECT id, 'C' || c || '.own' || p, 'static_call', first_line + 7 FROM methods"""
for _lang, _ext in (("ts", ".ts"), ("php", ".php")):
    _views = _generated(_ext).replace("{more}", "")
    oracle(f"{_lang}_call_refs", _REFS, _views)
    oracle(f"{_lang}_inheritance", """
SELECT path AS file_path, 'C' || c AS child, 'C' || p AS parent FROM groups
UNION ALL SELECT path, 'C' || c, 'Root' || c FROM groups""", _views)
oracle("python_call_refs", """
SELECT id AS caller_id, 'C' || c || '.shared' AS target_name, 'static_call' AS kind, first_line + 2 AS line FROM methods
UNION ALL SELECT id, 'C' || n || '.make', 'static_call', first_line + 3 FROM methods
UNION ALL SELECT id, 'C' || n, 'instantiation', first_line + 4 FROM methods
UNION ALL SELECT id, 'helper', 'static_call', first_line + 5 FROM methods""", _generated(".py").replace("{more}", ""))

_TAGGED = "tagged AS (SELECT 'docs/p' || doc_id || '.tsx' AS path, 'C' || i AS cls, 'T' || i AS other, 4 * i + 1 AS line FROM doc_lines)"
oracle("tsx_symbols", """
SELECT path || '::' || cls || m AS id, cls || m AS fqn, CASE WHEN m = '' THEN 'class' ELSE 'method' END AS symbol_type,
       path AS file_path, line + first AS line_start, line + last AS line_end
FROM tagged, (VALUES ('', 0, 3), ('.m', 1, 1), ('.n', 2, 2)) v(m, first, last)""", _TAGGED)
oracle("tsx_call_refs", """
SELECT path || '::' || cls || '.m' AS caller_id, cls || '.n' AS target_name, 'static_call' AS kind, line + 1 AS line FROM tagged, range(2)
UNION ALL SELECT path || '::' || cls || '.n', other || '.u', 'static_call', line + 2 FROM tagged""", _TAGGED)

# --- indexing -----------------------------------------------------------------

_EDGES = """edges AS (
  SELECT m.id AS src, m.path || '::Root' || m.c || '.shared' AS dst, 'static_call' AS call_kind FROM methods m
  UNION SELECT m.id, g.path || '::Root' || g.c || '.shared', 'static_call' FROM methods m JOIN groups g ON g.c IN (m.n, m.p)
  UNION SELECT m.id, g.path || '::Root' || g.c || '.own' || g.c, 'static_call' FROM methods m JOIN groups g ON g.c = m.p
  UNION SELECT m.id, g.path || '::C' || g.c, 'instantiation' FROM methods m JOIN groups g ON g.c = m.n)"""
_TS = _generated(".ts").replace("{more}", _ROOT.format(ctor="constructor", header=5)) + ", " + _EDGES
oracle("index_calls", "SELECT src, dst, call_kind FROM edges", _TS)
oracle("index_incremental", "SELECT src, dst, call_kind FROM edges", _TS)
oracle("index_php_calls", "SELECT src, dst, call_kind FROM edges", _generated(".php").replace("{more}", "") + ", " + _EDGES)
oracle("index_extends", """
SELECT a.path || '::C' || a.c AS src, b.path || '::C' || b.c AS dst FROM groups a JOIN groups b ON b.c = a.p
UNION ALL SELECT path || '::C' || c, path || '::Root' || c FROM groups""", _TS)
_PARENTS = """
SELECT CASE WHEN fqn LIKE '%.%' THEN path || '::' || split_part(fqn, '.', 1) ELSE path END AS src,
       CASE WHEN fqn LIKE '%.%' THEN 'CodeSymbol' ELSE 'File' END AS src_label, path || '::' || fqn AS dst FROM found"""
oracle("index_contains", _PARENTS, _TS)
oracle("index_unresolved", """
SELECT f.path || '::' || fqn AS id, CASE WHEN m.id IS NULL THEN 0 WHEN m.n IN (SELECT c FROM groups) THEN 1 ELSE 3 END AS unresolved_calls
FROM found f LEFT JOIN methods m ON m.id = f.path || '::' || fqn""", _TS)
oracle("index_summary", """
SELECT 'files_scanned' AS metric, count(*) AS value FROM groups UNION ALL SELECT 'symbols_found', count(*) FROM found
UNION ALL SELECT 'call_edges', count(*) FROM edges UNION ALL SELECT 'contains_edges', count(*) FROM found
UNION ALL SELECT 'file_nodes', count(*) FROM groups UNION ALL SELECT 'parse_errors', 0""", _TS)

# --- graph patterns -----------------------------------------------------------

oracle("pattern_label_scan", "SELECT id AS n_id, fqn AS n_fqn FROM symbols WHERE symbol_type = 'class'")
oracle("pattern_one_hop", """
SELECT DISTINCT src AS a_id, fqn AS b_fqn FROM calls JOIN symbols ON id = dst WHERE symbol_type = 'class'""")
oracle("pattern_reverse_hop", "SELECT dst AS a_id, count(*) AS n_callers FROM calls GROUP BY dst")
oracle("pattern_any_node", """
SELECT r.id AS r_id, dst AS t_id, coalesce(s.fqn, '') AS t_fqn, coalesce(f.kind, '') AS t_kind
FROM records r JOIN about ON src = r.id LEFT JOIN symbols s ON s.id = dst LEFT JOIN all_files f ON f.id = dst WHERE live""")
oracle("pattern_edge_count", "SELECT call_kind AS r_call_kind, count(*) AS n FROM calls GROUP BY call_kind")
oracle("pattern_variable_length", """
SELECT a.fqn AS c_fqn, b.fqn AS p_fqn, min(depth) AS p_depth FROM up JOIN symbols a ON a.id = seed JOIN symbols b ON b.id = node GROUP BY a.fqn, b.fqn""",
"""up AS (SELECT src AS seed, dst AS node, 1 AS depth FROM extends
  UNION SELECT seed, dst, depth + 1 FROM up JOIN extends ON src = node WHERE depth < 3)""")
oracle("pattern_not_exists", """
SELECT id AS c_id, fqn AS c_fqn FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM extends WHERE dst = s.id)""")
oracle("pattern_optional", "SELECT a.id AS r_id, coalesce(b.id, '') AS o_id FROM log a LEFT JOIN log b ON a.ss = b.id")
oracle("pattern_temporal", """
SELECT kind AS r_kind, count(*) AS n FROM records WHERE ts > '20240110000000' AND provenance_kind IN ('t', 'd') GROUP BY kind""")
oracle("graph_sql", """
SELECT symbol_type, count(DISTINCT dst) AS n_callees FROM calls JOIN symbols ON id = src
WHERE call_kind = 'static_call' GROUP BY symbol_type""")
