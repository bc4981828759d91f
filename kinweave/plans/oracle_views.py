"""The adapters as SQL common table expressions, for checking results in another engine."""

VIEWS = r"""
members AS (
  SELECT p_partkey AS k, p_partkey // 5 AS c, p_partkey % 5 AS j,
         replace(p_name, ' ', '_') || '_' || p_partkey AS method, CAST(p_size AS BIGINT) AS size,
         'src/m' || ((p_partkey // 5) % 10) || '/d' || ((p_partkey // 5) % 3) || '/f' || (p_partkey // 5) AS stem
  FROM part),
symbols AS (
  SELECT stem || '.ts::' || fqn AS id, fqn, CASE WHEN j = 0 THEN 'class' ELSE 'method' END AS symbol_type,
         stem || '.ts' AS file_path,
         CASE WHEN j = 0 THEN 1 ELSE 10 * j - 8 END AS line_start,
         CASE WHEN j = 0 THEN 50 ELSE 10 * j END AS line_end,
         size AS unresolved_calls, k, c, j
  FROM (SELECT *, 'C' || c || CASE WHEN j = 0 THEN '' ELSE '.' || method END AS fqn FROM members)),
files AS (SELECT DISTINCT file_path AS id, file_path AS path, '.ts' AS ext, 'source' AS kind FROM symbols),
call_keys AS (
  SELECT DISTINCT a.l_partkey AS src_k, b.l_partkey AS dst_k
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_partkey <> b.l_partkey),
calls AS (
  SELECT s.id AS src, d.id AS dst, CASE WHEN d.j = 0 THEN 'instantiation' ELSE 'static_call' END AS call_kind
  FROM call_keys JOIN symbols s ON s.k = src_k JOIN symbols d ON d.k = dst_k),
extends AS (
  SELECT s.id AS src, p.id AS dst
  FROM symbols s JOIN symbols p ON p.j = 0 AND p.c = (s.c - 1) // 3
  WHERE s.j = 0 AND s.c > 0),
seeds AS (
  SELECT DISTINCT id AS seed FROM (
    SELECT l_partkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY count(*) DESC, l_partkey) AS rn
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_nationkey, l_partkey) t
  JOIN symbols ON k = l_partkey WHERE rn = 1),
log AS (
  SELECT event_id + 1 AS line, 'e' || event_id AS id, kn,
         CASE WHEN event_type = 'purchase' THEN [subject, file_path] ELSE [subject] END AS sb,
         event_type || ' by user ' || user_id AS cl,
         CASE WHEN event_id % 3 = 0 THEN 'seen at step ' || (event_id % 10) END AS bc,
         CASE WHEN kn = 'behavior' AND event_id % 2 = 1 THEN 'a session' END AS gv,
         CASE WHEN kn = 'behavior' THEN event_type END AS wn,
         CASE WHEN kn = 'behavior' THEN 'it is stored' END AS tn,
         CASE WHEN kn = 'source' THEN CASE WHEN user_id % 2 = 0 THEN 'https://wiki/u' || user_id
                                           ELSE 'docs/d' || user_id || '.md' END END AS rf,
         CASE event_id % 7 WHEN 0 THEN 'u' WHEN 1 THEN 'a' WHEN 2 THEN 'i' WHEN 3 THEN 'g:' || event_id
              WHEN 4 THEN 't:tests/t' || user_id || '.ts'
              WHEN 5 THEN 'n:src/n' || user_id || '.ts:' || (event_id % 90 + 1)
              ELSE 'd:docs/d' || user_id || '.md' END AS pv,
         strftime(ts, '%Y%m%d%H%M%S') AS ts,
         CASE WHEN event_type = 'error' AND prev_id IS NOT NULL THEN 'e' || prev_id END AS ss
  FROM (
    SELECT e.*, file_path,
           ['gotcha', 'constraint', 'rejected', 'decision', 'source', 'behavior', 'intent', 'conflict'][event_id % 8 + 1] AS kn,
           CASE event_id % 11 WHEN 0 THEN 'src/gone/g' || event_id || '.ts::Gone' WHEN 1 THEN file_path
                WHEN 2 THEN 'src/m' || (c % 10) WHEN 3 THEN 'src/m' || (c % 10) || '/d' || (c % 3) ELSE s.id END AS subject
    FROM (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_id FROM events) e
    JOIN symbols s ON s.k = event_id % (SELECT count(*) FROM part)) t),
listing AS (
  SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'tests/t' || c_custkey || '.ts'
              WHEN c_mktsegment = 'HOUSEHOLD' THEN 'src/n' || c_custkey || '.ts'
              ELSE 'docs/d' || c_custkey || '.md' END AS path FROM customer
  UNION ALL SELECT path FROM files),
disk_dirs AS (
  SELECT DISTINCT array_to_string(parts[1:n], '/') AS path
  FROM (SELECT parts, unnest(range(1, len(parts))) AS n FROM (SELECT string_split(path, '/') AS parts FROM listing))),
on_disk AS (SELECT path, 'other' AS kind FROM listing UNION SELECT path, 'dir' FROM disk_dirs),
live_ids AS (SELECT id FROM log WHERE id NOT IN (SELECT ss FROM log WHERE ss IS NOT NULL)),
records AS (
  SELECT id, kn AS kind, cl AS claim, bc AS because, gv AS given, wn AS when_, tn AS then_, rf AS ref,
         pv AS provenance, split_part(pv, ':', 1) AS provenance_kind, ts, id IN (SELECT id FROM live_ids) AS live
  FROM log),
subjects AS (SELECT id AS record_id, unnest(sb) AS subject FROM log),
targets AS (
  SELECT target, min(rank) AS rank FROM (
    SELECT id AS target, 0 AS rank FROM symbols UNION ALL SELECT id, 1 FROM files
    UNION ALL SELECT path, CASE WHEN kind = 'other' THEN 2 ELSE 3 END FROM on_disk WHERE path NOT LIKE '%::%') GROUP BY target),
about AS (
  SELECT record_id AS src, subject AS dst, CASE WHEN rank = 0 THEN 'CodeSymbol' ELSE 'File' END AS dst_label,
         rank = 3 AS is_dir
  FROM subjects JOIN targets ON target = subject),
all_files AS (
  SELECT id, kind FROM files
  UNION ALL SELECT DISTINCT dst, CASE WHEN rank = 3 THEN 'dir' ELSE 'other' END FROM about JOIN targets ON target = dst AND rank >= 2),
priorities AS (
  SELECT unnest(['gotcha', 'constraint', 'rejected', 'decision', 'source', 'behavior', 'intent', 'conflict']) AS kind,
         unnest(range(8)) AS priority),
anchored AS (
  SELECT DISTINCT src, CASE WHEN dst_label = 'CodeSymbol' THEN split_part(dst, '::', 1) ELSE dst END AS anchor, is_dir
  FROM about JOIN live_ids ON live_ids.id = src),
doc_lines AS (
  SELECT doc_id, i - 1 AS i, lines[i] AS line, len(lines) AS n_lines
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)))
"""


def with_views(body: str, extra: str = "") -> str:
    """``body`` with the views (and ``extra`` ones, comma-separated) in scope."""
    return "WITH RECURSIVE" + VIEWS + (", " + extra if extra else "") + "\n" + body
