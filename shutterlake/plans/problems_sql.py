"""The general data problems in SQL, where it can say them: plain definitions, quadratic where that is clearest."""

_ORPHANS = """
refs AS (
  SELECT 'flag_marks' AS ref_table, mark_id AS ref_id, marked_at AS at, asset_id AS k, repository_id AS s, 'photo' AS p FROM flag_marks
  UNION SELECT 'new_assets', row_no, created_at, asset_id, repository_id, 'photo' FROM new_assets
  UNION SELECT 'task_states', state_id, emitted_at, id, '', 'task' FROM task_states
),
parents AS (
  SELECT id AS k, repository_id AS s, 'photo' AS p, make_timestamp(imported_at * 1000) AS born, make_timestamp(deleted_at * 1000) AS gone FROM assets
  UNION ALL SELECT id, '', 'task', reserved_at, removed_at FROM external_tasks
),
orphans AS (
  SELECT DISTINCT ref_table, strftime(r.at, '%Y-%m') AS month_key, ref_id,
    CASE WHEN q.k IS NULL THEN 'missing' WHEN q.born > r.at THEN 'later' WHEN q.gone <= r.at THEN 'deleted' END AS orphan_kind
  FROM refs r LEFT JOIN parents q ON q.k = r.k AND q.s = r.s AND q.p = r.p
  WHERE r.k IS NOT NULL
)
"""

_CHANGES = """
f AS (
  SELECT DISTINCT repository_id AS lib, snapshot_no AS snap, rel_path, size_bytes, mtime_ms,
    nfc_normalize(lower(replace(rel_path, chr(92), '/'))) AS k,
    CASE WHEN volume_serial IS NOT NULL AND file_id IS NOT NULL AND hex(file_id) <> repeat('0', 32)
         THEN volume_serial::VARCHAR || ':' || hex(file_id) END AS ident
  FROM rescan_files
),
d AS (SELECT lib, snap, lag(snap) OVER (PARTITION BY lib ORDER BY snap) AS prev FROM (SELECT DISTINCT lib, snap FROM f)),
n AS (SELECT f.*, d.prev FROM f JOIN d USING (lib, snap) WHERE d.prev IS NOT NULL),
o AS (SELECT f.*, d.snap AS nxt FROM f JOIN d ON f.lib = d.lib AND f.snap = d.prev),
by_id AS (SELECT n.lib, n.snap, n.k AS nk, o.k AS ok FROM n JOIN o ON n.lib = o.lib AND n.snap = o.nxt AND n.ident = o.ident),
by_path AS (
  SELECT n.lib, n.snap, n.k AS nk, o.k AS ok FROM n JOIN o ON n.lib = o.lib AND n.snap = o.nxt AND n.k = o.k
  WHERE NOT EXISTS (SELECT 1 FROM by_id b WHERE b.lib = n.lib AND b.snap = n.snap AND b.nk = n.k)
    AND NOT EXISTS (SELECT 1 FROM by_id b WHERE b.lib = o.lib AND b.snap = o.nxt AND b.ok = o.k)
),
pairs AS (SELECT * FROM by_id UNION ALL SELECT * FROM by_path),
changes AS (
  SELECT n.lib AS repository_id, n.snap AS snapshot_no, 'registered' AS change_kind, n.rel_path FROM n
  WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.lib = n.lib AND p.snap = n.snap AND p.nk = n.k)
  UNION ALL SELECT o.lib, o.nxt, 'missing', o.rel_path FROM o
  WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.lib = o.lib AND p.snap = o.nxt AND p.ok = o.k)
  UNION ALL SELECT p.lib, p.snap, 'renamed', n.rel_path FROM pairs p JOIN n ON n.lib = p.lib AND n.snap = p.snap AND n.k = p.nk WHERE p.nk <> p.ok
  UNION ALL SELECT p.lib, p.snap, 'modified', n.rel_path FROM pairs p
    JOIN n ON n.lib = p.lib AND n.snap = p.snap AND n.k = p.nk JOIN o ON o.lib = p.lib AND o.nxt = p.snap AND o.k = p.ok
    WHERE n.size_bytes <> o.size_bytes OR abs(n.mtime_ms - o.mtime_ms) > 2000
)
"""

_FILLS = """
o AS (
  SELECT id, repository_id AS g, camera_model AS m, taken_at AS t, u.f, u.v FROM assets,
    LATERAL (VALUES ('width', CASE WHEN width > 0 THEN width END), ('height', CASE WHEN height > 0 THEN height END),
      ('taken_at_source', list_position(['file_mtime', 'file_created', 'filename', 'sibling', 'exif'], taken_at_source) - 1)) AS u(f, v)
  WHERE repository_id IS NOT NULL AND camera_model IS NOT NULL AND taken_at IS NOT NULL
),
known AS (SELECT * FROM o WHERE v IS NOT NULL),
line AS (SELECT g, m, f, avg(v) AS mean, coalesce(regr_slope(v::DOUBLE, t::DOUBLE), 0) AS slope, avg(t::DOUBLE) AS t0 FROM known GROUP BY ALL),
often AS (SELECT g, m, f, v AS mode FROM known GROUP BY g, m, f, v QUALIFY row_number() OVER (PARTITION BY g, m, f ORDER BY count(*) DESC, v) = 1),
mline AS (SELECT m, f, avg(v) AS mean FROM known GROUP BY ALL),
moften AS (SELECT m, f, v AS mode FROM known GROUP BY m, f, v QUALIFY row_number() OVER (PARTITION BY m, f ORDER BY count(*) DESC, v) = 1),
cells AS (
  SELECT DISTINCT o.id, o.g, o.m, o.t, o.f, CASE WHEN o.f = 'taken_at_source' THEN mode::DOUBLE ELSE round(mean + slope * (o.t - t0), 3) END AS p
  FROM o LEFT JOIN line USING (g, m, f) LEFT JOIN often USING (g, m, f) WHERE o.v IS NULL
),
in_window AS (
  SELECT *, min(v) OVER cell = max(v) OVER cell AS agreed FROM (
    SELECT c.id, c.t, c.f, c.p, k.v, min(k.id) AS donor, abs(k.v - c.p) AS d FROM cells c JOIN known k ON k.g = c.g AND k.m = c.m AND k.f = c.f AND abs(k.t - c.t) <= 1800000 GROUP BY ALL)
  WINDOW cell AS (PARTITION BY id, t, f)
),
gvalues AS (SELECT g, m, f, v, min(id) AS donor FROM known GROUP BY ALL),
mvalues AS (SELECT m, f, v, min(id) AS donor FROM known GROUP BY ALL),
choices AS (
  SELECT id, t, f, p, d, v, donor, 1 AS rank, CASE WHEN agreed THEN 'window' ELSE 'window_mixed' END AS level FROM in_window
  UNION ALL SELECT c.id, c.t, c.f, c.p, abs(x.v - c.p), x.v, x.donor, 2, 'group' FROM cells c JOIN gvalues x USING (g, m, f)
  UNION ALL SELECT id, t, f, mp, abs(v - mp), v, donor, 3, 'model' FROM (
    SELECT c.id, c.t, c.f, CASE WHEN c.f = 'taken_at_source' THEN mode::DOUBLE ELSE round(mean, 3) END AS mp, x.v, x.donor
    FROM cells c JOIN mline USING (m, f) JOIN moften USING (m, f) JOIN mvalues x USING (m, f))
)
"""

SQL = {
    "p2_found": f"WITH {_ORPHANS} SELECT * FROM orphans WHERE orphan_kind IS NOT NULL",
    "p2_report": f"WITH {_ORPHANS} SELECT ref_table, month_key, orphan_kind, count(*) AS n_refs FROM orphans WHERE orphan_kind IS NOT NULL GROUP BY ALL",
    "p3_found": """
WITH a AS (
  SELECT id, repository_id AS r, camera_model AS m, taken_at AS t, u.field_name, u.v FROM assets,
    LATERAL (VALUES ('width', CASE WHEN width > 0 THEN width::VARCHAR END), ('height', CASE WHEN height > 0 THEN height::VARCHAR END),
      ('taken_at_source', CASE WHEN taken_at_source IN ('exif', 'sibling', 'filename', 'file_created', 'file_mtime') THEN taken_at_source END)) AS u(field_name, v)
  WHERE camera_model IS NOT NULL AND taken_at IS NOT NULL
)
SELECT x.id AS asset_id, x.field_name, min(y.v) AS fill_text
FROM a x JOIN a y ON x.r = y.r AND x.m = y.m AND x.field_name = y.field_name AND abs(x.t - y.t) <= 1800000
WHERE x.v IS NULL AND y.v IS NOT NULL
GROUP BY x.id, x.field_name HAVING count(DISTINCT y.v) = 1
""",
    "p3_filled": f"""WITH {_FILLS} SELECT id AS asset_id, f AS field_name,
  CASE WHEN f = 'taken_at_source' THEN ['file_mtime', 'file_created', 'filename', 'sibling', 'exif'][v + 1] ELSE v::VARCHAR END AS fill_text, donor AS donor_id, level, p AS prediction, round(d, 3) AS distance
FROM choices QUALIFY row_number() OVER (PARTITION BY id, t, f ORDER BY rank, d, v, donor) = 1""",
    "p5_found": """
WITH marks AS (SELECT DISTINCT mark_id, repository_id, millis FROM flag_marks WHERE millis IS NOT NULL),
flagged AS (SELECT *, coalesce(millis - lag(millis) OVER (PARTITION BY repository_id ORDER BY millis) > 1800000, true)::INT AS starts FROM marks),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY repository_id ORDER BY millis ROWS UNBOUNDED PRECEDING) AS seq FROM flagged)
SELECT repository_id, min(millis) AS start_ms, max(millis) AS end_ms, count(*) AS n_marks FROM numbered GROUP BY repository_id, seq
""",
    "p6_found": f"WITH {_CHANGES} SELECT DISTINCT * FROM changes",
    "p6_report": f"WITH {_CHANGES} SELECT repository_id, snapshot_no, change_kind, count(*) AS n_files FROM (SELECT DISTINCT * FROM changes) GROUP BY ALL",
}
