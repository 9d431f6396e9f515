"""The text problems in SQL, where it can say them."""

_STRIP = r"(\s*\(\d+\)|~\d+|\s+-\s+(copy|kopie|副本)|[ _](copy|kopie|副本))$"

_WINDOWS = """
w AS (SELECT doc_id, i, md5(substr(text, i, 150)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 148)) AS i FROM documents WHERE length(text) >= 150)),
shared AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1)
"""

SQL = {
    "p10_found": f"WITH {_WINDOWS}, d AS (SELECT DISTINCT doc_id, h FROM w SEMI JOIN shared USING (h)) SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM d a JOIN d b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p10_shares": f"""WITH {_WINDOWS}, s AS (SELECT DISTINCT doc_id, i FROM w SEMI JOIN shared USING (h)),
c AS (SELECT doc_id, sum(least(coalesce(nxt - i, 150), 150))::BIGINT AS shared_chars FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM s) GROUP BY doc_id)
SELECT doc_id, length(text) AS n_chars, coalesce(shared_chars, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(shared_chars, 0) / length(text) ELSE 0 END::DOUBLE AS shared_share FROM documents LEFT JOIN c USING (doc_id)""",
    "p4_found": rf"""
WITH r AS (
  SELECT register_id AS id, run_id, repository_id AS lib, size_bytes AS size,
    CASE WHEN source_volume_serial IS NOT NULL AND source_file_id IS NOT NULL AND hex(source_file_id) <> repeat('0', 32)
         THEN source_volume_serial::VARCHAR || ':' || hex(source_file_id) END AS ident,
    lower(nfc_normalize(regexp_extract(source_path, '[^/\\]*$'))) AS last
  FROM registers WHERE size_bytes IS NOT NULL
),
s AS (
  SELECT *, regexp_extract(last, '\.[^.]*$') AS ext,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(last, '\.[^.]*$', ''), '{_STRIP}', ''), '{_STRIP}', ''), '{_STRIP}', '') AS stem
  FROM r
)
SELECT min(a.id) AS first_id, b.id AS dup_id
FROM s a JOIN s b ON a.lib = b.lib AND a.run_id < b.run_id AND abs(a.size - b.size) * 200 <= greatest(a.size, b.size)
  AND (a.ident = b.ident OR (a.stem = b.stem AND a.ext = b.ext))
GROUP BY b.id
""",
}
