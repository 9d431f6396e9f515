"""Queries on lenses, imports, edits, tag relations, file sources and colour functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from shutterlake.functions import kernels as k
from shutterlake.functions import paths as p
from shutterlake.functions import scalars as s
from shutterlake.functions.text import fold_path, nfc
from shutterlake.operators import edits as e
from shutterlake.operators import linkage as l
from shutterlake.operators import tagging as t
from shutterlake.operators.lenses import match_lenses
from shutterlake.operators.snapshots import usable_identity
from shutterlake.plans.book import Book
from shutterlake.plans.catalog_queries import EFFECTIVE, LIVE, _effective
from shutterlake.session import drop_at_exit, shared_dir
from shutterlake.sources import files as src
from shutterlake.sources.tables import table

query = Book()

# ----- lenses and names

NUM = r"(\d+(?:\.\d+)?)"
FEATURES = rf"""
  CASE WHEN regexp_matches({{n}}, '(?i){NUM}\s*(mm)?\s*[-–—−]\s*{NUM}\s*mm') THEN regexp_extract({{n}}, '(?i){NUM}\s*(?:mm)?\s*[-–—−]\s*{NUM}\s*mm', 1) ELSE regexp_extract({{n}}, '(?i){NUM}\s*mm', 1) END AS lo,
  CASE WHEN regexp_matches({{n}}, '(?i){NUM}\s*(mm)?\s*[-–—−]\s*{NUM}\s*mm') THEN regexp_extract({{n}}, '(?i){NUM}\s*(?:mm)?\s*[-–—−]\s*{NUM}\s*mm', 2) ELSE regexp_extract({{n}}, '(?i){NUM}\s*mm', 1) END AS hi,
  regexp_extract({{n}}, '(?i)(?:^|[^a-z0-9])(?:f/?|1:)\s*{NUM}', 1) AS wide"""


@query(rf"""WITH a AS (SELECT id, camera_make, camera_model, coalesce(nullif(trim(lens), ''), CASE WHEN focal_mm IS NOT NULL THEN focal_mm::INT || 'mm' END) AS lens FROM assets),
prof AS (SELECT maker, model, {FEATURES.format(n="model")}, mounts FROM (SELECT lower(camera_make) AS maker, trim(lens) AS model, list(DISTINCT camera_model) FILTER (camera_model IS NOT NULL) AS mounts FROM assets
  WHERE camera_make IS NOT NULL AND trim(lens) <> '' GROUP BY 1, 2)),
inp AS (SELECT *, {FEATURES.format(n="lens")} FROM (SELECT DISTINCT camera_make, camera_model, lens FROM a WHERE lens IS NOT NULL AND camera_make IS NOT NULL)),
fits AS (SELECT i.*, q.model, NOT coalesce(list_contains(q.mounts, i.camera_model), false) AS away,
    len(list_filter(regexp_split_to_array(lower(i.lens), '[^a-z]+'), lambda w: length(w) >= 4 AND w NOT IN ('lens', 'vario') AND list_contains(regexp_split_to_array(lower(q.model), '[^a-z]+'), w))) AS family
  FROM inp i JOIN prof q ON q.maker = lower(i.camera_make) AND q.lo = i.lo AND q.hi = i.hi AND i.lo <> '' AND (i.wide = '' OR i.wide = q.wide)),
near AS (SELECT * FROM fits QUALIFY away = min(away) OVER (PARTITION BY camera_make, camera_model, lens)),
best AS (SELECT * FROM near QUALIFY family = max(family) OVER (PARTITION BY camera_make, camera_model, lens)),
sure AS (SELECT camera_make, camera_model, lens, min(model) AS profile FROM best GROUP BY ALL HAVING count(*) = 1 OR any_value(wide) <> '')
SELECT a.id, u.profile FROM a JOIN sure u ON a.camera_make = u.camera_make AND a.camera_model IS NOT DISTINCT FROM u.camera_model AND a.lens = u.lens""")
def lens_match(spark, root):
    """Photos whose lens, or if it is unknown its focal length, one lens of the maker fits; the lenses seen are the profiles, the cameras they were seen on their mounts."""
    a = table(spark, root, "assets")
    named = F.coalesce(F.nullif(F.trim("lens"), F.lit("")), F.when(F.col("focal_mm").isNotNull(), F.concat(F.col("focal_mm").cast("int").cast("string"), F.lit("mm"))))
    profiles = a.where("camera_make is not null and trim(lens) <> ''").groupBy(F.col("camera_make").alias("maker"), F.trim("lens").alias("model")).agg(F.collect_set("camera_model").alias("mounts"))
    photos = a.select("id", "camera_make", "camera_model", named.alias("lens")).where("lens is not null and camera_make is not null")
    m = match_lenses(photos, profiles).toDF("m_make", "m_model", "m_lens", "profile")
    same = (F.col("camera_make") == F.col("m_make")) & F.col("camera_model").eqNullSafe(F.col("m_model")) & (F.col("lens") == F.col("m_lens"))
    return photos.join(m, same).select("id", "profile")


RECENT = [101, 7, 30]


@query(r"""WITH RECURSIVE x AS (SELECT id, 0 AS kw, lower(name) AS t FROM tags WHERE name IS NOT NULL UNION ALL SELECT id, 1, lower(name_folded) FROM tags WHERE name_folded IS NOT NULL AND name IS NOT NULL),
q AS (SELECT id, kw, t, n FROM x, (VALUES ('an er'), ('aner')) AS v(n)),
step AS (SELECT id, kw, t, n, 0 AS i, 0 AS score, 0 AS streak, 0 AS m, -1 AS f FROM q
  UNION ALL SELECT id, kw, t, n, i + 1, CASE WHEN hit THEN score + 10 + 5 * (streak + 1) + CASE WHEN i = 0 OR regexp_matches(t[i], '[\s·/\\|,.\-_:]') THEN 8 ELSE 0 END ELSE score END,
    CASE WHEN hit THEN streak + 1 WHEN m < length(n) THEN 0 ELSE streak END, m + hit::INT, CASE WHEN hit AND f < 0 THEN i ELSE f END
  FROM (SELECT *, m < length(n) AND t[i + 1] = n[m + 1] AS hit FROM step WHERE i < length(t))),
sub AS (SELECT id, kw, n, CASE WHEN m < length(n) THEN -1.0 ELSE score - least(f, 20) END AS v FROM step WHERE i = length(t)),
best AS (SELECT g.id, g.name, v.n, CASE WHEN lower(name) = v.n THEN 1000.0 WHEN starts_with(lower(name), v.n) THEN 800.0 - least(length(name) - length(v.n), 100)
    ELSE greatest(coalesce((SELECT max(v) FROM sub WHERE sub.id = g.id AND kw = 0 AND sub.n = v.n), -1.0), coalesce((SELECT max(CASE WHEN v < 0 THEN -1.0 ELSE v * 0.7 END) FROM sub WHERE sub.id = g.id AND kw = 1 AND sub.n = v.n), -1.0)) END AS s
  FROM tags g, (VALUES ('an er'), ('aner')) AS v(n) WHERE name IS NOT NULL)
SELECT id, name, round(max(s) + CASE id WHEN 101 THEN 20 WHEN 7 THEN 17 WHEN 30 THEN 14 ELSE 0 END, 6)::DOUBLE AS score FROM best GROUP BY id, name HAVING max(s) >= 0""")
def match_scores(spark, root):
    x = table(spark, root, "tags").withColumn("m", s.match_score(" An Er ", F.col("name"), keywords=[F.col("name_folded")]))
    return x.where("m is not null").select("id", "name", F.round(F.col("m") + s.recent_boost(F.col("id"), RECENT), 6).alias("score"))


@query(r"""SELECT id, CASE WHEN length(trim(name, E' \t\n\r')) BETWEEN 1 AND 64 THEN trim(name, E' \t\n\r') END AS clean, lower(nfc_normalize(trim(name, E' \t\n\r'))) AS tag_key FROM tags WHERE name IS NOT NULL AND regexp_matches(name, '^[\x20-\x7e]*$')
UNION ALL SELECT id, NULL, NULL FROM tags WHERE name IS NULL OR NOT regexp_matches(name, '^[\x20-\x7e]*$')""")
def clean_names(spark, root):
    """Names of printable ASCII are cleaned and folded; others have a key of their own elsewhere (see the look-alikes)."""
    plain = F.coalesce(F.col("name").rlike(r"^[\x20-\x7e]*$"), F.lit(False))
    return table(spark, root, "tags").select("id", F.when(plain, s.clean_name(F.col("name"))).alias("clean"), F.lower(nfc(F.when(plain, F.regexp_replace("name", r"^\s+|\s+$", "")))).alias("tag_key"))


@query("""SELECT id, strftime(make_timestamp(imported_at // 1000 * 1000000), '%Y%m%d-%H%M%SZ') AS compact, strftime(make_timestamp(imported_at // 1000 * 1000000), '%Y-%m-%d %H:%M:%S UTC') AS human,
  strftime(make_timestamp(imported_at // 1000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM assets""")
def utc_formats(spark, root):
    return table(spark, root, "assets").select("id", *[s.utc_format(F.col("imported_at"), f).alias(f) for f in ("compact", "human", "iso")])


@query("""SELECT problem, count(*) AS n FROM (SELECT CASE WHEN rating IS NULL OR rating NOT BETWEEN 0 AND 5 THEN 'rating' WHEN color_label NOT IN ('red', 'yellow', 'green', 'cyan', 'blue', 'purple') THEN 'color'
  WHEN like_state NOT IN ('like', 'dislike') THEN 'like' WHEN lock_level IS NULL OR lock_level NOT BETWEEN 0 AND 2 THEN 'lock' END AS problem FROM assets) GROUP BY problem""")
def marking_problems(spark, root):
    return table(spark, root, "assets").groupBy(s.marking_problem(F.col("rating"), F.col("color_label"), F.col("like_state"), F.col("lock_level")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


# ----- imports

PLANNED = r"""pl AS (SELECT id, regexp_replace(rel_path_folded, '/[^/]*$', '') AS dir, regexp_replace(regexp_extract(rel_path_folded, '[^/]*$'), '^(.+)\.[^.]*$', '\1') AS stem, role = 'bitmap' AS bitmap,
  lower(coalesce(recycled_from, rel_path)) AS key, size_bytes AS size, content_hash AS hash FROM asset_files WHERE role <> 'sidecar'),
ex AS (SELECT rel_path_folded AS key, min({'s': size_bytes, 'h': content_hash}) AS e FROM asset_files WHERE missing_since IS NULL GROUP BY 1),
v AS (SELECT p.*, CASE WHEN p.id <> min(p.id) OVER (PARTITION BY nfc_normalize(p.key)) THEN 'conflict' WHEN ex.e IS NULL THEN 'free' WHEN p.size = (ex.e).s AND p.hash = (ex.e).h THEN 'skip' ELSE 'conflict' END AS verdict
  FROM pl p LEFT JOIN ex ON ex.key = nfc_normalize(p.key))"""


@query(f"""WITH {PLANNED} SELECT id, coalesce(min(id) FILTER (bitmap) OVER w, min(id) OVER w) AS leader, verdict, bool_or(verdict = 'conflict') OVER w AS group_conflict FROM v WINDOW w AS (PARTITION BY dir, stem)""")
def import_plan(spark, root):
    """All photographs of the catalogue imported again, recycled ones to where they came from, against the files that are on disk."""
    f = table(spark, root, "asset_files")
    x = F.col("rel_path_folded")
    key = fold_path(F.coalesce("recycled_from", "rel_path")).alias("key")
    planned = f.where("role <> 'sidecar'").select("id", p.parent(x).alias("dir"), p.stem(x).alias("stem"), (F.col("role") == "bitmap").alias("bitmap"), key, F.col("size_bytes").alias("size"), F.col("content_hash").alias("hash"))
    existing = f.where("missing_since is null").select(x.alias("key"), F.col("size_bytes").alias("size"), F.col("content_hash").alias("hash"))
    return l.import_plan(planned, existing)


@query(r"""WITH r AS (SELECT register_id AS id, run_id, repository_id || ':' || CASE WHEN source_volume_serial IS NOT NULL AND source_file_id IS NOT NULL AND hex(source_file_id) <> repeat('0', 32)
    THEN source_volume_serial::VARCHAR || ':' || hex(source_file_id) END AS ident, repository_id || ':' || nfc_normalize(lower(replace(source_path, chr(92), '/'))) AS path, size_bytes AS size, mtime_ms AS mtime FROM registers),
m AS (SELECT max(run_id) // 2 AS m FROM r), h AS (SELECT r.* FROM r, m WHERE run_id <= m), n AS (SELECT r.* FROM r, m WHERE run_id > m)
SELECT id, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.ident = n.ident) THEN 'identity' ELSE 'path' END AS known_by FROM n
WHERE EXISTS (SELECT 1 FROM h WHERE h.ident = n.ident) OR EXISTS (SELECT 1 FROM h WHERE h.path = n.path AND h.size IS NOT DISTINCT FROM n.size AND h.mtime IS NOT DISTINCT FROM n.mtime)""")
def known_sources(spark, root):
    """Operations of the later half of the runs whose source the earlier half has registered."""
    r = table(spark, root, "registers")
    ident = F.when(usable_identity(F.col("source_volume_serial"), F.col("source_file_id")), F.concat_ws(":", "repository_id", F.col("source_volume_serial").cast("string"), F.hex("source_file_id")))
    path = F.concat(F.col("repository_id"), F.lit(":"), fold_path("source_path"))
    r = r.select(F.col("register_id").alias("id"), "run_id", ident.alias("ident"), path.alias("path"), F.col("size_bytes").alias("size"), F.col("mtime_ms").alias("mtime"))
    middle = (r.agg(F.max("run_id")).first()[0] or 0) // 2
    return l.known_sources(r.where(F.col("run_id") > middle), r.where(F.col("run_id") <= middle))


STAGES = ["preparing", "opening", "rendering", "writing", "opened", "failed", "cancelled"]
FINAL = ["opened", "failed", "cancelled"]
_RANK = "CASE status " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(STAGES)) + " END"


@query(f"""WITH last AS (SELECT id, (max({{'e': emitted_at, 'r': revision, 's': status}})).s AS status FROM task_states GROUP BY id),
j AS (SELECT repository_id, status, status IN ('opened', 'failed', 'cancelled') AS final, {_RANK} AS rank FROM external_tasks JOIN last USING (id))
SELECT repository_id, count(*) AS n_tasks, count(*) FILTER (final) AS n_final, coalesce(arg_max(status, rank) FILTER (NOT final), arg_max(status, rank)) AS stage FROM j GROUP BY repository_id""")
def stage_progress(spark, root):
    """Tasks of each library by their last state; the stage is the furthest of those not final, else of all."""
    last = table(spark, root, "task_states").groupBy("id").agg(F.max(F.struct("emitted_at", "revision", "status")).alias("l")).select("id", "l.status")
    j = table(spark, root, "external_tasks").join(last, "id").withColumns({"final": F.col("status").isin(FINAL), "rank": F.array_position(F.array(*map(F.lit, STAGES)), F.col("status"))})
    open_, all_ = F.max_by("status", F.when(~F.col("final"), F.col("rank"))), F.max_by("status", "rank")
    open_ = F.when(F.count_if(~F.col("final")) > 0, open_)
    return j.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n_tasks"), F.count_if("final").alias("n_final"), F.coalesce(open_, all_).alias("stage"))


# ----- edits and versions


@query(f"""WITH x AS (SELECT asset_id, max(CASE flag WHEN 'pick' THEN 5 WHEN 'none' THEN 3 ELSE 1 END) AS rating FROM flag_marks WHERE asset_id IS NOT NULL GROUP BY 1)
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN a.id IS NULL THEN 'unknown' WHEN coalesce(lock_level, 0) >= 2 THEN 'locked' WHEN a.rating IS NOT DISTINCT FROM x.rating THEN 'unchanged' ELSE 'applied' END AS outcome
  FROM x LEFT JOIN assets a ON a.id = x.asset_id) GROUP BY 1""")
def edit_report(spark, root):
    return e.apply_edits(table(spark, root, "assets"), _ratings(spark, root), ["rating"])[1].groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def _ratings(spark, root):
    """Every mark as an edit of the rating: five for a pick, three for none, one for a reject."""
    m = table(spark, root, "flag_marks").where("asset_id is not null")
    return m.select("asset_id", F.when(F.col("flag") == "pick", 5).when(F.col("flag") == "none", 3).otherwise(1).cast("long").alias("rating"))


@query("""WITH x AS (SELECT asset_id, max(CASE flag WHEN 'pick' THEN 5 WHEN 'none' THEN 3 ELSE 1 END) AS rating FROM flag_marks WHERE asset_id IS NOT NULL GROUP BY 1)
SELECT a.id, CASE WHEN x.asset_id IS NOT NULL AND coalesce(a.lock_level, 0) < 2 THEN x.rating ELSE a.rating END::BIGINT AS rating FROM assets a LEFT JOIN x ON x.asset_id = a.id""")
def edited_ratings(spark, root):
    return e.apply_edits(table(spark, root, "assets"), _ratings(spark, root), ["rating"])[0].select("id", F.col("rating").cast("long").alias("rating"))


@query("SELECT DISTINCT a.id FROM assets a WHERE lock_level >= 1 AND EXISTS (SELECT 1 FROM external_tasks x WHERE x.asset_id = a.id)")
def locked_for_move(spark, root):
    return e.locked_for_move(table(spark, root, "assets"), table(spark, root, "external_tasks"))


@query("""SELECT a.id, CASE WHEN deleted_at IS NULL AND coalesce(lock_level, 0) < 1 AND EXISTS (SELECT 1 FROM flag_marks m WHERE m.asset_id = a.id AND m.flag = 'reject') THEN 1700000000000 ELSE deleted_at END AS deleted_at FROM assets a""")
def recycle_rejects(spark, root):
    return e.recycle(table(spark, root, "assets"), table(spark, root, "flag_marks").where("flag = 'reject'"), 1_700_000_000_000).select("id", "deleted_at")


@query("SELECT f.id, coalesce(f.recycled_from, f.rel_path) AS rel_path FROM asset_files f JOIN assets a ON a.id = f.asset_id WHERE a.deleted_at IS NOT NULL")
def restore_recycled(spark, root):
    a = table(spark, root, "assets")
    gone = a.where("deleted_at is not null").select(F.col("id").alias("asset_id"))
    files = e.restore(a, table(spark, root, "asset_files"), gone)[1]
    return files.join(gone, "asset_id", "left_semi").select("id", "rel_path")


_LISTING = """f AS (SELECT repository_id, snapshot_no, repository_id || ':' || nfc_normalize(lower(replace(rel_path, chr(92), '/'))) AS key, rel_path, size_bytes, mtime_ms FROM rescan_files),
l AS (SELECT repository_id, max(snapshot_no) AS last, max(snapshot_no) FILTER (snapshot_no < m) AS before FROM (SELECT *, max(snapshot_no) OVER (PARTITION BY repository_id) AS m FROM f) GROUP BY 1),
n AS (SELECT key, min({'p': rel_path, 's': size_bytes, 't': mtime_ms}) AS n FROM f JOIN l ON f.repository_id = l.repository_id AND snapshot_no = last GROUP BY key),
o AS (SELECT key, min({'p': rel_path, 's': size_bytes, 't': mtime_ms}) AS o FROM f JOIN l ON f.repository_id = l.repository_id AND snapshot_no = before GROUP BY key)"""


@query(f"""WITH {_LISTING} SELECT coalesce(n.key, o.key) AS key, CASE WHEN n IS NOT NULL THEN (n).p ELSE (o).p END AS rel_path, CASE WHEN n IS NOT NULL THEN (n).s ELSE (o).s END AS size_bytes,
  CASE WHEN n IS NOT NULL THEN (n).t ELSE (o).t END AS mtime_ms, CASE WHEN n IS NULL THEN 1700000000000 END AS missing_since FROM (SELECT n.key AS nk, * FROM n) n FULL JOIN o ON n.key = o.key""")
def applied_snapshot(spark, root):
    """The last delivery of each library applied to the files of the one before."""
    f = table(spark, root, "rescan_files").withColumn("key", F.concat(F.col("repository_id"), F.lit(":"), fold_path("rel_path")))
    no = f.select("repository_id", "snapshot_no").distinct()
    place = F.row_number().over(Window.partitionBy("repository_id").orderBy(F.col("snapshot_no").desc()))
    two = no.withColumn("place", place).where("place <= 2")
    f = f.join(two, ["repository_id", "snapshot_no"]).select("key", "rel_path", "size_bytes", "mtime_ms", "place")
    before = f.where("place = 2").groupBy("key").agg(F.min(F.struct("rel_path", "size_bytes", "mtime_ms")).alias("r")).select("key", "r.*").withColumn("missing_since", F.lit(None).cast("long"))
    return e.apply_snapshot(before, f.where("place = 1"), 1_700_000_000_000)


# ----- orders and worklists


@query(f"SELECT DISTINCT f.asset_id FROM asset_files f JOIN assets a ON a.id = f.asset_id WHERE f.missing_since IS NULL AND (a.width IS NULL OR a.height IS NULL) AND f.asset_id > 1500 ORDER BY 1 LIMIT 64")
def missing_sizes(spark, root):
    """The next 64 photos after a cursor whose size is not known and whose files are there."""
    unsized = table(spark, root, "assets").where("(width is null or height is null) and id > 1500").select(F.col("id").alias("asset_id"))
    return table(spark, root, "asset_files").where("missing_since is null and asset_id > 1500").select("asset_id").distinct().join(unsized, "asset_id", "left_semi").orderBy("asset_id").limit(64)


@query("""SELECT f.id, f.asset_id, row_number() OVER (PARTITION BY f.asset_id ORDER BY f.role = 'raw', f.rel_path) AS place FROM asset_files f JOIN assets a ON a.id = f.asset_id WHERE a.taken_at IS NULL AND f.missing_since IS NULL""")
def backfill_order(spark, root):
    """Files to read for photos without a time, bitmaps before raws; a photo has few files."""
    untimed = table(spark, root, "assets").where("taken_at is null").select(F.col("id").alias("asset_id"))
    f = table(spark, root, "asset_files").where("missing_since is null").join(untimed, "asset_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("asset_id").orderBy(F.col("role") == "raw", "rel_path"))
    return f.select("id", "asset_id", place.cast("long").alias("place"))


@query("SELECT id, asset_id FROM external_tasks WHERE removed_at IS NULL ORDER BY reserved_at DESC, id LIMIT 1")
def queue_head(spark, root):
    return table(spark, root, "external_tasks").where("removed_at is null").orderBy(F.col("reserved_at").desc(), "id").limit(1).select("id", "asset_id")


@query("""SELECT repository_id, count(*) AS uses, max(created_at)::VARCHAR AS last_use FROM new_assets GROUP BY 1 ORDER BY uses DESC, max(created_at) DESC, 1 LIMIT 20""")
def frequent_recents(spark, root):
    g = table(spark, root, "new_assets").groupBy("repository_id").agg(F.count(F.lit(1)).alias("uses"), F.max("created_at").alias("at"))
    text = F.regexp_replace(F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    return g.orderBy(F.col("uses").desc(), F.col("at").desc(), "repository_id").limit(20).select("repository_id", "uses", text.alias("last_use"))


@query("""SELECT id, row_number() OVER (ORDER BY pinned DESC, (rule IS NOT NULL) DESC, name_folded, id) AS place FROM (SELECT id, name_folded, use_count > 20 AS pinned, CASE WHEN use_count > 5 THEN name END AS rule FROM tags
  WHERE name_folded IS NOT NULL) ORDER BY place LIMIT 200""")
def collection_list(spark, root):
    """The first page of collections, here the tags: pinned if used more than 20 times, with a rule if more than 5."""
    c = table(spark, root, "tags").where("name_folded is not null").select("id", "name_folded", (F.col("use_count") > 20).alias("pinned"), F.when(F.col("use_count") > 5, F.col("name")).alias("rule"))
    page = t.collection_order(c).limit(200)
    order = Window.orderBy(F.col("pinned").desc(), F.col("rule").isNotNull().desc(), "name_folded", "id")
    return page.select("id", F.row_number().over(order).cast("long").alias("place"))


@query("""WITH r AS (SELECT trim(city) AS v, 0 AS tier FROM assets WHERE trim(city) <> '' GROUP BY 1 ORDER BY max(updated_at) DESC, 1 LIMIT 5), c AS (SELECT trim(city) AS v, 1 AS tier FROM assets WHERE trim(city) <> '' GROUP BY 1),
u AS (SELECT v, min(tier) AS tier FROM (SELECT * FROM r UNION ALL SELECT * FROM c) GROUP BY v), h AS (SELECT *, starts_with(lower(v), 'o') AS pre, contains(lower(v), 'o') AS sub FROM u)
SELECT v AS value, tier FROM h WHERE CASE WHEN (SELECT bool_or(pre) FROM h) THEN pre ELSE sub END""")
def suggestion_filter(spark, root):
    """Suggestions that start with what was typed; if none does, those that hold it."""
    a = table(spark, root, "assets").select(F.trim("city").alias("value"), "updated_at").where("value <> ''")
    last = a.groupBy("value").agg(F.max("updated_at").alias("at"))
    both = last.orderBy(F.col("at").desc(), "value").limit(5).select("value", F.lit(0).alias("tier")).unionByName(last.select("value", F.lit(1).alias("tier")))
    return _suggest(both.groupBy("value").agg(F.min("tier").alias("tier")), " O ")


def _suggest(values, typed):
    n = typed.strip().lower()
    v = values.withColumns({"pre": F.lower("value").startswith(n), "sub": F.contains(F.lower("value"), F.lit(n))}).where("sub")
    some = v.agg(F.coalesce(F.max("pre"), F.lit(False)).alias("some"))  # one row
    return v.join(F.broadcast(some), F.col("pre") | ~F.col("some")).select("value", "tier")


@query(f"""SELECT a.id, last.status, coalesce(a.taken_at, f.t) AS shown_at FROM assets a LEFT JOIN (SELECT x.asset_id, (max({{'i': x.id, 'e': s.emitted_at, 'r': s.revision, 's': s.status}})).s AS status FROM external_tasks x JOIN task_states s ON s.id = x.id GROUP BY 1) last ON last.asset_id = a.id
LEFT JOIN (SELECT asset_id, min(coalesce(file_created_ms, mtime_ms)) AS t FROM asset_files GROUP BY 1) f ON f.asset_id = a.id WHERE {LIVE}""")
def stacked_rows(spark, root):
    """Live photos with the state of their last edit (one to one) and their time, computed from the files where it isn't stored."""
    x = table(spark, root, "external_tasks").join(table(spark, root, "task_states").select("id", "emitted_at", "revision", "status"), "id")
    last = x.groupBy("asset_id").agg(F.max(F.struct("id", "emitted_at", "revision", "status")).alias("l")).select(F.col("asset_id").alias("x"), "l.status")
    files = table(spark, root, "asset_files").groupBy(F.col("asset_id").alias("y")).agg(F.min(F.coalesce("file_created_ms", "mtime_ms")).alias("t"))
    a = table(spark, root, "assets").where("deleted_at is null")
    return a.join(last, F.col("id") == F.col("x"), "left").join(files, F.col("id") == F.col("y"), "left").select("id", "status", F.coalesce("taken_at", "t").alias("shown_at"))


@query("""SELECT r.repository_id, coalesce(n.n, 0) AS n_live, CASE WHEN last_opened_at IS NULL THEN 'never opened' WHEN coalesce(n.n, 0) = 0 THEN 'empty' ELSE 'in use' END AS state FROM repositories r
LEFT JOIN (SELECT repository_id, count(*) AS n FROM assets WHERE deleted_at IS NULL GROUP BY 1) n USING (repository_id)""")
def repository_states(spark, root):
    n = table(spark, root, "assets").where("deleted_at is null").groupBy("repository_id").agg(F.count(F.lit(1)).alias("n"))
    live = F.coalesce("n", F.lit(0))
    state = F.when(F.col("last_opened_at").isNull(), "never opened").when(live == 0, "empty").otherwise("in use")
    return table(spark, root, "repositories").join(n, "repository_id", "left").select("repository_id", live.alias("n_live"), state.alias("state"))


@query("""SELECT id, asset_id, CASE WHEN n = 1 THEN 'only' WHEN role = 'raw' THEN 'raw' ELSE 'I' || lpad(place::VARCHAR, 2, '0') END AS suffix FROM (SELECT f.id, f.asset_id, f.role, count(*) OVER (PARTITION BY f.asset_id) AS n,
  row_number() OVER (PARTITION BY f.asset_id, f.role ORDER BY f.id) AS place FROM (SELECT * FROM asset_files WHERE role <> 'sidecar' QUALIFY row_number() OVER (PARTITION BY asset_id, coalesce(content_hash, 'file-' || id) ORDER BY role, id) = 1) f)""")
def export_names(spark, root):
    """The mark each different image of a photo gets in its exported name: none's alone, the raw, or the number of the bitmap."""
    f = table(spark, root, "asset_files").where("role <> 'sidecar'").withColumn("hash", F.coalesce("content_hash", F.concat(F.lit("file-"), F.col("id").cast("string"))))
    f = f.groupBy("asset_id", "hash").agg(F.min(F.struct("role", "id")).alias("f")).select("asset_id", "f.*")
    place = F.row_number().over(Window.partitionBy("asset_id", "role").orderBy("id"))
    f = f.withColumns({"n": F.count(F.lit(1)).over(Window.partitionBy("asset_id")), "place": place})
    return f.select("id", "asset_id", F.when(F.col("n") == 1, "only").when(F.col("role") == "raw", "raw").otherwise(F.format_string("I%02d", "place")).alias("suffix"))


@query("""SELECT content_hash, min(id) AS id FROM asset_files WHERE role = 'raw' AND content_hash IS NOT NULL AND content_hash NOT IN (SELECT content_hash FROM asset_files WHERE role = 'bitmap' AND content_hash IS NOT NULL) GROUP BY 1""")
def admitted_contents(spark, root):
    """Raw files as offers to a dictionary of contents that holds the bitmaps: those of a new hash are admitted, the first of each."""
    f = table(spark, root, "asset_files").where("content_hash is not null")
    return l.admit(f.where("role = 'bitmap'"), f.where("role = 'raw'"), "content_hash", "id").select("content_hash", "id")


@query("""WITH r AS (SELECT repository_id AS scope, max(created_at) AS asked FROM new_assets GROUP BY 1), a AS (SELECT repository_id AS scope, max(reserved_at) AS done FROM external_tasks GROUP BY 1)
SELECT scope FROM r LEFT JOIN a USING (scope) WHERE done IS NULL OR done < asked""")
def pending_rescans(spark, root):
    """Libraries with an import after their last task, as rescans asked for and not yet acknowledged."""
    asked = table(spark, root, "new_assets").select(F.col("repository_id").alias("scope"), F.col("created_at").alias("at"))
    done = table(spark, root, "external_tasks").select(F.col("repository_id").alias("scope"), F.col("reserved_at").alias("at"))
    return l.pending(asked, done)


@query("""WITH x AS (SELECT id, imported_at AS t FROM assets), d AS (SELECT id, list_reverse(list_transform(range(9), lambda i: ((t * 100) // pow(62, i)::BIGINT) % 62)) AS n FROM x)
SELECT id, array_to_string(list_transform(n, lambda k: '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'[k::INT + 1]), '') AS time_part, 16 AS n_chars FROM d""")
def sortable_ids(spark, root):
    a = table(spark, root, "assets").select("id", s.sortable_id(F.col("imported_at"), F.col("id")).alias("s"))
    return a.select("id", F.substring("s", 1, 9).alias("time_part"), F.length("s").alias("n_chars"))


# ----- tag relations

_DIRS = r"SELECT DISTINCT regexp_replace(rel_path, '/[^/]*$', '') AS d, lower(ext) AS k FROM asset_files WHERE ext IS NOT NULL"


@query(rf"SELECT k AS tag_key, count(*) AS n_directories FROM ({_DIRS}) WHERE starts_with(d, 'photos/') AND NOT regexp_matches(d, '(^|/)(\.|\.\.|)(/|$)') AND NOT contains(d, chr(92)) GROUP BY 1")
def directory_tag_counts(spark, root):
    """Directories by the kinds of files they hold, as tags of their own."""
    f = table(spark, root, "asset_files").select(p.parent(F.col("rel_path")).alias("directory_key"), F.lower("ext").alias("tag_key"))
    return t.directory_tag_counts(f)


_TERMS = "terms AS (SELECT * FROM (VALUES ('pick', 1), ('reject', 2), ('none', NULL)) AS v(tag_key, tag_id))"


@query(f"""WITH {EFFECTIVE}, {_TERMS}, legacy AS (SELECT asset_id, row_no % 4 + 1 AS tag_id FROM new_assets)
SELECT e.asset_id, t.tag_id::INT AS tag_id FROM effective e JOIN terms t USING (tag_key) WHERE t.tag_id IS NOT NULL UNION SELECT asset_id, tag_id::INT FROM legacy WHERE tag_id NOT IN (SELECT tag_id FROM terms WHERE tag_id IS NOT NULL)""")
def effective_tag_ids(spark, root):
    terms = spark.createDataFrame([("pick", 1), ("reject", 2), ("none", None)], "tag_key string, tag_id int")
    legacy = table(spark, root, "new_assets").select("asset_id", (F.col("row_no") % 4 + 1).cast("int").alias("tag_id"))
    return t.effective_ids(_effective(spark, root), terms, legacy)


_RESULTS = """cur AS (SELECT id AS asset_id, coalesce(camera_model, '') AS source_key, 'old' AS payload, true AS valid FROM assets),
att AS (SELECT DISTINCT asset_id, id AS token, repository_id AS source_key FROM external_tasks),
off AS (SELECT x.asset_id, s.id AS token, x.repository_id AS source_key, s.status AS payload FROM task_states s JOIN external_tasks x ON x.id = s.id WHERE s.status IN ('opened', 'failed')),
taken AS (SELECT o.asset_id, min(o.payload) AS payload, arg_min(o.source_key, (o.payload, o.source_key)) AS source_key FROM off o JOIN att USING (asset_id, token, source_key) GROUP BY 1),
res AS (SELECT * FROM cur WHERE asset_id NOT IN (SELECT asset_id FROM taken) UNION ALL SELECT asset_id, source_key, payload, true FROM taken)"""


def _results(spark, root):
    a, x = table(spark, root, "assets"), table(spark, root, "external_tasks")
    current = a.select(F.col("id").alias("asset_id"), F.coalesce("camera_model", F.lit("")).alias("source_key"), F.lit("old").alias("payload"), F.lit(True).alias("valid"))
    states = table(spark, root, "task_states").where(F.col("status").isin("opened", "failed")).select(F.col("id").alias("token"), F.col("status").alias("payload"))
    attempts = x.select("asset_id", F.col("id").alias("token"), F.col("repository_id").alias("source_key"))
    return t.commit_results(current, attempts.join(states, "token"), attempts)


@query(f"WITH {_RESULTS} SELECT * FROM res")
def committed_results(spark, root):
    """Results of tasks by asset, replaced where an attempt of the same task and library is open."""
    return _results(spark, root)


@query(f"WITH {_RESULTS} SELECT r.asset_id, r.source_key, r.valid AND coalesce(r.source_key = n.now, true) AS valid FROM res r LEFT JOIN (SELECT asset_id, max(repository_id) AS now FROM new_assets GROUP BY 1) n USING (asset_id)")
def invalidated_results(spark, root):
    now = table(spark, root, "new_assets").select("asset_id", F.col("repository_id").alias("current_source"))
    return t.invalidate_results(_results(spark, root), now).select("asset_id", "source_key", "valid")


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_id <= 5000 ORDER BY event_id LIMIT 1024)")
def pruned_log(spark, root):
    return t.prune_log(table(spark, root, "events"), 5000).select("event_id")


TAG_RULE = [t.Group(("eHO7KpUEu4BcA5cz",), min_rating=1, tag_keys=("Pick", "none")), t.Group(("yREhggL42rKRh00y", "eHO7KpUEu4BcA5cz"), colors=("blue",))]


@query(f"""WITH {EFFECTIVE} SELECT repository_id, id AS asset_id FROM assets a WHERE {LIVE} AND (repository_id = 'eHO7KpUEu4BcA5cz' AND rating >= 1 AND EXISTS (SELECT 1 FROM effective e WHERE e.asset_id = a.id AND e.tag_key IN ('pick', 'none'))
  OR repository_id IN ('eHO7KpUEu4BcA5cz', 'yREhggL42rKRh00y') AND color_label = 'blue')""")
def rule_with_tags(spark, root):
    return t.rule_matches(table(spark, root, "assets"), TAG_RULE, _effective(spark, root))


# ----- file sources


@query(r"""SELECT skip, count(*) AS n FROM (SELECT CASE WHEN contains(n, ':') OR n IN ('thumbs.db', 'desktop.ini', '.ds_store') OR starts_with(n, '._') OR starts_with(n, '~$') OR ends_with(n, '.tmp') THEN 'junk'
  WHEN regexp_matches(target_rel, '(^|/)\.') THEN 'hidden' WHEN row_no % 7 = 0 THEN 'empty' WHEN NOT regexp_matches(n, '\.(ari|cr3|cr2|crw|erf|raf|3fr|kdc|dcs|dcr|iiq|mos|mef|mrw|nef|nrw|orf|rw2|pef|srw|arw|srf|sr2|dng|jpg|jpeg|png|webp|tif|tiff|heif|heic|avif)$') THEN 'not a photo' END AS skip
  FROM (SELECT row_no, target_rel, lower(regexp_extract(target_rel, '[^/\\]*$')) AS n FROM new_assets)) WHERE skip IS NOT NULL GROUP BY skip""")
def skip_reasons(spark, root):
    """Targets of imports as a listing; every seventh is taken as an empty file."""
    n = table(spark, root, "new_assets").select(F.col("target_rel").alias("rel_path"), F.when(F.col("row_no") % 7 == 0, 0).otherwise(1).alias("size_bytes"))
    return src.skip_counts(n)


@query("""WITH g AS (SELECT city, round(avg(gps_lat), 3) AS lat, round(avg(gps_lon), 3) AS lon, count(*) AS n FROM assets WHERE trim(city) <> '' AND gps_lat IS NOT NULL AND gps_lon IS NOT NULL GROUP BY city)
SELECT city AS name, lat, lon, CASE WHEN n > 3 THEN n ELSE 0 END::BIGINT AS population FROM g""")
def gazetteer(spark, root):
    """Cities written as a tab-separated gazetteer, with comments, short and bad lines, and read back."""
    a = table(spark, root, "assets").where("trim(city) <> '' and gps_lat is not null and gps_lon is not null")
    g = a.groupBy("city").agg(F.round(F.avg("gps_lat"), 3).alias("lat"), F.round(F.avg("gps_lon"), 3).alias("lon"), F.count(F.lit(1)).alias("n"))
    people = F.when(F.col("n") > 3, F.col("n").cast("string")).otherwise("many")
    fields = [F.lit("7"), F.col("city"), F.lit("x"), F.lit(""), F.col("lat").cast("string"), F.col("lon").cast("string"), F.lit("P"), F.lit("PPL"), F.lit("XX"), *[F.lit("")] * 5, people]
    bad = spark.createDataFrame([("# a comment",), ("",), ("1\tshort",), ("2\tfar\t\t\t95.0\t10.0\tP\tPPL\tXX\t\t\t\t\t\t5",)], "value string")
    path = shared_dir(spark, "gazetteer")
    g.select(F.concat_ws("\t", *fields).alias("value")).unionByName(bad).write.text(path)
    drop_at_exit(spark, path)
    return src.read_gazetteer(spark, path).select("name", "lat", "lon", "population")


@query("""SELECT id, CASE WHEN rating BETWEEN 0 AND 5 THEN rating END::INT AS rating, CASE WHEN lower(color_label) IN ('red', 'yellow', 'green', 'cyan', 'blue', 'purple') THEN lower(color_label) END AS color_label,
  nullif(trim(city), '') AS city, nullif(trim(country), '') AS country FROM assets""")
def sidecar_round_trip(spark, root):
    """Markings written as sidecars and read back."""
    a = table(spark, root, "assets")
    xml = src.compose_sidecar(F.col("rating"), F.col("color_label"), F.col("city"), F.col("country"), F.array(F.lit("a & b"), F.lit("<c>")))
    return src.parse_sidecars(a.select("id", xml.alias("xml"))).select("id", "rating", "color_label", "city", "country")


@query("""WITH s AS (SELECT DISTINCT asset_id FROM asset_files WHERE role = 'sidecar'), t AS (SELECT asset_id FROM external_tasks UNION SELECT asset_id FROM flag_marks WHERE flag = 'pick')
SELECT a.id, CASE WHEN hit THEN 4 ELSE rating END::BIGINT AS rating, CASE WHEN hit THEN 'found' ELSE author END AS author FROM (SELECT *, id IN (SELECT asset_id FROM s) AND id NOT IN (SELECT asset_id FROM t WHERE asset_id IS NOT NULL)
  AND coalesce(rating, 0) = 0 AND coalesce(author, '') IN ('', '0') AS hit FROM assets) a""")
def adopted_sidecars(spark, root):
    """Photos with a sidecar that nobody has marked, edited or picked take its rating and author."""
    a, f = table(spark, root, "assets"), table(spark, root, "asset_files")
    said = f.where("role = 'sidecar'").select("asset_id", F.lit(4).cast(dict(a.dtypes)["rating"]).alias("rating"), F.lit("found").alias("author")).distinct()
    touched = table(spark, root, "external_tasks").select("asset_id").unionByName(table(spark, root, "flag_marks").where("flag = 'pick'").select("asset_id"))
    return src.adopt_sidecars(a, said, ["rating", "author"], touched).select("id", F.col("rating").cast("long").alias("rating"), "author")


@query("""WITH b AS (SELECT r_regionkey, repeat(r_name || '|', 700000) AS s FROM region), n AS (SELECT *, length(s) AS n, 1048576 AS m FROM b)
SELECT r_regionkey, CASE WHEN n <= 3 * m THEN sha256(s) ELSE sha256(unhex(regexp_replace(lpad(hex(n), 16, '0'), '(..)(..)(..)(..)(..)(..)(..)(..)', '\\8\\7\\6\\5\\4\\3\\2\\1')) || encode(substr(s, 1, m)) || encode(substr(s, (n - m) // 2 + 1, m)) || encode(substr(s, n - m + 1, m))) END AS digest FROM n""")
def sampled_fingerprint(spark, root):
    """Contents of a few megabytes: above three pieces only head, middle and tail are hashed, with the size."""
    return table(spark, root, "region").select("r_regionkey", s.sampled_sha256(F.encode(F.repeat(F.concat("r_name", F.lit("|")), F.lit(700_000)), "UTF-8")).alias("digest"))


# ----- colours

RGB = "px AS (SELECT vec_id, embedding[1]::DOUBLE AS r, embedding[2]::DOUBLE AS g, embedding[3]::DOUBLE AS b FROM embeddings)"


def _rgb(spark, root):
    return table(spark, root, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("rgb")])


@query(f"""WITH {RGB}, y AS (SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS y, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM px),
v AS (SELECT *, CASE WHEN hi > 1e-6 THEN least(1, greatest(0, (hi - lo) / hi)) ELSE 0 END AS sat FROM y)
SELECT vec_id, round(y + (r - y) * 1.4, 6) AS saturated, round(y + (r - y) * (1 + 0.5 * (1 - sat)), 6) AS vibrant, round(CASE WHEN abs(r) <= 0.1 THEN r ELSE sign(r) * (0.1 + (abs(r) - 0.1) / (1 + (abs(r) - 0.1) / 0.1)) END, 6) AS soft FROM v""")
def saturation(spark, root):
    r, g, b = (F.col(c) for c in "rgb")
    y = k.luma(r, g, b)
    vibrant = k.vibrance(r, y, F.greatest(r, g, b), F.least(r, g, b), 0.5)
    return _rgb(spark, root).select("vec_id", F.round(k.saturate(r, y, 0.4), 6).alias("saturated"), F.round(vibrant, 6).alias("vibrant"), F.round(k.soft_saturate(r, 0.1), 6).alias("soft"))


@query(f"""WITH {RGB}, m AS (SELECT vec_id, 0.2126 * r + 0.7152 * g + 0.0722 * b AS y, r, b FROM px), c AS (SELECT vec_id, least(1, greatest(0, y)) AS y, least(0.5, greatest(-0.5, (b - y) / 1.8556)) AS cb, least(0.5, greatest(-0.5, (r - y) / 1.5748)) AS cr FROM m),
d AS (SELECT *, greatest(0, least(1, (sqrt(cb * cb + cr * cr) - 0.05) / 0.15)) AS t, greatest(0, least(1, (abs(y - 0.1) - 0.1) / 0.3)) AS u FROM c)
SELECT vec_id, round(y, 6) AS y, round(cb, 6) AS cb, round(cr, 6) AS cr, round((1 - t * t * (3 - 2 * t)) * (1 - u * u * (3 - 2 * u)), 6) AS weight FROM d""")
def chroma_bands(spark, root):
    """Luma and chroma of a colour, and its weight in a band of chroma and one of luma around a reference."""
    y, cb, cr = s.chroma(F.col("r"), F.col("g"), F.col("b"))
    c = _rgb(spark, root).select("vec_id", y.alias("y"), cb.alias("cb"), cr.alias("cr"))
    weight = s.band_weight(F.sqrt(F.col("cb") * F.col("cb") + F.col("cr") * F.col("cr")), 0.05, 0.2) * s.band_weight(F.abs(F.col("y") - 0.1), 0.1, 0.4)
    return c.select("vec_id", *[F.round(x, 6).alias(x) for x in ("y", "cb", "cr")], F.round(weight, 6).alias("weight"))


@query("""WITH v AS (SELECT vec_id, 0.5 + embedding[1]::DOUBLE AS v FROM embeddings), t AS (SELECT *, pow(greatest(v, 0), 1 / 2.2) AS t FROM v),
b AS (SELECT *, 0.7 * 0.072 * pow(sin(pi() * t / (0.12 + 0.36 * 0.49)), 2) AS lift FROM t), l AS (SELECT *, least(1, greatest(0, t + lift)) AS up FROM b)
SELECT vec_id, round(v * pow(2, 0.5) * 1.1, 6) AS exposed,
  round(CASE WHEN v <= 0 OR v >= 1 THEN v WHEN v <= 0.18 THEN 0.18 * pow(v / 0.18, pow(2, 0.3)) ELSE 1 - 0.82 * pow((1 - v) / 0.82, pow(2, 0.3)) END, 6) AS contrasted,
  round(CASE WHEN v <= 0 OR v >= 1 OR t <= 0.8 - 0.55 * 0.36 THEN v ELSE pow(least(1, greatest(0, t - 0.6 * 0.15 * pow(sin(pi() * (t - (0.8 - 0.55 * 0.36)) / (0.2 + 0.55 * 0.36)), 2))), 2.2) END, 6) AS rescued,
  round(CASE WHEN v <= 0 OR v > 1 OR t >= 0.12 + 0.36 * 0.49 THEN v ELSE pow(least(1, greatest(0, up + 0.85 * (0.2 + (up - 0.2) * (1 + 1.3 * lift) - up))), 2.2) END, 6) AS lifted FROM l""")
def tone_steps(spark, root):
    """Exposure, contrast, highlights and blacks of a value around the middle."""
    v = table(spark, root, "embeddings").select("vec_id", (F.lit(0.5) + F.get("embedding", F.lit(0)).cast("double")).alias("v"))
    steps = {"exposed": k.exposure(F.col("v"), 0.5, 1.1), "contrasted": k.contrast(F.col("v"), 0.3), "rescued": k.highlights(F.col("v"), -0.6), "lifted": k.blacks(F.col("v"), 0.7)}
    return v.select("vec_id", *[F.round(c, 6).alias(n) for n, c in steps.items()])


@query("""WITH t AS (SELECT DISTINCT iso::DOUBLE * 10 AS kelvin, greatest(4000.0, least(25000.0, iso::DOUBLE * 10)) AS t FROM assets WHERE iso IS NOT NULL),
x AS (SELECT kelvin, CASE WHEN t <= 7000 THEN 0.244063 + 0.09911e3 / t + 2.9678e6 / pow(t, 2) - 4.6070e9 / pow(t, 3) ELSE 0.237040 + 0.24748e3 / t + 1.9018e6 / pow(t, 2) - 2.0064e9 / pow(t, 3) END AS x FROM t)
SELECT kelvin, round(x, 6) AS x, round(-3 * x * x + 2.870 * x - 0.275, 6) AS y FROM x""")
def daylight_points(spark, root):
    """Chromaticity of daylight at ten times the sensitivities in use."""
    t_ = table(spark, root, "assets").where("iso is not null").select((F.col("iso").cast("double") * 10).alias("kelvin")).distinct()
    x, y = k.kelvin_xy(F.col("kelvin"))
    return t_.select("kelvin", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


MATRIX = [[0.4124, 0.3576, 0.1805], [0.2126, 0.7152, 0.0722], [0.0193, 0.1192, 0.9505]]


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS r, round(embedding[2]::DOUBLE, 6) AS g, round(embedding[3]::DOUBLE, 6) AS b FROM embeddings")
def colour_matrix(spark, root):
    """Colours through a matrix and back through its inverse."""
    there = _rgb(spark, root).select("vec_id", *[c.alias(n) for n, c in zip("xyz", k.matrix_product(MATRIX, [F.col(c) for c in "rgb"]))])
    return there.select("vec_id", *[F.round(c, 6).alias(n) for n, c in zip("rgb", k.matrix_product(k.inverse_3x3(MATRIX), [F.col(c) for c in "xyz"]))])


CUBE = np.stack(np.meshgrid(*[np.linspace(0, 1, 5)] * 3, indexing="ij"), axis=-1)[..., ::-1] * 0.5
SHAPER = [0.0, 0.5, 1.0]


@query("""WITH v AS (SELECT vec_id, list_transform(embedding[1:3], lambda z: z::DOUBLE) AS v FROM embeddings), c AS (SELECT *, list_transform(v, lambda z: greatest(0.0, least(1.0, z))) AS p FROM v)
SELECT vec_id, round(v[1] + (p[3] * 0.5 - v[1]) * 0.75, 6) AS r, round(v[2] + (p[2] * 0.5 - v[2]) * 0.75, 6) AS g, round(v[3] + (p[1] * 0.5 - v[3]) * 0.75, 6) AS b FROM c""")
def colour_cube(spark, root):
    """A cube that swaps red and blue and halves all, at three quarters of its strength: trilinear interpolation of a linear map is exact."""
    out = k.apply_cube(F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double")), CUBE, SHAPER, 0.75)
    return table(spark, root, "embeddings").select("vec_id", out.alias("o")).select("vec_id", *[F.round(F.get("o", F.lit(i)), 6).alias(c) for i, c in enumerate("rgb")])


LUT = np.linspace(0, 2, 4097).tolist()


@query("SELECT vec_id, list_transform(embedding, lambda z: round(2 * greatest(0.0, least(1.0, z::DOUBLE)), 6)) AS looked_up FROM embeddings")
def lookup_table(spark, root):
    unit = F.transform("embedding", lambda v: v.cast("double"))
    out = k.lut_1d(unit, LUT)
    return table(spark, root, "embeddings").select("vec_id", F.transform(out, lambda v: F.round(v, 6)).alias("looked_up"))
