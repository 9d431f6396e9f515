"""Queries for grouping in time, linkage, ranks, text functions, geography, vectors and kernels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shutterlake.functions import kernels as k
from shutterlake.functions import paths as p
from shutterlake.functions.text import fold_path, nfc
from shutterlake.operators import catalog as cat
from shutterlake.operators import linkage as l
from shutterlake.operators import ranking as r
from shutterlake.operators import timeline as tl
from shutterlake.operators.geo import haversine_km, nearest_place
from shutterlake.operators.snapshots import usable_identity
from shutterlake.operators.vectors import concept_scores, top_concepts
from shutterlake.plans.book import Book
from shutterlake.sources.tables import table

query = Book()

# ----- time

SLICES = """
p AS (SELECT id, repository_id, taken_at AS ms, taken_at + coalesce(taken_at_offset_min, 0) * 60000 AS seen FROM assets),
d AS (SELECT *, coalesce(strftime(make_timestamp(seen * 1000), '%Y-%m-%d'), 'unknown') AS day_key FROM p),
f AS (SELECT *, CASE WHEN ms IS NULL THEN 0 ELSE coalesce(seen - lag(seen) OVER (PARTITION BY repository_id, day_key ORDER BY seen, id) > 3600000, true)::INT END AS starts FROM d),
s AS (SELECT id, repository_id, day_key, CASE WHEN ms IS NULL THEN 0 ELSE sum(starts) OVER (PARTITION BY repository_id, day_key ORDER BY seen, id ROWS UNBOUNDED PRECEDING) END::BIGINT AS slice_no FROM f)
"""


def _slices(spark, root, gap=tl.DEFAULT_GAP_MIN):
    return tl.time_slices(table(spark, root, "assets"), key="id", scope="repository_id", millis="taken_at", offset="taken_at_offset_min", gap_min=gap)


@query(f"WITH {SLICES} SELECT * FROM s")
def time_slices(spark, root):
    return _slices(spark, root)


@query(f"WITH {SLICES} SELECT repository_id, day_key, count(*) AS n_photos, max(slice_no) AS n_slices FROM s GROUP BY 1, 2")
def day_groups(spark, root):
    return tl.day_groups(_slices(spark, root), "repository_id")


@query("SELECT id, weekofyear(make_timestamp(taken_at * 1000)) AS week_no FROM assets WHERE taken_at IS NOT NULL")
def iso_week(spark, root):
    return table(spark, root, "assets").where("taken_at is not null").select("id", F.weekofyear(F.timestamp_millis("taken_at")).alias("week_no"))


@query("""SELECT repository_id, asset_id, source, millis FROM (SELECT *, row_number() OVER (PARTITION BY repository_id, asset_id ORDER BY
  CASE source WHEN 'exif' THEN 4 WHEN 'sibling' THEN 3 WHEN 'filename' THEN 2 WHEN 'file_created' THEN 1 ELSE 0 END DESC, millis DESC) AS rn
  FROM flag_marks WHERE asset_id IS NOT NULL AND millis IS NOT NULL AND source IN ('exif', 'sibling', 'filename', 'file_created', 'file_mtime')) WHERE rn = 1""")
def best_source(spark, root):
    return tl.best_source(table(spark, root, "flag_marks").where("asset_id is not null"), ["repository_id", "asset_id"], "source", "millis")


# ----- linkage


@query()
def reconcile_snapshots(spark, root):
    """Each delivery of a library against the last one delivered before it, as a disk listing against catalogue rows."""
    f = table(spark, root, "rescan_files")
    ident = F.when(usable_identity(F.col("volume_serial"), F.col("file_id")), F.concat_ws(":", F.col("volume_serial").cast("string"), F.hex("file_id")))
    f = f.select("repository_id", "snapshot_no", fold_path("rel_path").alias("key"), F.col("size_bytes").alias("size"), F.col("mtime_ms").alias("mtime"), ident.alias("ident"))
    f = f.distinct().withColumn("id", F.xxhash64("repository_id", "snapshot_no", "key"))
    scope = lambda no: F.concat_ws("#", F.col("repository_id"), no.cast("string"))
    order = Window.partitionBy("repository_id").orderBy("snapshot_no")
    deliveries = f.select("repository_id", "snapshot_no").distinct().withColumns({"next_no": F.lead("snapshot_no").over(order), "previous_no": F.lag("snapshot_no").over(order)})
    f = f.join(deliveries, ["repository_id", "snapshot_no"])
    disk = f.where("previous_no is not null").withColumn("scope", scope(F.col("snapshot_no")))
    db = f.where("next_no is not null").withColumn("scope", scope(F.col("next_no"))).withColumn("missing", F.lit(False))
    out = l.reconcile(disk, db)
    return out.groupBy("scope", "state", "evidence").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH f AS (SELECT f.id, f.role = 'raw' AS raw, CASE WHEN f.file_created_ms > 0 THEN f.file_created_ms END AS t,
    regexp_replace(regexp_replace(f.rel_path_folded, '/[^/]*$', ''), '/_raw$', '') || '/' || regexp_replace(regexp_extract(f.rel_path_folded, '[^/]*$'), '^(.+)\.[^.]*$', '\1') AS pair FROM asset_files f WHERE role <> 'sidecar')
SELECT x.id, CASE WHEN x.raw AND x.t IS NULL THEN (SELECT min(y.t) FROM f y WHERE y.pair = x.pair AND NOT y.raw) END AS inherited_at FROM f x""")
def sibling_inherit(spark, root):
    f = table(spark, root, "asset_files").where("role <> 'sidecar'").select("id", F.col("rel_path_folded").alias("path"), (F.col("role") == "raw").alias("raw"), F.when(F.col("file_created_ms") > 0, F.col("file_created_ms")).alias("t"))
    return l.inherit_times(f, key="id", path="path", is_raw="raw", time="t").select("id", "inherited_at")


@query(r"""WITH f AS (SELECT asset_id, arg_min(rel_path_folded, (role, id)) AS path FROM asset_files WHERE role <> 'sidecar' GROUP BY asset_id),
o AS (SELECT regexp_replace(f.path, '\.[^./]*$', '') || '.xmp' AS want, arg_min(a.id, a.id) AS asset_id, arg_min(a.deleted_at IS NULL AND (a.rating > 0 OR a.color_label IS NOT NULL OR a.like_state IS NOT NULL OR trim(a.author) <> ''
    OR trim(a.description) <> ''), a.id) AS wanted FROM assets a JOIN f ON f.asset_id = a.id GROUP BY 1),
s AS (SELECT rel_path_folded AS path, missing_since IS NULL AS ours FROM asset_files WHERE role = 'sidecar')
SELECT * FROM (SELECT coalesce(want, path) AS path, asset_id, CASE WHEN want IS NULL THEN 'orphan' WHEN wanted AND path IS NULL THEN 'absent' WHEN wanted THEN 'present' WHEN path IS NULL THEN NULL WHEN ours THEN 'stale' ELSE 'foreign' END AS verdict
  FROM o FULL JOIN s ON want = path) WHERE verdict IS NOT NULL""")
def sidecar_audit(spark, root):
    """A photo's sidecar stands beside its display file and is wanted if it has a marking or a text; sidecars not seen on disk count as someone else's."""
    f, a = table(spark, root, "asset_files"), table(spark, root, "assets")
    said = (F.col("rating") > 0) | F.col("color_label").isNotNull() | F.col("like_state").isNotNull() | (F.trim("author") != "") | (F.trim("description") != "")
    own = f.where("role <> 'sidecar'").groupBy("asset_id").agg(F.min_by("rel_path_folded", F.struct("role", "id")).alias("path"))
    wanted = F.coalesce(F.col("deleted_at").isNull() & F.coalesce(said, F.lit(False)), F.lit(False)).alias("wanted")
    photos = own.join(a.select(F.col("id").alias("asset_id"), wanted, F.lit(None).cast("string").alias("content")), "asset_id")
    there = f.where("role = 'sidecar'").select(F.col("rel_path_folded").alias("path"), F.col("missing_since").isNull().alias("ours"), F.lit(None).cast("string").alias("content"))
    return l.sidecar_audit(photos, there)


@query("""SELECT f.id, c.class_id, c.n_copies FROM asset_files f JOIN (SELECT content_hash_kind AS k, content_hash AS h, min(id) AS class_id, count(*) AS n_copies FROM asset_files
  WHERE content_hash IS NOT NULL AND content_hash_kind IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) c ON f.content_hash_kind = c.k AND f.content_hash = c.h""")
def content_dedup(spark, root):
    return l.content_duplicates(table(spark, root, "asset_files"))


@query("SELECT size_bytes, count(*) AS n_files, count(DISTINCT rel_path_folded) AS n_paths FROM asset_files WHERE size_bytes IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def size_dedup(spark, root):
    return l.size_duplicates(table(spark, root, "asset_files"))


@query("""WITH g AS (SELECT city, min(country) AS country, min(province_state) AS province_state FROM assets WHERE city IS NOT NULL GROUP BY city)
SELECT a.id, CASE WHEN coalesce(trim(a.country), '') = '' THEN g.country ELSE a.country END AS country,
  CASE WHEN coalesce(trim(a.province_state), '') = '' THEN g.province_state ELSE a.province_state END AS province_state FROM assets a LEFT JOIN g ON a.city = g.city""")
def fill_geo_blanks(spark, root):
    a = table(spark, root, "assets").select("id", "city", "country", "province_state")
    g = a.where("city is not null").groupBy("city").agg(F.min("country").alias("country"), F.min("province_state").alias("province_state"))
    return l.fill_blanks(a, g, "city", ["country", "province_state"]).select("id", "country", "province_state")


@query("""SELECT id, (max({'e': emitted_at, 'r': revision, 's': status})).s AS status, max(revision) AS revision, max(emitted_at)::VARCHAR AS emitted_at FROM task_states WHERE id IS NOT NULL GROUP BY id""")
def upsert_latest(spark, root):
    """Later states over earlier ones; of states at one time the one of the greatest revision, then status."""
    s = table(spark, root, "task_states").select("id", F.col("revision").alias("at_revision"), "revision", "status", "emitted_at")
    u = l.upsert(s.where("revision <= 2"), s.where("revision > 2 or revision is null"), ["id"], ["emitted_at", "at_revision", "status"], counters=["revision"])
    text = F.regexp_replace(F.date_format("emitted_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    return u.where("id is not null").select("id", "status", "revision", text.alias("emitted_at"))


@query("""SELECT asset_id FROM (SELECT DISTINCT asset_id, 1 AS s FROM new_assets UNION ALL SELECT DISTINCT asset_id, 2 FROM external_tasks) GROUP BY asset_id HAVING count(*) = 1""")
def symmetric_toggle(spark, root):
    return l.toggle(table(spark, root, "new_assets"), table(spark, root, "external_tasks"), "asset_id")


@query("SELECT a.id, a.rating, x.pos FROM (VALUES (1005, 0), (1003, 1), (-7, 2), (1010, 3)) AS x(id, pos) JOIN assets a USING (id)")
def rows_by_position(spark, root):
    return l.by_position([1005, 1003, -7, 1010], table(spark, root, "assets").select("id", "rating"), "id")


@query("SELECT event_type, (props::JSON->>'k')::INT AS k, count(*) AS n FROM events WHERE json_valid(props) GROUP BY 1, 2")
def json_group(spark, root):
    e = table(spark, root, "events").where(F.try_parse_json("props").isNotNull())
    return e.groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT e.event_id, c.c_name FROM events e JOIN customer c ON c.c_custkey = (e.props::JSON->>'k')::BIGINT")
def json_key_join(spark, root):
    return table(spark, root, "events").join(table(spark, root, "customer"), F.get_json_object("props", "$.k").cast("long") == F.col("c_custkey")).select("event_id", "c_name")


@query("""SELECT repository_id, id AS asset_id, 'asset' AS origin FROM assets UNION SELECT repository_id, asset_id, 'import' FROM new_assets UNION SELECT repository_id, asset_id, 'task' FROM external_tasks""")
def union_distinct(spark, root):
    parts = [table(spark, root, "assets").select("repository_id", F.col("id").alias("asset_id"), F.lit("asset").alias("origin"))]
    parts += [table(spark, root, n).select("repository_id", "asset_id", F.lit(o).alias("origin")) for n, o in (("new_assets", "import"), ("external_tasks", "task"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


# ----- ranks


@query("SELECT id, row_number() OVER (PARTITION BY asset_id ORDER BY mtime_ms NULLS FIRST, id) - 1 AS ordinal, (count(*) OVER (PARTITION BY asset_id) % 100)::INT AS counter FROM asset_files")
def ordinal_rank(spark, root):
    f = table(spark, root, "asset_files").select("id", "asset_id", "mtime_ms")
    return r.ordinals(f, "asset_id", ["mtime_ms", "id"]).select("id", F.col("ordinal").cast("long").alias("ordinal"), "counter")


@query("""WITH u AS (SELECT repository_id, list(DISTINCT id % 100) AS used, max(lock_level) AS c FROM external_tasks JOIN (SELECT DISTINCT repository_id, lock_level FROM assets) USING (repository_id) GROUP BY 1)
SELECT repository_id, list_filter(list_transform(range(100), lambda i: ((i + c) % 100)), lambda x: NOT list_contains(used, x))[1]::INT AS next_ordinal FROM u""")
def next_ordinal(spark, root):
    top = table(spark, root, "assets").groupBy("repository_id").agg(F.max("lock_level").alias("c"))
    return r.next_free_ordinal(table(spark, root, "external_tasks").join(top, "repository_id"), "repository_id", "id", "c")


@query("""WITH n AS (SELECT row_no, CASE WHEN complete THEN sum(CASE WHEN complete THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY row_no) END AS k
  FROM (SELECT row_no, coalesce(complete, false) AS complete, regexp_replace(lower(target_rel), '/[^/]*$', '') AS d FROM new_assets))
SELECT row_no, ((k - 1) % 99 + 1)::BIGINT AS seq FROM n""")
def sequence_numbers(spark, root):
    n = table(spark, root, "new_assets").select("row_no", p.parent(F.lower("target_rel")).alias("d"), (~F.coalesce("complete", F.lit(False))).alias("skipped"))
    return r.sequence_numbers(n, "d", ["row_no"], "skipped", 2).select("row_no", "seq")


@query()
def collision_suffixes(spark, root):
    n = table(spark, root, "new_assets")
    items = n.select(p.parent(F.col("target_rel")).alias("dir"), F.col("row_no").alias("id"), p.stem(F.col("target_rel")).alias("stem"))
    f = table(spark, root, "asset_files")
    return r.collision_suffixes(items, f.select(p.parent(F.col("rel_path")).alias("dir"), p.stem(F.col("rel_path")).alias("stem")).distinct())


EVICT = "asset_files"


@query("""WITH c AS (SELECT id, coalesce(size_bytes, 0) AS b, coalesce(file_created_ms, 0) AS h, coalesce(mtime_ms, 0) AS u, missing_since IS NOT NULL AS p FROM asset_files),
t AS (SELECT greatest(0, sum(b) - sum(b) // 2) AS excess FROM c),
x AS (SELECT id, sum(b) OVER (ORDER BY h, u, id ROWS UNBOUNDED PRECEDING) - b AS bytes_before FROM c WHERE NOT p)
SELECT id, bytes_before::BIGINT AS bytes_before FROM x, t WHERE bytes_before < excess""")
def evict_cumulative(spark, root):
    f = table(spark, root, "asset_files").withColumn("pinned", F.col("missing_since").isNotNull())
    half = f.agg(F.expr("sum(size_bytes) div 2")).first()[0] or 0
    return r.evict(f, half, key="id", size="size_bytes", hits="file_created_ms", last_used="mtime_ms", pinned="pinned")


@query("SELECT repository_id, row_no FROM (SELECT repository_id, row_no, row_number() OVER (PARTITION BY repository_id ORDER BY created_at DESC, row_no DESC) AS rn FROM new_assets) WHERE rn <= 5")
def keep_recent(spark, root):
    return cat.keep_recent(table(spark, root, "new_assets"), "repository_id", "created_at", "row_no", 5).select("repository_id", "row_no")


@query("""WITH v AS (SELECT event_type, value, ts, row_number() OVER (PARTITION BY event_type ORDER BY value) AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (place = greatest(1, ceil(0.5 * n))) AS p50, max(value) FILTER (place = greatest(1, ceil(0.95 * n))) AS p95, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS greatest, count(*) AS n,
  round(count(*) FILTER (value > 100) / count(*), 6) AS over_budget, round(count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0), 6) AS per_second FROM v GROUP BY event_type""")
def percentile_nearest_rank(spark, root):
    return r.nearest_rank(table(spark, root, "events"), ["event_type"], "value", [0.5, 0.95], budget=100.0, at="ts")


@query("""WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, value FROM v WHERE i = floor(0.95 * (n - 1) + 0.5)""")
def percentile_rounded_rank(spark, root):
    return r.rounded_rank(table(spark, root, "events"), "event_type", "value", 0.95)


@query("""WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, value AS median FROM v WHERE i = floor(n / 2)""")
def median_value(spark, root):
    return r.upper_median(table(spark, root, "events"), ["event_type"], "value")


THRESHOLDS = """WITH s AS (SELECT repository_id AS k, rating::DOUBLE AS score, (like_state IS NOT DISTINCT FROM 'like')::INT AS label FROM assets WHERE rating IS NOT NULL),
d AS (SELECT k, score AS threshold, sum(label) AS pos, count(*) AS a FROM s GROUP BY 1, 2),
w AS (SELECT k, threshold, sum(pos) OVER (PARTITION BY k ORDER BY threshold DESC) AS tp, sum(a) OVER (PARTITION BY k ORDER BY threshold DESC) AS n, sum(pos) OVER (PARTITION BY k) AS t FROM d)
SELECT k AS repository_id, threshold, tp / n AS precision, tp / t AS recall, tp::BIGINT AS tp FROM w WHERE tp >= 1 AND tp / n >= 0.05
QUALIFY row_number() OVER (PARTITION BY k ORDER BY {goal} DESC, tp / n DESC, threshold DESC) = 1"""


def _judged(spark, root):
    return table(spark, root, "assets").select("repository_id", F.col("rating").cast("double").alias("score"), F.col("like_state").eqNullSafe("like").cast("int").alias("label"))


@query(THRESHOLDS.format(goal="tp / t"))
def threshold_select(spark, root):
    return r.choose_threshold(_judged(spark, root), "repository_id", "label", "score", 0.05)


@query(THRESHOLDS.format(goal="(1 + 0.25) * (tp / n) * (tp / t) / (0.25 * (tp / n) + tp / t)"))
def threshold_f_beta(spark, root):
    return r.choose_threshold(_judged(spark, root), "repository_id", "label", "score", 0.05, beta=0.5)


@query("""SELECT repository_id, CASE WHEN count(DISTINCT color_label) = 0 THEN 'none' WHEN count(DISTINCT color_label) > 1 OR count(color_label) < count(*) THEN 'mixed' ELSE 'value' END AS state,
  CASE WHEN count(DISTINCT color_label) = 1 AND count(color_label) = count(*) THEN min(color_label) END AS value FROM assets GROUP BY 1""")
def tri_state(spark, root):
    return r.tri_state(table(spark, root, "assets"), "repository_id", "color_label")


# ----- text and path functions

STEM = r"regexp_replace({n}, '^(.+)\.[^.]*$', '\1')"


@query(r"""SELECT id, regexp_extract(rel_path, '[^/]*$') AS file_name, regexp_replace(rel_path, '/[^/]*$', '') AS dir_path, lower(regexp_extract(regexp_extract(rel_path, '[^/]*$'), '^.+\.([^.]+)$', 1)) AS extension,
  regexp_replace(regexp_extract(rel_path, '[^/]*$'), '^(.+)\.[^.]*$', '\1') AS stem FROM asset_files""")
def path_parts(spark, root):
    x = F.col("rel_path")
    return table(spark, root, "asset_files").select("id", p.file_name(x).alias("file_name"), p.parent(x).alias("dir_path"), p.extension(x).alias("extension"), p.stem(x).alias("stem"))


@query(r"""WITH p AS (SELECT register_id, replace(source_path, chr(92), '/') AS s FROM registers), f AS (SELECT *, regexp_replace(s, '/+', '/', 'g') AS flat FROM p)
SELECT register_id, nfc_normalize(CASE WHEN starts_with(s, '//') THEN '/' ELSE '' END || CASE WHEN length(flat) > 1 AND NOT regexp_matches(flat, '^[A-Za-z]:/$') THEN regexp_replace(flat, '/$', '') ELSE flat END) AS path FROM f""")
def path_normalise(spark, root):
    return table(spark, root, "registers").select("register_id", nfc(p.normalise_path(F.col("source_path"))).alias("path"))


@query("SELECT row_no, nfc_normalize(lower(replace(target_rel, chr(92), '/'))) AS folded FROM new_assets")
def path_fold(spark, root):
    return table(spark, root, "new_assets").select("row_no", fold_path("target_rel").alias("folded"))


@query(r"""SELECT pair_key, count(*) AS n, bool_or(role = 'raw') AS has_raw FROM (SELECT role, lower(concat_ws('/', regexp_replace(regexp_replace(rel_path, '/[^/]*$', ''), '(?i)(^|/)_raw$', ''),
  regexp_replace(regexp_extract(rel_path, '[^/]*$'), '^(.+)\.[^.]*$', '\1'))) AS pair_key FROM asset_files) GROUP BY 1""")
def pair_groups(spark, root):
    f = table(spark, root, "asset_files")
    return f.groupBy(p.pair_key(F.col("rel_path")).alias("pair_key")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("role") == "raw").alias("has_raw"))


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN lower(ext) IN ('ari','cr3','cr2','crw','erf','raf','3fr','kdc','dcs','dcr','iiq','mos','mef','mrw','nef','nrw','orf','rw2','pef','srw','arw','srf','sr2','dng') THEN 'raw'
  WHEN lower(ext) IN ('jpg','jpeg','png','webp','tif','tiff','heic','heif','avif') THEN 'bitmap' WHEN lower(ext) IN ('xmp','aae','thm','lrv','dop','pp3') THEN 'sidecar' ELSE 'other' END AS kind FROM asset_files) GROUP BY 1""")
def kind_counts(spark, root):
    return table(spark, root, "asset_files").groupBy(p.kind(F.col("ext")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT a.id AS a_id, b.id AS b_id FROM tags a JOIN tags b ON a.id < b.id AND abs(length(a.name) - length(b.name)) <= 1 AND levenshtein(a.name, b.name) <= 1 AND length(a.name) >= 4 AND length(b.name) >= 4""")
def fuzzy_names(spark, root):
    return l.near_names(table(spark, root, "tags"), key="id", name="name")


@query(r"""WITH n AS (SELECT id, regexp_extract(rel_path, '[^/]*$') AS n FROM asset_files), r AS (SELECT id, n, list_transform(regexp_extract_all(lower(n), '\d+|\D+'), lambda x:
  CASE WHEN regexp_matches(x, '^\d') THEN printf('0%05d', length(regexp_replace(x, '^0+(.)', '\1'))) || regexp_replace(x, '^0+(.)', '\1') ELSE '1' || x END) AS parts FROM n)
SELECT id, row_number() OVER (ORDER BY array_to_string(parts, chr(1)) || chr(0) || n, id) AS place FROM r""")
def natural_order(spark, root):
    """The place of each file when names are ordered as people count: places are running sums over ranged partitions."""
    keyed = table(spark, root, "asset_files").select("id", p.natural_key(p.file_name(F.col("rel_path"))).alias("k"))
    return r.running_sum(keyed, [], ["k", "id"], F.lit(1).cast("long"), "place").select("id", "place")


TEMPLATE = ":CYEAR/:CMONTH/:CDAY-W:CWEEK/:BRAND/:MODEL/:FILENAME_:SEQ0000"


@query(r"""WITH a AS (SELECT id, make_timestamp(taken_at * 1000) AS w, organization_uid, camera_make, camera_model FROM assets)
SELECT id, concat_ws('/', coalesce(strftime(w, '%Y'), '0000'), coalesce(strftime(w, '%m'), '00'), coalesce(strftime(w, '%d'), '00') || '-W' || coalesce(lpad(weekofyear(w)::VARCHAR, 2, '0'), '00'),
  coalesce(nullif(trim(camera_make), ''), 'Unknown'), coalesce(nullif(trim(camera_model), ''), 'Unknown'), coalesce(organization_uid, '') || '_' || printf('%04d', id)) AS path FROM a""")
def template_render(spark, root):
    return table(spark, root, "assets").select("id", p.render(TEMPLATE, when=F.timestamp_millis("taken_at"), name=F.col("organization_uid"), brand=F.col("camera_make"), model=F.col("camera_model"), seq=F.col("id")).alias("path"))


@query(r"""SELECT problem, count(*) AS n FROM (SELECT CASE WHEN source_path IS NULL OR trim(source_path) = '' THEN 'empty' WHEN regexp_matches(source_path, '[<>:"|?*\\\x00-\x1f]') THEN 'illegal character'
  WHEN list_contains(string_split(source_path, '/'), '') THEN 'empty segment' WHEN list_contains(string_split(source_path, '/'), '..') OR list_contains(string_split(source_path, '/'), '.') THEN 'relative segment' END AS problem FROM registers) GROUP BY 1""")
def path_problems(spark, root):
    return table(spark, root, "registers").groupBy(p.path_problem(F.col("source_path")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT id, regexp_replace(regexp_replace(printf('%.4f', f_number), '0+$', ''), '\.$', '') AS f_text FROM assets WHERE f_number IS NOT NULL""")
def number_format(spark, root):
    return table(spark, root, "assets").where("f_number is not null").select("id", F.regexp_replace(F.regexp_replace(F.format_string("%.4f", "f_number"), "0+$", ""), r"\.$", "").alias("f_text"))


@query("SELECT id, sha256(content_hash) AS digest FROM asset_files WHERE content_hash IS NOT NULL")
def fingerprint_sha(spark, root):
    return table(spark, root, "asset_files").where("content_hash is not null").select("id", F.sha2("content_hash", 256).alias("digest"))


# ----- geography, vectors, kernels

PLACES = "places AS (SELECT row_number() OVER (ORDER BY city) AS place_id, city, round(avg(gps_lat), 3) AS lat, round(avg(gps_lon), 3) AS lon FROM assets WHERE city IS NOT NULL AND gps_lat IS NOT NULL GROUP BY city)"


@query(f"""WITH {PLACES}, d AS (SELECT a.id, p.place_id, 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(p.lat - a.gps_lat) / 2), 2) + cos(radians(a.gps_lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - a.gps_lon) / 2), 2)))) AS km
  FROM assets a JOIN places p ON true WHERE a.gps_lat IS NOT NULL AND a.gps_lon IS NOT NULL)
SELECT id, arg_min(place_id, km) AS place_id, round(min(km), 6) AS km FROM d GROUP BY id""")
def nearest_city(spark, root):
    a = table(spark, root, "assets")
    cities = a.where("city is not null and gps_lat is not null").groupBy("city").agg(F.round(F.avg("gps_lat"), 3).alias("lat"), F.round(F.avg("gps_lon"), 3).alias("lon"))
    places = r.running_sum(cities, [], ["city"], F.lit(1).cast("long"), "place_id")
    return nearest_place(a, places, key="id", lat="gps_lat", lon="gps_lon").withColumn("km", F.round("km", 6))


@query("SELECT id, round(2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(0 - gps_lat) / 2), 2) + cos(radians(gps_lat)) * pow(sin(radians(0 - gps_lon) / 2), 2)))), 6) AS km FROM assets WHERE gps_lat IS NOT NULL AND gps_lon IS NOT NULL")
def great_circle(spark, root):
    a = table(spark, root, "assets").where("gps_lat is not null and gps_lon is not null")
    return a.select("id", F.round(haversine_km(F.col("gps_lat"), F.col("gps_lon"), F.lit(0.0), F.lit(0.0)), 6).alias("km"))


CONCEPTS = """
x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, round(avg(v::DOUBLE), 9) AS v FROM x GROUP BY 1, 2),
c AS (SELECT label AS concept, list(v ORDER BY i) AS positive FROM m GROUP BY 1),
n AS (SELECT a.concept, a.positive, b.positive AS negative FROM c a JOIN c b ON b.concept = (SELECT min(concept) FROM c))
"""


def _concepts(spark, root):
    e = table(spark, root, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    m = e.groupBy("label", "i").agg(F.round(F.avg(F.col("v").cast("double")), 9).alias("v"))
    c = m.groupBy(F.col("label").alias("concept")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("positive"))
    first = c.agg(F.min_by("positive", "concept").alias("negative")).withColumn("k", F.lit(1))
    return c.withColumn("k", F.lit(1)).join(first, "k").drop("k")


COS = "list_dot_product(e.v, {0}) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product({0}, {0})))"


@query(f"""WITH {CONCEPTS}, e AS (SELECT vec_id, list_transform(embedding, lambda z: z::DOUBLE) AS v FROM embeddings)
SELECT vec_id, concept, round(({COS.format("positive")} - {COS.format("negative")}) / 2, 6) AS score FROM e JOIN n ON true""")
def contrastive_scores(spark, root):
    return concept_scores(table(spark, root, "embeddings"), _concepts(spark, root), key="vec_id", vector="embedding").withColumn("score", F.round("score", 6))


@query(f"""WITH {CONCEPTS}, e AS (SELECT vec_id, list_transform(embedding, lambda z: z::DOUBLE) AS v FROM embeddings),
s AS (SELECT vec_id, concept, {COS.format("positive")} AS score FROM e JOIN n ON true)
SELECT vec_id, rank::INT AS rank, concept, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, concept) AS rank FROM s) WHERE rank <= 3""")
def top_k_concepts(spark, root):
    plain = _concepts(spark, root).withColumn("negative", F.lit(None).cast("array<double>"))
    return top_concepts(table(spark, root, "embeddings"), plain, 3, key="vec_id", vector="embedding").withColumn("score", F.round("score", 6))


PIXELS = "px AS (SELECT vec_id, unnest(list_transform(embedding, lambda z: greatest(0, least(255, floor(128 + z::DOUBLE * 256)))::INT)) AS v FROM embeddings)"


def _pixels():
    return F.transform("embedding", lambda z: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.lit(128) + z.cast("double") * 256).cast("int"))))


@query("""WITH e AS (SELECT list_transform(embedding, lambda z: greatest(0, least(255, floor(128 + z::DOUBLE * 256)))::INT) AS p FROM embeddings),
rgb AS (SELECT unnest(list_transform(range(len(p) // 3), lambda i: {'r': p[i * 3 + 1], 'g': p[i * 3 + 2], 'b': p[i * 3 + 3]})) AS c FROM e),
ch AS (SELECT u.channel, u.v FROM rgb, LATERAL (VALUES ('r', c.r), ('g', c.g), ('b', c.b), ('luma', (2126 * c.r + 7152 * c.g + 722 * c.b + 5000) // 10000)) AS u(channel, v)),
h AS (SELECT channel, CASE WHEN v = 0 THEN 0 ELSE (v - 1) // 3 + 1 END::INT AS bin, count(*) / CASE WHEN v = 0 THEN 1 ELSE 3 END AS part FROM ch GROUP BY channel, v)
SELECT channel, bin, round(sum(part), 6) AS height, round(sum(part) / max(sum(part)) FILTER (channel <> 'luma') OVER (), 6) AS share FROM h GROUP BY channel, bin""")
def histogram86(spark, root):
    """Three consecutive values of a vector as the channels of a pixel."""
    px = table(spark, root, "embeddings").select(_pixels().alias("p"))
    at = lambda i, c: F.element_at("p", i * 3 + c)
    triples = F.transform(F.sequence(F.lit(0), F.floor(F.size("p") / F.lit(3)).cast("int") - 1), lambda i: F.struct(at(i, 1).alias("r"), at(i, 2).alias("g"), at(i, 3).alias("b")))
    rgb = px.where(F.size("p") >= 3).select(F.explode(triples).alias("c")).select("c.*")
    return k.histogram(rgb, "r", "g", "b")


@query("""WITH p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT vec_id, i::INT AS i, round(avg(v) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS v FROM p""")
def box_blur_row(spark, root):
    return table(spark, root, "embeddings").select("vec_id", F.posexplode(k.box_blur(F.col("embedding"), 2)).alias("i", "v")).withColumn("v", F.round("v", 6))


@query("""WITH p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT vec_id, (i // 8)::INT AS i, round(avg(v), 6) AS v FROM p GROUP BY 1, 2""")
def box_down_row(spark, root):
    return table(spark, root, "embeddings").select("vec_id", F.posexplode(k.box_down(F.col("embedding"), 8)).alias("i", "v")).withColumn("v", F.round("v", 6))


@query(f"WITH {PIXELS} SELECT vec_id, round(sum(CASE WHEN v / 255.0 <= 0.04045 THEN v / 255.0 / 12.92 ELSE pow((v / 255.0 + 0.055) / 1.055, 2.4) END), 4) AS light FROM px GROUP BY 1")
def linear_light(spark, root):
    px = table(spark, root, "embeddings").select("vec_id", F.explode(_pixels()).alias("v"))
    return px.groupBy("vec_id").agg(F.round(F.sum(k.srgb_to_linear(F.col("v") / 255.0)), 4).alias("light"))


CURVE = [(0.0, 0.0), (0.25, 0.18), (0.5, 0.55), (1.0, 1.0)]


# The cubic of each piece by its ends and slopes: mean slopes 0.72, 1.1, 1.19 and 0.9, of which none needs a limit.
_PIECE = "({y0} * (1 + 2 * t) * pow(1 - t, 2) + {h} * {m0} * t * pow(1 - t, 2) + {y1} * t * t * (3 - 2 * t) + {h} * {m1} * t * t * (t - 1))"


@query(f"""WITH {PIXELS}, o AS (SELECT vec_id, v / 255.0 AS x, row_number() OVER () AS n FROM px),
k AS (SELECT *, CASE WHEN x < 0.25 THEN x / 0.25 WHEN x < 0.5 THEN (x - 0.25) / 0.25 ELSE (x - 0.5) / 0.5 END AS t FROM o)
SELECT vec_id, list(round(CASE WHEN x < 0.25 THEN {_PIECE.format(y0=0.0, y1=0.18, m0=0.72, m1=1.1, h=0.25)} WHEN x < 0.5 THEN {_PIECE.format(y0=0.18, y1=0.55, m0=1.1, m1=1.19, h=0.25)}
  ELSE {_PIECE.format(y0=0.55, y1=1.0, m0=1.19, m1=0.9, h=0.5)} END, 6) ORDER BY n) AS toned FROM k GROUP BY vec_id""")
def tone_curve(spark, root):
    unit = F.transform(_pixels(), lambda v: v / 255.0)
    toned = table(spark, root, "embeddings").select("vec_id", k.apply_curve(unit, CURVE).alias("t"))
    return toned.select("vec_id", F.transform("t", lambda v: F.round(v, 6)).alias("toned"))


@query("""WITH e AS (SELECT event_id, date_trunc('hour', ts) AS h, event_type, value FROM events)
SELECT h::VARCHAR AS hour_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY 1, 2""")
def hourly_rollup(spark, root):
    e = table(spark, root, "events").groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("hour_start"), "event_type")
    return e.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
