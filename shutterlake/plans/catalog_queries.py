"""Queries on the catalogue: filters, scopes, pages, facets, suggestions, totals, tags and rule collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.operators import catalog as c
from shutterlake.operators import tagging as t
from shutterlake.operators.catalog import Catalog, Filter, Query, Scope
from shutterlake.plans.book import Book
from shutterlake.sources.tables import table

query = Book()
LIVE = "deleted_at IS NULL"


def _marks(spark, root):
    """Marks as tag sources: the flag is the tag, read from the camera (``ai``) or set by hand."""
    m = table(spark, root, "flag_marks").where("asset_id is not null")
    return m.select("asset_id", F.col("flag").alias("tag_key"), F.when(F.col("source") == "exif", "ai").otherwise("manual").alias("source"))


def _effective(spark, root):
    masks = table(spark, root, "external_tasks").select("asset_id", F.lit("reject").alias("tag_key"))
    valid = table(spark, root, "new_assets").where("complete").select("asset_id")
    return t.effective_tags(_marks(spark, root), masks, valid)


EFFECTIVE = """
effective AS (
  SELECT DISTINCT asset_id, flag AS tag_key FROM flag_marks m
  WHERE asset_id IS NOT NULL AND (source IS DISTINCT FROM 'exif' OR EXISTS (SELECT 1 FROM new_assets n WHERE n.asset_id = m.asset_id AND n.complete))
    AND NOT (flag = 'reject' AND EXISTS (SELECT 1 FROM external_tasks e WHERE e.asset_id = m.asset_id))
)"""


def _catalog(spark, root, tags=False):
    return Catalog(table(spark, root, "assets"), table(spark, root, "asset_files"), _effective(spark, root) if tags else None)


def _ids(spark, root, tags=False, **q):
    return _catalog(spark, root, tags).select(Query(**q)).select("id")


@query(f"SELECT id FROM assets WHERE {LIVE} AND rating >= 3 AND (color_label IN ('red', 'blue') OR color_label IS NULL) AND lock_level IN (0, 1)")
def filter_and(spark, root):
    return _ids(spark, root, filter=Filter("all", min_rating=3, colors=["red", "blue", "none"], locks=[0, 1]))


@query(f"SELECT id FROM assets WHERE {LIVE} AND (rating >= 5 OR coalesce(color_label IN ('green'), false) OR coalesce(like_state IN ('like'), false))")
def filter_or(spark, root):
    return _ids(spark, root, filter=Filter(min_rating=5, colors=["green"], likes=["like"]))


@query(f"""SELECT id FROM assets WHERE {LIVE} AND (camera_make IS NULL AND camera_model IS NULL OR coalesce(camera_make, '') || '|' || coalesce(camera_model, '') = 'Numaro|Numaro 7s')
  AND (lens IS NULL OR lens = '50mm F1.8 N')""")
def filter_nullable_set(spark, root):
    return _ids(spark, root, filter=Filter("all", cameras=["Numaro|Numaro 7s", "none"], lenses=["50mm F1.8 N", "none"]))


@query(f"SELECT id FROM assets WHERE {LIVE} AND taken_at BETWEEN 1483228800000 AND 1640995200000 AND iso BETWEEN 200 AND 1600 AND focal_mm >= 24")
def filter_range(spark, root):
    return _ids(spark, root, filter=Filter("all", taken=(1483228800000, 1640995200000), iso=(200, 1600), focal=(24.0, None)))


@query(f"SELECT id FROM assets WHERE {LIVE} AND (iso >= 3200 OR iso <= 100)")
def filter_range_any(spark, root):
    return _ids(spark, root, filter=Filter(iso=(3200, 100)))


@query(f"""SELECT id FROM assets a WHERE {LIVE} AND NOT EXISTS (SELECT 1 FROM flag_marks m WHERE m.asset_id = a.id AND m.flag = 'reject')
  AND EXISTS (SELECT 1 FROM flag_marks m WHERE m.asset_id = a.id AND m.flag = 'pick')""")
def filter_flags(spark, root):
    m = table(spark, root, "flag_marks")
    pick, reject = (m.where(F.col("flag") == f).select("asset_id") for f in ("pick", "reject"))
    return _ids(spark, root, filter=Filter("all", flag_in=pick, flag_not_in=reject))


@query("SELECT id FROM assets WHERE deleted_at IS NOT NULL")
def visibility_recycled(spark, root):
    return _ids(spark, root, visibility="recycled")


@query(f"SELECT id FROM assets a WHERE {LIVE} AND EXISTS (SELECT 1 FROM asset_files f WHERE f.asset_id = a.id AND (f.rel_path_folded = 'photos' OR starts_with(f.rel_path_folded, 'photos/')))")
def scope_subtree(spark, root):
    return _ids(spark, root, scope=Scope("subtree", "Photos\\"))


@query(rf"""SELECT id FROM assets a WHERE {LIVE} AND EXISTS (SELECT 1 FROM asset_files f WHERE f.asset_id = a.id
  AND regexp_replace(regexp_replace(f.rel_path_folded, '/[^/]*$', ''), '/_raw$', '') = 'photos/2017-01-25')""")
def scope_directory(spark, root):
    return _ids(spark, root, scope=Scope("directory", "photos/2017-01-25"))


@query("SELECT id FROM assets WHERE false")
def scope_ids_empty(spark, root):
    return _ids(spark, root, scope=Scope("ids", ids=[]))


@query(f"WITH {EFFECTIVE} SELECT id FROM assets WHERE {LIVE} AND id IN (SELECT asset_id FROM effective WHERE tag_key = 'pick')")
def scope_tag(spark, root):
    return _ids(spark, root, tags=True, scope=Scope("tag", tag="pick"))


@query(f"WITH {EFFECTIVE} SELECT id FROM assets WHERE {LIVE} AND (rating >= 4 OR id IN (SELECT asset_id FROM effective WHERE tag_key IN ('pick', 'none')))")
def filter_tag_keys(spark, root):
    return _ids(spark, root, tags=True, filter=Filter(min_rating=4, tag_keys=["pick", "none"]))


TEXT = """SELECT id FROM assets a WHERE deleted_at IS NULL AND ({own} EXISTS (SELECT 1 FROM asset_files f WHERE f.asset_id = a.id
  AND contains(lower(regexp_extract(f.rel_path, '[^/]*$')), '{t}')))"""


@query(TEXT.format(t="mm f", own="coalesce(contains(lower(concat_ws(' ', camera_make, camera_model)), 'mm f'), false) OR coalesce(contains(lower(lens), 'mm f'), false) OR coalesce(contains(lower(description), 'mm f'), false) OR"))
def text_search(spark, root):
    return _ids(spark, root, filter=Filter(text="mm F"))


@query(TEXT.format(t="01", own=""))
def text_search_short(spark, root):
    return _ids(spark, root, filter=Filter(text=" 01 "))


DISPLAY = """
display AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY role, id) AS rn FROM asset_files) WHERE rn = 1
),
per AS (SELECT asset_id, bool_or(role = 'raw') AS has_raw, count(*) AS n FROM asset_files GROUP BY asset_id)
"""


@query(f"""WITH {DISPLAY} SELECT a.id, a.taken_at, a.rating, coalesce(d.rel_path, '') AS rel_path, coalesce(regexp_extract(d.rel_path, '[^/]*$'), '') AS file_name,
  coalesce(d.file_created_ms, d.mtime_ms) AS file_time_ms, d.size_bytes, coalesce(p.has_raw, false) AS has_raw, least(coalesce(p.n, 0), 100) AS n_files
FROM assets a LEFT JOIN display d ON d.asset_id = a.id LEFT JOIN per p ON p.asset_id = a.id
WHERE a.deleted_at IS NULL AND a.rating >= 3 ORDER BY a.taken_at DESC NULLS LAST, a.id DESC LIMIT 200 OFFSET 100""")
def browse_page(spark, root):
    page = _catalog(spark, root).page(Query(filter=Filter(min_rating=3)), 100, 200)
    return page.select("id", "taken_at", "rating", "rel_path", "file_name", "file_time_ms", "size_bytes", "has_raw", "n_files")


@query(f"""WITH {DISPLAY} SELECT a.id, nullif(coalesce(camera_make, '') || '|' || coalesce(camera_model, ''), '|') AS camera FROM assets a WHERE {LIVE}
ORDER BY camera NULLS LAST, id LIMIT 500""")
def page_by_camera(spark, root):
    return _catalog(spark, root).page(Query(sort="camera"), 0, 500).select("id", "camera")


@query(f"""WITH {DISPLAY} SELECT a.id, regexp_extract(d.rel_path, '[^/]*$') AS file_name FROM assets a JOIN display d ON d.asset_id = a.id WHERE {LIVE}
ORDER BY file_name, a.id LIMIT 300""")
def page_by_file_name(spark, root):
    return _catalog(spark, root).page(Query(sort="file_name"), 0, 300).select("id", "file_name")


@query(f"SELECT id, organization_uid FROM assets WHERE {LIVE} AND rating >= 1 AND id > 1200 AND id <= 900000 ORDER BY id LIMIT 500")
def keyset_page(spark, root):
    return _catalog(spark, root).keyset_page(Query(filter=Filter(min_rating=1)), 1200, 900000, 500)


@query(f"WITH {DISPLAY} SELECT a.id, a.taken_at, coalesce(d.rel_path, '') AS rel_path FROM assets a LEFT JOIN display d ON d.asset_id = a.id WHERE {LIVE}")
def timeline(spark, root):
    return _catalog(spark, root).timeline(Query())


@query(f"SELECT count(*) AS n_assets FROM assets WHERE {LIVE} AND rating >= 3")
def filtered_count(spark, root):
    return _catalog(spark, root).count(Query(filter=Filter(min_rating=3)))


@query(f"""SELECT facet, value, count(*) AS n FROM (
  SELECT u.facet, u.value FROM assets, LATERAL (VALUES ('rating', rating::VARCHAR), ('color_label', color_label), ('like_state', like_state), ('lock_level', lock_level::VARCHAR)) AS u(facet, value)
  WHERE {LIVE} AND rating >= 0) GROUP BY facet, value""")
def facets(spark, root):
    return _catalog(spark, root).facets(Query(filter=Filter(min_rating=0)))


@query(f"SELECT trim(author) AS value, count(*) AS n FROM assets WHERE {LIVE} AND trim(author) <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def text_values(spark, root):
    return _catalog(spark, root).text_values("author")


@query(f"SELECT trim(city) AS value, count(*) AS n FROM assets WHERE {LIVE} AND country = 'Veldmark' AND trim(city) <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def text_values_cascaded(spark, root):
    return _catalog(spark, root).text_values("city", {"country": "Veldmark", "city": "ignored"})


@query(f"WITH {DISPLAY} SELECT asset_id, id AS file_id, rel_path FROM display")
def display_file_pick(spark, root):
    return _catalog(spark, root).display_files().select("asset_id", "file_id", "rel_path")


@query("SELECT asset_id, arg_min(recycled_from, id) AS recycled_from FROM asset_files WHERE recycled_from IS NOT NULL GROUP BY asset_id")
def first_recycled_from(spark, root):
    return c.first_by(table(spark, root, "asset_files").where("recycled_from is not null"), "asset_id", "recycled_from", "id")


@query("""SELECT count(DISTINCT a.id) AS n_assets, count(f.id) AS n_files, coalesce(sum(f.size_bytes), 0) AS n_bytes
FROM assets a LEFT JOIN asset_files f ON f.asset_id = a.id WHERE a.deleted_at IS NOT NULL""")
def recycle_summary(spark, root):
    return c.recycle_summary(table(spark, root, "assets"), table(spark, root, "asset_files"))


@query("""SELECT repository_id, count(DISTINCT a.id) FILTER (deleted_at IS NULL) AS n_live, count(DISTINCT a.id) FILTER (deleted_at IS NOT NULL) AS n_recycled,
  count(f.id) AS n_files, coalesce(sum(f.size_bytes), 0) AS n_bytes FROM assets a LEFT JOIN asset_files f ON f.asset_id = a.id GROUP BY repository_id""")
def rollup_totals(spark, root):
    return c.repository_totals(table(spark, root, "assets"), table(spark, root, "asset_files"))


@query("""WITH d AS (SELECT regexp_replace(rel_path, '/[^/]*$', '') AS dir FROM asset_files WHERE role <> 'sidecar')
SELECT regexp_replace(dir, '(?i)/_raw$', '') AS dir_path, count(*) FILTER (regexp_replace(dir, '(?i)/_raw$', '') = dir) AS photos, count(*) AS images FROM d GROUP BY 1""")
def directory_counts(spark, root):
    return c.directory_counts(table(spark, root, "asset_files"))


@query("SELECT status, count(*) AS n, count(*) FILTER (error IS NOT NULL) AS n_errors, max(revision) AS max_revision FROM task_states GROUP BY status")
def conditional_counts(spark, root):
    return table(spark, root, "task_states").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNotNull()).alias("n_errors"), F.max("revision").alias("max_revision"))


@query("SELECT run_id, count(*) FILTER (kind = 'bitmap') AS bitmap, count(*) FILTER (kind = 'raw') AS raw, count(*) FILTER (kind = 'sidecar') AS sidecar FROM registers GROUP BY run_id")
def state_pivot(spark, root):
    return table(spark, root, "registers").groupBy("run_id").pivot("kind", ["bitmap", "raw", "sidecar"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT coalesce(ext, '') AS class, count(*) AS n, coalesce(sum(size_bytes), 0) AS bytes FROM asset_files GROUP BY 1 UNION ALL SELECT 'all', count(*), coalesce(sum(size_bytes), 0) FROM asset_files")
def cache_stats(spark, root):
    per = table(spark, root, "asset_files").groupBy(F.coalesce("ext", F.lit("")).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    return per.unionByName(per.agg(F.lit("all").alias("class"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")))


@query("SELECT count(*) AS n, max(id) AS max_id FROM assets")
def table_signature(spark, root):
    return table(spark, root, "assets").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("max_id"))


@query("SELECT DISTINCT camera_make, camera_model, lens FROM assets")
def distinct_values(spark, root):
    return table(spark, root, "assets").select("camera_make", "camera_model", "lens").distinct()


# ----- tags and rule collections


@query(f"WITH {EFFECTIVE} SELECT * FROM effective")
def effective_tags(spark, root):
    return _effective(spark, root)


@query(f"WITH {EFFECTIVE} SELECT tag_key, count(*) AS n_assets FROM effective GROUP BY tag_key")
def tag_usage(spark, root):
    return t.tag_usage(_effective(spark, root))


@query("SELECT id, name_folded, use_count FROM tags WHERE contains(lower(name_folded), 'er') ORDER BY use_count DESC, id LIMIT 60")
def tag_search(spark, root):
    return t.tag_search(table(spark, root, "tags"), " ER ", 60).select("id", "name_folded", "use_count")


RULE = [
    t.Group(("eHO7KpUEu4BcA5cz", "yREhggL42rKRh00y"), min_rating=3, colors=("red", "none")),
    t.Group(("eHO7KpUEu4BcA5cz",), likes=("like",), locks=(0, 1)),
]
RULE_SQL = f"""{LIVE} AND (repository_id IN ('eHO7KpUEu4BcA5cz', 'yREhggL42rKRh00y') AND rating >= 3 AND (color_label = 'red' OR color_label IS NULL)
  OR repository_id = 'eHO7KpUEu4BcA5cz' AND like_state = 'like' AND lock_level IN (0, 1))"""


@query(f"SELECT repository_id, id AS asset_id FROM assets WHERE {RULE_SQL}")
def rule_matches(spark, root):
    return t.rule_matches(table(spark, root, "assets"), RULE)


def _members(spark, root):
    return table(spark, root, "new_assets").where("complete").select("repository_id", "asset_id").distinct()


CURSOR = "2020-01-01 00:00:00"


@query(f"""SELECT DISTINCT repository_id, asset_id FROM new_assets WHERE complete UNION SELECT repository_id, id FROM assets a WHERE {RULE_SQL}
  AND EXISTS (SELECT 1 FROM flag_marks m WHERE m.asset_id = a.id AND m.marked_at > TIMESTAMP '{CURSOR}')
  AND NOT EXISTS (SELECT 1 FROM external_tasks e WHERE e.repository_id = a.repository_id AND e.asset_id = a.id)""")
def bucket_incremental(spark, root):
    events = table(spark, root, "flag_marks").select(F.col("marked_at").cast("timestamp").alias("event_at"), "asset_id")
    out = table(spark, root, "external_tasks").select("repository_id", "asset_id")
    cursor = F.to_timestamp(F.lit(CURSOR))
    return t.reconcile_members(_members(spark, root), out, table(spark, root, "assets"), events, RULE, cursor)


@query("""SELECT flag AS bucket, count(*) AS n_members, count(DISTINCT repository_id) AS n_repositories
FROM (SELECT DISTINCT flag, repository_id, asset_id FROM flag_marks WHERE asset_id IS NOT NULL) GROUP BY flag""")
def bucket_member_counts(spark, root):
    m = table(spark, root, "flag_marks").where("asset_id is not null").select(F.col("flag").alias("bucket"), "repository_id", "asset_id").distinct()
    counted = t.member_counts(m)
    return counted.select("bucket", "n_members", F.size(F.map_keys(F.from_json("by_repository", "map<string,long>"))).cast("long").alias("n_repositories"))


@query("SELECT repository_id, asset_id FROM (SELECT DISTINCT repository_id, asset_id FROM new_assets) n WHERE EXISTS (SELECT 1 FROM assets a WHERE a.id = n.asset_id AND a.repository_id = n.repository_id)")
def validated_members(spark, root):
    a = table(spark, root, "assets").select("repository_id", F.col("id").alias("asset_id"))
    return table(spark, root, "new_assets").select("repository_id", "asset_id").distinct().join(a, ["repository_id", "asset_id"], "left_semi")
