"""Smaller catalogue queries: suggestions, differences, exclusions, lens matching, hashes and dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from shutterlake.functions import scalars as s
from shutterlake.functions.paths import file_name
from shutterlake.functions.text import fold_path
from shutterlake.operators import linkage as l
from shutterlake.operators import tagging as t
from shutterlake.plans.book import Book
from shutterlake.sources.tables import table

query = Book()
DIRS = [("photos/2016-03-01", True), ("photos/2017-01-25", False), ("recycle", True)]


@query("""SELECT count(*) AS n FROM asset_files WHERE starts_with(rel_path, 'photos/2016-03-01/') OR starts_with(rel_path, 'recycle/')
  OR (starts_with(rel_path, 'photos/2017-01-25/') AND NOT contains(substr(rel_path, 19), '/'))""")
def excluded_count(spark, root):
    hit = reduce(lambda a, b: a | b, (s.is_under(F.col("rel_path"), d, deep) for d, deep in DIRS))
    return table(spark, root, "asset_files").where(hit).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT trim(author) AS v, 0 AS tier, -max(updated_at) AS o FROM assets WHERE trim(author) <> '' GROUP BY 1 ORDER BY max(updated_at) DESC, 1 LIMIT 5),
c AS (SELECT trim(author) AS v, 1 AS tier, -count(*) AS o FROM assets WHERE trim(author) <> '' GROUP BY 1),
u AS (SELECT v, min(tier) AS tier FROM (SELECT * FROM r UNION ALL SELECT * FROM c) GROUP BY v) SELECT v AS value, tier FROM u ORDER BY tier, value LIMIT 20""")
def suggestion_merge(spark, root):
    """Recent values first, then all others, each once."""
    a = table(spark, root, "assets").select(F.trim("author").alias("value"), "updated_at").where("value <> ''")
    last = a.groupBy("value").agg(F.max("updated_at").alias("at"))
    recent = last.orderBy(F.col("at").desc(), "value").limit(5).select("value", F.lit(0).alias("tier"))
    both = recent.unionByName(last.select("value", F.lit(1).alias("tier")))
    return both.groupBy("value").agg(F.min("tier").alias("tier")).orderBy("tier", "value").limit(20)


@query("SELECT id, name FROM (SELECT id, name, use_count, use_count > 20 AS pinned FROM tags WHERE use_count > 20 OR contains(lower(name), 'hill')) ORDER BY pinned DESC, use_count DESC, id LIMIT 60")
def tag_menu(spark, root):
    t = table(spark, root, "tags").withColumn("pinned", F.col("use_count") > 20)
    return t.where(F.col("pinned") | F.lower("name").contains("hill")).orderBy(F.col("pinned").desc(), F.col("use_count").desc(), "id").limit(60).select("id", "name")


@query("""WITH b AS (SELECT DISTINCT repository_id, asset_id FROM new_assets WHERE NOT coalesce(complete, false)), a AS (SELECT DISTINCT repository_id, asset_id FROM new_assets WHERE complete)
SELECT repository_id, asset_id, 'added' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT repository_id, asset_id, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def set_difference(spark, root):
    n = table(spark, root, "new_assets").withColumn("done", F.coalesce("complete", F.lit(False)))
    side = n.groupBy("repository_id", "asset_id").agg(F.max("done").alias("after"), F.min("done").alias("all_after"))
    return side.where(F.col("after") == F.col("all_after")).select("repository_id", "asset_id", F.when(F.col("after"), "added").otherwise("removed").alias("change"))


@query("SELECT a.id, EXISTS (SELECT 1 FROM external_tasks e WHERE e.asset_id = a.id AND e.removed_at IS NULL) AS edited FROM assets a")
def edited_flag(spark, root):
    owners = table(spark, root, "external_tasks").where("removed_at is null").select(F.col("asset_id").alias("id")).distinct().withColumn("edited", F.lit(True))
    return table(spark, root, "assets").select("id").join(owners, "id", "left").select("id", F.coalesce("edited", F.lit(False)).alias("edited"))


@query("""SELECT repository_id, run_id, count(*) AS n_items, coalesce(sum(size_bytes), 0) AS n_bytes, arg_max(kind, register_id) AS last_kind FROM registers GROUP BY 1, 2""")
def run_progress(spark, root):
    return table(spark, root, "registers").groupBy("repository_id", "run_id").agg(F.count(F.lit(1)).alias("n_items"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n_bytes"), F.max_by("kind", "register_id").alias("last_kind"))


@query("""SELECT content_hash AS hash, arg_min(asset_id, (role, id)) AS asset_id, arg_min(id, (role, id)) AS file_id FROM (SELECT coalesce(content_hash, 'file-' || id) AS content_hash, asset_id, role, id FROM asset_files WHERE role <> 'sidecar') GROUP BY 1""")
def export_variants(spark, root):
    """One file for each content, the bitmap before the raw; files without a hash stand for themselves."""
    f = table(spark, root, "asset_files").where("role <> 'sidecar'").withColumn("hash", F.coalesce("content_hash", F.concat(F.lit("file-"), F.col("id").cast("string"))))
    return f.groupBy("hash").agg(F.min_by(F.struct("asset_id", F.col("id").alias("file_id")), F.struct("role", "id")).alias("m")).select("hash", "m.*")


@query("""SELECT id, printf('%016x', list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length(organization_uid) + 1), lambda i: ascii(organization_uid[i])::UHUGEINT)),
  lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT) AS fnv FROM assets""")
def profile_hash(spark, root):
    return table(spark, root, "assets").select("id", s.fnv1a_hex("organization_uid").alias("fnv"))


@query("SELECT doc_id, sha256(encode(text)) AS digest FROM documents")
def content_fingerprint(spark, root):
    return table(spark, root, "documents").select("doc_id", s.sampled_sha256(F.encode("text", "UTF-8")).alias("digest"))


@query("""SELECT read_id, epoch_ms(try_strptime(regexp_extract(millis, '^\\s*(\\d{4}:\\d{2}:\\d{2} \\d{2}:\\d{2}:\\d{2})', 1), '%Y:%m:%d %H:%M:%S')) AS local_ms FROM (SELECT DISTINCT read_id, millis FROM taken_reads)""")
def exif_datetime(spark, root):
    return table(spark, root, "taken_reads").select("read_id", "millis").distinct().select("read_id", s.exif_datetime(F.col("millis")).alias("local_ms"))


@query()
def resolved_times(spark, root):
    """The capture time of each file: from its name, else its creation, else its modification."""
    f = table(spark, root, "asset_files")
    r = s.resolve_taken_at(F.lit(None).cast("long"), s.name_datetime(file_name(F.col("rel_path"))), F.col("file_created_ms"), F.col("mtime_ms"))
    return f.select("id", r.alias("r")).select("id", "r.*")


@query("SELECT id, CASE WHEN lower(color_label) IN ('red', 'yellow', 'green', 'cyan', 'blue', 'purple') THEN upper(color_label[1]) || lower(color_label[2:]) END AS label FROM assets")
def label_map(spark, root):
    return table(spark, root, "assets").select("id", s.label_out(F.col("color_label")).alias("label"))


@query("""SELECT asset_id, max(millis) - min(millis) AS span_ms, count(DISTINCT flag) AS n_flags, count(*) FILTER (flag = 'pick') AS n_picks FROM (SELECT DISTINCT mark_id, asset_id, millis, flag FROM flag_marks) WHERE asset_id IS NOT NULL GROUP BY 1""")
def mark_summary(spark, root):
    m = table(spark, root, "flag_marks").select("mark_id", "asset_id", "millis", "flag").distinct().where("asset_id is not null")
    return m.groupBy("asset_id").agg((F.max("millis") - F.min("millis")).alias("span_ms"), F.count_distinct("flag").alias("n_flags"), F.count_if(F.col("flag") == "pick").alias("n_picks"))


@query("SELECT f.id, f.rel_path FROM asset_files f WHERE f.asset_id IN (SELECT unnest(from_json('[1001, 1005, 1010, 77]', '[\"BIGINT\"]')))")
def json_idlist(spark, root):
    ids = spark.range(1).select(F.explode(F.from_json(F.lit("[1001, 1005, 1010, 77]"), "array<bigint>")).alias("asset_id"))
    return table(spark, root, "asset_files").join(ids, "asset_id", "left_semi").select("id", "rel_path")


@query("""WITH m AS (SELECT DISTINCT repository_id, asset_id FROM new_assets WHERE complete), r AS (SELECT DISTINCT repository_id, asset_id FROM external_tasks WHERE removed_at IS NOT NULL),
a AS (SELECT DISTINCT repository_id, asset_id FROM external_tasks) SELECT * FROM (SELECT * FROM m UNION SELECT * FROM a) EXCEPT SELECT * FROM r""")
def member_edits(spark, root):
    key = ["repository_id", "asset_id"]
    tasks = table(spark, root, "external_tasks")
    members = table(spark, root, "new_assets").where("complete")
    return t.edit_members(members, tasks.limit(0), tasks, tasks.where("removed_at is not null"), key)[0]
