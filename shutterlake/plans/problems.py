"""Queries for the general data problems: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.operators.impute import agreed_fills, fill_missing
from shutterlake.operators.instants import normalise_instants
from shutterlake.operators.orphans import orphan_references, orphan_report
from shutterlake.operators.sessions import sessionise
from shutterlake.operators.snapshots import snapshot_change_report, snapshot_changes
from shutterlake.session import drop_at_exit, shared_dir
from shutterlake.sources.tables import table

SESSION_GAP_MS = 30 * 60 * 1000


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    reads = normalise_instants(table(spark, root, "taken_reads"), table(spark, root, "repositories"), reading="millis", offset="offset_min")
    return reads.where("instant_ms is not null").select("read_id", "instant_ms").distinct()


def p1_kept(spark: SparkSession, root: str) -> DataFrame:
    """The same from two deliveries, by halves of the libraries, against one kept dictionary: the second parses only what the first has not."""
    reads, zones = table(spark, root, "taken_reads"), table(spark, root, "repositories")
    store = shared_dir(spark, "instants-kept")
    half = F.pmod(F.xxhash64("repository_id"), F.lit(2))
    first, second = (normalise_instants(reads.where(half == i), zones, reading="millis", offset="offset_min", store=store) for i in (0, 1))
    drop_at_exit(spark, store)
    return first.unionByName(second).where("instant_ms is not null").select("read_id", "instant_ms").distinct()


def _orphans(spark: SparkSession, root: str) -> DataFrame:
    assets, tasks = table(spark, root, "assets"), table(spark, root, "external_tasks")
    photo = dict(ref_key="asset_id", parent_key="id", born="imported_at", gone="deleted_at", scope="repository_id", time_unit="millis")
    parts = {
        "flag_marks": orphan_references(table(spark, root, "flag_marks"), assets, ref_id="mark_id", ref_time="marked_at", **photo),
        "new_assets": orphan_references(table(spark, root, "new_assets"), assets, ref_id="row_no", ref_time="created_at", **photo),
        "task_states": orphan_references(
            table(spark, root, "task_states"), tasks, ref_id="state_id", ref_key="id", ref_time="emitted_at", parent_key="id", born="reserved_at", gone="removed_at"
        ),
    }
    named = [df.select(F.lit(t).alias("ref_table"), F.date_format("ref_time", "yyyy-MM").alias("month_key"), "ref_id", "orphan_kind") for t, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return _orphans(spark, root).distinct()


def p2_report(spark: SparkSession, root: str) -> DataFrame:
    return orphan_report(p2_found(spark, root))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    fills = agreed_fills(table(spark, root, "assets"), key="id", group="repository_id", model="camera_model", time="taken_at")
    return fills.select(F.col("id").alias("asset_id"), "field_name", "fill_text").distinct()


def p3_filled(spark: SparkSession, root: str) -> DataFrame:
    fills = fill_missing(table(spark, root, "assets"), key="id", group="repository_id", model="camera_model", time="taken_at")
    return fills.withColumnRenamed("id", "asset_id").withColumn("distance", F.round("distance", 3))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    s = sessionise(table(spark, root, "flag_marks"), user="repository_id", millis="millis", event="mark_id", gap_ms=SESSION_GAP_MS)
    return s.select("repository_id", "start_ms", "end_ms", F.col("n_events").alias("n_marks"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return snapshot_changes(table(spark, root, "rescan_files")).distinct()


def p6_report(spark: SparkSession, root: str) -> DataFrame:
    return snapshot_change_report(p6_found(spark, root))


QUERIES = {f.__name__: f for f in (p1_found, p1_kept, p2_found, p2_report, p3_found, p3_filled, p5_found, p6_found, p6_report)}
