"""Batch edits of a catalogue as new table versions: locks are respected, what was skipped is reported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lock levels from which a photo is not edited, and from which it is neither moved nor deleted.
NO_EDIT, NO_MOVE = 2, 1


def apply_edits(assets: DataFrame, edits: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The assets after ``edits`` (asset_id and new values of ``columns``), and a report (asset_id, outcome).

    Assets locked against edits keep their values. ``outcome``: applied, unchanged, locked or unknown. Of several edits
    of one asset the greatest counts; a null new value clears the column.
    """
    e = edits.where("asset_id is not null").groupBy("asset_id").agg(F.max(F.struct(*columns)).alias("__e")).withColumnRenamed("asset_id", "__a")
    j = assets.join(e, F.col("id") == F.col("__a"), "left")
    open_ = F.col("__a").isNotNull() & (F.coalesce("lock_level", F.lit(0)) < NO_EDIT)
    after = j.withColumns({c: F.when(open_, F.col(f"__e.{c}")).otherwise(F.col(c)) for c in columns}).select(assets.columns)
    seen = e.join(assets.select("id", "lock_level", *columns), F.col("id") == F.col("__a"), "left")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__e.{c}"))
    outcome = F.when(F.col("id").isNull(), "unknown").when(F.coalesce("lock_level", F.lit(0)) >= NO_EDIT, "locked").when(same, "unchanged").otherwise("applied")
    return after, seen.select(F.col("__a").alias("asset_id"), outcome.alias("outcome"))


def locked_for_move(assets: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of ``ids`` (asset_id) that must stay where they are."""
    return assets.where(F.col("lock_level") >= NO_MOVE).join(ids.select(F.col("asset_id").alias("id")), "id", "left_semi").select("id")


def recycle(assets: DataFrame, ids: DataFrame, at_ms: int) -> DataFrame:
    """``assets`` with those of ``ids`` marked deleted, unless locked or deleted before."""
    hit = assets.join(ids.select(F.col("asset_id").alias("__a")).distinct(), F.col("id") == F.col("__a"), "left")
    free = F.col("__a").isNotNull() & F.col("deleted_at").isNull() & (F.coalesce("lock_level", F.lit(0)) < NO_MOVE)
    return hit.withColumn("deleted_at", F.when(free, F.lit(at_ms).cast("long")).otherwise(F.col("deleted_at"))).select(assets.columns)


def restore(assets: DataFrame, files: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assets and files after those of ``ids`` come back: no longer deleted, files at the path they were recycled from."""
    back = ids.select(F.col("asset_id").alias("__a")).distinct()
    a = assets.join(back, F.col("id") == F.col("__a"), "left").withColumn("deleted_at", F.when(F.col("__a").isNull(), F.col("deleted_at"))).select(assets.columns)
    f = files.join(back, F.col("asset_id") == F.col("__a"), "left")
    home = F.col("__a").isNotNull() & F.col("recycled_from").isNotNull()
    f = f.withColumns({"rel_path": F.when(home, F.col("recycled_from")).otherwise(F.col("rel_path")), "recycled_from": F.when(~home, F.col("recycled_from"))})
    return a, f.select(files.columns)


def apply_snapshot(files: DataFrame, listing: DataFrame, at_ms: int) -> DataFrame:
    """The files of a catalogue after a rescan: (key, rel_path, size_bytes, mtime_ms, missing_since) by unique folded path.

    Files in the listing take its spelling, size and time and are no longer missing; new ones come in; those not in it are missing
    since ``at_ms``, or since before. Of listing rows with one key the least is taken; null keys are no files.
    """
    cols = ["rel_path", "size_bytes", "mtime_ms"]
    new = listing.where("key is not null").groupBy("key").agg(F.min(F.struct(*cols)).alias("n"))
    old = files.where("key is not null").select("key", F.struct(*cols, "missing_since").alias("o"))
    j = old.join(new, "key", "full_outer")
    there = F.col("n").isNotNull()
    since = F.when(~there, F.coalesce("o.missing_since", F.lit(at_ms).cast("long")))
    return j.select("key", *[F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in cols], since.alias("missing_since"))
