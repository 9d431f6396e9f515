"""Photos grouped by local day and, within a day, into slices separated by gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_GAP_MIN = 60


def time_slices(photos: DataFrame, *, key: str, scope: str, millis: str, offset: str, gap_min: float | None = DEFAULT_GAP_MIN) -> DataFrame:
    """(key, scope, day_key, slice_no): a new slice starts when the gap exceeds ``gap_min``; an equal gap doesn't.

    Visible time is the instant moved by its own offset; a null offset means UTC. A gap that is null, not a number
    or not positive gives one slice a day. Photos without a time form day ``unknown``, slice 0. The window of
    one scope and day sees that day's photos only.
    """
    seen = F.col(millis) + F.coalesce(F.col(offset), F.lit(0)) * 60_000
    p = photos.select(F.col(key), F.col(scope), F.col(millis).alias("__ms"), seen.alias("__seen"))
    p = p.withColumn("day_key", F.coalesce(F.date_format(F.timestamp_millis("__seen"), "yyyy-MM-dd"), F.lit("unknown")))
    known = p.where("__ms is not null")
    if gap_min is None or not gap_min > 0:
        known = known.withColumn("slice_no", F.lit(1).cast("long"))
    else:
        w = Window.partitionBy(scope, "day_key").orderBy("__seen", key)
        starts = F.coalesce(F.col("__seen") - F.lag("__seen").over(w) > gap_min * 60_000, F.lit(True)).cast("int")
        known = known.withColumn("__s", starts).withColumn("slice_no", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    unknown = p.where("__ms is null").withColumn("slice_no", F.lit(0).cast("long"))
    return known.select(key, scope, "day_key", "slice_no").unionByName(unknown.select(key, scope, "day_key", "slice_no"))


def day_groups(slices: DataFrame, scope: str) -> DataFrame:
    return slices.groupBy(scope, "day_key").agg(F.count(F.lit(1)).alias("n_photos"), F.max("slice_no").alias("n_slices"))


# Rank of each source of a capture time.
SOURCE_RANK = {"exif": 4, "sibling": 3, "filename": 2, "file_created": 1, "file_mtime": 0}


def best_source(reads: DataFrame, key: list[str], source: str, value: str) -> DataFrame:
    """Each key's reading from the best source; ties to the greatest value."""
    rank = F.create_map(*[F.lit(x) for kv in SOURCE_RANK.items() for x in kv])[F.col(source)]
    r = reads.where(F.col(source).isin(list(SOURCE_RANK)) & F.col(value).isNotNull())
    return r.groupBy(*key).agg(F.max_by(F.struct(source, value), F.struct(rank, F.col(value))).alias("b")).select(*key, f"b.{source}", f"b.{value}")
