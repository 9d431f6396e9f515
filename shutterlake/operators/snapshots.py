"""Problem 6: what changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions.text import fold_path


#: Deliveries (library and snapshot) that may be sent to all executors; more are joined by a shuffle.
BROADCAST_DELIVERIES = 200_000


def usable_identity(volume: Column, file_id: Column) -> Column:
    """Neither part null, file id not all zero (an empty one is all zero)."""
    zeros = F.regexp_replace(F.hex(file_id), "0", "") == ""
    return volume.isNotNull() & file_id.isNotNull() & ~zeros


def snapshot_changes(
    files: DataFrame, *, library: str = "repository_id", snapshot: str = "snapshot_no", path: str = "rel_path", size: str = "size_bytes",
    mtime: str = "mtime_ms", volume: str = "volume_serial", file_id: str = "file_id", mtime_slack_ms: int = 2000,
) -> DataFrame:
    """(repository_id, snapshot_no, change_kind, rel_path) between each snapshot of a library and its previous one.

    A full outer join on the primary key, library, delivery and folded path, compares canonical row hashes. Its keys are unique and
    never null, so no task gets a hot one. Rows without a partner and partners with other identities are then looked up by
    identity in one row a delivery and identity: a file continues the earlier one with its identity, at the same path if
    that has it, else the first by path; what no identity continues goes by the path. What is left is
    ``registered`` or ``missing``; of partners, unequal hashes are examined for ``renamed`` (other folded path) and ``modified``
    (other size, or times more than ``mtime_slack_ms`` apart); both may hold.

    A row repeated in a snapshot counts once: of rows with the same folded path the least spelling is kept. Files may
    share an identity: each of them continues the earlier file. Null paths, libraries and snapshots are no files. A
    null size or time differs from a known one and equals another null. Libraries may skip deliveries. The first
    delivery of a library gives no rows; an empty table gives none.
    """
    f = files.select(
        F.col(library).alias("lib"), F.col(snapshot).cast("int").alias("snap"), F.col(path).alias("path"), F.col(size).alias("size"), F.col(mtime).alias("mtime"),
        F.when(usable_identity(F.col(volume), F.col(file_id)), F.struct(F.col(volume).cast("long").alias("v"), F.col(file_id).alias("f"))).alias("ident"),
    ).where("lib is not null and snap is not null and path is not null")
    # Each delivery is the newer side of one comparison and the older side of the next.
    order = Window.partitionBy("d_lib").orderBy("d_snap")
    deliveries = f.select(F.col("lib").alias("d_lib"), F.col("snap").alias("d_snap")).distinct().withColumns({"before": F.lag("d_snap").over(order), "next": F.lead("d_snap").over(order)})
    f = f.withColumn("key", fold_path("path")).groupBy("lib", "snap", "key").agg(F.min(F.struct("path", "size", "mtime", "ident")).alias("r"))
    state = F.struct("r.path", "r.size", "r.mtime", F.xxhash64("key", "r.size", "r.mtime").alias("hash"), F.col("r.ident").alias("ident"))
    f = f.select("lib", "snap", "key", state.alias("s"))
    if deliveries.count() <= BROADCAST_DELIVERIES:
        deliveries = F.broadcast(deliveries)
    placed = f.join(deliveries, (F.col("lib") == F.col("d_lib")) & (F.col("snap") == F.col("d_snap")))
    new = placed.where("before is not null").select("lib", F.col("snap").alias("at"), "key", "before", F.col("s").alias("n"))
    old = placed.where("next is not null").select("lib", F.col("next").alias("at"), "key", F.col("s").alias("o"))
    by_path = new.join(old, ["lib", "at", "key"], "full_outer")
    by_path = by_path.withColumn("open", ~F.col("n.ident").eqNullSafe(F.col("o.ident")))
    # One row a delivery and identity; a probe without an identity gets one of its own that nothing has.
    first = f.where("s.ident is not null").groupBy("lib", "snap", F.struct(F.lit(True).alias("real"), "s.ident.v", "s.ident.f").alias("who")).agg(F.min(F.struct("key", "s.path", "s.size", "s.mtime", "s.hash")).alias("first"))
    who = lambda side: F.struct(F.col(f"{side}.ident").isNotNull().alias("real"), F.coalesce(f"{side}.ident.v", F.xxhash64("key")).alias("v"), F.coalesce(f"{side}.ident.f", F.encode("key", "UTF-8")).alias("f"))
    earlier = first.select("lib", F.col("snap").alias("before"), F.col("who").alias("n_who"), F.col("first").alias("by_ident"))
    later = first.select("lib", F.col("snap").alias("at"), F.col("who").alias("o_who"), F.lit(True).alias("goes_on"))
    opened = by_path.where("open").withColumns({"n_who": who("n"), "o_who": who("o"), "before": F.coalesce("before", F.lit(-1))})
    opened = opened.join(earlier, ["lib", "before", "n_who"], "left").join(later, ["lib", "at", "o_who"], "left")
    goes_on = F.coalesce("goes_on", F.lit(False))
    # The earlier file a new one continues, and the earlier file that nothing continues.
    rest = F.col("by_ident").isNull() & ~goes_on
    side = lambda c: F.when(F.col(c).isNotNull(), F.struct("key", f"{c}.path", f"{c}.size", f"{c}.mtime", f"{c}.hash"))
    partner = F.when(F.col("by_ident").isNotNull(), F.col("by_ident")).when(rest, side("o"))
    lost = F.when(~goes_on & (F.col("n").isNull() | F.col("by_ident").isNotNull()), F.col("o"))
    settled = by_path.where("not open").select("lib", "at", "key", "n", side("o").alias("p"), F.when(F.col("n").isNull(), F.col("o")).alias("lost"))
    pairs = settled.unionByName(opened.select("lib", "at", "key", "n", F.when(F.col("n").isNotNull(), partner).alias("p"), lost.alias("lost")))
    far = F.coalesce(F.abs(F.col("n.mtime") - F.col("p.mtime")) > mtime_slack_ms, F.lit(False)) | (F.col("n.mtime").isNull() != F.col("p.mtime").isNull())
    unequal = F.col("n.hash") != F.col("p.hash")
    change = lambda when, kind, side: F.when(when, F.struct(F.lit(kind).alias("kind"), F.col(f"{side}.path").alias("path")))
    kinds = F.array(
        change(F.col("n").isNotNull() & F.col("p").isNull(), "registered", "n"),
        change(F.col("lost").isNotNull(), "missing", "lost"),
        change(unequal & (F.col("key") != F.col("p.key")), "renamed", "n"),
        change(unequal & (~F.col("n.size").eqNullSafe(F.col("p.size")) | far), "modified", "n"),
    )
    out = pairs.select("lib", "at", F.explode(F.array_compact(kinds)).alias("c"))
    return out.select(F.col("lib").alias("repository_id"), F.col("at").alias("snapshot_no"), F.col("c.kind").alias("change_kind"), F.col("c.path").alias("rel_path"))


def snapshot_change_report(changes: DataFrame) -> DataFrame:
    """Number of changes per library, snapshot and kind."""
    return changes.groupBy("repository_id", "snapshot_no", "change_kind").agg(F.count(F.lit(1)).alias("n_files"))
