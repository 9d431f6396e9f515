"""Problem 5: activity split into sessions by inactivity gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a time block. A block's window sorts at most this many distinct milliseconds of one key.
BLOCK_MS = 6 * 3600 * 1000


def sessionise(events: DataFrame, *, user: str, millis: str, event: str, gap_ms: int, block_ms: int = BLOCK_MS) -> DataFrame:
    """(user, start_ms, end_ms, duration_ms, n_events) of each session.

    Events are counted once per distinct ``event``, ``user`` and ``millis``; a gap above ``gap_ms``
    starts a new session, a gap of exactly ``gap_ms`` does not. Null times are no activity; a null
    user is a user of its own; a null event id counts as one event per instant. An empty table gives no
    sessions. Only the three named columns are read.

    Lag, flag and running sum run per user and time block; the first and last fragment of each block
    are then joined across block borders the same way, on at most two rows a block. So a user that
    holds a third of all events is spread over its blocks.
    """
    points = (
        events.where(F.col(millis).isNotNull())
        .select(F.col(user).alias("__user"), F.col(millis).cast("long").alias("__ms"), F.col(event).alias("__event"))
        .distinct()
        .groupBy("__user", "__ms")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__block", F.floor(F.col("__ms") / F.lit(block_ms)))
    )
    w = Window.partitionBy("__user", "__block").orderBy("__ms")
    starts = F.coalesce(F.col("__ms") - F.lag("__ms").over(w) > gap_ms, F.lit(True)).cast("int")
    pieces = (
        points.withColumn("__starts", starts)
        .withColumn("__seq", F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("__user", "__block", "__seq")
        .agg(F.min("__ms").alias("__s"), F.max("__ms").alias("__e"), F.sum("__n").alias("__n"))
    )
    last = F.max("__seq").over(Window.partitionBy("__user", "__block"))
    pieces = pieces.withColumn("__edge", (F.col("__seq") == 1) | (F.col("__seq") == last))
    across = Window.partitionBy("__user").orderBy("__s")
    edges = (
        pieces.where("__edge")
        .withColumn("__starts", F.coalesce(F.col("__s") - F.lag("__e").over(across) > gap_ms, F.lit(True)).cast("int"))
        .withColumn("__seq", F.sum("__starts").over(across.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("__user", "__seq")
        .agg(F.min("__s").alias("__s"), F.max("__e").alias("__e"), F.sum("__n").alias("__n"))
    )
    whole = pieces.where("not __edge").select("__user", "__s", "__e", "__n").unionByName(edges.select("__user", "__s", "__e", "__n"))
    return whole.select(F.col("__user").alias(user), F.col("__s").alias("start_ms"), F.col("__e").alias("end_ms"), (F.col("__e") - F.col("__s")).alias("duration_ms"), F.col("__n").alias("n_events"))
