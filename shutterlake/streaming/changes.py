"""Change logs as streams: membership kept up to date, debounced change notices, sessions as they close."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shutterlake.operators.tagging import Group, rule_matches

QUIET_MS, LONGEST_MS = 200, 1000


def read_log(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """A folder of log files as a stream; ``files_per_trigger`` bounds a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def follow_members(log: DataFrame, assets: DataFrame, exclusions: DataFrame, groups: list[Group], members_path: str, checkpoint: str):
    """Keep a rule collection's members below ``members_path`` from a log with ``asset_id``.

    Each micro-batch looks at the assets it names and writes those that match and are not excluded to a folder of its own
    number, so a repeated batch replaces what it wrote. Members are only added; readers take distinct rows.
    """

    def one(batch: DataFrame, no: int) -> None:
        touched = batch.where("asset_id is not null").select(F.col("asset_id").alias("id")).distinct()
        hit = rule_matches(assets.join(touched, "id", "left_semi"), groups).join(exclusions, ["repository_id", "asset_id"], "left_anti")
        hit.write.mode("overwrite").parquet(f"{members_path}/batch={no}")

    return log.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bursts(times: list[int], open_burst: tuple[int, int, int] | None, quiet_ms: int, longest_ms: int):
    """Closed bursts (first, last, n) and the one still open, from sorted times and the burst open before.

    A burst ends after ``quiet_ms`` without an event, or before the event that would make it ``longest_ms`` old.
    """
    closed, at = [], open_burst
    for t in times:
        if at is not None and (t - at[1] >= quiet_ms or t - at[0] >= longest_ms):
            closed.append(at)
            at = None
        at = (t, t, 1) if at is None else (at[0], max(at[1], t), at[2] + 1)
    return closed, at


def debounce(log: DataFrame, *, scope: str, at: str, quiet_ms: int = QUIET_MS, longest_ms: int = LONGEST_MS, late: str = "10 seconds") -> DataFrame:
    """(scope, first_ms, last_ms, n) of each burst of a stream with timestamps ``at``, emitted once it is over.

    The state of a scope is its open burst (three numbers). Events later than the watermark are dropped by the
    stream; a burst still open when the watermark passes its end is closed by timeout.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            closed, held = [held], None
        else:
            times = sorted(t for pdf in batches for t in pdf["__ms"])
            closed, held = bursts(times, held, quiet_ms, longest_ms)
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update(held)
            state.setTimeoutTimestamp(max(held[1] + quiet_ms, state.getCurrentWatermarkMs() + 1))
        if closed:
            yield pd.DataFrame([(key[0], *map(int, c)) for c in closed], columns=["scope", "first_ms", "last_ms", "n"])

    kind = dict(log.dtypes)[scope]
    e = log.select(F.col(scope), F.col(at).cast("timestamp").alias("__at")).where("__at is not null").withWatermark("__at", late).withColumn("__ms", F.unix_millis("__at"))
    return e.groupBy(scope).applyInPandasWithState(step, f"scope {kind}, first_ms long, last_ms long, n long", "first long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)


#: Directories a notice lists; beyond that it lists none, which means all of the scope.
MAX_ITEMS = 66


def dirty_batches(log: DataFrame, *, scope: str, item: str, at: str, quiet_ms: int = QUIET_MS, longest_ms: int = LONGEST_MS, late: str = "10 seconds") -> DataFrame:
    """(scope, first_ms, last_ms, items) of each burst as in ``debounce``, with the distinct items it names, sorted; none if there are more than ``MAX_ITEMS``. Records without an item open no burst.

    So the state of a scope is bounded however many items change: an overflow is kept as a mark, not as items.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = None
        if state.exists:
            first, last, items, over = state.get
            held = [first, last, set(filter(None, items.split("\n"))), over]
        closed = []
        if state.hasTimedOut:
            closed, held = [held], None
        else:
            for t, i in sorted(x for pdf in batches for x in zip(pdf["__ms"], pdf["__item"]) if x[1]):
                if held is not None and (t - held[1] >= quiet_ms or t - held[0] >= longest_ms):
                    closed.append(held)
                    held = None
                held = held or [t, t, set(), False]
                held[1] = max(held[1], t)
                if i not in held[2]:
                    if len(held[2]) < MAX_ITEMS:
                        held[2].add(i)
                    else:
                        held[3] = True
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update((int(held[0]), int(held[1]), "\n".join(sorted(held[2])), held[3]))
            state.setTimeoutTimestamp(max(held[1] + quiet_ms, state.getCurrentWatermarkMs() + 1))
        if closed:
            yield pd.DataFrame([(key[0], int(a), int(b), [] if over else sorted(items)) for a, b, items, over in closed], columns=["scope", "first_ms", "last_ms", "items"])

    kind = dict(log.dtypes)[scope]
    name = F.regexp_replace(F.col(item).cast("string"), "\n", " ")
    e = log.select(F.col(scope), name.alias("__item"), F.col(at).cast("timestamp").alias("__at")).where("__at is not null").withWatermark("__at", late).withColumn("__ms", F.unix_millis("__at"))
    return e.groupBy(scope).applyInPandasWithState(step, f"scope {kind}, first_ms long, last_ms long, items array<string>", "first long, last long, items string, over boolean", "append", GroupStateTimeout.EventTimeTimeout)


def stream_sessions(log: DataFrame, *, user: str, at: str, gap: str, late: str = "1 day") -> DataFrame:
    """Sessions of a stream, complete when the watermark has passed their end. A gap of exactly ``gap`` separates, unlike the batch operator's."""
    e = log.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    s = e.groupBy(F.col(user), F.session_window("__at", gap)).agg(F.min("__at").alias("start_at"), F.max("__at").alias("end_at"), F.count(F.lit(1)).alias("n_events"))
    return s.select(user, "start_at", "end_at", "n_events")


#: Time of a closing record: later than any event, so the watermark it sets passes the end of every session; Arrow batches hold no times beyond 2262.
CLOSING_TIME = "2262-01-01 00:00:00"


def drain_ended(spark: SparkSession, log: DataFrame, build: Callable[[DataFrame], DataFrame], *, at: str, work: str) -> DataFrame:
    """The table of ``build(log)`` once the log has ended, with what the watermark still held back.

    ``build`` gets the log with a second source below ``work``, which is empty in the first run. The second run goes on
    from its state and reads a single closing record there, so no event of the log can come after it. What the record
    itself opens (at ``CLOSING_TIME``, all else null) stays in the state and is not emitted.
    """
    record = spark.range(1).select(*[F.lit(CLOSING_TIME if f.name == at else None).cast(f.dataType).alias(f.name) for f in log.schema])
    record.where("false").write.parquet(f"{work}/end")
    stream = build(log.unionByName(spark.readStream.schema(log.schema).parquet(f"{work}/end")))
    drain(stream, f"{work}/rows", f"{work}/log")
    record.write.mode("append").parquet(f"{work}/end")
    return drain(stream, f"{work}/rows", f"{work}/log")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is into a table, and read it."""
    q = commit_batches(stream, path, checkpoint, mode=mode)
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def commit_batches(stream: DataFrame, path: str, checkpoint: str, every: str | None = None, mode: str = "append"):
    """Start writing a stream to a table, a commit for each micro-batch: as many files as ``read_log`` allows, or what came within ``every`` (as ``5 seconds``).

    Without ``every`` the stream ends once it has read all there is.
    """
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
