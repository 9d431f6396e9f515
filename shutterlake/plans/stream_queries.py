"""Streaming queries, each run over all of its log; their results are those of the batch, so SQL can say most."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.plans.book import Book
from shutterlake.plans.catalog_queries import RULE, RULE_SQL
from shutterlake.session import drop_at_exit, shared_dir
from shutterlake.sources.tables import table
from shutterlake.streaming import changes as s

query = Book()


def _log(spark, root, name):
    return s.read_log(spark, f"{root}/{name}.parque[t]", table(spark, root, name).schema)


@query(f"""SELECT repository_id, id AS asset_id FROM assets a WHERE {RULE_SQL} AND EXISTS (SELECT 1 FROM flag_marks m WHERE m.asset_id = a.id)
  AND NOT EXISTS (SELECT 1 FROM external_tasks e WHERE e.repository_id = a.repository_id AND e.asset_id = a.id)""")
def stream_members(spark, root):
    at = shared_dir(spark, "members")
    q = s.follow_members(_log(spark, root, "flag_marks"), table(spark, root, "assets"), table(spark, root, "external_tasks").select("repository_id", "asset_id"), RULE, f"{at}/rows", f"{at}/log")
    q.awaitTermination()
    drop_at_exit(spark, at)
    return spark.read.parquet(f"{at}/rows").select("repository_id", "asset_id").distinct()


@query()
def stream_debounce(spark, root):
    return _ended(spark, root, "bursts", lambda log: s.debounce(log, scope="user_id", at="ts", quiet_ms=600_000, longest_ms=3_600_000))


@query()
def stream_dirty(spark, root):
    """Bursts of each kind of event with the users they name; none where they are too many."""
    return _ended(spark, root, "dirty", lambda log: s.dirty_batches(log, scope="event_type", item="user_id", at="ts", quiet_ms=60_000, longest_ms=3_600_000))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events WHERE ts IS NOT NULL),
f AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t) >= 1800000000, true)::INT AS starts FROM e),
n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS no FROM f)
SELECT user_id, min(t) // 1000 AS start_ms, max(t) // 1000 AS end_ms, count(*) AS n_events FROM n GROUP BY user_id, no""")
def stream_sessions(spark, root):
    out = _ended(spark, root, "stream-sessions", lambda log: s.stream_sessions(log, user="user_id", at="ts", gap="30 minutes"))
    return out.select("user_id", F.unix_millis("start_at").alias("start_ms"), F.unix_millis("end_at").alias("end_ms"), "n_events")


def _ended(spark, root, name, build):
    """The stream over all events, with what is open at their end, in a folder that goes with the driver."""
    at = shared_dir(spark, name)
    out = s.drain_ended(spark, _log(spark, root, "events"), build, at="ts", work=at)
    drop_at_exit(spark, at)
    return out
