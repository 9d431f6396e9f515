"""Problem 2: references to records that do not exist (at the time of the reference).

Parent keys are compressed into runs of consecutive integers inside fixed-width key buckets. Each
distinct reference key is matched as-of to the preceding run start of its bucket; a key beyond that
run's end (or before the first run) has no parent. Buckets bound what one task sorts, whatever the
number of references: references are reduced to their distinct keys first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys per bucket; a window partition holds at most twice as many rows (parents' runs and references).
BUCKET_BITS = 16


def _bucket(key: Column) -> Column:
    return F.shiftright(key, BUCKET_BITS)


def key_runs(parents: DataFrame, scope: str, key: str) -> DataFrame:
    """(scope, bucket, run_start, run_end): maximal runs of consecutive keys in each scope and bucket.

    Gaps-and-islands: key minus row number is constant along a run.
    """
    keys = parents.where(F.col(key).isNotNull() & F.col(scope).isNotNull()).select(scope, key).distinct()
    w = Window.partitionBy(scope, "bucket").orderBy(key)
    return (
        keys.withColumn("bucket", _bucket(F.col(key)))
        .withColumn("island", F.col(key) - F.row_number().over(w))
        .groupBy(scope, "bucket", "island")
        .agg(F.min(key).alias("run_start"), F.max(key).alias("run_end"))
        .drop("island")
    )


def match_runs(refs: DataFrame, runs: DataFrame, scope: str, key: str) -> DataFrame:
    """``refs``, distinct in scope and key, with ``in_run``: whether the preceding run start's run reaches the key."""
    w = Window.partitionBy(scope, "bucket").orderBy(F.col("at"), F.col("is_ref")).rowsBetween(Window.unboundedPreceding, 0)
    rest = [c for c in refs.columns if c not in (scope, key)]
    nothing = [F.lit(None).cast(refs.schema[c].dataType).alias(c) for c in rest]
    events = runs.select(scope, "bucket", F.col("run_start").alias("at"), F.lit(0).alias("is_ref"), "run_end", *nothing).unionByName(
        refs.select(scope, _bucket(F.col(key)).alias("bucket"), F.col(key).alias("at"), F.lit(1).alias("is_ref"), F.lit(None).cast("long").alias("run_end"), *rest)
    )
    return (
        events.repartition(scope, "bucket")  # the window must not trust that the union's inputs are partitioned alike
        .withColumn("reach", F.last("run_end", ignorenulls=True).over(w))
        .where("is_ref = 1")
        .select(scope, F.col("at").alias(key), F.coalesce(F.col("reach") >= F.col("at"), F.lit(False)).alias("in_run"), *rest)
    )


def orphan_references(
    refs: DataFrame, parents: DataFrame, *, ref_id: str, ref_key: str, ref_time: str, parent_key: str, born: str, gone: str,
    scope: str | None = None, time_unit: str = "timestamp",
) -> DataFrame:
    """(ref_id, ref_time, orphan_kind) of each reference that does not resolve at its time.

    ``missing``: no parent has the key (with ``scope``: the key in that scope). ``later``: the parent
    came after the reference. ``deleted``: it was gone by then. A parent that came later and is also
    gone counts as ``later``. Null keys are no references; a null scope matches no parent; a null
    reference time can only be ``missing``; null ``born``/``gone`` never make an orphan. Repeated rows
    give one result row. Parents whose key repeats count as one that came with the first and went with
    the last (only if none is still there). Empty tables: no parents makes every reference missing.
    ``time_unit`` says what ``born`` and ``gone`` are: ``timestamp`` or ``millis``.
    """
    if time_unit == "millis":
        when = F.unix_millis(F.col(ref_time).cast("timestamp"))
    else:
        when = F.unix_micros(F.col(ref_time).cast("timestamp"))
        parents = parents.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in (born, gone)})
    in_scope = F.col(scope) if scope else F.lit("")
    r = refs.where(F.col(ref_key).isNotNull()).select(
        in_scope.alias("__scope"), F.col(ref_key).cast("long").alias("__key"), F.col(ref_id).alias("ref_id"), F.col(ref_time).alias("ref_time"), when.alias("__at")
    )
    p = (
        parents.where(F.col(parent_key).isNotNull())
        .select((F.col(scope) if scope else F.lit("")).alias("__scope"), F.col(parent_key).cast("long").alias("__key"), F.col(born).alias("__born"), F.col(gone).alias("__gone"))
        .where("__scope is not null")
        .groupBy("__scope", "__key")
        .agg(F.min("__born").alias("__born"), F.when(F.count("__gone") == F.count(F.lit(1)), F.max("__gone")).alias("__gone"))
    )
    # One row per distinct reference key, with the span of its reference times: partial aggregation tames hot keys.
    keys = r.groupBy("__scope", "__key").agg(F.min("__at").alias("__first"), F.max("__at").alias("__last"))
    # The match needs the keys only; their times wait where the keys were aggregated, as the parents' do, and nothing but the match's flag moves.
    names = keys.where("__scope is not null").select("__scope", "__key")
    placed = match_runs(names, key_runs(p, "__scope", "__key"), "__scope", "__key")
    known = (
        keys.join(placed, ["__scope", "__key"], "left")
        .join(p, ["__scope", "__key"], "left")
        .withColumn("__missing", ~F.coalesce(F.col("in_run"), F.lit(False)))
    )
    # Only keys with at least one orphan go back to the rows.
    suspect = known.where("__missing or __first < __born or __last >= __gone").select(
        F.col("__scope").alias("__s"), F.col("__key").alias("__k"), "__missing", "__born", "__gone"
    )
    kind = F.when(F.col("__missing"), "missing").when(F.col("__born") > F.col("__at"), "later").when(F.col("__gone") <= F.col("__at"), "deleted")
    return (
        r.join(suspect, (F.col("__key") == F.col("__k")) & F.col("__scope").eqNullSafe(F.col("__s")))
        .select("ref_id", "ref_time", kind.alias("orphan_kind"))
        .where("orphan_kind is not null")
        .distinct()
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per table, period and kind."""
    return orphans.groupBy("ref_table", "month_key", "orphan_kind").agg(F.count(F.lit(1)).alias("n_refs"))
