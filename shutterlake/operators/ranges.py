"""Extremes over a range around each point, without listing pairs.

The axis is cut into blocks. A range is the end of one block, whole blocks, and the start of another, so
running minima from either end of a block answer it: one sort per block, linear in the points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FAR = (1 << 62) - 1


def range_extremes(points: DataFrame, probes: DataFrame, *, group: list[str], at: str, lo: Column, hi: Column, block: Callable[[Column], Column], least: list[str], most: list[str]) -> DataFrame:
    """For each row of ``probes`` (group, at): the minima of ``least`` and maxima of ``most`` over the points in [lo, hi].

    ``points`` must be distinct in (group, at), ``probes`` too. ``lo`` and ``hi`` are columns of ``at``.
    ``block`` must be monotone, and for each probe either lo's block lies before hi's or the block holds
    a single position. A window partition is one block of one group: at most as many rows as the block
    has positions, and as many probes. Nulls in payloads are skipped; a range without points gives nulls.
    """
    g = [F.col(c) for c in group]
    payload = list(dict.fromkeys(least + most))
    ext = lambda w: {f"__lo_{c}": F.min(c).over(w) for c in least} | {f"__hi_{c}": F.max(c).over(w) for c in most}
    p = points.select(*g, block(F.col(at)).alias("__b"), F.col(at).alias("__pos"), F.lit(0).alias("__probe"), F.lit(None).cast("long").alias("__x"), *payload)
    nothing = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in payload]
    q = probes.select(*g, F.col(at).alias("__x"), lo.alias("__l"), hi.alias("__h")).withColumns({"__lb": block(F.col("__l")), "__hb": block(F.col("__h"))})
    ends = q.select(*g, F.col("__lb").alias("__b"), F.col("__l").alias("__pos"), F.lit(1).alias("__probe"), "__x", *nothing)
    rest = q.where("__hb > __lb").select(*g, F.explode(F.sequence(F.col("__lb") + 1, F.col("__hb"))).alias("__b"), "__hb", "__h", "__x")
    heads = rest.select(*g, "__b", F.when(F.col("__b") == F.col("__hb"), F.col("__h")).otherwise(F.lit(_FAR)).alias("__pos"), F.lit(1).alias("__probe"), "__x", *nothing)
    run = lambda order: Window.partitionBy(*group, "__b").orderBy(order, "__probe").rowsBetween(Window.unboundedPreceding, 0)
    # The explicit partitioning keeps the window from trusting that the union's inputs are partitioned alike.
    found = [p.unionByName(part).repartition(*group, "__b").withColumns(ext(run(order))).where("__probe = 1") for part, order in ((ends, F.col("__pos").desc()), (heads, F.col("__pos").asc()))]
    aggs = [F.min(f"__lo_{c}").alias(f"least_{c}") for c in least] + [F.max(f"__hi_{c}").alias(f"most_{c}") for c in most]
    return found[0].unionByName(found[1]).groupBy(*g, F.col("__x").alias(at)).agg(*aggs)
