"""Ranks, sequence numbers, running sums and order statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.session import cut


def running_sums(df: DataFrame, by: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """``df`` with, for each of ``values``, the sum over the rows of its key up to and including it, ordered by ``order`` (unique within a key).

    Safe for keys that hold much of the table: rows are ranged by key and order over all partitions, sums run within a
    partition, and a key that spans several gets the totals of the partitions before. At most one key spans a border, so
    these totals are at most two rows a partition and are sent to all executors. The ranged rows are materialised, as their
    borders come from a sample.
    """
    keys = [F.col(c) for c in by]
    v = {n: f"__v{i}" for i, n in enumerate(values)}
    ranged = df.withColumns({v[n]: c for n, c in values.items()}).repartitionByRange(*keys, *[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id())
    ranged = cut(ranged, "ranged")
    inside = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    group = F.to_json(F.struct(*by)) if by else F.lit("")  # a null key is a key of its own
    sums = ranged.groupBy(group.alias("__key"), F.col("__part").alias("__p")).agg(*[F.sum(c).alias(f"__t{c}") for c in v.values()])
    parts = Window.partitionBy("__key").orderBy("__p")
    before = {f"__b{c}": F.sum(f"__t{c}").over(parts) - F.col(f"__t{c}") for c in v.values()}
    sums = sums.withColumns(before).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("__key"))).where("__n > 1")
    out = ranged.withColumns({f"__in{c}": F.sum(c).over(inside) for c in v.values()})
    out = out.join(F.broadcast(sums.select("__key", "__p", *before)), (group == F.col("__key")) & (F.col("__part") == F.col("__p")), "left")
    out = out.withColumns({n: F.col(f"__in{c}") + F.coalesce(f"__b{c}", F.lit(0)) for n, c in v.items()})
    return out.drop(*v.values(), "__part", "__key", "__p", *before, *[f"__in{c}" for c in v.values()])


def running_sum(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``running_sums`` of one value."""
    return running_sums(df, by, order, {name: value})


def ordinals(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Zero-based rank of each row of a key, and the key's next number in a ring of 100."""
    counts = df.groupBy(F.col(key).alias("__k")).agg((F.count(F.lit(1)) % 100).cast("int").alias("counter"))
    ranked = running_sum(df, [key], order, F.lit(1).cast("long"), "ordinal").withColumn("ordinal", F.col("ordinal") - 1)
    return ranked.join(counts, F.col(key).eqNullSafe(F.col("__k"))).drop("__k")


def next_free_ordinal(used: DataFrame, key: str, ordinal: str, counter: str, ring: int = 100) -> DataFrame:
    """Per key the first free number of the ring from its counter on, or null if all are taken."""
    per = used.groupBy(key).agg(F.collect_set(F.pmod(F.col(ordinal), F.lit(ring))).alias("used"), F.max(counter).alias("c"))
    free = F.array_except(F.transform(F.sequence(F.lit(0), F.lit(ring - 1)), lambda i: F.pmod(i + F.col("c"), F.lit(ring)).cast("int")), F.col("used").cast("array<int>"))
    return per.select(key, F.get(free, F.lit(0)).alias("next_ordinal"))


def sequence_numbers(items: DataFrame, directory: str, order: list[str], skipped: str, width: int, base: int = 0) -> DataFrame:
    """Numbers 1..10^width-1 per directory in order, wrapping; skipped items get none and use none up."""
    top = 10**width - 1
    numbered = running_sum(items, [directory], order, F.when(F.col(skipped), 0).otherwise(1).cast("long"), "__nth")
    return numbered.withColumn("seq", F.when(~F.col(skipped), (F.pmod(F.col("__nth") + (base - 1), F.lit(top)) + 1).cast("long"))).drop("__nth")


def collision_suffixes(items: DataFrame, taken: DataFrame) -> DataFrame:
    """(dir, id, final_stem): the wanted stem if free, else the first free ``stem_NN``; in id order within a directory.

    ``items`` are (dir, id, stem), ``taken`` (dir, stem); names are compared without case. What one item takes
    the next can't, so a directory is one group; its items are what one folder holds.
    """

    def assign(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        used, out, nxt = {s.lower() for s in b.stem}, [], {}
        for i, s in a.sort_values("id")[["id", "stem"]].itertuples(index=False):
            k, name = nxt.get(s.lower(), 0), s
            if s.lower() in used:
                while True:
                    k += 1
                    name = f"{s}_{k:02d}"
                    if name.lower() not in used:
                        break
                nxt[s.lower()] = k
            used.add(name.lower())
            out.append((i, name))
        return pd.DataFrame(out, columns=["id", "final_stem"]).assign(dir=a.dir.iloc[0] if len(a) else "")[["dir", "id", "final_stem"]]

    return items.select("dir", "id", "stem").groupBy("dir").cogroup(taken.select("dir", "stem").groupBy("dir")).applyInPandas(assign, "dir string, id long, final_stem string")


def evict(cache: DataFrame, max_bytes: int, *, key: str, size: str, hits: str, last_used: str, pinned: str) -> DataFrame:
    """Entries to drop, least used first (hits, last use, key), until the total is at most ``max_bytes``; pinned ones stay.

    Null sizes, hits and times count as 0.
    """
    c = cache.select(key, F.coalesce(F.col(size), F.lit(0)).alias("__b"), F.coalesce(F.col(hits), F.lit(0)).alias("__h"), F.coalesce(F.col(last_used), F.lit(0)).alias("__u"), F.col(pinned).alias("__p"))
    total = c.agg(F.coalesce(F.sum("__b"), F.lit(0))).first()[0]
    run = running_sum(c.where("not __p").drop("__p"), [], ["__h", "__u", key], F.col("__b").cast("long"), "__upto")
    return run.withColumn("bytes_before", F.col("__upto") - F.col("__b")).where(F.col("bytes_before") < max(0, total - max_bytes)).select(key, "bytes_before")


def order_statistics(df: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """Per key the values at the given places (from 1, in terms of ``n``, the number of its values) of their sorted list.

    Values are counted before they are ordered, and the counts are summed over ranged partitions, so a key
    with a third of all rows is no single task's. Null values are left out; keys without values give no row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__value")).agg(F.count(F.lit(1)).alias("__c"))
    upto = running_sum(counts, by, ["__value"], F.col("__c"), "__upto")
    totals = counts.groupBy(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)]).agg(F.sum("__c").alias("n"))
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)]
    j = upto.join(totals, same)
    at = {k: F.when((F.col("__upto") >= place) & (F.col("__upto") - F.col("__c") < place), F.col("__value")) for k, place in places.items()}
    return j.groupBy(*by).agg(*[F.max(c).alias(k) for k, c in at.items()])


def nearest_rank(df: DataFrame, by: list[str], value: str, quantiles: list[float], budget: float | None = None, at: str | None = None) -> DataFrame:
    """Exact percentiles by nearest rank (the value at place ceil(q*n)), with mean, least, greatest and count.

    With ``budget`` also the share of values above it; with ``at``, a timestamp, values a second between the first and the last (null if these are one).
    """
    v = F.col(value)
    places = {f"p{round(x * 100)}": F.greatest(F.lit(1), F.ceil(F.lit(x) * F.col("n"))) for x in quantiles}
    more = [F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.count(v).alias("n")]
    if budget is not None:
        more.append(F.round(F.count_if(v > budget) / F.count(v), 6).alias("over_budget"))
    if at is not None:
        seconds = (F.max(F.when(v.isNotNull(), F.unix_micros(F.col(at).cast("timestamp")))) - F.min(F.when(v.isNotNull(), F.unix_micros(F.col(at).cast("timestamp"))))) / 1e6
        more.append(F.round(F.count(v) / F.nullif(seconds, F.lit(0.0)), 6).alias("per_second"))
    known = df.where(v.isNotNull())
    plain = known.groupBy(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)]).agg(*more)
    same = [F.col(c).eqNullSafe(F.col(f"__b{i}")) for i, c in enumerate(by)]
    return order_statistics(known, by, value, places).join(plain, same).drop(*[f"__b{i}" for i in range(len(by))])


def rounded_rank(df: DataFrame, by: str, value: str, q: float) -> DataFrame:
    """The value at index round(q*(n-1)) of the sorted values, from 0: the other definition."""
    return order_statistics(df, [by], value, {"value": F.floor(F.lit(q) * (F.col("n") - 1) + 0.5) + 1})


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value at index floor(n/2) of the sorted values, from 0: of an even number the upper of the two in the middle."""
    return order_statistics(df, by, value, {"median": F.floor(F.col("n") / 2) + 1})


def choose_threshold(pairs: DataFrame, by: str, label: str, score: str, precision: float, min_tp: int = 1, beta: float | None = None) -> DataFrame:
    """Per class the threshold (among its scores) with the greatest recall, or F-``beta``, at a precision of at least ``precision``.

    Predictions are scores at or above the threshold. Ties go to the better precision, then the higher threshold. Scores are
    counted before they are ordered and summed over ranged partitions. Raises on a precision beyond (0, 1], ``min_tp`` below 1 or a ``beta`` that isn't positive.
    """
    if not 0 < precision <= 1 or min_tp < 1 or (beta is not None and not 0 < beta < float("inf")):
        raise ValueError("invalid policy")
    s = pairs.where(F.col(score).isNotNull()).groupBy(by, F.col(score).alias("threshold")).agg(F.sum(label).alias("pos"), F.count(F.lit(1)).alias("all"))
    actual = s.groupBy(F.col(by).alias("__k")).agg(F.sum("pos").alias("actual"))
    s = running_sums(s.withColumn("__down", -F.col("threshold")), [by], ["__down"], {"tp": F.col("pos"), "predicted": F.col("all")})
    s = s.join(actual, F.col(by).eqNullSafe(F.col("__k")))
    s = s.withColumns({"precision": F.col("tp") / F.col("predicted"), "recall": F.col("tp") / F.nullif(F.col("actual"), F.lit(0))}).where((F.col("precision") >= precision) & (F.col("tp") >= min_tp))
    p, r = F.col("precision"), F.col("recall")
    goal = r if beta is None else (1 + beta**2) * p * r / (beta**2 * p + r)
    best = F.max_by(F.struct("threshold", "precision", "recall", "tp"), F.struct(goal.alias("goal"), p, F.col("threshold")))
    return s.groupBy(by).agg(best.alias("b")).select(by, "b.*")


def tri_state(df: DataFrame, by: str, value: str) -> DataFrame:
    """Per group ``none``, ``mixed`` or ``value`` with the one value all rows (null included) agree on."""
    g = df.groupBy(by).agg(F.count_distinct(value).alias("d"), F.count(value).alias("n"), F.count(F.lit(1)).alias("all"), F.min(value).alias("v"))
    state = F.when(F.col("d") == 0, "none").when((F.col("d") > 1) | (F.col("n") < F.col("all")), "mixed").otherwise("value")
    return g.select(by, state.alias("state"), F.when(state == "value", F.col("v")).alias("value"))
