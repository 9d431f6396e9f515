"""Problem 9: sources mixed to target weights by Pfair scheduling."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from math import ceil, floor, lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.operators.ranking import running_sums

#: Documents in one bucket of a running sum, on average.
BUCKET_ROWS = 20_000
#: Longest period of the schedule; shares are rounded to multiples of 1 / period.
MAX_PERIOD = 10_000


def block_counts(shares: list[float], longest: int = MAX_PERIOD) -> list[int]:
    """Blocks of each source in one period: exact for shares that are multiples of 1/n, n <= ``longest``; else by largest remainder."""
    total = sum(shares)
    exact = [Fraction(x / total).limit_denominator(longest) for x in shares]
    if sum(exact) == 1:
        period = lcm(*(f.denominator for f in exact))
        if period <= longest:
            return [int(f * period) for f in exact]
    counts = [floor(x / total * longest) for x in shares]
    by_rest = sorted(range(len(shares)), key=lambda i: (counts[i] - shares[i] / total * longest, i))
    for i in by_rest[: longest - sum(counts)]:
        counts[i] += 1
    return counts


def pfair_schedule(counts: list[int]) -> list[int]:
    """The source of each slot of one period.

    Block i (from 1) of a source of weight w is released at floor((i-1)/w) and due at ceil(i/w); each slot
    goes to the released block due first (ties: the lower index). So after t slots each source has more than
    w*t - 1 and less than w*t + 1 blocks.
    """
    period, done, slots = sum(counts), [0] * len(counts), []
    for t in range(period):
        ready = [(ceil(Fraction((done[s] + 1) * period, n)), s) for s, n in enumerate(counts) if done[s] < n and done[s] * period // n <= t]
        due, s = min(ready)
        assert due > t, "a deadline was missed"
        done[s] += 1
        slots.append(s)
    return slots


@dataclass
class MixPlan:
    """What the totals of the sources (one row each) decide: slots, blocks and passes by source."""

    sources: list[str]
    targets: list[float]
    available: list[int]
    max_repeats: list[int]
    schedule: list[int]
    blocks: list[int]
    block_tokens: int

    def passes(self, i: int) -> int:
        return -(-self.blocks[i] * self.block_tokens // self.available[i]) if self.available[i] else 0


def plan_mixture(rows: list[tuple[str, float, int, int]], block_tokens: int) -> MixPlan:
    """``rows``: (source, target share, max repeats, tokens). The mixture is as long as the scarcest source allows.

    Sources without tokens, with a share or repeat cap that is not positive can't contribute; the others
    keep their shares in proportion to each other.
    """
    usable = [(s, w, r, n) for s, w, r, n in sorted(rows, key=lambda x: x[0]) if n > 0 and w > 0 and r > 0]
    if not usable:
        return MixPlan([], [], [], [], [], [], block_tokens)
    names, shares, repeats, tokens = (list(x) for x in zip(*usable))
    counts = block_counts(shares)
    schedule, period = pfair_schedule(counts), sum(counts)
    prefix = [[0] * len(names)]
    for s in schedule:
        prefix.append([c + (i == s) for i, c in enumerate(prefix[-1])])
    caps = [n * r // block_tokens for n, r in zip(tokens, repeats)]
    blocks_at = lambda n: [c * (n // period) + p for c, p in zip(counts, prefix[n % period])]
    slots = min(int(Fraction((cap + 1) * period, c)) for cap, c in zip(caps, counts) if c)
    while slots and any(b > cap for b, cap in zip(blocks_at(slots), caps)):
        slots -= 1
    return MixPlan(names, shares, tokens, repeats, schedule, blocks_at(slots), block_tokens)


def mix(docs: DataFrame, targets: DataFrame, *, key: str, source: str, tokens: str, block_tokens: int = 1024, seed: int = 17) -> DataFrame:
    """(doc_id, source, pass_no, start_token, n_tokens, block_no, slot) of each use of a text.

    Reading by (slot, start_token) gives the mixture. Each source's texts are laid end to end in an order
    drawn by hash anew for each pass; a text lies in the block its first token falls into and is never cut.
    Slots go to blocks by ``pfair_schedule``: the share of each source deviates by less than one block (plus
    the rest of the text that crosses its end) at any point. A text is used at most ``max_repeats`` times.
    Rows whose source is null or not among the targets belong to no mixture. Null sizes count as 0. Equal
    keys are texts of their own. Without texts or targets the result is empty.

    Running sums are taken in hash buckets and then over the buckets' sums, so no source is sorted in one task.
    """
    t = targets.groupBy(F.col("source").alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where("source is not null")
    d = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("n_tokens")).where("source is not null")
    plan = plan_of(d, t, block_tokens)
    return _lay(d, plan, seed)


def plan_of(d: DataFrame, t: DataFrame, block_tokens: int) -> MixPlan:
    """The driver sees one row a target, no documents."""
    sums = d.groupBy("source").agg(F.sum("n_tokens").alias("n"))
    rows = t.join(sums, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("n", F.lit(0))).collect()
    return plan_mixture([tuple(r) for r in rows], block_tokens)


def _lay(d: DataFrame, plan: MixPlan, seed: int) -> DataFrame:
    spark = d.sparkSession
    period = len(plan.schedule)
    per_source = [(s, i, plan.passes(i), plan.blocks[i] * plan.block_tokens, plan.schedule.count(i), [t for t, x in enumerate(plan.schedule) if x == i]) for i, s in enumerate(plan.sources)]
    # As many rows as the target table, each with at most MAX_PERIOD slot numbers: small enough to send to all.
    book = spark.createDataFrame(per_source or [("", 0, 0, 0, 1, [0])], "source string, no int, passes int, quota long, per_period long, slots array<int>")
    bits = max(4, (max(1, d.count()) // BUCKET_ROWS).bit_length())
    uses = d.join(F.broadcast(book), "source").where("passes > 0").withColumn("pass_no", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    uses = uses.withColumn("__h", F.xxhash64("doc_id", "pass_no", F.lit(seed))).withColumn("__b", F.shiftrightunsigned("__h", 64 - bits))
    # xxhash64 is signed; the unsigned shift orders buckets, and within one the sign is constant.
    sums = uses.groupBy("source", "pass_no", "__b").agg(F.sum("n_tokens").alias("__t"))
    over = Window.partitionBy("source").orderBy("pass_no", "__b")
    sums = sums.withColumn("__before", F.sum("__t").over(over) - F.col("__t")).select("source", "pass_no", "__b", "__before")
    within = Window.partitionBy("source", "pass_no", "__b").orderBy("__h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    laid = uses.withColumn("__in", F.sum("n_tokens").over(within) - F.col("n_tokens")).join(sums, ["source", "pass_no", "__b"])
    laid = laid.withColumn("start_token", F.col("__before") + F.col("__in")).where("start_token < quota")
    laid = laid.withColumn("block_no", F.expr(f"start_token div {plan.block_tokens}"))
    slot = F.expr(f"block_no div per_period * {period} + slots[cast(block_no % per_period as int)]")
    return laid.select("doc_id", "source", "pass_no", "start_token", "n_tokens", "block_no", slot.alias("slot"))


def share_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: its target and actual share, tokens, texts used and the most uses of one text."""
    per_doc = mixture.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.sum("n_tokens").alias("t"))
    got = per_doc.groupBy("source").agg(F.sum("t").alias("mix_tokens"), F.count(F.lit(1)).alias("n_texts"), F.max("uses").alias("most_uses"))
    whole = F.sum("mix_tokens").over(Window.partitionBy(F.lit(1)))  # over the rows of the target table
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        targets.select("source", "target_share", "max_repeats")
        .join(got, "source", "left")
        .select("source", "target_share", "max_repeats", zero("mix_tokens"), zero("n_texts"), zero("most_uses"), F.coalesce(F.col("mix_tokens") / whole, F.lit(0.0)).alias("actual_share"))
    )


def deviation_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, most_over, most_under) in tokens: how far each source is beyond and behind its share of what was read, after any slot of the mixture.

    Sums run over ranged partitions of the slots, so no task reads the whole mixture.
    """
    rows = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("w")).orderBy("source").collect()
    used = {r.source for r in mixture.select("source").distinct().collect()}
    shares = {r.source: r.w for r in rows if r.source in used}
    per_slot = mixture.groupBy("slot").agg(*[F.sum(F.when(F.col("source") == s, F.col("n_tokens")).otherwise(0)).alias(f"t{i}") for i, s in enumerate(shares)], F.sum("n_tokens").alias("t"))
    upto = running_sums(per_slot, [], ["slot"], {f"u{i}": F.col(f"t{i}") for i in range(len(shares))} | {"u": F.col("t")})
    whole = sum(shares.values())
    off = [F.struct(F.lit(s).alias("source"), (F.col(f"u{i}") - F.col("u") * (w / whole)).alias("d")) for i, (s, w) in enumerate(shares.items())]
    if not off:
        return targets.select("source", F.lit(0.0).alias("most_over"), F.lit(0.0).alias("most_under")).limit(0)
    return upto.select(F.explode(F.array(*off)).alias("o")).groupBy("o.source").agg(F.round(F.max("o.d"), 3).alias("most_over"), F.round(F.min("o.d"), 3).alias("most_under"))
