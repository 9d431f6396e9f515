"""Problem 8: items packed into containers of fixed capacity by minimum bin slack."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.session import cut

#: Items of one shard on average; bounds what a task sorts and holds.
SHARD_ITEMS = 4096
_PACKED = "doc_id long, piece_no int, start_token long, n_tokens long, shard long, bin int, bin_fill long"


def fullest(stock: dict[int, list], lengths: list[int], room: int) -> list[int]:
    """Lengths of a combination of the stock's items with the greatest total not above ``room``.

    ``lengths`` are the stock's distinct lengths in the order they are tried. Bit i of the set says that
    total i can be reached; each item shifts the set. Stops as soon as ``room`` itself is reached.
    """
    mask, full = (1 << (room + 1)) - 1, 1 << room
    reach, steps = 1, []
    for n in lengths:
        if n > room:
            continue
        for _ in range(min(len(stock[n]), room // n)):
            wider = (reach | reach << n) & mask
            if wider == reach:
                break
            steps.append((n, reach))
            reach = wider
            if reach & full:
                break
        if reach & full:
            break
    total, chosen = reach.bit_length() - 1, []
    for n, before in reversed(steps):
        if not before >> total & 1:
            chosen.append(n)
            total -= n
    return chosen


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indexes of the items in each bin. Each bin takes the longest item left and the fullest combination beside it.

    Sizes must lie in 1..capacity. Ties between items of one size go to the later index.
    """
    stock: dict[int, list[int]] = {}
    for i, n in enumerate(sizes):
        stock.setdefault(n, []).append(i)
    lengths, bins = sorted(stock, reverse=True), []
    while lengths:
        first = lengths[0]
        taken = [stock[first].pop()]
        if not stock[first]:
            del stock[first]
            lengths.pop(0)
        for n in fullest(stock, lengths, capacity - first):
            taken.append(stock[n].pop())
            if not stock[n]:
                del stock[n]
                lengths.remove(n)
        bins.append(taken)
    return bins


def _packer(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece_no"], ignore_index=True)
        sizes = pdf.n_tokens.tolist()
        solid = [i for i, n in enumerate(sizes) if n > 0]
        bins = pack([sizes[i] for i in solid], capacity)
        at, fill = [0] * len(sizes), [0] * max(1, len(bins))
        for b, members in enumerate(bins):
            for i in members:
                at[solid[i]] = b
                fill[b] += sizes[solid[i]]
        return pdf.assign(bin=at, bin_fill=[fill[b] for b in at])[[c.split()[0] for c in _PACKED.split(", ")]]

    return run


def pack_documents(docs: DataFrame, *, key: str, tokens: str, capacity: int, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(doc_id, piece_no, start_token, n_tokens, container_id, fill) of each item or piece of an item.

    An item above ``capacity`` is cut into pieces of ``capacity`` and a rest; no other is cut. Null
    sizes count as 0; items of size 0 lie in their shard's first container. Repeated keys are
    items of their own. An empty table gives no rows.

    Items are spread over shards by hash, so a shard's size doesn't depend on any column's skew, and
    packed shard by shard. Bins that stay short of full are opened again and repacked together in a second
    round over as many fewer shards, so the space left over is that of a few bins, not of one bin a shard.
    """
    n = F.coalesce(F.col(tokens), F.lit(0)).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)), F.lit(capacity).cast("long"))
    pieces = docs.select(F.col(key).cast("long").alias("doc_id"), n.alias("__n"), F.posexplode(starts).alias("piece_no", "start_token"))
    pieces = cut(pieces.select("doc_id", "piece_no", "start_token", F.least(F.col("__n") - F.col("start_token"), F.lit(capacity)).alias("n_tokens")), "pieces")
    first = cut(_round(pieces, capacity, shard_items), "packed")
    open_bins = first.where(F.col("bin_fill") < capacity)
    second = _round(open_bins.select(pieces.columns), capacity, shard_items)
    place = lambda df, no: df.select(
        "doc_id", "piece_no", "start_token", "n_tokens", (F.lit(no << 56) + F.shiftleft("shard", 24) + F.col("bin")).alias("container_id"), F.col("bin_fill").alias("fill")
    )
    return place(first.where(F.col("bin_fill") == capacity), 0).unionByName(place(second, 1))


def _round(pieces: DataFrame, capacity: int, shard_items: int) -> DataFrame:
    shards = max(1, -(-pieces.count() // shard_items))
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(shards)))
    # A fixed number of partitions: packing costs more time a byte than adaptive coalescing expects.
    return sharded.repartition(-(-shards // 4), "shard").groupBy("shard").applyInPandas(_packer(capacity), _PACKED)


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, the least number of containers possible, the share of space used."""
    c = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
    return c.agg(
        F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_tokens"),
        F.ceil(F.coalesce(F.sum("t"), F.lit(0)) / F.lit(capacity)).alias("least_containers"), (F.sum("t") / (F.count(F.lit(1)) * F.lit(capacity))).alias("space_used"),
    )
