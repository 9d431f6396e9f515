"""Problem 10: spans of at least a given length that appear verbatim in more than one record.

Windows of ``ANCHOR`` characters are hashed only where the position modulo ``PERIOD`` lies in a difference
cover. For any two positions there is a shift below ``PERIOD`` that brings both onto the cover, so two records
that share ``ANCHOR + PERIOD - 1`` characters share the hash of an aligned anchor. Anchors seen in two
records are extended: every span of the full length that contains one is hashed, spans with equal hashes are
grouped, and the passages themselves are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.session import cut

#: A perfect difference set: every residue of the period is a difference of two of its members.
PERIOD = 73
COVER = (0, 1, 3, 7, 15, 31, 36, 54, 63)
#: Characters hashed at a time, and anchors gathered before they are sent.
SEGMENT, FLUSH = 1 << 20, 1 << 21
#: An anchor's hash has so many bits more than the number of anchors, so that about one in 2**24 meets another by chance at any size.
SPARE_BITS = 24
#: Anchors and full spans a hash partition is sized for, and spans sent at a time.
PARTITION_ANCHORS, PARTITION_SPANS, SPAN_ROWS = 1 << 20, 1 << 17, 1 << 18
#: Hash partitions one flush is split into; beyond that anchors are sent in two steps, so that what travels together stays long.
FLUSH_PARTS, STEP_TASKS = 4096, 16
#: Tasks of one stage at most; beyond that a task takes several hash partitions one after the other.
MAX_TASKS = 100_000
#: Documents whose ids may be sent to all executors (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 200_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    base = np.ones(1, dtype=np.uint64)
    inverse = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int):
        if len(cls.base) < n:
            size = max(n, 1 << 16)
            for name, by in (("base", _BASE), ("inverse", _INVERSE)):
                x = np.full(size, np.uint64(by), dtype=np.uint64)
                x[0] = 1
                setattr(cls, name, np.cumprod(x, dtype=np.uint64))
        return cls.base[:n], cls.inverse[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def window_hashes(chars: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``chars[i : i + width]`` for each i of ``at``: a polynomial over mixed characters, modulo 2**64."""
    base, inverse = _Powers.upto(len(chars) + 1)
    sums = np.zeros(len(chars) + 1, dtype=np.uint64)
    np.cumsum(_mix(chars.astype(np.uint64) + np.uint64(0x51ED27)) * base[: len(chars)], out=sums[1:])
    return _mix((sums[at + width] - sums[at]) * inverse[at])


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' characters end to end, and where each starts (with the end of the last)."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return code_points("".join(texts)), np.concatenate([[0], np.cumsum(lengths)])


def cover_positions(length: int, width: int) -> np.ndarray:
    """Positions on the cover at which a window of ``width`` fits into ``length`` characters."""
    last = length - width
    if last < 0:
        return np.zeros(0, dtype=np.int64)
    p = (np.arange(last // PERIOD + 1, dtype=np.int64)[:, None] * PERIOD + np.array(COVER)).ravel()
    return p[p <= last]


def _anchors(ids: list[int], texts: list[str], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, doc, position) of all anchors, a segment of characters at a time; longer texts in overlapping parts."""
    batch: list[tuple[int, int, str]] = []
    room = SEGMENT

    def run():
        chars, starts = _joined([t for _, _, t in batch])
        spots = [cover_positions(len(t), width) for _, _, t in batch]
        counts = np.array([len(s) for s in spots])
        local = np.concatenate(spots)
        at = local + np.repeat(starts[:-1], counts)
        return window_hashes(chars, width, at), np.repeat(np.array([d for d, _, _ in batch], dtype=np.int64), counts), local + np.repeat(np.array([o for _, o, _ in batch], dtype=np.int64), counts)

    step = SEGMENT // PERIOD * PERIOD
    for doc, text in zip(ids, texts):
        for offset in range(0, max(1, len(text) - width + 1), step):
            part = text if len(text) <= step else text[offset : offset + step + width - 1]
            if len(part) < width:
                continue
            batch.append((doc, offset, part))
            room -= len(part)
            if room <= 0:
                yield run()
                batch, room = [], SEGMENT
    if batch:
        yield run()


def _press(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, byte plane by byte plane, compressed."""
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def _unpress(blob: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), dtype=np.uint8)
    out[:, :width] = raw.T
    return out.reshape(-1).view("<u8").copy()


_BLOBS = "part int, known boolean, hashes binary, docs binary, spots binary"


class _Layout:
    """How anchors travel: the partition is the hash modulo their number, the quotient is sent, with one bit above it."""

    def __init__(self, anchors: int):
        self.partitions = max(8, anchors // PARTITION_ANCHORS + 1)
        self.bits = min(63, SPARE_BITS + max(1, anchors).bit_length())
        self.mask = np.uint64((1 << self.bits) - 1)
        self.flag = ((1 << self.bits) // self.partitions).bit_length()
        self.width = self.flag // 8 + 1
        # Hash partitions of one first step, 1 where one step does.
        self.together = -(-self.partitions // FLUSH_PARTS)


def _split(layout: _Layout, h: np.ndarray, d: np.ndarray, p: np.ndarray, known: np.ndarray, stands: np.ndarray, together: int) -> pd.DataFrame:
    """Anchors as one row of compressed columns for each partition and kind; partitions are taken ``together``, with whole hashes, for a first step."""
    part = (h % np.uint64(layout.partitions)).astype(np.int64)
    part[known] = d[known] % layout.partitions
    part //= together
    rows = []
    for flag in (False, True):
        chosen = np.flatnonzero(known == flag)
        chosen = chosen[np.argsort(part[chosen], kind="stable")]
        kinds, edges = np.unique(part[chosen], return_index=True)
        for k, i in zip(kinds.tolist(), np.split(chosen, edges[1:])):
            gaps = np.diff(d[i], prepend=0).astype(np.int64)
            docs = _press((gaps << 1 ^ gaps >> 63).view(np.uint64), 8)
            if flag:
                rows.append((k, True, b"", docs, _press(p[i].view(np.uint64), 8)))
            else:
                # One bit above the hash says that another document of the flush has it.
                x, bit, width = (h[i], 63, 8) if together > 1 else (h[i] // np.uint64(layout.partitions), layout.flag, layout.width)
                rows.append((k, False, _press(x | stands[i].astype(np.uint64) << np.uint64(bit), width), docs, b""))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _BLOBS.split(", ")])


def _second_step(layout: _Layout):
    """Rows of the first step gathered again and split into the hash partitions proper."""

    def gather(held: list) -> pd.DataFrame:
        return _split(layout, *map(np.concatenate, zip(*held)), 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            for row in pdf.itertuples():
                d = _docs(row.docs)
                x = np.zeros(len(d), np.uint64) if row.known else _unpress(row.hashes, 8)
                spots = _unpress(row.spots, 8).astype(np.int64) if row.known else np.zeros(len(d), np.int64)
                held.append((x & layout.mask, d, spots, np.full(len(d), row.known), x >> np.uint64(63) != 0))
                n += len(d)
                if n >= FLUSH:
                    yield gather(held)
                    held, n = [], 0
        if held:
            yield gather(held)

    return run


def _anchor_blobs(width: int, layout: _Layout):
    def flush(held) -> Iterator[pd.DataFrame]:
        h, d, p = (np.concatenate(x) for x in zip(*held))
        h &= layout.mask
        order = np.argsort(h, kind="stable")
        hs, ds = h[order], d[order]
        fresh = np.r_[True, hs[1:] != hs[:-1]]
        first = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        # Hashes that two documents of this flush share are known to be shared; one member stands for them, the rest needs no grouping.
        mixed = np.maximum.reduceat(ds, first) != np.minimum.reduceat(ds, first) if len(ds) else np.zeros(0, bool)
        known_sorted = mixed[group] & ~fresh
        stands_sorted = mixed[group] & fresh
        known, stands = np.zeros(len(h), bool), np.zeros(len(h), bool)
        known[order], stands[order] = known_sorted, stands_sorted
        yield _split(layout, h, d, p, known, stands, layout.together)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            for a in _anchors(pdf.id.tolist(), pdf.text.tolist(), width):
                held.append(a)
                n += len(a[0])
                if n >= FLUSH:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _docs(blob: bytes) -> np.ndarray:
    z = _unpress(blob, 8)
    return np.cumsum((z >> np.uint64(1)).astype(np.int64) ^ -(z & np.uint64(1)).astype(np.int64))


def _by_doc(d: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct documents and what belongs to each."""
    order = np.lexsort((x, d))
    d, x = d[order], x[order]
    edges = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.zeros(0, np.int64)
    return d[edges], np.split(x, edges[1:]) if len(d) else []


_FOUND = "id long, spots array<long>, hashes array<long>"


def _shared_anchors(layout: _Layout):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of the partition's anchors those that lie in at least two documents: by place where that came along, else by hash."""
        known, rest = pdf[pdf.known], pdf[~pdf.known]
        out = []
        if len(known):
            ids, spots = _by_doc(np.concatenate([_docs(b) for b in known.docs]), np.concatenate([_unpress(b, 8).astype(np.int64) for b in known.spots]))
            out.append((ids, spots, [[]] * len(ids)))
        if len(rest):
            d = np.concatenate([_docs(b) for b in rest.docs])
            x = np.concatenate([_unpress(b, layout.width) for b in rest.hashes])
            top = np.uint64(1 << layout.flag)
            sure, h = (x & top) != 0, x & ~top
            order = np.argsort(h, kind="stable")
            hs, ds = h[order], d[order]
            fresh = np.r_[True, hs[1:] != hs[:-1]]
            first, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
            # A hash may also repeat in other documents of a flush, where only its stand-in came along.
            shared = (np.maximum.reduceat(ds, first) != np.minimum.reduceat(ds, first)) | np.logical_or.reduceat(sure[order], first)
            keep = order[shared[group]]
            whole = h[keep] * np.uint64(layout.partitions) + np.uint64(rest.part.iloc[0])
            ids, hashes = _by_doc(d[keep], whole.view(np.int64))
            out.append((ids, [[]] * len(ids), hashes))
        return pd.concat([pd.DataFrame({"id": i, "spots": pd.Series(s, dtype=object), "hashes": pd.Series(h, dtype=object)}) for i, s, h in out])

    return run


_SPANS = "id long, span long, start long"


def _full_spans(length: int, width: int, layout: _Layout):
    def starts_of(spots: np.ndarray, n: int) -> np.ndarray:
        """Starts of all full spans that contain an anchor: the union of [spot - (length - width), spot]."""
        lo, hi = np.maximum(spots - (length - width), 0), np.minimum(spots, n - length)
        mark = np.zeros(n - length + 2, dtype=np.int64)
        ok = lo <= hi
        np.add.at(mark, lo[ok], 1)
        np.add.at(mark, hi[ok] + 1, -1)
        return np.flatnonzero(np.cumsum(mark[:-1]) > 0)

    def places(pdf: pd.DataFrame) -> list[np.ndarray]:
        """The places of each text's shared anchors; those known by hash are found by hashing its anchors again."""
        asked = [np.asarray(x, dtype=np.int64) for x in pdf.hashes]
        wanted = np.unique(_mix(np.concatenate(asked).view(np.uint64) ^ _mix(np.repeat(np.arange(len(asked), dtype=np.uint64), [len(x) for x in asked]))))
        found = [[np.asarray(x, dtype=np.int64)] for x in pdf.spots]
        some = [k for k, x in enumerate(asked) if len(x)]
        for h, k, p in _anchors(some, [pdf.text.iloc[k] for k in some], width):
            hit = np.isin(_mix((h & layout.mask) ^ _mix(k.astype(np.uint64))), wanted)
            ids, at = _by_doc(k[hit], p[hit])
            for i, x in zip(ids, at):
                found[i].append(x)
        return [np.unique(np.concatenate(x)) for x in found]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            for doc, text, spots in zip(pdf.id, pdf.text, places(pdf)):
                if len(text) < length:
                    continue
                at = starts_of(spots, len(text))
                chars = code_points(text)
                for k in range(0, len(at), SEGMENT):  # long texts in parts
                    some = at[k : k + SEGMENT]
                    for a in np.split(some, np.flatnonzero(np.diff(some) > SEGMENT) + 1):
                        if len(a):
                            held.append((np.full(len(a), doc), window_hashes(chars[a[0] : a[-1] + length], length, a - a[0]).view(np.int64), a))
                            n += len(a)
                if n >= SPAN_ROWS:
                    yield pd.DataFrame(dict(zip(("id", "span", "start"), map(np.concatenate, zip(*held)))))
                    held, n = [], 0
        if held:
            yield pd.DataFrame(dict(zip(("id", "span", "start"), map(np.concatenate, zip(*held)))))

    return run


def _with_ids(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` whose id occurs in ``wanted``, where these are few enough to be sent to all; else all."""
    if wanted.agg(F.approx_count_distinct("id")).first()[0] > BROADCAST_IDS:
        return docs
    return docs.join(F.broadcast(wanted.select("id").distinct()), "id", "left_semi")


def candidate_spans(docs: DataFrame, *, key: str, text: str, length: int) -> DataFrame:
    """(id, span, start): hashes of all full spans that hold an anchor found in another record as well, partitioned by hash."""
    width = length - PERIOD + 1
    if width < 1:
        raise ValueError(f"spans must be longer than {PERIOD} characters")
    d = docs.where(F.length(text) >= length).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    chars = d.agg(F.sum(F.length("text"))).first()[0] or 0
    layout = _Layout(int(chars * len(COVER) / PERIOD))
    blobs = d.mapInPandas(_anchor_blobs(width, layout), _BLOBS)
    if layout.together > 1:
        spread = F.pmod(F.xxhash64("hashes", "docs"), F.lit(STEP_TASKS))
        blobs = blobs.repartition(FLUSH_PARTS * STEP_TASKS, "part", spread).mapInPandas(_second_step(layout), _BLOBS)
    # The number of tasks grows with the data, whatever the session's default is.
    blobs = blobs.repartition(min(2 * layout.partitions, MAX_TASKS), "part")
    shared = cut(blobs.groupBy("part").applyInPandas(_shared_anchors(layout), _FOUND), "anchors")
    both = shared.groupBy("id").agg(F.flatten(F.collect_list("spots")).alias("spots"), F.flatten(F.collect_list("hashes")).alias("hashes"))
    n_anchors = shared.agg(F.coalesce(F.sum(F.size("spots") + F.size("hashes")), F.lit(0))).first()[0]
    spans = _with_ids(d, shared).join(both, "id").mapInPandas(_full_spans(length, width, layout), _SPANS).where("span is not null and id is not null")
    # As many partitions as the spans around the shared anchors fill.
    return spans.repartition(min(max(4, n_anchors * PERIOD // len(COVER) // PARTITION_SPANS + 1), MAX_TASKS), "span")


def _groups(docs: DataFrame, *, key: str, text: str, length: int) -> DataFrame:
    """(span, id, passage): the members of one span for each set of records that share one, with the passage itself."""
    s = candidate_spans(docs, key=key, text=text, length=length).groupBy("span", "id").agg(F.min("start").alias("start"))
    sets = s.groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"), F.min("start").alias("z")).where("n > 1")
    first = sets.groupBy("n", "x", "y").agg(F.min("span").alias("span"), F.min("z").alias("z")).select("span", "z")
    # The second condition always holds; by it both sides read all columns of unfiltered rows, and so the same shuffle.
    members = cut(s.join(first, "span").where("start >= z").select("span", "id", "start"), "members")
    texts = _with_ids(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("__text")), members)
    return cut(members.join(texts, "id").select("span", "id", F.substring("__text", F.col("start").cast("int") + 1, F.lit(length)).alias("passage")).distinct(), "groups")


def span_pairs(docs: DataFrame, *, key: str, text: str, length: int) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b, of all records that share a span of at least ``length`` characters.

    Characters are code points, nothing is normalised. Null, empty and shorter texts share nothing; a span that
    repeats within one record only is not shared; rows repeated with one key are one record. Spans with the
    same set of records stand for one another, so a pair is not listed once per character of what it shares.
    The result lists pairs and grows with the square of a group that shares one passage; nothing before does.
    """
    s = _groups(docs, key=key, text=text, length=length)
    a, b = s.withColumnRenamed("id", "doc_a"), s.withColumnRenamed("id", "doc_b")
    return a.join(b, ["span", "passage"]).where("doc_a < doc_b").select("doc_a", "doc_b").distinct()


def span_groups(docs: DataFrame, *, key: str, text: str, length: int) -> DataFrame:
    """(group_id, doc_id, n_docs, passage): each set of records that share a span, by one span and its passage.

    The linear form of ``span_pairs``: two records are a pair if and only if they are in one group. ``group_id`` is the
    least record of the group; groups may overlap, and two may have the same least record but other passages.
    """
    s = _groups(docs, key=key, text=text, length=length)
    g = s.groupBy("span", "passage").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n_docs")).where("n_docs > 1")
    return s.join(g, ["span", "passage"]).select("group_id", F.col("id").alias("doc_id"), "n_docs", "passage")


def shared_share(docs: DataFrame, *, key: str, text: str, length: int) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share) of every record; what a shared span covers counts once.

    Null and empty texts have share 0. Rows repeated with one key are one record (the longest text's length).
    """
    same = Window.partitionBy("span")
    s = candidate_spans(docs, key=key, text=text, length=length).withColumns({"a": F.min("id").over(same), "b": F.max("id").over(same)})
    s = s.where("a < b").select("id", "start").distinct()
    after = F.lead("start").over(Window.partitionBy("id").orderBy("start"))
    covered = s.withColumn("c", F.least(F.coalesce(after - F.col("start"), F.lit(length)), F.lit(length))).groupBy("id").agg(F.sum("c").alias("shared_chars"))
    sizes = docs.groupBy(F.col(key).cast("long").alias("id")).agg(F.max(F.coalesce(F.length(text), F.lit(0))).alias("n_chars"))
    n = F.coalesce("shared_chars", F.lit(0))
    return sizes.join(covered, "id", "left").select(F.col("id").alias("doc_id"), "n_chars", n.alias("shared_chars"), F.when(F.col("n_chars") > 0, n / F.col("n_chars")).otherwise(0.0).alias("shared_share"))
