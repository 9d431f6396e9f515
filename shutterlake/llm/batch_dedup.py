"""Problem 4: new batches checked for duplicates and near-duplicates against everything accepted before.

A record is described by contents: short texts that say what it is (here the file's identity, and its name
without letter case, Unicode form and copy marks). Winnowing reduces a content to fingerprints. A look-up key
combines several fingerprints of one content, chosen so that any two contents with the wanted coverage (shared
fingerprints over all of both) have a key in common. Partitioned Bloom filters tell which keys of a batch the
history may hold; only their partitions of the fingerprint store are read, joined by key, and
coverage is verified. The batch's own entries are looked up in the same join, as the newest segment. Then store and filters take in
what is new. The history's records are never read again.
"""

from __future__ import annotations

import itertools
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.llm.store import COLUMNS, FingerprintStore
from shutterlake.operators.ranges import range_extremes
from shutterlake.operators.snapshots import usable_identity
from shutterlake.session import cut, discard, drop_at_exit, prepare, shared_dir

#: Characters in a shingle of a content, and shingles in a winnowing window.
GRAM, WINDOW = 5, 4
#: Fingerprints a key combines where the coverage wanted is below 1.
COMBINED = 2
#: A fingerprint that more than one in so many contents of the first batch have is common, and chosen for keys last.
COMMON_SHARE = 1000
#: Coverage from which names count as near-duplicates: one edit in a name of 20 characters leaves about two thirds.
NEAR_COVERAGE = 0.6

# What operating systems and cameras add to the name of a copy, by place.
COPY_WORDS = "copy|kopie|copie|copia|cópia|kopia|kopi|kopio|kópia|másolat|копия|副本|复件|コピー|복사본"
_SUFFIX = re.compile(rf"(?:\s*\(\d+\)|~\d+|(?:\s+-\s*|[ _-])(?:{COPY_WORDS})(?:[ _]?\d+)?|\s*\((?:\w+ )?(?:{COPY_WORDS})(?: \d+)?\)|\s*的?副本(?:\s*\d+)?)$")
_PREFIX = re.compile(r"^(?:copy(?: \(\d+\))? of|kopie von|copie de|copia de) ")


def name_content(path: str | None) -> str | None:
    """The last segment of a path apart from letter case, Unicode form and copy marks; null for none."""
    if path is None:
        return None
    name = path.replace("\\", "/").rstrip("/").rpartition("/")[2]
    name = name.lower() if name.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", name).casefold())
    stem, dot, ext = name.rpartition(".")
    if not stem:
        stem, dot, ext = name, "", ""
    while True:
        less = _PREFIX.sub("", _SUFFIX.sub("", stem))
        if less == stem or not less.strip():
            break
        stem = less
    return stem.strip() + dot + ext or None


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(texts: list[str], whole: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(owner, print): the distinct winnowed fingerprints of each text, sorted within it; a text marked ``whole`` has one.

    Of each window of consecutive shingle hashes the least is a fingerprint. Texts shorter than a shingle are filled up with zeros.
    """
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    chars = np.frombuffer("".join(t.ljust(gram, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    room = np.maximum(lengths, gram)
    starts = np.concatenate([[0], np.cumsum(room)])[:-1]
    grams = room - gram + 1
    owner = np.repeat(np.arange(len(texts)), grams)
    nth = np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)
    at = starts[owner] + nth
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(gram):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + chars[at + k] + np.uint64(1))
    # The union of all shingles of a text marked whole.
    sums = np.add.reduceat(_mix(h + nth.astype(np.uint64)), np.cumsum(grams) - grams) if len(at) else h
    least = h.copy()
    for k in range(1, window):
        inside = np.flatnonzero(nth + k < grams[owner])
        least[inside] = np.minimum(least[inside], h[inside + k])
    opens = nth <= np.maximum(grams[owner] - window, 0)
    least[whole[owner]] = sums[owner[whole[owner]]]
    prints, owner = (least[opens] >> np.uint64(1)).astype(np.int64), owner[opens]
    order = np.lexsort((prints, owner))
    prints, owner = prints[order], owner[order]
    fresh = np.r_[True, (prints[1:] != prints[:-1]) | (owner[1:] != owner[:-1])] if len(prints) else np.zeros(0, bool)
    return owner[fresh], prints[fresh]


def winnow(content: str) -> list[int]:
    """Sorted distinct fingerprints of one content."""
    return fingerprints([content], np.zeros(1, bool))[1].tolist()


def keys_of(prints: list[np.ndarray], space: np.ndarray, coverage: float, common: np.ndarray) -> list[np.ndarray]:
    """The look-up keys of each content from its sorted distinct fingerprints, in its space (scope and kind).

    Two sets of n and m fingerprints with the coverage share at least o = ceil(coverage * max(n, m)). In one order of
    all fingerprints (rare ones first) their first n - o + l and m - o + l then share at least l, so the combinations of l
    of these are keys that meet. With coverage 1 all fingerprints are one key.
    """
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(prints)
    sizes = np.array([len(p) for p in prints])
    for n in np.unique(sizes):
        i = np.flatnonzero(sizes == n)
        p = np.stack([prints[k] for k in i])
        need = n if coverage >= 1 else int(np.ceil(coverage * n - 1e-9))
        l = n if coverage >= 1 else min(need, COMBINED)
        if coverage < 1:
            rare = np.argsort(np.isin(p, common), axis=1, kind="stable")
            p = np.take_along_axis(p, rare, axis=1)[:, : n - need + l]
        picks = np.array(list(itertools.combinations(range(p.shape[1]), l)))
        keys = _mix(_mix(p.astype(np.uint64))[:, picks].sum(axis=2, dtype=np.uint64) + space[i].astype(np.uint64)[:, None]).view(np.int64)
        for k, row in zip(i, keys):
            out[k] = np.unique(row)
    return out


@F.pandas_udf(T.StringType())
def _names(s: pd.Series) -> pd.Series:
    return s.map(name_content, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _prints(kind: pd.Series, content: pd.Series) -> pd.Series:
    """Fingerprints of a name are winnowed; an identity is opaque and has one."""
    owner, prints = fingerprints(content.tolist(), (kind != "name").to_numpy())
    return pd.Series(np.split(prints, np.flatnonzero(np.diff(owner)) + 1) if len(owner) else [], dtype=object)


def _keys(coverage: float, common: np.ndarray):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(prints: pd.Series, space: pd.Series) -> pd.Series:
        return pd.Series(keys_of([np.asarray(p, dtype=np.int64) for p in prints], space.to_numpy(), coverage, common), dtype=object)

    return run


def register_contents(ops: DataFrame) -> DataFrame:
    """(id, run, size, space, c1, c2, prints): up to two contents of each operation of known size, by digest and fingerprints.

    The digest (128 bits) is that of library, kind and content; ``space`` is that of library and kind.
    """
    o = ops.where("size_bytes >= 0 and repository_id is not null and run_id is not null").select(
        F.col("register_id").alias("id"), F.col("run_id").alias("run"), F.col("repository_id").alias("scope"), F.col("size_bytes").cast("long").alias("size"), _names("source_path").alias("name"),
        F.when(usable_identity(F.col("source_volume_serial"), F.col("source_file_id")), F.concat_ws(":", F.col("source_volume_serial").cast("string"), F.hex("source_file_id"))).alias("identity"),
    )
    kinds = F.explode(F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(k).alias("content"))) for k in ("name", "identity")])))
    o, what = o.select("id", "run", "scope", "size", kinds.alias("k")).select("id", "run", "scope", "size", "k.*"), ["scope", "kind", "content"]
    return o.select("id", "run", "size", F.xxhash64("scope", "kind").alias("space"), F.xxhash64(*what).alias("c1"), F.xxhash64(F.lit(1), *what).alias("c2"), _prints("kind", "content").alias("prints"))


def _size_block(size):
    """Blocks of sizes: one size each up to 2,047, then a quarter of a percent."""
    small = 2048
    return F.when(size < small, size).otherwise(F.lit(small) + F.floor(F.log(size.cast("double") / F.lit(float(small))) / F.lit(float(np.log1p(0.0025))))).cast("long")


class BatchDeduplicator:
    """Accepted operations of all batches so far, as a fingerprint store with its Bloom filters below ``path``.

    ``check(batch)`` gives (first_id, dup_id): operations of the batch for which an earlier run of the same
    library registered the same source file, with the first such registration: their sizes differ by at
    most ``1 - nearness`` of the larger and a content of one kind is equal (coverage 1 and the same digest). ``near()`` gives
    (first_id, dup_id, coverage): pairs of different names of one library with at least ``coverage`` and
    sizes as near, by the first registration of each name and size (its class); it needs a ``coverage`` below 1.
    ``accept()`` takes in what the history lacks; ``release()`` gives up what the batch left in the shared folder.

    A batch may hold several runs; ids must ascend with runs. Rows with a null or negative size, library or run
    match nothing; null or empty paths and unusable identities are no contents. Repeated rows count once. A store
    remembers its settings; opening it with others raises. Hot contents are one entry a size before
    anything is sorted, and sizes are matched without listing pairs.
    """

    def __init__(self, spark: SparkSession, path: str, coverage: float = 1.0, nearness: tuple[int, int] = (995, 1000)):
        prepare(spark)
        self.spark, self.nearness, self.coverage = spark, nearness, coverage
        self.store = FingerprintStore(spark, path, {"gram": GRAM, "window": WINDOW, "combined": COMBINED, "coverage": coverage})
        self._held: list[str] = []

    def _common(self, prints: DataFrame) -> np.ndarray:
        """Fingerprints that are frequent in the first batch: at most ``COMMON_SHARE`` times the mean number a content has. They order, they decide nothing."""
        if self.coverage >= 1:
            return np.zeros(0, np.int64)
        if self.store.extra is None:
            least = max(2, prints.count() // COMMON_SHARE)
            often = prints.select(F.explode("prints").alias("p")).groupBy("p").count().where(F.col("count") > least)
            self._extra = sorted(r.p for r in often.collect())
        else:
            self._extra = self.store.extra
        return np.array(self._extra, dtype=np.int64)

    def check(self, batch: DataFrame) -> DataFrame:
        self.release()
        held, who = self._held, ["c1", "c2"]
        rows = cut(register_contents(batch), "contents", held)
        keys = _keys(self.coverage, self._common(rows))("prints", "space")
        # One row a content and size, before anything is sorted. Ids ascend with runs, so the least of both belong together.
        classes = rows.groupBy(*who, "prints", "space", "size").agg(F.min("id").alias("id"), F.min("run").alias("run"))
        self._entries = entries = cut(classes.select(F.explode(keys).alias("key"), *COLUMNS[1:]), "entries", held)
        asked = entries.select("key").distinct()
        known = self.store.read(self.store.positives(asked, rows.count()) if self.store.segments else {})
        self._looked = pool = entries.withColumn("old", F.lit(False))
        if known is not None:
            self._looked = entries.withColumn("old", F.lit(False)).unionByName(known.withColumn("old", F.lit(True)))
            # Coverage 1 is equality of the sorted sets of fingerprints; the digest decides what they leave open.
            same = ["key", "prints", *who]
            pool = pool.unionByName(known.join(entries.select(*same).distinct(), same, "left_semi").withColumn("old", F.lit(True)))
        self._pool = pool = cut(pool.groupBy(*who, "prints", "size").agg(F.min("id").alias("id"), F.min("run").alias("run"), F.max("old").alias("old"), F.max(~F.col("old")).alias("own")), "pool", held)
        pool = pool.select(*who, "size", F.struct("id", "run").alias("first"), "own")
        crowd = pool.groupBy(*who).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*who)
        points = cut(pool.join(crowd, who, "left_semi").select(*who, F.col("size").alias("at"), "first", "own"), "points", held)
        lo, hi = self.nearness
        near = range_extremes(
            points, points.where("own"), group=who, at="at", lo=F.expr(f"(at * {lo} + {hi - 1}) div {hi}"), hi=F.expr(f"(at * {hi}) div {lo}"), block=_size_block, least=["first"], most=[]
        )
        nearest = pool.where("own").withColumnRenamed("size", "at").join(near, [*who, "at"], "left").select(*who, F.col("at").alias("size"), F.coalesce("least_first", "first").alias("first"))
        matched = rows.select("id", "run", *who, "size").join(nearest, [*who, "size"]).where("first.run < run")
        return matched.groupBy(F.col("id").alias("dup_id")).agg(F.min("first.id").alias("first_id")).select("first_id", "dup_id")

    def near(self) -> DataFrame:
        """Near-duplicates of the batch last checked; each pair of classes is listed with the batch that brings the later one."""
        if self.coverage >= 1:
            raise ValueError("a coverage of 1 has no near-duplicates")
        lo, hi = self.nearness
        fresh = self._fresh().select("key", *[F.col(c).alias(f"o_{c}") for c in COLUMNS if c != "key"])
        a, b = F.col("size"), F.col("o_size")
        close = F.least(a, b) * hi >= F.greatest(a, b) * lo
        other = (F.col("run") < F.col("o_run")) & ((F.col("c1") != F.col("o_c1")) | (F.col("c2") != F.col("o_c2")))
        pairs = self._looked.join(fresh, "key").where(other & close)
        pairs = pairs.select(F.col("id").alias("first_id"), F.col("o_id").alias("dup_id"), F.round(_covered("prints", "o_prints"), 6).alias("coverage"))
        return pairs.where(F.col("coverage") >= self.coverage).distinct()

    def _fresh(self) -> DataFrame:
        """Entries of the batch that the history lacks."""
        return self._entries.join(self._pool.where("not old").select("c1", "c2", "size"), ["c1", "c2", "size"], "left_semi").select(*COLUMNS)

    def accept(self) -> None:
        """Take what is new of the batch last checked into store and filters."""
        fresh = self._fresh()
        if self.coverage >= 1:
            n = self._pool.where("not old").count()  # one key a content
        else:
            fresh = cut(fresh, "fresh", self._held)
            n = fresh.count()
        self.store.append(fresh, n, self._extra if self.coverage < 1 and self.store.extra is None else None)

    def release(self) -> None:
        """Give up the batch's intermediate tables; what ``check`` and ``near`` returned must have been read."""
        discard(self.spark, self._held)


def _covered(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def replay(ops: DataFrame, batches: int = 3, path: str | None = None, coverage: float = 1.0) -> DataFrame:
    """``check`` (with a ``coverage`` below 1: ``near``) and ``accept`` over the whole table in ``batches`` parts by run: the result of every run."""
    spark, own = ops.sparkSession, path is None
    span = ops.agg(F.min("run_id"), F.max("run_id")).first()
    if span[0] is None:
        return spark.createDataFrame([], "first_id long, dup_id long" + ("" if coverage >= 1 else ", coverage double"))
    path = path or shared_dir(spark, "registers")
    d = BatchDeduplicator(spark, path, coverage)
    cuts = [span[0] + (span[1] + 1 - span[0]) * i // batches for i in range(batches + 1)]
    found = None
    for lo, hi in zip(cuts, cuts[1:]):
        if lo < hi:
            dups = d.check(ops.where((F.col("run_id") >= lo) & (F.col("run_id") < hi)))
            part = cut(dups if coverage >= 1 else d.near(), "dups")
            d.accept()
            d.release()
            found = part if found is None else found.unionByName(part)
    if own:
        drop_at_exit(spark, path)
    return found
