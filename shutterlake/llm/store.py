"""A fingerprint store that grows batch by batch, in segments with their own Bloom filters.

A segment is written once: its entries as Parquet, laid out in hash partitions of their look-up key, and one
Bloom filter a partition. The number of partitions follows from the segment's size and is kept with it, so a
partition is as small in a long history as in a short one and a store opens alike under any setting. Segments
of similar size are merged when there are ``FANOUT`` of them, so there are few and an entry is
rewritten a logarithmic number of times. A manifest names the living segments; it is created exclusively
under the next number, for entries and filters at once, so of two writers one fails and a lost run leaves the old state.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries a partition is sized for, filter bits a key, bits set a key, and segments of one size that are merged.
PARTITION_ENTRIES, BITS_PER_KEY, HASHES, FANOUT = 50_000, 16, 6, 4
#: Keys one task asks one filter about.
PROBE_KEYS = 500_000

#: ``c1`` and ``c2`` are a digest of the content; the text itself is not kept.
ENTRY = "key bigint, prints array<bigint>, c1 bigint, c2 bigint, size bigint, id bigint, run bigint"
COLUMNS = [c.split()[0] for c in ENTRY.split(", ")]
_FILTER = "part int, bits binary"


def _slots(keys: np.ndarray, n_bits: int) -> np.ndarray:
    """Places of each key's bits, by double hashing; ``n_bits`` is a power of two."""
    h = keys.astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    step = (h >> np.uint64(33)) | np.uint64(1)
    return ((h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(n_bits - 1)).astype(np.int64)


def build_filter(keys: np.ndarray) -> bytes:
    n_bits = 1 << max(10, int(len(keys) * BITS_PER_KEY - 1).bit_length())
    bits = np.zeros(n_bits, dtype=bool)
    bits[_slots(keys, n_bits).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(bits: bytes, keys: np.ndarray) -> np.ndarray:
    b = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).view(bool)
    return b[_slots(keys, len(b))].all(axis=1)


def _filter_of(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"part": [pdf.part.iloc[0]], "bits": [build_filter(pdf.key.to_numpy())]})


def _positives(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if keys.empty or filters.empty:
        return pd.DataFrame({"segment": pd.Series(dtype=str), "part": pd.Series(dtype="int32"), "n": pd.Series(dtype="int64")})
    hit = int(may_hold(filters.bits.iloc[0], keys.key.to_numpy()).sum())
    return pd.DataFrame({"segment": [filters.segment.iloc[0]], "part": [filters.part.iloc[0]], "n": [hit]})


class FingerprintStore:
    """Entries below ``path``. ``settings`` must be the same whenever one store is opened; others raise."""

    def __init__(self, spark: SparkSession, path: str, settings: dict):
        self.spark, self.path = spark, path.rstrip("/")
        self._manifest = self._latest() or {"no": 0, "settings": settings, "segments": [], "retired": [], "extra": None}
        if self._manifest["settings"] != settings:
            raise ValueError(f"the store was made with {self._manifest['settings']}, not {settings}")

    # ----- manifest

    def _fs(self, name: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _numbers(self) -> list[int]:
        fs, where = self._fs("_manifest")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(where)) if fs.exists(where) else []

    def _latest(self) -> dict | None:
        """The last manifest that was written whole."""
        for no in reversed(self._numbers()):
            fs, where = self._fs(f"_manifest/{no:09d}")
            stream = fs.open(where)
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            try:
                return json.loads(text)
            except json.JSONDecodeError:
                continue
        return None

    def _commit(self, segments: list[dict], retired: list[str], extra=None) -> None:
        last = self._manifest
        if (self._latest() or last)["no"] != last["no"]:
            raise RuntimeError("another writer has changed the store")
        no = max([last["no"], *self._numbers()]) + 1
        new = {"no": no, "settings": last["settings"], "segments": segments, "retired": retired, "extra": extra if extra is not None else last["extra"]}
        fs, where = self._fs(f"_manifest/{no:09d}")
        out = fs.create(where, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        self._manifest = new
        # What the manifest before gave up is read by nobody who opens the store from now on.
        for name in last["retired"]:
            f, p = self._fs(name)
            f.delete(p, True)
        for old in self._numbers():
            if old < no - 1:
                f, p = self._fs(f"_manifest/{old:09d}")
                f.delete(p, False)

    @property
    def segments(self) -> list[dict]:
        return self._manifest["segments"]

    @property
    def extra(self):
        """What the first writer noted for all later ones."""
        return self._manifest["extra"]

    # ----- writing

    def _write(self, entries: DataFrame, n: int) -> dict:
        parts = 1 << max(0, (max(1, n) - 1) // PARTITION_ENTRIES).bit_length()
        name = f"segment-{uuid.uuid4().hex}"
        placed = entries.select(*COLUMNS, F.col("key").bitwiseAND(parts - 1).cast("int").alias("part"))
        # Rebalancing splits a partition that one content fills over several tasks.
        placed.hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.path}/{name}/rows")
        keys = self.spark.read.schema(f"{ENTRY}, part int").parquet(f"{self.path}/{name}/rows").select("part", "key").distinct()
        keys.groupBy("part").applyInPandas(_filter_of, _FILTER).write.parquet(f"{self.path}/{name}/filters")
        return {"name": name, "parts": parts, "entries": n}

    def append(self, entries: DataFrame, n: int, extra=None) -> None:
        """Take in ``n`` entries as a segment, and merge segments of its size if there are enough of them."""
        if not n:
            if extra is not None:
                self._commit(self.segments, [], extra)
            return
        self._commit([*self.segments, self._write(entries, n)], [], extra)
        while True:
            tiers: dict[int, list[dict]] = {}
            for s in self.segments:
                tiers.setdefault(_tier(s["entries"]), []).append(s)
            full = next((t for _, t in sorted(tiers.items()) if len(t) >= FANOUT), None)
            if full is None:
                return
            both = self.read({s["name"]: None for s in full})
            merged = self._write(both, sum(s["entries"] for s in full))
            gone = [s["name"] for s in full]
            self._commit([s for s in self.segments if s["name"] not in gone] + [merged], gone)

    # ----- reading

    def read(self, chosen: dict[str, list[int] | None]) -> DataFrame | None:
        """Entries of the chosen segments, of the listed partitions only (None: of all)."""
        out = None
        for name, parts in chosen.items():
            base = f"{self.path}/{name}/rows"
            paths = [base] if parts is None else [f"{base}/part={p}" for p in parts]
            if paths:
                rows = self.spark.read.schema(ENTRY).option("basePath", base).parquet(*paths).select(*COLUMNS)
                out = rows if out is None else out.unionByName(rows)
        return out

    def positives(self, keys: DataFrame, n: int) -> dict[str, list[int]]:
        """The partitions of each segment whose filter may hold one of ``n`` distinct keys.

        The driver sees numbers of partitions, one for 50,000 entries. Many keys to one filter are split over copies of it.
        """
        asked, filters = None, None
        for s in self.segments:
            salts = max(1, -(-n // (s["parts"] * PROBE_KEYS)))
            k = keys.select(F.lit(s["name"]).alias("segment"), F.col("key").bitwiseAND(s["parts"] - 1).cast("int").alias("part"), F.pmod(F.shiftright("key", 40), F.lit(salts)).alias("salt"), "key")
            f = self.spark.read.schema(_FILTER).parquet(f"{self.path}/{s['name']}/filters")
            f = f.select(F.lit(s["name"]).alias("segment"), "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), "bits")
            asked, filters = (k, f) if asked is None else (asked.unionByName(k), filters.unionByName(f))
        if asked is None:
            return {}
        by = ["segment", "part", "salt"]
        hits = asked.groupBy(*by).cogroup(filters.groupBy(*by)).applyInPandas(_positives, "segment string, part int, n long")
        found: dict[str, list[int]] = {}
        for r in hits.where("n > 0").select("segment", "part").distinct().collect():
            found.setdefault(r.segment, []).append(r.part)
        return {name: sorted(p) for name, p in found.items()}


def _tier(entries: int) -> int:
    """0 up to a partition's worth of entries, then one more each time the size grows by ``FANOUT``."""
    t, top = 0, PARTITION_ENTRIES
    while entries > top:
        t, top = t + 1, top * FANOUT
    return t
