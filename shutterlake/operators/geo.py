"""Nearest place to each point by great-circle distance, exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.session import cut

EARTH_KM = 6371.0088
#: Places of one block; a block is sent to all executors (about 40 bytes a place).
BLOCK_PLACES = 200_000


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def _km(lat1, lon1, lat2, lon2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def nearest_place(points: DataFrame, places: DataFrame, *, key: str, lat: str, lon: str) -> DataFrame:
    """(key, place_id, km) for each point with a position; ties go to the smaller place id.

    Places are (place_id, lat, lon). They are taken in blocks of bounded size, sorted by latitude. Points are taken a batch at a
    time in the order of their latitudes, with the places around these latitudes, of which more are taken until the edge is farther than the
    best found. Points without a position and places without one are left out.
    """
    p = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(key).alias("__k"), F.col(lat).cast("double").alias("__la"), F.col(lon).cast("double").alias("__lo"))
    schema = f"__k {dict(points.dtypes)[key]}, place_id long, km double"
    spark, found = points.sparkSession, None
    good = cut(places.where("lat is not null and lon is not null").select("place_id", "lat", "lon"), "places")
    blocks = -(-good.count() // BLOCK_PLACES)
    if not blocks:
        return spark.createDataFrame([], schema.replace("__k", key))
    block_of = F.pmod(F.xxhash64("place_id"), F.lit(blocks))
    for b in range(blocks):
        table = good.where(block_of == b).select("place_id", "lat", "lon").toPandas().sort_values(["lat", "place_id"], ignore_index=True)
        sent = spark.sparkContext.broadcast((table.lat.to_numpy(), table.lon.to_numpy(), table.place_id.to_numpy()))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                ids, km = nearest(*sent.value, pdf["__la"].to_numpy(), pdf["__lo"].to_numpy())
                yield pd.DataFrame({"__k": pdf["__k"], "place_id": ids, "km": km})[: len(ids)]

        part = p.mapInPandas(run, schema)
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        found = found.groupBy("__k").agg(F.min_by("place_id", F.struct("km", "place_id")).alias("place_id"), F.min("km").alias("km"))
    return found.withColumnRenamed("__k", key)


def nearest(la: np.ndarray, lo: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray, points: int = 256, width: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """The nearest place and its distance for points (x, y); places are sorted by latitude.

    Points are taken ``points`` at a time in the order of their latitudes, with the places of these latitudes and ``width`` more on either
    side, which is doubled for those whose best is not nearer than the edge.
    """
    best_id, best = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf)
    if not len(la):
        return best_id[:0], best[:0]
    per_degree = EARTH_KM * np.pi / 180
    order = np.argsort(x, kind="stable")
    for left in np.array_split(order, -(-len(order) // points)) if len(order) else []:
        more = width
        while len(left):
            a, b = max(0, np.searchsorted(la, x[left].min()) - more), min(len(la), np.searchsorted(la, x[left].max()) + more)
            for k in range(a, b, 1 << 14):  # bounds what is held at once
                i = slice(k, min(b, k + (1 << 14)))
                km = _km(x[left][:, None], y[left][:, None], la[None, i], lo[None, i])
                least = km.min(axis=1)
                same = np.where(km == least[:, None], ids[None, i], np.iinfo(np.int64).max).min(axis=1)
                nearer = (least < best[left]) | ((least == best[left]) & (same < best_id[left]))
                best[left[nearer]], best_id[left[nearer]] = least[nearer], same[nearer]
            below = (x[left] - la[a]) * per_degree if a > 0 else np.inf
            above = (la[b - 1] - x[left]) * per_degree if b < len(la) else np.inf
            left = left[np.minimum(below, above) <= best[left] * (1 + 1e-9) + 1e-9]
            if a == 0 and b == len(la):
                break
            more *= 2
    return best_id, best
