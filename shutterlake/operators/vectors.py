"""Scoring of all vectors against a stated set of concepts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.session import cut

#: Concepts sent to all executors at a time.
MAX_CONCEPTS = 4096


def _unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length over their norms, and which of them have a norm that is positive and finite."""
    v = np.array(vectors, dtype=float)
    with np.errstate(all="ignore"):
        n = np.sqrt((v * v).sum(axis=1))
        ok = (n > 0) & np.isfinite(n)
        return np.where(ok[:, None], v / n[:, None], 0.0), ok


def similarities(vectors: list, concepts: list) -> np.ndarray:
    """Cosines of vectors (rows) and concepts (columns); nan for other lengths, zero norms, values that are not finite, and nulls."""
    out = np.full((len(vectors), len(concepts)), np.nan)
    by_length: dict[int, tuple[list[int], list[int]]] = {}
    for side, xs in enumerate((vectors, concepts)):
        for i, x in enumerate(xs):
            if x is not None and len(x):
                by_length.setdefault(len(x), ([], []))[side].append(i)
    for rows, columns in by_length.values():
        if rows and columns:
            (a, a_ok), (b, b_ok) = _unit([vectors[i] for i in rows]), _unit([concepts[i] for i in columns])
            out[np.ix_(rows, columns)] = np.where(a_ok[:, None] & b_ok[None, :], np.clip(a @ b.T, -1.0, 1.0), np.nan)
    return out


def _scorer(spark, positive: list, negative: list):
    """A UDF from a vector to its scores: half the difference of the similarities, the plain one where a concept has no negative. One matrix product a batch."""
    sent = spark.sparkContext.broadcast((positive, negative))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(vectors: pd.Series) -> pd.Series:
        p, n = sent.value
        plain, has = similarities(vectors.tolist(), p), np.array([x is not None for x in n], dtype=bool)
        if has.any():
            plain[:, has] = np.clip((plain[:, has] - similarities(vectors.tolist(), [x for x in n if x is not None])) / 2, -1.0, 1.0)
        return pd.Series([[None if np.isnan(x) else float(x) for x in row] for row in plain], dtype=object)

    return run


def _blocks(concepts: DataFrame) -> list[tuple[list[str], object]]:
    """(names, scorer) of the concepts, at most about ``MAX_CONCEPTS`` at a time, by name; the driver sees one block."""
    c = cut(concepts.select("concept", "positive", "negative"), "concepts")
    n = -(-c.count() // MAX_CONCEPTS)
    out = []
    for b in range(n):
        rows = sorted(c.where(F.pmod(F.xxhash64("concept"), F.lit(n)) == b).collect(), key=lambda r: r.concept)
        if rows:
            out.append(([r.concept for r in rows], _scorer(concepts.sparkSession, [r.positive for r in rows], [r.negative for r in rows])))
    return out


def _named(names: list[str], scores: Column) -> Column:
    return F.zip_with(F.array(*map(F.lit, names)), scores, lambda c, s: F.struct((-s).alias("neg"), c.alias("concept")))


def concept_scores(vectors: DataFrame, concepts: DataFrame, *, key: str, vector: str) -> DataFrame:
    """(key, concept, score) for each vector and concept (concept, positive, negative).

    Concepts are sent to all executors in blocks of ``MAX_CONCEPTS``, so vectors aren't shuffled. Vectors that
    can't be scored (another length, zero or not finite, null) give null.
    """
    out = None
    for names, score in _blocks(concepts):
        s = vectors.select(key, F.explode(_named(names, score(F.col(vector)))).alias("c")).select(key, "c.concept", (-F.col("c.neg")).alias("score"))
        out = s if out is None else out.unionByName(s)
    return vectors.sparkSession.createDataFrame([], f"{key} {dict(vectors.dtypes)[key]}, concept string, score double") if out is None else out


def top_concepts(vectors: DataFrame, concepts: DataFrame, k: int, *, key: str, vector: str) -> DataFrame:
    """(key, rank, concept, score): the ``k`` best concepts of each vector; ties go to the smaller concept.

    All scores of a vector are made and sorted within its row, so neither vectors nor scores are shuffled. Concepts beyond
    ``MAX_CONCEPTS`` are taken in blocks, of which each vector keeps its ``k`` best.
    """
    best, blocks = None, _blocks(concepts)
    for names, score in blocks:
        known = F.filter(_named(names, score(F.col(vector))), lambda s: s["neg"].isNotNull())
        top = vectors.select(key, F.slice(F.array_sort(known), 1, k).alias("r"))
        best = top if best is None else best.unionByName(top)
    if best is None:
        best = vectors.select(key, F.expr("cast(array() as array<struct<neg: double, concept: string>>)").alias("r"))
    elif len(blocks) > 1:
        best = best.groupBy(key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("r"))), 1, k).alias("r"))
    s = best.select(key, F.posexplode("r").alias("rank", "r"))
    return s.select(key, (F.col("rank") + 1).alias("rank"), F.col("r.concept").alias("concept"), (-F.col("r.neg")).alias("score"))
