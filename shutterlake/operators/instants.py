"""Problem 1: readings of mixed notation, precision and zone, as one instant.

Distinct readings form a dictionary that is parsed once and kept as a table; rows get their
instant by a join. A later run parses only readings the table does not hold yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from shutterlake.functions.instants import parse_instant
from shutterlake.session import drop_at_exit, shared_dir

KEY = ["reading", "offset_text", "tz_name", "source"]
DICTIONARY = "reading string, offset_text string, tz_name string, source string, instant_ms long"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        values = [parse_instant(*(None if x is None or x != x else x for x in row)) for row in zip(*(pdf[k] for k in KEY[:3]))]
        yield pdf[KEY].assign(instant_ms=pd.array(values, dtype="Int64"))


class InstantDictionary:
    """A growing table of parsed readings below ``path``.

    ``resolve(keys)`` parses those keys the table lacks, appends them in one write and returns the
    table. A lost write leaves no committed files, so a repeated run is safe; a key that two writers
    add at once appears twice with the same instant and is reduced on reading.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(DICTIONARY).parquet(self.path)
        except AnalysisException:
            return None

    def resolve(self, keys: DataFrame) -> DataFrame:
        if KEY[3] not in keys.columns:
            keys = keys.withColumn(KEY[3], F.lit(None).cast("string"))
        known = self.read()
        if known is not None:
            same = [keys[k].eqNullSafe(known[k]) for k in KEY]
            keys = keys.join(known, same, "left_anti")
        keys.mapInPandas(_parse, DICTIONARY).write.mode("append").parquet(self.path)
        return self.read().dropDuplicates(KEY) if known is not None else self.read()


def normalise_instants(reads: DataFrame, zones: DataFrame, *, reading: str, offset: str, library: str = "repository_id", zone: str = "tz_name", source: str | None = "source", store: str | None = None) -> DataFrame:
    """``reads`` with a column ``instant_ms`` (UTC milliseconds, null for unusable readings).

    ``zones`` gives the zone of each library. A dictionary entry is a distinct reading with offset, zone and ``source`` (a column of
    ``reads``, or None); the source is kept with it but doesn't change how the text is read. Rows with a null reading keep a null instant without
    entering the dictionary; empty, blank and very long texts are unusable readings; a library
    without a (valid) zone leaves zone-less local readings null. Repeated rows stay repeated. Columns of
    ``reads`` named like the dictionary's are not touched: the work runs on columns of its own.
    An ``instant_ms`` that ``reads`` already has is replaced.
    """
    reads = reads.drop("instant_ms")
    z = zones.groupBy(F.col(library).alias("__lib")).agg(F.min(zone).alias("__zone"))
    rows = (
        reads.withColumns({"__reading": F.col(reading).cast("string"), "__offset": F.col(offset).cast("string"), "__source": F.col(source).cast("string") if source in reads.columns else F.lit(None).cast("string")})
        .join(z, F.col(library) == F.col("__lib"), "left")
        .drop("__lib")
    )
    keys = rows.where("__reading is not null").select(F.col("__reading").alias(KEY[0]), F.col("__offset").alias(KEY[1]), F.col("__zone").alias(KEY[2]), F.col("__source").alias(KEY[3])).distinct()
    spark = reads.sparkSession
    path = store or shared_dir(spark, "instants")
    book = InstantDictionary(spark, path).resolve(keys)
    if store is None:
        drop_at_exit(spark, path)
    book = book.where("instant_ms is not null").toDF("__k0", "__k1", "__k2", "__k3", "instant_ms")
    same = (F.col("__reading") == F.col("__k0")) & F.col("__offset").eqNullSafe(F.col("__k1")) & F.col("__zone").eqNullSafe(F.col("__k2")) & F.col("__source").eqNullSafe(F.col("__k3"))
    return rows.join(book, same, "left").drop("__reading", "__offset", "__zone", "__source", "__k0", "__k1", "__k2", "__k3")
