"""Catalogue tables on Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shutterlake.session import prepare


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of a catalogue folder: ``root/name.parquet`` (a file or a folder of parts)."""
    prepare(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")
