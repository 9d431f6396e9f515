"""Queries for the text problems: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shutterlake.llm.batch_dedup import NEAR_COVERAGE, replay
from shutterlake.llm.lookalikes import canonical_names, lookalike_classes, lookalike_pairs
from shutterlake.llm.mixing import deviation_report, mix, share_report
from shutterlake.llm.packing import pack_documents, packing_report
from shutterlake.llm.spans import shared_share, span_groups, span_pairs
from shutterlake.llm.tokens import token_count
from shutterlake.session import cut
from shutterlake.sources.tables import table

CAPACITY = 2048
SPAN_CHARS = 150


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return replay(table(spark, root, "registers"))


def p4_near(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of different names, by the first registration of each name and size; equal names and sizes are one class."""
    return replay(table(spark, root, "registers"), coverage=NEAR_COVERAGE)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return lookalike_pairs(table(spark, root, "tags"), key="id", name="name")


def p7_classes(spark: SparkSession, root: str) -> DataFrame:
    return lookalike_classes(table(spark, root, "tags"), key="id", name="name")


def p7_folded(spark: SparkSession, root: str) -> DataFrame:
    return canonical_names(table(spark, root, "tags")).select("id", "name_folded", "folded_changed")


def _sized(spark: SparkSession, root: str) -> DataFrame:
    return cut(table(spark, root, "documents").select("doc_id", "source", token_count("text").alias("n_tokens")), "sizes")


def p8_packed(spark: SparkSession, root: str) -> DataFrame:
    return pack_documents(_sized(spark, root), key="doc_id", tokens="n_tokens", capacity=CAPACITY)


def p8_report(spark: SparkSession, root: str) -> DataFrame:
    return packing_report(p8_packed(spark, root), CAPACITY)


def p9_mixture(spark: SparkSession, root: str) -> DataFrame:
    return mix(_sized(spark, root), table(spark, root, "mix_targets"), key="doc_id", source="source", tokens="n_tokens")


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return share_report(p9_mixture(spark, root), table(spark, root, "mix_targets"))


def p9_deviation(spark: SparkSession, root: str) -> DataFrame:
    return deviation_report(p9_mixture(spark, root), table(spark, root, "mix_targets"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return span_pairs(table(spark, root, "documents"), key="doc_id", text="text", length=SPAN_CHARS)


def p10_groups(spark: SparkSession, root: str) -> DataFrame:
    return span_groups(table(spark, root, "documents"), key="doc_id", text="text", length=SPAN_CHARS)


def p10_shares(spark: SparkSession, root: str) -> DataFrame:
    return shared_share(table(spark, root, "documents"), key="doc_id", text="text", length=SPAN_CHARS)


QUERIES = {f.__name__: f for f in (p4_found, p4_near, p7_found, p7_classes, p7_folded, p8_packed, p8_report, p9_mixture, p9_shares, p9_deviation, p10_found, p10_groups, p10_shares)}
